"""The registered queries of this subpackage; each reads whole tables and uses the production parameters of its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skytable.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids of every document and of the bytes that they decode to."""
    from skytable.llm.byte_bpe import digests, read_ranks

    entries = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return digests(table(spark, folder, "documents", "doc_id", "text"), entries, public_tokenizers.PATTERN)


@register
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document by the compiled transducer."""
    from pyspark.sql import functions as F

    from skytable.llm.token_counts import count_tokens, read_vocabulary

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    counted = count_tokens(table(spark, folder, "documents", "doc_id", "text"), vocabulary)
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


@register
def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL. The labelled URL table holds the URLs that the rules decide, with their verdicts."""
    from pyspark.sql import functions as F

    from skytable.llm.url_filter import Rule, host_of, judge, path_of, rule_for, train

    rules = [Rule("net/", True), Rule("example.net/en/", False), Rule("example.com/de/", True), Rule("org/fr/", False)]
    pages = table(spark, folder, "pages", "page_id", "url")
    decided = rule_for(host_of(F.col("url")), path_of(F.col("url")), rules)
    blocking = F.array_contains(F.array(*[F.lit(r.text) for r in rules if r.block]), F.col("rule"))
    labelled = pages.select("url", decided.alias("rule")).where("rule is not null").select("url", blocking.alias("block"))
    return judge(pages, rules, train(labelled))


@register
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    from skytable.llm.quality import judge

    return judge(table(spark, folder, "documents", "doc_id", "text", "lang", "source"))


@register
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document."""
    from skytable.llm.jaccard_join import near_copies

    return near_copies(table(spark, folder, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_links")


@register
def op7_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Five nearest neighbours of every vector whose id is divisible by 50."""
    from skytable.llm.nearest import nearest

    vectors = table(spark, folder, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))


@register
def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans with the terms that reveal entities."""
    from pyspark.sql import functions as F

    from skytable.llm.sanitise import KINDS, digest_of, find, listed

    found = find(table(spark, folder, "documents", "doc_id", "text"))

    def count(kind: int):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, digest_of(F.col("base")).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@register
def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage of every document that repeats in another one."""
    from skytable.llm.chunk_dedup import repeated_passages

    return repeated_passages(table(spark, folder, "documents", "doc_id", "text"))


@register
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Topic, sampling probability and draw of every document."""
    from skytable.llm.mixing import BUDGET, LANG_TARGETS, SOURCE_TARGETS, TOPIC_TARGETS, mix

    return mix(table(spark, folder, "documents", "doc_id", "text", "lang", "source"), SOURCE_TARGETS, LANG_TARGETS, TOPIC_TARGETS, BUDGET)


@register
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of one fifth of the documents are held out."""
    from pyspark.sql import functions as F

    from skytable.llm.toxicity import sample, score, train

    docs = table(spark, folder, "documents", "doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, folder, "labels", "doc_id", "toxic").where(~held_out)
    scored = score(docs, train(*sample(docs, labels)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@register
def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Leaf, roots, proof and verification of every document; one more character is claimed for a seventh of them."""
    from pyspark.sql import functions as F

    from skytable.llm.merkle import manifest, verified

    def tampered(docs: DataFrame):
        more = (docs["n_chars"].cast("decimal(20,0)") + 1).cast("string")
        return F.crc32(docs["doc_id"].cast("string")) % 7 == 0, [docs["doc_id"], docs["source"], docs["lang"], more, docs["text"]]

    docs = table(spark, folder, "documents", "doc_id", "source", "lang", "n_chars", "text")
    return verified(manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", tampered))


@register
def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct prefix of the conversations, each rebuilt on the first turns of its twenty's first conversation."""
    from pyspark.sql import functions as F

    from skytable.llm.prefix_trie import prefix_nodes

    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    conv = F.col("conv_id")
    return prefix_nodes(rows, conv - conv % 20, F.crc32(conv.cast("string")) % 4)


@register
def op11_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that come earlier."""
    from pyspark.sql import functions as F

    from skytable.llm.suffix_dedup import remove_repeats

    cleaned = remove_repeats(table(spark, folder, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    spans = F.size("spans").cast("bigint")
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL["op10_jaccard_join"] = r"""
with recursive words as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
), grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from words
), sizes as (
  select doc_id, count(*) as n from grams group by 1
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from grams a join grams b using (g) where a.doc_id <> b.doc_id group by 1, 2
), links as (
  select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9
), reached(doc_id, member) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from reached r join links l on l.a = r.member
), counted as (
  select a as doc_id, count(*) as n from links group by 1
)
select d.doc_id, min(r.member) as class_id, coalesce(max(k.n), 0)::bigint as n_links
from documents d join reached r on r.doc_id = d.doc_id left join counted k on k.doc_id = d.doc_id group by d.doc_id
"""

# The table of CRC-32 is made from its polynomial; trees are lists of digests, level by level.
SQL["op12_merkle_manifest"] = r"""
with recursive bits(n, v, k) as (
  select n, n, 0 from (select unnest(range(256))::bigint as n) union all
  select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8
), crc as (
  select list(v order by n) as t from bits where k = 8
), given as (
  select *, row_number() over () as r from documents
), fields as (
  select r, doc_id, lang, n_chars, unnest([0, 1]) as changed, text, source from given
), leaves as (
  select r, doc_id, lang, changed, sha256(list_aggregate([case when f is null then '-' else strlen(f)::varchar || ':' || f end
    for f in [doc_id::varchar, source, lang, (n_chars + changed)::varchar, text]], 'string_agg', '')) as h from fields
), own as (
  select a.r, a.doc_id, a.lang, a.h as leaf, b.h as claimed from leaves a join leaves b using (r) where a.changed = 0 and b.changed = 1
), placed as (
  select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from own
), trees(lang, level, nodes) as (
  select lang, 0, list(leaf order by i) from placed group by lang union all
  select lang, level + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) for k in range((len(nodes) + 1) // 2)] from trees where len(nodes) > 1
), subroots as (
  select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from trees where len(nodes) = 1
), tops(level, nodes) as (
  select 0, list(subroot order by i) from subroots union all
  select level + 1, [sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')) for k in range((len(nodes) + 1) // 2)] from tops where len(nodes) > 1
), path as (
  select r, t.level, (p.i >> t.level) % 2 as odd, t.nodes[xor(p.i >> t.level, 1) + 1] as sibling
  from placed p join trees t on p.lang is not distinct from t.lang where len(t.nodes) > 1 union all
  select r, 1000 + t.level, (s.i >> t.level) % 2, t.nodes[xor(s.i >> t.level, 1) + 1]
  from placed p join subroots s on p.lang is not distinct from s.lang join tops t on len(t.nodes) > 1
), steps as (
  select r, list({'odd': odd, 'sibling': sibling} order by level) as steps, string_agg(sibling, '' order by level) as siblings from path group by r
), hit as (
  select p.*, s.steps, coalesce(s.siblings, '') as siblings, coalesce(xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ord(c)::bigint for c in string_split(doc_id::varchar, '')]),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) % 7 = 0, false) as tampered from placed p left join steps s using (r) cross join crc
), folded(r, k, h) as (
  select r, 0, case when tampered then coalesce(claimed, leaf) else leaf end from hit union all
  select f.r, f.k + 1, sha256(case when h.steps[f.k + 1].sibling is null then f.h when h.steps[f.k + 1].odd = 1 then h.steps[f.k + 1].sibling || f.h else f.h || h.steps[f.k + 1].sibling end)
  from folded f join hit h using (r) where f.k < coalesce(len(h.steps), 0)
)
select h.doc_id, h.leaf, s.subroot, (select nodes[1] from tops where len(nodes) = 1) as root, sha256(h.siblings) as proof_sha256, f.h as folded_root,
  f.h = (select nodes[1] from tops where len(nodes) = 1) as verified
from hit h join subroots s on h.lang is not distinct from s.lang join folded f on f.r = h.r and f.k = coalesce(len(h.steps), 0)
"""

# Prefixes are lists; a node's subtree is found by its members, which are the conversations that begin with it.
SQL["op13_prefix_trie"] = r"""
with recursive bits(n, v, k) as (
  select n, n, 0 from (select unnest(range(256))::bigint as n) union all
  select n, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from bits where k < 8
), crc as (
  select list(v order by n) as t from bits where k = 8
), turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} as t from conversations where conv_id is not null
), given as (
  select conv_id as c, list(t order by i) as l from turns group by 1
), heads as (
  select c, l, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split(c::varchar, '')]),
    lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]))) % 4 as h from given cross join crc
), rebuilt as (
  select a.c, list_concat(coalesce(b.l[:a.h], []), a.l[a.h + 1:]) as l from heads a left join given b on b.c = a.c - a.c % 20
), members as (
  select c, l, l[:d] as p, d from (select c, l, unnest(range(len(l) + 1)) as d from rebuilt)
), nodes as (
  select p, d, min(c) as conv_id, count(*) as n_convs, string_agg(case when len(l) = d then c::varchar end, ',' order by c) as ends,
    count(distinct l[:d + 1]) - max((len(l) = d)::int) as n_children from members group by p, d
), valued as (
  select *, case when d = 0 then 0 else (n_convs - 1) * len(regexp_extract_all(p[-1].text, '[^\x20\x09-\x0D]+')) end as own from nodes
), subtrees as (
  select a.p, count(*) filter (where b.n_children = 0) as n_leaves, sum(b.own)::bigint as saved
  from valued a join valued b on b.d >= a.d and b.p[:a.d] = a.p group by a.p
)
select n.conv_id, n.d::bigint as depth, u.conv_id as parent_conv_id, n.n_convs, n.n_children::bigint as n_children, s.n_leaves, s.saved as saved_tokens,
  sha256(coalesce(n.ends, '')) as ends_sha256
from nodes n join subtrees s on s.p = n.p left join nodes u on n.d > 0 and u.d = n.d - 1 and u.p = n.p[:n.d - 1]
"""
