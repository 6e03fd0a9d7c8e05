"""Z-fast trie of conversations: a compacted trie of their turns whose nodes are hashed at handles.

Every compacted node stands for the prefixes of lengths ``lo + 1 .. hi`` that its conversations share. Its handle is the prefix whose length is the number
of ``(lo, hi]`` that is divisible by the highest power of two, so a conversation finds its exit node by a binary search on lengths that
asks the table of handles once a step. Conversations that are equal are one string with its members.

Strings come in batches, which are joins: all strings that are left search at once (one join with the handles for each step); inner ends
split edges; of the strings that leave the trie by the same next turn one enters as a leaf, and the others search again in the next batch, where they get
further. The longest enters, so that the next batch meets as much of the common path as there is. At the end edges are expanded to a row for each prefix.

Prefixes are compared by 120 bits of position-wise SHA-256 digests, combined by exclusive or, so that prefixes of a conversation of any length are sums
over chunks of its turns. What a node holds is summed over the strings on whose path it lies; the words of its subtree come from the same sums, because
every string owns the lower part of its path, from where it is the least one.

Defined cases: rows without a conversation id belong to none and are left out; turns of equal number are ordered by role and text; null role
and text are empty; a conversation without turns is a member of the root only; an empty table gives an empty table; only
the four named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skytable.operators.ranking import rank_in_chunks
from skytable.session import cut_lineage

# Turns of one conversation, and ids of one string, that one window or group holds at most: 2 ** CHUNK.
CHUNK = 12
WORD = r"[^\x20\x09-\x0D]+"
_NODE = ["lo", "hi", "x", "h1", "h2", "p1", "p2", "e1", "e2", "f", "f1", "f2"]


def turns_of(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``at`` (from 1 on), ``digest`` and ``words`` of every turn."""
    plain = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).where("conv_id is not null")
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    chunk = F.coalesce(F.shiftright(F.col("turn").cast("bigint"), CHUNK), F.lit(-(1 << 60)))
    ordered = plain.select("conv_id", "turn", "role", "text", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"))
    ranked = rank_in_chunks(ordered, ["conv_id"], [F.col("turn"), F.col("role"), F.col("text")], chunk, "at")
    return ranked.select("conv_id", "at", "digest", "words")


def rebuilt(turns: DataFrame, base: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations (``conv_id``), and their turns (``conv_id``, ``d``, ``digest``, ``words``): the first ``taken`` ones of ``base``, then their own after as many."""
    convs = cut_lineage(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    wanted = convs.select("conv_id", base.alias("base"), taken.alias("taken"))
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    wanted = wanted.join(sizes, "base", "left").withColumn("shift", F.least(F.col("taken"), F.coalesce("n_base", F.lit(0))) - F.col("taken"))
    head = turns.select(F.col("conv_id").alias("base"), "at", "digest", "words").join(wanted.select("conv_id", "base", "taken"), "base").where(F.col("at") <= F.col("taken"))
    tail = turns.join(wanted.select("conv_id", "taken", "shift"), "conv_id").where(F.col("at") > F.col("taken"))
    parts = head.select("conv_id", F.col("at").alias("d"), "digest", "words").union(tail.select("conv_id", F.col("at") + F.col("shift"), "digest", "words"))
    return convs.select("conv_id"), parts


def prefixes(turns: DataFrame) -> DataFrame:
    """``x`` (the conversation), ``d``, ``h1``, ``h2`` (digest of the first d turns) and ``w`` (their words)."""
    digest = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), "digest"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("bigint")
    own = turns.select(F.col("conv_id").alias("x"), "d", F.shiftright("d", CHUNK).alias("c"), part(1).alias("z1"), part(16).alias("z2"), "words")
    sums = own.groupBy("x", "c").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"), F.sum("words").alias("sw"))
    before = W.partitionBy("x").orderBy("c").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    sums = sums.select("x", "c", *[F.coalesce(f(s).over(before), zero).alias(s) for f, s in ((F.bit_xor, "s1"), (F.bit_xor, "s2"), (F.sum, "sw"))])
    upto = W.partitionBy("x", "c").orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    run = own.select("x", "c", "d", F.bit_xor("z1").over(upto).alias("r1"), F.bit_xor("z2").over(upto).alias("r2"), F.sum("words").over(upto).alias("rw"))
    return run.join(sums, ["x", "c"]).select("x", "d", F.col("r1").bitwiseXOR(F.col("s1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("s2")).alias("h2"), (F.col("rw") + F.col("sw")).alias("w"))


def strings(convs: DataFrame, given: DataFrame) -> DataFrame:
    """Distinct conversations: ``n`` turns, digest, words, least id ``x``, number of members and the digest of their ids.

    A digest of ids is sequential, so the ids of a string pass one task, as texts of whole chunks in a stream; none is held longer than its batch.
    """
    ends = given.groupBy("x").agg(F.max_by(F.struct("d", "h1", "h2", "w"), "d").alias("e"))
    zero = F.lit(0).cast("bigint")
    ends = convs.join(ends, convs["conv_id"] == ends["x"], "left").select("conv_id", *[F.coalesce(F.col(f"e.{c}"), zero).alias(a) for c, a in (("d", "n"), ("h1", "h1"), ("h2", "h2"), ("w", "w"))])
    keys = ["n", "h1", "h2"]
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda v: v.cast("string")), ",")
    chunks = ends.groupBy(*keys, F.shiftright("conv_id", CHUNK).alias("c")).agg(F.max("w").alias("w"), F.min("conv_id").alias("x"), F.count("*").alias("cnt"), ids.alias("ids"))
    dealt = chunks.repartition(*keys).sortWithinPartitions(*keys, "c")
    names = [*keys, "w", "x", "cnt"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, sha256()

        def row(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))]
            return pa.RecordBatch.from_arrays([*columns, pa.array([r[-1] for r in rows], pa.string())], [*names, "ends"])

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if current and current[:3] == [r[k] for k in keys]:
                    current[5] += r["cnt"]
                    digest.update(b"," + r["ids"].encode())
                else:
                    if current:
                        done.append((*current, digest.hexdigest()))
                    current, digest = [r[c] for c in names], sha256(r["ids"].encode())
            if done:
                yield row(done)
        if current:
            yield row([(*current, digest.hexdigest())])

    return dealt.select(*names, "ids").mapInArrow(run, ", ".join([*[f"{c} bigint" for c in names], "ends string"]))


def fattest(a: str, b: str) -> Column:
    """The number of (a, b] that is divisible by the highest power of two."""
    return F.expr(f"{b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1)")


def _at(given: DataFrame, x: str, d: str, one: str, two: str) -> DataFrame:
    """The prefix digests with other names, to be joined on ``x`` and ``d``."""
    return given.select(F.col("x").alias(x), F.col("d").alias(d), F.col("h1").alias(one), F.col("h2").alias(two))


def described(nodes: DataFrame, given: DataFrame) -> DataFrame:
    """Nodes (``lo``, ``hi``, ``x``) with the digests at both ends, after the first turn of their edge, and at their handle."""
    wanted = nodes.withColumn("f", fattest("lo", "hi"))
    depths = F.explode(F.array_distinct(F.array("lo", F.col("lo") + 1, "f", "hi")))
    joined = wanted.withColumn("d", depths).join(given.drop("w"), ["x", "d"])
    at = lambda where, h, name: F.max(F.when(F.col("d") == where, F.col(h))).alias(name)
    pairs = [(F.col("hi"), "h"), (F.col("lo"), "p"), (F.col("lo") + 1, "e"), (F.col("f"), "f")]
    return joined.groupBy("lo", "hi", "x", "f").agg(*[at(d, f"h{i}", f"{name}{i}") for d, name in pairs for i in (1, 2)]).select(*_NODE)


def locate(pending: DataFrame, nodes: DataFrame, given: DataFrame, steps: int) -> DataFrame:
    """Where strings (``x``, ``n``) leave the trie: at depth ``at``, inside the edge of node ``s_lo``, ``s_hi``, ``s_x`` (null: at a node's end)."""
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    state = pending.select("x", "n", zero.alias("a"), F.col("n").alias("b"), F.lit(-1).cast("bigint").alias("lo"), zero.alias("hi"), none.alias("nx"), zero.alias("k1"), zero.alias("k2"))
    handles = nodes.where("hi > 0").select("f", F.col("f1").alias("q1"), F.col("f2").alias("q2"), *[F.col(c).alias(f"_{a}") for c, a in (("lo", "lo"), ("hi", "hi"), ("x", "nx"), ("h1", "k1"), ("h2", "k2"))])
    for _ in range(steps):
        asked = state.withColumn("f", F.when(F.col("a") < F.col("b"), fattest("a", "b")))
        asked = asked.join(_at(given, "x", "f", "q1", "q2"), ["x", "f"], "left").join(handles, ["f", "q1", "q2"], "left")
        hit = F.col("_hi").isNotNull()
        state = asked.select(
            "x",
            "n",
            F.when(hit, F.col("_hi")).otherwise(F.col("a")).alias("a"),
            F.when(hit | F.col("f").isNull(), F.col("b")).otherwise(F.col("f") - 1).alias("b"),
            *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("lo", "hi", "nx", "k1", "k2")],
        )
    whole = state.join(_at(given, "x", "hi", "g1", "g2"), ["x", "hi"], "left").withColumn("full", F.coalesce((F.col("g1") == F.col("k1")) & (F.col("g2") == F.col("k2")), F.lit(False)))
    # After a whole node the next turn may lead into the edge of a child whose handle is too deep.
    whole = whole.withColumn("next", F.when(F.col("full"), F.col("hi") + 1)).join(_at(given, "x", "next", "n1", "n2"), ["x", "next"], "left")
    edges = nodes.where("hi > 0").select((F.col("lo") + 1).alias("next"), F.col("e1").alias("n1"), F.col("e2").alias("n2"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"), F.col("x").alias("c_x"))
    whole = whole.join(edges, ["next", "n1", "n2"], "left")
    inside = lambda own, child: F.when(F.col("full"), F.col(child)).otherwise(F.col(own))
    exits = whole.select("x", "n", "hi", inside("lo", "c_lo").alias("s_lo"), inside("hi", "c_hi").alias("s_hi"), inside("nx", "c_x").alias("s_x"))
    along = exits.where("s_lo is not null").select("x", "s_x", F.explode(F.expr("sequence(s_lo + 1, least(s_hi, n))")).alias("d"))
    along = along.join(_at(given, "x", "d", "a1", "a2"), ["x", "d"]).join(_at(given, "s_x", "d", "b1", "b2"), ["s_x", "d"])
    common = along.where("a1 = b1 and a2 = b2").groupBy("x").agg(F.max("d").alias("common"))
    return exits.join(common, "x", "left").select("x", "n", F.coalesce("common", "s_lo", "hi").alias("at"), "s_lo", "s_hi", "s_x")


def build(distinct: DataFrame, given: DataFrame) -> DataFrame:
    """The nodes of the compacted trie over strings (``x``, ``n``), with the root as ``lo`` -1 and ``hi`` 0. Starts jobs, some for each batch."""
    spark = distinct.sparkSession
    zero = (0,) * 2
    root = spark.createDataFrame([(-1, 0, None, *zero, *zero, *zero, 0, *zero)], ", ".join(f"{c} bigint" for c in _NODE))
    nodes, pending, steps = root, distinct.where("n > 0").select("x", "n"), 0
    while True:
        placed = locate(pending, nodes, given, steps).withColumn("next", F.col("at") + 1)
        placed = cut_lineage(placed.join(_at(given, "x", "next", "q1", "q2"), ["x", "next"], "left"))
        # Of those that leave by the same turn the longest enters, of these the one of least id.
        entering = placed.where("n > at").groupBy("next", "q1", "q2").agg(F.max(F.struct("n", (-F.col("x")).alias("minus"))).alias("e"))
        leaves = entering.select((F.col("next") - 1).alias("lo"), F.col("e.n").alias("hi"), (-F.col("e.minus")).alias("x"))
        edges = placed.where("at > s_lo and at < s_hi").select(F.col("s_lo").alias("lo"), F.col("s_hi").alias("hi"), F.col("s_x").alias("x"), "at").distinct()
        whole = edges.select("lo", "hi", "x").distinct()
        cut = W.partitionBy("hi", "x").orderBy("at").rowsBetween(-1, -1)
        parts = edges.union(whole.select("lo", "hi", "x", F.col("hi"))).select(F.coalesce(F.max("at").over(cut), "lo").alias("lo"), F.col("at").alias("hi"), "x")
        kept = nodes.join(whole.select("hi", "x", F.lit(True).alias("split")), ["hi", "x"], "left").where("split is null").select(*_NODE)
        entered = leaves.select("x", F.lit(True).alias("entered"))
        nodes = cut_lineage(kept.union(described(parts.union(leaves), given)))
        pending = cut_lineage(placed.where("n > at").join(entered, "x", "left").where("entered is null").select("x", "n"))
        longest = pending.agg(F.max("n")).first()[0]
        if longest is None:
            return nodes
        steps = int(longest).bit_length()


def prefix_nodes(rows: DataFrame, base: Column, taken: Column) -> DataFrame:
    """A row for every distinct prefix of the rebuilt conversations: least member, depth, parent, members, children, leaves, saved words, and the digest of those that end there."""
    convs, parts = rebuilt(cut_lineage(turns_of(rows)), base, taken)
    given = cut_lineage(prefixes(cut_lineage(parts)))
    distinct = cut_lineage(strings(convs, given))
    # Only the least member of a string stands for it from here on.
    zero = F.lit(0).cast("bigint")
    given = given.join(distinct.select("x"), "x", "left_semi").union(distinct.select("x", zero, zero, zero, zero))
    given = cut_lineage(given)
    nodes = build(distinct, given)
    path = given.select("x", F.col("d").alias("hi"), "h1", "h2").join(nodes.select("hi", "h1", "h2", "lo"), ["hi", "h1", "h2"])
    path = cut_lineage(path)
    children = nodes.where("hi > 0").groupBy(F.col("lo").alias("hi"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    ends = distinct.select(F.col("n").alias("hi"), "h1", "h2", "x", "w", "cnt", "ends").join(children, ["hi", "h1", "h2"], "left")
    own = cut_lineage(ends.withColumn("leaf", F.col("n_children").isNull().cast("bigint")))
    held = path.join(own.select("x", "w", "cnt", "leaf"), "x").groupBy("hi", "h1", "h2", "lo")
    held = cut_lineage(held.agg(F.min(F.struct("x", "w")).alias("least"), F.sum("cnt").alias("n_convs"), F.sum(F.col("cnt") * F.col("w")).alias("spoken"), F.sum("leaf").alias("n_leaves")))
    # Words that a string owns: those after the depth from which on it is the least of its node.
    begin = held.groupBy(F.col("least.x").alias("x")).agg(F.max("least.w").alias("w"), F.greatest(F.min("lo"), zero).alias("d"))
    owned = begin.join(given.select("x", "d", F.col("w").alias("before")), ["x", "d"]).select("x", (F.col("w") - F.col("before")).alias("owned"))
    shared = path.join(owned, "x", "left").groupBy("hi", "h1", "h2").agg(F.sum(F.coalesce("owned", zero)).alias("all_owned"))
    whole = held.join(shared, ["hi", "h1", "h2"]).join(nodes.select("hi", "h1", "h2", "p1", "p2"), ["hi", "h1", "h2"])
    whole = whole.withColumn("x", F.col("least.x")).join(owned, "x", "left").join(children, ["hi", "h1", "h2"], "left").join(own.select("hi", "h1", "h2", "ends"), ["hi", "h1", "h2"], "left")
    total = F.col("spoken") - (F.col("all_owned") - F.coalesce("owned", zero)) - F.col("least.w")
    above = held.select(F.col("hi").alias("lo"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("least.x").alias("above"))
    root = F.col("hi") == 0
    whole = whole.withColumn("total", total).join(above, ["lo", "p1", "p2"], "left")
    rows = whole.select("x", "hi", "lo", F.when(~root, F.col("above")).alias("above"), "n_convs", "n_children", "n_leaves", "total", "ends", F.explode(F.expr("sequence(lo + 1, hi)")).alias("depth"))
    rows = rows.withColumn("d", F.greatest(F.col("depth") - 1, zero)).join(given.select("x", "d", "w"), ["x", "d"])
    last = F.col("depth") == F.col("hi")
    return rows.select(
        F.col("x").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("lo") + 1, F.col("x")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.coalesce("n_children", zero)).otherwise(F.lit(1)).cast("bigint").alias("n_children"),
        "n_leaves",
        (F.col("total") - (F.col("n_convs") - 1) * F.col("w")).alias("saved_tokens"),
        F.when(last, F.col("ends")).alias("ends"),
    ).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
