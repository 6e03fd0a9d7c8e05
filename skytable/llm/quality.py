"""Quality rules: base statistics of a text, and multivariate outliers by minimum-covariance-determinant estimates.

All of it is DataFrame functions. The base statistics of a text come from its own word array; nothing is exploded. For
each language and source the statistics, transformed, get a robust centre and covariance: starting from medians
and quartile ranges, each concentration step keeps the three quarters of the documents that lie nearest by Mahalanobis distance and estimates
from them anew, which never raises the determinant of the covariance; a last step re-estimates from all within the 97.5 % ellipsoid. A document
further out than the cutoff is rejected.

One step is one aggregation: rows are summed by group and distance bin, and the bins up to the one that completes the
three quarters are added up. So a source with a third of all rows is a few hundred partial sums, never one task's rows.

Defined cases: a null text has no words; documents that fail the base rules take no part in the estimates; a null language or source is a group of
its own; sources with fewer than ``LEAST_ROWS`` documents of a language are taken together, and so are languages that then still have fewer;
if all of these together are fewer, the method rejects none of them; repeated rows count each; an empty table gives an empty table; only the id, text, language and source columns are read,
so other columns cannot clash.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skytable.llm.common import null_safe
from skytable.session import cut_lineage

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
# Bits of a packed number that hold a window's place.
_PLACE = 30
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

# Share of a group that a concentration step keeps, number of steps, and the factor that makes the covariance of the kept part
# consistent for five normal variables: share / P(chi2 of 7 degrees <= its quantile of 5 degrees at the share).
SHARE, STEPS = 0.75, 3
FACTOR = 1.412
# The same for the last step, at 97.5 %, and that quantile.
NEAR, NEAR_FACTOR = 12.833, 1.064
# Squared distance beyond which a document is rejected; statistics have longer tails than the normal distribution.
CUTOFF = 60.0
LEAST_ROWS = 40
# Least standard deviation of each transformed statistic, so that a statistic that is zero for most documents does not
# make one repeated line an outlier.
FLOORS = {"log_words": 0.5, "word_length": 0.5, "symbols": 0.1, "dup_lines": 0.3, "repeats": 0.12}
_BINS_PER_UNIT = 20


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, the base statistics and ``base_failed`` of every whole text, with the columns of ``keep``.

    ``n_repeat_words`` counts the words in three-word windows that occur twice or more. Windows are compared by 64-bit
    hashes; sorting packs the upper bits of a hash with the window's place into one number, which finds candidates, and the
    candidates are compared by their full hashes.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("doc_id"), *[docs[c] for c in keep or []], text.alias("__t"))
    kept = ["doc_id", *(keep or [])]
    rows = rows.select(
        *kept,
        F.filter(F.split("__t", SPACES), lambda w: w != "").alias("__w"),
        F.char_length(F.translate("__t", " \t\n\x0b\f\r", "")).cast("bigint").alias("word_chars"),
        (F.char_length("__t") - F.char_length(F.translate("__t", SYMBOLS[1:-1], ""))).cast("bigint").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda line: F.translate(line, " \t\n\x0b\f\r", "") != "").alias("__lines"),
    )
    kept += ["word_chars", "n_symbols"]
    rows = rows.select(
        *kept,
        F.size("__w").cast("bigint").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    kept += ["n_words", "n_dup_lines"]
    many = F.greatest(F.col("n_words").cast("int") - 2, F.lit(0))
    windows = F.arrays_zip(*[F.slice("__h", at, many).alias(f"w{at}") for at in (1, 2, 3)])
    rows = rows.select(*kept, F.transform(windows, lambda w: F.xxhash64(w["w1"], w["w2"], w["w3"])).alias("__win"))
    low = (1 << _PLACE) - 1
    packed = F.transform("__win", lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("bigint")))
    # Without any equal windows there is nothing to sort.
    repeated = F.size(F.array_distinct("__win")) < F.size("__win")
    rows = rows.select(*kept, "__win", F.when(repeated, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>")).alias("__s"))
    neighbours = F.greatest(F.size("__s") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("__s", 1, neighbours).alias("a"), F.slice("__s", 2, neighbours).alias("b"))
    same = F.filter(pairs, lambda p: F.shiftright(p["a"], _PLACE) == F.shiftright(p["b"], _PLACE))
    places = F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["a"].bitwiseAND(F.lit(low)), p["b"].bitwiseAND(F.lit(low))))))
    rows = rows.select(*kept, "__win", places.alias("__c"))
    exact = F.sort_array(F.transform("__c", lambda i: F.struct(F.get("__win", i.cast("int")).alias("h"), i.alias("i"))))
    rows = rows.select(*kept, exact.alias("__e"))
    neighbours = F.greatest(F.size("__e") - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice("__e", 1, neighbours).alias("a"), F.slice("__e", 2, neighbours).alias("b"))
    same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
    rows = rows.select(*kept, F.array_sort(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["a"]["i"], p["b"]["i"]))))).alias("__p"))
    gaps = F.zip_with(F.slice("__p", 1, F.greatest(F.size("__p") - 1, F.lit(0))), F.slice("__p", 2, F.size("__p")), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("__p") == 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(gaps, F.lit(3).cast("bigint"), lambda s, g: s + g))
    rows = rows.select(*kept, covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select("doc_id", *(keep or []), *BASE, failed.alias("base_failed"))


def transformed() -> dict[str, Column]:
    """The transformed statistics, in the order of ``FLOORS``; defined for texts without words too."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "log_words": F.log(words),
        "word_length": F.col("word_chars") / words,
        "symbols": F.log1p(20 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "dup_lines": F.log1p(100 * F.col("n_dup_lines") / words),
        "repeats": F.sqrt(F.col("n_repeat_words") / words),
    }


def _squared_distance(names: list[str]) -> Column:
    """Mahalanobis distance from the centre ``m_*`` by forward substitution in the Cholesky factor ``l_*_*``."""
    z: list[Column] = []
    for i, name in enumerate(names):
        rest = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * z[j]
        z.append(rest / F.col(f"l_{i}_{i}"))
    total = z[0] * z[0]
    for x in z[1:]:
        total = total + x * x
    return total


def _factored(params: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Cholesky factor ``l_*_*`` of the covariances ``c_*_*`` (lower triangle), column by column."""
    for j in range(size):
        left = F.col(f"c_{j}_{j}")
        for k in range(j):
            left = left - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        params = params.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(left, F.lit(1e-12))))
        below = {}
        for i in range(j + 1, size):
            left = F.col(f"c_{i}_{j}")
            for k in range(j):
                left = left - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            below[f"l_{i}_{j}"] = left / F.col(f"l_{j}_{j}")
        params = params.withColumns(below)
    lower = [f"l_{i}_{j}" for i in range(size) for j in range(i + 1)]
    return params.select(*keys, "n_rows", *[f"m_{i}" for i in range(size)], *lower)


def _start(stats: DataFrame, keys: list[str], names: list[str], floors: list[float]) -> DataFrame:
    """Medians and quartile ranges of every statistic, from counts on a grid of twentieths of the floors."""
    cells = stats.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), F.floor(F.col(c) / F.lit(f / _BINS_PER_UNIT)).alias("bin")) for i, (c, f) in enumerate(zip(names, floors, strict=True))])).alias("x"))
    counts = cells.groupBy(*keys, "x.dim", "x.bin").count()
    order = Window.partitionBy(*keys, "dim").orderBy("bin")
    upto, whole = F.sum("count").over(order), F.sum("count").over(Window.partitionBy(*keys, "dim"))
    ranked = counts.select(*keys, "dim", "bin", upto.alias("upto"), whole.alias("whole"))
    at = lambda q, d: F.min(F.when((F.col("dim") == d) & (F.col("upto") >= q * F.col("whole")), F.col("bin") + 0.5))
    found = ranked.groupBy(*keys).agg(
        F.max("whole").alias("n_rows"),
        *[(at(0.5, i) * (f / _BINS_PER_UNIT)).alias(f"m_{i}") for i, f in enumerate(floors)],
        *[((at(0.75, i) - at(0.25, i)) * (f / _BINS_PER_UNIT / 1.349)).alias(f"s_{i}") for i, f in enumerate(floors)],
    )
    for i in range(len(names)):
        for j in range(i + 1):
            found = found.withColumn(f"c_{i}_{j}", F.pow(f"s_{i}", 2) + floors[i] ** 2 if i == j else F.lit(0.0))
    return _factored(found, keys, len(names))


def _estimate(stats: DataFrame, params: DataFrame, keys: list[str], names: list[str], floors: list[float], share: float | None, factor: float) -> DataFrame:
    """Centre and covariance of each group's nearest ``share`` (or of all within ``NEAR``), by one aggregation over distance bins."""
    pairs = [(j, i) for i, j in combinations_with_replacement(range(len(names)), 2)]
    near = null_safe(stats, params, keys, "inner").withColumn("d2", _squared_distance(names))
    if share is None:
        near = near.where(F.col("d2") <= NEAR)
    binned = near.withColumn("bin", F.floor(16 * F.log2(1 + F.col("d2"))).cast("int"))
    sums = [F.sum(c).alias(f"t_{i}") for i, c in enumerate(names)]
    sums += [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p_{i}_{j}") for i, j in pairs]
    # One bin where no share is asked for.
    bins = (binned if share is not None else binned.withColumn("bin", F.lit(0))).groupBy(*keys, "bin").agg(F.max("n_rows").alias("n_rows"), F.count("*").alias("n"), *sums)
    if share is not None:
        before = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin")) - F.col("n")
        bins = bins.withColumn("before", before).where(F.col("before") < share * F.col("n_rows"))
    total = bins.groupBy(*keys).agg(
        F.max("n_rows").alias("n_rows"),
        F.sum("n").alias("n"),
        *[F.sum(f"t_{i}").alias(f"t_{i}") for i in range(len(names))],
        *[F.sum(f"p_{i}_{j}").alias(f"p_{i}_{j}") for i, j in pairs],
    )
    total = total.withColumns({f"m_{i}": F.col(f"t_{i}") / F.col("n") for i in range(len(names))})
    cov = {}
    for i, j in pairs:
        c = (F.col(f"p_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor
        cov[f"c_{i}_{j}"] = F.greatest(c, F.lit(0.0)) + floors[i] ** 2 if i == j else c
    return _factored(total.withColumns(cov), keys, len(names))


def robust_estimates(stats: DataFrame, keys: list[str], floors: dict[str, float] = FLOORS) -> DataFrame:
    """Minimum-covariance-determinant centre and Cholesky factor of each group of the columns named in ``floors``.

    Starts one job per step. Each step's estimates are written to shared storage, so the next one knows their
    size: Spark broadcasts them while they are below its threshold and shuffles, with skew splitting, beyond.
    """
    names, least = list(floors), list(floors.values())
    params = cut_lineage(_start(stats, keys, names, least))
    for _ in range(STEPS):
        params = cut_lineage(_estimate(stats, params, keys, names, least, SHARE, FACTOR))
    return cut_lineage(_estimate(stats, params, keys, names, least, None, NEAR_FACTOR))


GROUP = ["__level", "__g_lang", "__g_source"]


def _groups(stats: DataFrame) -> DataFrame:
    """The group whose estimates each language and source uses: its own, its language's small sources, or all small ones."""
    counts = stats.where(~F.col("base_failed")).groupBy("__lang", "__source").count()
    small = counts.where(F.col("count") < LEAST_ROWS).groupBy("__lang").agg(F.sum("count").alias("together"))
    levels = null_safe(counts, small, ["__lang"], "left")
    level = F.when(F.col("count") >= LEAST_ROWS, 0).when(F.col("together") >= LEAST_ROWS, 1).otherwise(2)
    levels = levels.withColumn("__level", level)
    lang, source = F.when(F.col("__level") < 2, F.col("__lang")), F.when(F.col("__level") < 1, F.col("__source"))
    return levels.select("__lang", "__source", "__level", lang.alias("__g_lang"), source.alias("__g_source"))


def judge(
    docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed``, ``kept`` and ``distance2`` of every document.

    ``distance2`` is null where the method says nothing. The statistics are written to shared storage once and read by every step.
    """
    return _judged(docs, cutoff, id_col, text_col, lang_col, source_col, []).select("doc_id", *BASE, "base_failed", "kept", "distance2")


def keep_good(
    docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """The documents that are kept, with their columns. They are written to shared storage with their statistics, so that no text is shuffled."""
    columns = docs.columns
    judged = _judged(docs, cutoff, id_col, text_col, lang_col, source_col, columns)
    return judged.where("kept").select(*[F.col(f"__keep_{i}").alias(c) for i, c in enumerate(columns)])


def _judged(docs: DataFrame, cutoff: float, id_col: str, text_col: str, lang_col: str, source_col: str, keep: list[str]) -> DataFrame:
    carried = {"__lang": docs[lang_col], "__source": docs[source_col]} | {f"__keep_{i}": docs[c] for i, c in enumerate(keep)}
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *[c.alias(n) for n, c in carried.items()])
    stats = cut_lineage(base_statistics(docs, keep=list(carried)))
    values = {f"__{n}": c for n, c in transformed().items()}
    floors = {f"__{n}": f for n, f in FLOORS.items()}
    grouped = null_safe(stats.withColumns(values), cut_lineage(_groups(stats)), ["__lang", "__source"], "left")
    usable = cut_lineage(grouped.where(~F.col("base_failed")).select(*GROUP, *values))
    params = robust_estimates(usable, GROUP, floors)
    joined = null_safe(grouped, params.where(F.col("n_rows") >= LEAST_ROWS), GROUP, "left")
    judged = joined.withColumn("distance2", F.when(~F.col("base_failed"), _squared_distance(list(values))))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return judged.withColumn("kept", kept)
