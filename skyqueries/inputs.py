"""Input tables of the registered queries, derived from the given tables.

Each definition is one SQL text that Spark and the checking database read alike, so both start from equal values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skytable.session import apply_settings

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _ra(k: str) -> str:
    return f"((({k}) * 179) % 36000) / 1e2"


def _dec(k: str) -> str:
    return f"((({k}) * 97) % 17801) / 1e2 - 89e0"


# Position of a key as text, in the file-name form of reports.
def _report_name(k: str) -> str:
    ra, dec = f"((({k}) * 179) % 36000)", f"(((({k}) * 97) % 17801) - 8900)"
    return (
        f"('t' || lpad(cast(cast(floor({ra} / 100e0) as bigint) as string), 3, '0') || '_' || "
        f"lpad(cast({ra} % 100 as string), 2, '0') || '00' || "
        f"case when {dec} < 0 then '-' else '+' end || cast(cast(floor(abs({dec}) / 100e0) as bigint) as string) || '_' || "
        f"lpad(cast(abs({dec}) % 100 as string), 2, '0') || '00_r')"
    )


VIEWS: dict[str, str] = {
    "cat_a": f"select o_orderkey as id, {_ra('o_orderkey')} as ra, {_dec('o_orderkey')} as dec from {{orders}}",
    "cat_b": f"select p_partkey as id, {_ra('p_partkey * 7')} as ra, "
    f"{_dec('p_partkey * 7')} + ((p_partkey % 7) - 3) * 0.4e0 / 36e2 as dec from {{part}}",
    "cat_c": f"select c_custkey as id, {_ra('c_custkey * 10')} + ((c_custkey % 5) - 2) * 0.3e0 / 36e2 as ra, "
    f"{_dec('c_custkey * 10')} as dec from {{customer}}",
    "sexa": "select o_orderkey as id, lpad(cast(o_orderkey % 24 as string), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as string), 2, '0') "
    "|| ':' || lpad(cast((o_orderkey * 7) % 60 as string), 2, '0') || '.' || cast(o_orderkey % 10 as string) as ra_text, "
    "case when o_orderkey % 2 = 0 then '-' else '+' end || lpad(cast(o_orderkey % 90 as string), 2, '0') || ':' || "
    "lpad(cast((o_orderkey * 3) % 60 as string), 2, '0') || ':' || lpad(cast((o_orderkey * 11) % 60 as string), 2, '0') || '.' || "
    "cast(o_orderkey % 10 as string) as dec_text from {orders}",
    "lines": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate from {lineitem}",
    "products": "select p_partkey as id, 'obs' || cast(p_partkey % 300 as string) as dataset, "
    "case when p_partkey % 11 = 0 then null else 'jw' || lpad(cast(p_partkey % 500 as string), 5, '0') || "
    "case when p_partkey % 4 = 0 then '_cat.ecsv' else '_i2d.fits' end end as filename, "
    "case when p_partkey % 3 = 0 then '' else 'mast:x/' || cast(p_partkey as string) end as uri, "
    "case when p_partkey % 5 = 0 then null when p_partkey % 7 = 0 then '2' else '3.0' end as calib_level, "
    "case when p_partkey % 9 = 0 then 'spectrum' else 'image' end as dataproduct_type, "
    "cast(null as string) as obs_collection, cast(p_size as string) as size, p_brand as instrume, p_type as category from {part}",
    "observations": "select s_suppkey as id, 'obs' || cast(s_suppkey % 250 as string) as fileSetName, 'T' || cast(s_suppkey as string) as targprop, "
    "cast(s_nationkey as string) as program, 'PUBLIC' as access, '3' as productLevel, 'F' || cast(s_nationkey as string) as opticalElements "
    "from {supplier}",
    "manifest_files": "select p_partkey as id, 'jw' || lpad(cast((p_partkey * 13) % 1700 as string), 6, '0') || '_o' || "
    "lpad(cast(p_partkey % 1000 as string), 3, '0') || '_t001_' || "
    "case p_partkey % 6 when 0 then 'nircam' when 1 then 'NIRISS' when 2 then 'miri' when 3 then 'fgs' when 4 then 'nirspec' else 'nircam' end || '_' || "
    "case p_partkey % 8 when 0 then 'clear-f150w' when 1 then 'f405n-f444w' when 2 then 'clear' when 3 then 'CLEARP-F277W' "
    "when 4 then 'nrca1' when 5 then 'f322w2-f323n' when 6 then 'clear-f200w-sub64' else 'f090w-brightsky' end || "
    "case when p_partkey % 10 = 9 then '_cal.fits' else '_i2d.fits' end as file_name, p_size as size from {part}",
    "truth": f"select c_custkey as id, {_ra('c_custkey * 10')} as ra, {_dec('c_custkey * 10')} as dec, "
    "cast((c_custkey * 37) % 101 / 1e2 as string) as fraction, "
    "case when c_custkey % 17 = 0 then 'n/a' else cast(c_custkey % 12 as string) end as votes from {customer}",
    "truth_report": f"select o_orderkey as row_id, case when o_orderkey % 13 = 0 then 'bad' || cast(o_orderkey as string) else {_report_name('o_orderkey')} end as name "
    "from {orders}",
    "raw_report": "select cast(o_orderkey as string) as index, cast((o_orderkey % 7) / 1e1 as string) as P_CW, '0' as P_ACW, "
    f"{_report_name('o_orderkey')} as name, "
    "case when o_orderkey % 19 = 0 then 'input rejected' else ' OK' end as fit_state, "
    "case when o_orderkey % 23 = 0 then ' ' else 'none' end as warnings, "
    "case o_orderkey % 3 when 0 then 'unavailable' when 1 then 'aggressive-exclusive' else 'none' end as star_mask_used, "
    "case o_orderkey % 4 when 0 then 'conservative-exclusive' when 1 then 'unavailable' else 'x' end as noise_mask_used, "
    "case o_orderkey % 3 when 0 then 'Z-wise' when 1 then 'S-wise' else 'EQ' end as chirality_maj, "
    "case o_orderkey % 2 when 0 then 'Z-wise' else 'S-wise' end as chirality_alenWtd, "
    "case o_orderkey % 2 when 0 then 'true' else 'false' end as badBulgeFitFlag, "
    "case when o_orderkey % 29 = 0 then '-Inf' else cast((o_orderkey % 100) / 1e2 as string) end as bulgeAxisRatio, "
    "cast((o_orderkey % 400) / 1e1 as string) as diskMinAxsLen, "
    "'[' || cast(o_orderkey % 64 as string) || ' ' || cast(o_orderkey % 48 as string) || ']' as iptSz, "
    "'[1 ' || cast(o_orderkey % 9 as string) || '; 3 4]' as covarFit, "
    "case when o_orderkey % 31 = 0 then '0+5.6e-09i' else cast(-(o_orderkey % 40) as string) end as likOfCtr, "
    "cast((o_orderkey * 3) % 500 as string) as totalArcLength, "
    "case o_orderkey % 4 when 0 then '''one-long''' when 1 then '<2 arcs' when 2 then '''all-short''' else 'agree' end as top2_chirality_agreement, "
    "'[' || cast(o_orderkey % 5 as string) || ' ' || cast(o_orderkey % 4 as string) || ']' as chirality_votes_maj, "
    "case o_orderkey % 3 when 0 then '[1 2 3]' when 1 then '4_5' else '[7 x]' end as sorted_agreeing_pangs, "
    "case o_orderkey % 2 when 0 then 'true' else 'false' end as bar_used, "
    "cast(o_orderkey % 50 as string) as cropRad from {orders}",
    "scored": "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount * 10 as p, l_discount * 10 + (l_tax - 0.04e0) as pred, "
    "case when (l_orderkey * 31 + l_linenumber) % 5 = 0 then 'test' else 'train' end as split from {lineitem}",
    "labelled": "select d.doc_id as id, d.source as source, d.lang as lang, d.n_chars as n_chars, l.quality as quality, l.toxic as toxic "
    "from {documents} d join {labels} l on d.doc_id = l.doc_id",
    "progress": "select event_id, ts, cast(user_id % 10 as bigint) as worker, user_id, value as bytes_read, event_type = 'error' as is_error, "
    "event_type from {events}",
}

# Views over other views.
LAYERED: dict[str, str] = {
    "detections": "select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, "
    "l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 as seq, "
    f"{_ra('l_orderkey')} + (l_linenumber % 3) * 0.01e0 + ((l_partkey % 3) - 1) * 0.00005e0 as ra, {_dec('l_orderkey')} as dec, "
    "l_returnflag as band, l_linestatus as file, cast(l_quantity as bigint) as height, l_suppkey % 50 as width, "
    "l_orderkey as k1, l_linenumber % 3 as k2 from {lineitem}",
    "pixels": "select vec_id as image_id, 8 as h, 8 as w, cast(floor(pos / 8) as int) as y, cast(pos % 8 as int) as x, cast(v as double) as v from "
    "(select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from {embeddings})",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A derived table in Spark."""
    apply_settings(spark)
    text = VIEWS[name]
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated detections with their arrival number."""
    from pyspark.sql import functions as F

    from skytable.operators.ranking import renumber

    lines = view(spark, folder, "lines")
    numbered = renumber(lines, [F.col(c) for c in lines.columns], "seq")
    return numbered.selectExpr(
        "seq",
        f"{_ra('l_orderkey')} + (l_linenumber % 3) * 0.01e0 + ((l_partkey % 3) - 1) * 0.00005e0 as ra",
        f"{_dec('l_orderkey')} as dec",
        "l_returnflag as band",
        "l_linestatus as file",
        "cast(l_quantity as bigint) as height",
        "l_suppkey % 50 as width",
        "l_orderkey as k1",
        "l_linenumber % 3 as k2",
    )


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """8 x 8 images, one per vector."""
    apply_settings(spark)
    return table(spark, folder, "embeddings").selectExpr("vec_id as image_id", "8 as h", "8 as w", "posexplode(embedding) as (pos, e)").selectExpr(
        "image_id", "h", "w", "cast(pos div 8 as int) as y", "cast(pos % 8 as int) as x", "cast(e as double) as v"
    )


def sql_with(names: list[str], body: str) -> str:
    """Checking SQL: the views as named subqueries, then the body."""
    parts = []
    for n in names:
        text = VIEWS.get(n) or LAYERED[n]
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{n} as ({text})")
    return ("with " + ", ".join(parts) + ", " if not body.lstrip().lower().startswith("select") else "with " + ", ".join(parts) + " ") + body


class Registry:
    """Named queries and their checking SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, views: list[str] | None = None, sql: str | None = None):
        def keep(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql_with(views, sql) if views else sql
            return fn

        return keep


HAVERSINE = (
    "degrees(2 * asin(least(1.0, sqrt(pow(sin(radians({d2} - {d1}) / 2), 2) + cos(radians({d1})) * cos(radians({d2})) * "
    "pow(sin(radians({r2} - {r1}) / 2), 2))))) * 3600"
)


def haversine(r1: str, d1: str, r2: str, d2: str) -> str:
    return HAVERSINE.format(r1=r1, d1=d1, r2=r2, d2=d2)
