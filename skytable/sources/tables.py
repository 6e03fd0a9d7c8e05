"""CSV tables: catalogs, reports, manifests, and the writers."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skytable.functions import names
from skytable.functions import report as R

# The manifest layout and where the older, headerless layout keeps its fields (counted from 0).
MANIFEST_COLUMNS = (
    "dataURI productFilename obsID target_name obs_collection calib_level productType dataproduct_type "
    "instrume exp_type filters proposal_id size dataRights"
).split()
LEGACY_URI, LEGACY_NAME, LEGACY_LEVEL, LEGACY_WIDTH = 6, 14, 18, 19
SOURCE_BASE_FIELDS = "ra dec scope provider path ext ext_name product_filename obs_id target_name filter".split()


def header_of(spark: SparkSession, path: str, skip_ending: str = "", **options) -> list[str]:
    """Column names of a CSV, or of the first file of several that is not empty: reads one line."""
    reader = spark.read
    for k, v in options.items():
        reader = reader.option(k, v)
    lines = reader.text(path)
    if skip_ending:
        lines = lines.filter(~F.col("_metadata.file_name").endswith(skip_ending))
    first = lines.first()
    return [] if first is None else [c.strip() for c in next(csv.reader([first[0]], skipinitialspace=True), [])]


def _by_name(spark: SparkSession, path: str, header: list[str], wanted: list[str], options: dict[str, str]) -> DataFrame:
    """All columns of the header as text, from which the wanted ones are taken by name; other columns are ignored."""
    missing = [c for c in wanted if c not in header]
    if header and missing:
        raise ValueError(f"columns absent from the header of {path}: {', '.join(missing)}")
    # A name that occurs twice counts where it comes first.
    places = {c: i for i, c in reversed(list(enumerate(header or wanted)))}
    schema = R.text_schema([f"c{i}" for i in range(len(header or wanted))])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True)
    reader = reader.option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.csv(path).select(*[F.col(f"c{places[c]}").alias(c) for c in wanted], "_metadata")


def read_catalog(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A1: catalog CSV by the names of its header, which may carry blanks and other columns; types come from the schema, without an inference pass."""
    wanted = spark.createDataFrame([], schema).schema
    names_ = [f.name.strip() for f in wanted.fields]
    df = _by_name(spark, path, header_of(spark, path), names_, {})
    return df.select(*[F.col(f"`{n}`").try_cast(f.dataType).alias(n) for n, f in zip(names_, wanted.fields, strict=True)])


def read_report(spark: SparkSession, path, columns: list[str] | None = None, skip_ending: str = "", **options) -> DataFrame:
    """A2: structure report as text columns, taken by the names of the header; rows are cut and padded to it by the permissive reader.

    Files read together share the header of the first one. A wanted name that the header lacks is an error.
    """
    lookup = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    header = header_of(spark, path, skip_ending, **lookup)
    df = _by_name(spark, path, header, columns or R.REPORT_COLUMNS, options)
    if skip_ending:
        df = df.filter(~F.col("_metadata.file_name").endswith(skip_ending))
    return df.select(*[c for c in df.columns if c != "_metadata"])


def report_lines(spark: SparkSession, root: str, columns: list[str], skip_ending: str = "", **lookup) -> DataFrame:
    """Lines of many CSVs as text columns, each file by its own header, with ``file_path`` and ``reason`` (null for a good line).

    A file's header is its first line that is not blank; files may have their columns in any order and others besides. Short lines are
    padded with nulls, blank ones left out. A line with more fields than the header, and every line of a file that lacks one of
    the columns, keeps its text in ``line`` and has a reason. Quoted fields may hold commas and doubled quotes, not line ends.
    """
    reader = spark.read
    for k, v in lookup.items():
        reader = reader.option(k, v)
    lines = reader.text(root).select(F.col("value").alias("line"), "_metadata.file_path", "_metadata.file_block_start")
    lines = lines.filter(F.trim("line") != "")
    if skip_ending:
        lines = lines.filter(~F.col("file_path").endswith(skip_ending))
    # Only a file's first block holds its header, and lines come in order.
    tops = lines.filter("file_block_start = 0").withColumn("at", F.monotonically_increasing_id())
    tops = tops.groupBy("file_path").agg(F.min_by("line", "at").alias("top"))
    names_ = F.transform(split_csv(F.col("top")), lambda c: F.trim(c))
    placed = tops.select("file_path", "top", F.size(names_).alias("wide"), *[F.array_position(names_, c).alias(f"at_{i}") for i, c in enumerate(columns)])
    absent = F.filter(F.array(*[F.when(F.col(f"at_{i}") == 0, F.lit(c)) for i, c in enumerate(columns)]), lambda c: c.isNotNull())
    placed = placed.withColumn("absent", absent)
    rows = lines.join(placed, "file_path").filter((F.col("file_block_start") > 0) | (F.col("line") != F.col("top"))).withColumn("fields", split_csv(F.col("line")))
    reason = F.when(F.size("absent") > 0, F.concat(F.lit("no column "), F.array_join("absent", ", "))).when(F.size("fields") > F.col("wide"), "too many fields")
    value = lambda i: F.when(F.col(f"at_{i}") > 0, F.trim(F.get("fields", F.col(f"at_{i}") - 1)))
    rows = rows.withColumn("reason", reason)
    return rows.select(*[F.when(F.col("reason").isNull(), value(i)).alias(c) for i, c in enumerate(columns)], "file_path", "line", "reason")


COMBINED = {"recursiveFileLookup": "true", "pathGlobFilter": "*.csv"}
VARIED = {"recursiveFileLookup": "true", "pathGlobFilter": "galaxy.csv"}


def combine_reports(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """A3: all per-object CSVs under a tree except the arc tables, by the header of each; empty and header-only files add no rows.

    What is left out is in :func:`rejected_lines`.
    """
    return report_lines(spark, root, columns, "_arcs.csv", **COMBINED).filter("reason is null").select(*columns)


def rejected_lines(spark: SparkSession, root: str, columns: list[str], skip_ending: str = "_arcs.csv", lookup: dict[str, str] | None = None) -> DataFrame:
    """A3, A4: the lines that the readers leave out: ``file_path``, ``line`` and ``reason``."""
    rows = report_lines(spark, root, columns, skip_ending, **(lookup or COMBINED))
    return rows.filter("reason is not null").select("file_path", "line", "reason")


def read_variations(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """A4: per-object reports ``<object>/2-OUT/galaxy.csv`` by the header of each; good fits only, lines with too many fields left out."""
    owner = F.regexp_extract("file_path", r"([^/]+)/2-OUT/galaxy\.csv$", 1)
    rows = report_lines(spark, root, columns, **VARIED).filter("reason is null").withColumn("object_id", owner)
    return rows.select(*columns, "object_id").filter((F.col("object_id") != "") & (F.trim("fit_state") == "OK"))


def list_images(spark: SparkSession, root: str, pattern: str = r"(?i)\.fits$") -> DataFrame:
    """A5: image files under a tree, in the order of their paths. Only listing columns are read, never the content."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", "length", "modificationTime").filter(F.col("path").rlike(pattern)).orderBy("path")


IMAGE_PATTERN = r"(?i)\.(fits\.gz|fits|fit|png)$"


def image_kind(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, IMAGE_PATTERN, 1))
    return F.when(ending == "png", "png").when(ending != "", "fits")


def majority_images(listing: DataFrame) -> DataFrame:
    """A5: keep the images of the more frequent kind; FITS on a tie."""
    tagged = listing.withColumn("kind", image_kind(F.col("path"))).filter("kind is not null")
    votes = tagged.groupBy("kind").agg(F.count("*").alias("n"))
    # Two rows at most.
    winner = votes.agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))
    return tagged.join(F.broadcast(winner), "kind", "left_semi")


def manifest_rows(lines: DataFrame, header: list[str] | None) -> DataFrame:
    """(data_uri, product_filename) of level-3 rows.

    ``lines`` has one array column ``fields``; ``header`` is the first line. With the three key names in it the fields
    are taken by name and the header line dropped, else by the legacy positions.
    """
    clean = [h.strip() for h in (header or [])]

    def field(i: int) -> Column:
        return F.trim(F.coalesce(F.get("fields", F.lit(i)), F.lit("")))

    if {"dataURI", "productFilename", "calib_level"} <= set(clean):
        uri, name, level = (field(clean.index(c)) for c in ("dataURI", "productFilename", "calib_level"))
        wide = F.lit(True)
    else:
        uri, name, level = field(LEGACY_URI), field(LEGACY_NAME), field(LEGACY_LEVEL)
        wide = F.size("fields") >= LEGACY_WIDTH
    rows = lines.filter(wide & (level == "3") & (uri != "") & (name != ""))
    return rows.select(uri.alias("data_uri"), name.alias("product_filename"))


def read_download_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A9 on a file: one line is read to learn the layout."""
    header = header_of(spark, path)
    lines = spark.read.text(path).select(split_csv(F.col("value")).alias("fields"))
    return manifest_rows(lines, header)


def split_csv(line: Column) -> Column:
    """Fields of a CSV line; quoted fields may hold commas, doubled quotes stand for one."""
    raw = F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(
        raw,
        lambda t: F.when(t.startswith('"'), F.replace(F.regexp_replace(t, r'^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(t),
    )


PORTAL_SKIP, PORTAL_COLUMN = 4, "dataURI"


def portal_uris(spark: SparkSession, path: str, skip: int = PORTAL_SKIP, column: str = PORTAL_COLUMN, mosaics_only: bool = True) -> DataFrame:
    """A10: URIs of a portal's CSV export, by name from the first line after ``skip`` lines that is not blank; of mosaics only, or all that are not empty.

    Reads the first lines to learn the header. Lines of the first block that equal one of them are no rows.
    """
    top = [r[0] for r in spark.read.text(path).take(skip + 20)]
    at = next((i for i, line in enumerate(top) if i >= skip and line.strip()), None)
    header = [] if at is None else [c.strip() for c in next(csv.reader([top[at]], skipinitialspace=True))]
    if column not in header:
        raise ValueError(f"no column {column} after the first {skip} lines of {path}")
    rows = spark.read.text(path).select("value", "_metadata.file_block_start")
    rows = rows.filter((F.col("file_block_start") > 0) | ~F.col("value").isin(top[: at + 1]))
    uri = F.trim(F.get(split_csv(F.col("value")), F.lit(header.index(column)))).alias("uri")
    return rows.select(uri).filter(F.col("uri").endswith("_i2d.fits") if mosaics_only else F.col("uri") != "")


def source_manifest(rows: DataFrame, extras: list[str]) -> DataFrame:
    """Base fields, then the extra fields taken from the ``extras`` map column, ordered by scope and position."""
    base = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in SOURCE_BASE_FIELDS]
    more = [F.coalesce(F.get(F.array(F.col("extras")[e]), F.lit(0)), F.lit("")).alias(e) for e in extras]
    order = [F.col("scope"), F.col("ra").try_cast("double"), F.col("dec").try_cast("double")]
    return rows.select(*base, *more).orderBy(*order)


def extra_fields(rows: DataFrame) -> list[str]:
    """Sorted names found in the ``extras`` maps; field names are few, the job is one aggregate."""
    found = rows.select(F.explode(F.map_keys("extras")).alias("k")).distinct().orderBy("k")
    return [r[0] for r in found.toLocalIterator()]


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Plain CSV output; many files, so no task holds the whole table."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_shards(df: DataFrame, path: str, number: str, capacity: int) -> None:
    """Records in numbered shards of ``capacity``."""
    sharded = df.withColumn("shard", names.shard_number(F.col(number), capacity))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def csv_name(path: str) -> str:
    """Outputs of the scorer always end in .csv."""
    if path.lower().endswith(".csv"):
        return path
    folder, slash, last = path.rpartition("/")
    stem = last.rsplit(".", 1)[0] if "." in last else last
    return f"{folder}{slash}{stem}.csv"


def write_predictions(df: DataFrame, path: str) -> None:
    """A13."""
    columns = ["name", "predicted_P_spiral", "tree_std", "flagged_non_galaxy", "low_confidence"]
    write_csv(df.select(*columns), csv_name(path))


def write_by_label(df: DataFrame, path: str, label: str) -> None:
    """One folder per score bin or class."""
    df.write.mode("overwrite").partitionBy(label).parquet(path)


def write_overlap(df: DataFrame, path: str) -> None:
    """RA and DEC of matched rows."""
    write_csv(df.select(F.col("ra").alias("RA"), F.col("dec").alias("DEC")), path)
