"""Session helpers: settings that may change at run time, and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Run-time settings the library relies on; cluster sizing (memory, executors) stays with the caller.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even when that costs one more shuffle after the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skytable")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for name, value in RUNTIME_SETTINGS.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Set the run-time settings on a session somebody else made."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    # Python workers find the library where the driver found it, whatever folder they start in.
    root, environment = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; a cluster without the setting is an error, because
    a machine-local folder would not survive the loss of that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    made = tempfile.mkdtemp(prefix="skytable-")
    context.setCheckpointDir(made)
    return context.getCheckpointDir()


_written: list[str] = []


def scratch_path(spark: SparkSession) -> str:
    """A new name in the shared folder; what is written there is deleted with the tables of this process."""
    _written.append(f"{shared_dir(spark).rstrip('/')}/skytable-{uuid.uuid4().hex}")
    return _written[-1]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to shared storage and read back, so that a lost executor costs one read, not the whole history.

    A written table computes its input once; ``checkpoint()`` without a cache would compute it twice.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_tables() -> list[str]:
    """The tables that :func:`cut_lineage` wrote in this process and that are still there, oldest first."""
    return list(_written)


def forget_written(spark: SparkSession, tables: list[str] | None = None) -> int:
    """Delete tables that :func:`cut_lineage` wrote in this process, all or the given ones; returns how many. Results built on them become invalid."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    for name in written_tables() if tables is None else [t for t in tables if t in _written]:
        _written.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        done += int(path.getFileSystem(conf).delete(path, True))
    return done
