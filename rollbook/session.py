"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(
    app: str = "rollbook", cores: str = "*", partitions: int = 8, scratch: str | None = None
) -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if scratch:
        builder = builder.config("spark.checkpoint.dir", scratch)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}  # application -> the folder of a local session without the setting


def read_table(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    A machine-local folder is used only where the setting is missing on a local
    master; elsewhere executors would not see it, so that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="rollbook-")
        _LOCAL[app] = base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Rows written once to the shared folder and read back."""
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that a job of this library wrote, wherever Spark keeps it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(
    spark: SparkSession,
    sf_dir: str,
    label: str,
    build: Callable[[SparkSession, str], DataFrame],
    folders: tuple[str, ...] = (),
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A derived table, written once per application to the shared folder and read back, by ``folders`` of some columns.

    What is read more than once (the registry, the block archive, the folded
    ledger) is a Parquet table here, not a lineage that is computed again: filters
    and column selection reach the files and a lost executor costs one re-read.
    """
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _STORED:
        path = scratch_dir(spark, label)
        build(spark, sf_dir).write.options(**(options or {})).partitionBy(*folders).parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
