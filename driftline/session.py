"""Session construction and the shared scratch area."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def build_session(app: str = "driftline", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Read from ``spark.checkpoint.dir``. Only where that is unset (tests on one
    machine) a temporary folder is made and remembered in the session; on a
    cluster, whose machines don't share such a folder, an unset one is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: The folder that what is written now goes to, below that of all.
_SCOPE: ContextVar[str | None] = ContextVar("scope", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    scope = _SCOPE.get()
    return f"{scratch_root(spark)}/driftline/{scope + '/' if scope else ''}{uuid.uuid4().hex}-{name}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Rows that are written between steps inside this block are deleted at its end, whatever task attempts have left there too; take results out before."""
    scope = uuid.uuid4().hex
    before = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/driftline/{scope}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, where it isn't installed or on their PYTHONPATH."""
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="driftline-package-")
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/driftline", "zip", os.path.dirname(here), os.path.basename(here)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint this survives the loss of an executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """Like ``written``, as a table bucketed by ``key``: joining or grouping it by the key doesn't shuffle it.

    There are as many buckets as shuffle partitions unless ``buckets`` says how
    many. Only the writer needs the catalog; the table's name leaves it at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    to = "driftline_" + path.rpartition("/")[2].replace("-", "_")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, key).format("parquet").saveAsTable(to)
    made = spark.table(to)
    spark.sql(f"DROP TABLE {to}")  # its files lie outside the warehouse and stay
    return made


def partitioned(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, with a folder for each value of ``key``, so that a join can leave whole values unread.

    Rows are brought together by the key first; adaptive execution splits a value that is large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.hint("rebalance", key).write.option("compression", "zstd").partitionBy(key).parquet(path)
    columns = [c for c in df.columns if c != key]
    return spark.read.schema(StructType([*[df.schema[c] for c in columns], df.schema[key]])).parquet(path).select(*df.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{os.fspath(sf_dir).rstrip('/')}/{name}.parquet")
