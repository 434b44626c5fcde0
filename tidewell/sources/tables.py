"""Parquet tables by metric and day that batches change in place: whole new partitions are staged, then put in by dynamic overwrite.

A batch of a stream goes through four steps, each of which may be repeated: it takes the table's lock (a file that only
one writer can create), stages the new contents of every partition it touches, overwrites these partitions, and leaves a
mark. Whatever breaks off is taken up again by the same batch: what has been staged is put in as it is, so partitions that
were half replaced are replaced again. A stream that finds the lock of another one fails and changes nothing; its batch
comes again. Readers meanwhile see old or new partitions.
"""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("metric_type", "day")


@functools.cache
def _own_folder(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidewell-")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir. Only a local master may do without: its application gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _own_folder(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/tidewell/{what}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def _lock(spark: SparkSession, table: str, stream: str) -> None:
    """Takes the table's lock, a file that names its stream, unless the stream has it already; another's lock is an error."""
    fs, at = _file(spark, f"{table}/lock")
    try:
        out = fs.create(at, False)
    except Exception:  # noqa: BLE001  it is there, whichever error the file system has for that
        if not fs.exists(at):
            raise
        held = fs.open(at)
        owner = spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
        held.close()
        if owner != stream:
            raise RuntimeError(f"{table} is being written by stream {owner or '(unknown: remove its file lock by hand)'}") from None
    else:
        out.write(bytearray(stream.encode()))
        out.close()


def parted(rows: DataFrame) -> DataFrame:
    """Samples with the day (UTC) of their partition."""
    return rows.withColumn("day", F.to_date("started_at"))


def read_table(spark: SparkSession, table: str, schema: str, touched: DataFrame | None = None) -> DataFrame:
    """The table's rows; with `touched` (metric_type, day) those of these partitions only, the others aren't read.

    The driver gets the names of the touched metrics and days, never a partition's rows.
    """
    if not exists(spark, f"{table}/rows"):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, day date").parquet(f"{table}/rows")
    if touched is not None:
        few = touched.agg(F.collect_set("metric_type").alias("m"), F.collect_set("day").alias("d")).first()
        rows = rows.where(F.col("metric_type").isin(*few["m"] or [""]) & F.col("day").isin(*few["d"] or [None])).join(touched.select(*PARTS).distinct(), list(PARTS), "left_semi")
    return rows.select(*[f.split()[0] for f in schema.split(", ")])


def put(spark: SparkSession, table: str, made: Callable[[], tuple[DataFrame, DataFrame]], stream: str, batch: int) -> bool:
    """Puts in a batch, once: made() gives (touched partitions, whole new rows of them). False if it had been put in before.

    A touched partition that has no row left becomes empty.
    """
    mark, staged = f"{table}/done/{stream}/{batch}", f"{table}/staged/{stream}-{batch}"
    if exists(spark, mark):
        return False
    _lock(spark, table, stream)
    if not exists(spark, f"{staged}/rows/_SUCCESS"):
        remove(spark, staged)
        touched, rows = made()
        touched.select(*PARTS).distinct().write.parquet(f"{staged}/touched")
        # Small partitions share a task and have one file each, a large one is split by size.
        parted(rows).hint("rebalance", *PARTS).write.partitionBy(*PARTS).parquet(f"{staged}/rows")
    _overwrite(spark, table, staged)
    fs, at = _file(spark, mark)
    fs.createNewFile(at)
    remove(spark, staged)
    remove(spark, f"{table}/lock")
    return True


def _overwrite(spark: SparkSession, table: str, staged: str) -> None:
    touched = spark.read.schema("metric_type string, day date").parquet(f"{staged}/touched")
    if touched.isEmpty():
        return
    schema = spark.read.parquet(f"{staged}/rows").schema if _has_rows(spark, staged) else None
    if schema is None:
        left = touched
    else:
        rows = spark.read.parquet(f"{staged}/rows").withColumns({"metric_type": F.col("metric_type").cast("string"), "day": F.col("day").cast("date")})
        rows.hint("rebalance", *PARTS).sortWithinPartitions(*PARTS, "user_id", "started_at").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(f"{table}/rows")
        left = touched.join(rows.select(*PARTS).distinct(), list(PARTS), "left_anti")
    for r in left.collect():  # partitions that have lost all rows: one name each
        remove(spark, f"{table}/rows/{_folder(r)}")


def _has_rows(spark: SparkSession, staged: str) -> bool:
    fs, at = _file(spark, f"{staged}/rows")
    return any(s.getPath().getName().startswith(PARTS[0] + "=") for s in fs.listStatus(at))


def _folder(row) -> str:
    """The folder of a partition: Spark escapes a metric's name as it does for any partition column."""
    from pyspark import SparkContext

    escape = SparkContext._active_spark_context._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    return f"metric_type={escape(row['metric_type'])}/day={row['day']}"
