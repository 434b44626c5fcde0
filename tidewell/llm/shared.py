"""What the operators of this folder have in common: column access and tables that outlive executors."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """The column of exactly this name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that an operator's own names can't clash with them."""
    return F.struct(*[col(c) for c in df.columns]).alias(name)


@functools.cache
def _own_dir(application: str) -> str:
    return "file://" + tempfile.mkdtemp(prefix="tidewell-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local master may do without: its application gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = _own_dir(spark.sparkContext.applicationId)
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidewell/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there."""
    spark, path = df.sparkSession, new_path(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Shares that the rows of one key are dealt into, so that no key comes whole to one task.
SALTS = 60


def salted(*of: Column) -> Column:
    """The share of a row, by a hash of what tells the rows of one key apart."""
    return F.pmod(F.xxhash64(*of), F.lit(SALTS)).cast("int")


def salts_seen(salt: Column) -> Column:
    """An aggregate: the shares of a key that have rows, one bit each."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def each_salt(seen: Column) -> Column:
    """One row for each share in `seen`: what is known of a key goes to those of its shares that have rows, and to no others."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit(seen, s) == 1))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Gives this process's free memory back to the machine."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, whose worker gives its free memory back when a task has ended: workers live on, beside those of later operators."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def slices(batch, column: int, most: int):
    """The parts of an Arrow batch whose strings in `column` have at most `most` bytes together, or one row each."""
    import pyarrow.compute as pc

    start = total = 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if total and total + (n or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)
