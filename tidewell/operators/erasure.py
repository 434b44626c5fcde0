"""Erasure of users from a store: from its samples, its device rows and its rejected rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import SAMPLES
from ..sources.tables import PARTS, exists, parted, put, read_table, remove, scratch
from .store import erase_users

_TABLES = ("", "/devices")
_FOLDERS = ["stream", "batch"]


def _hit(spark: SparkSession, table: str, requests: DataFrame) -> DataFrame:
    """Partitions with rows of the users. Only user and partition columns are read."""
    return parted(read_table(spark, table, SAMPLES)).join(requests.select("user_id").distinct(), "user_id", "left_semi").select(*PARTS).distinct()


def erase_stored(spark: SparkSession, store: str, requests: DataFrame, request: str | None = None) -> None:
    """Takes all rows of the users (user_id) out of a store that ingest keeps. Partitions without them stay as they are, file by file.

    A call that breaks off is taken up by the same `request`. While a stream holds the store's lock it fails, as another
    stream would.
    """
    request = request or uuid.uuid4().hex
    users = requests.select("user_id").distinct()
    for table in (store + t for t in _TABLES):
        if exists(spark, f"{table}/rows"):
            hit = _hit(spark, table, users)
            put(spark, table, lambda table=table, hit=hit: (hit, erase_users(read_table(spark, table, SAMPLES, hit), users)), f"erase-{request}", 0)
    if exists(spark, f"{store}/rejected"):
        _rejected(spark, f"{store}/rejected", users)


def _rejected(spark: SparkSession, folder: str, users: DataFrame) -> None:
    """Writes the folders of rejected rows that hold the users anew; what is left of them is staged first."""
    rows = spark.read.parquet(folder)
    hit = rows.join(users, "user_id", "left_semi").select(*_FOLDERS).distinct()
    staged = scratch(spark, "rejected")
    rows.join(hit, _FOLDERS, "left_semi").join(users, "user_id", "left_anti").write.partitionBy(*_FOLDERS).parquet(f"{staged}/rows")
    hit.write.parquet(f"{staged}/hit")
    left = spark.read.schema(rows.schema).parquet(f"{staged}/rows")
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_FOLDERS).parquet(folder)
    kept = left.select(*_FOLDERS).distinct()
    for r in spark.read.parquet(f"{staged}/hit").join(kept, _FOLDERS, "left_anti").collect():  # folders without any row left: one name each
        remove(spark, f"{folder}/stream={r['stream']}/batch={r['batch']}")
    remove(spark, staged)


def still_stored(spark: SparkSession, store: str, requests: DataFrame) -> DataFrame:
    """The proof: user_id, table, rows of the users in any file under the store; empty after an erasure."""
    users, found = requests.select("user_id").distinct(), []
    for name, table in (("samples", store), ("devices", f"{store}/devices")):
        if exists(spark, f"{table}/rows"):
            found.append(read_table(spark, table, SAMPLES).select("user_id", F.lit(name).alias("table")))
    if exists(spark, f"{store}/rejected"):
        found.append(spark.read.parquet(f"{store}/rejected").select("user_id", F.lit("rejected").alias("table")))
    every = found[0] if found else spark.createDataFrame([], "user_id string, table string")
    for more in found[1:]:
        every = every.unionByName(more)
    return every.join(users, "user_id", "left_semi").groupBy("user_id", "table").agg(F.count(F.lit(1)).alias("rows"))
