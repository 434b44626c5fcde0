"""Freshness, absence and inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import rounded

#: Most rows of a metric catalog: it becomes part of the plan.
MOST_METRICS = 5000


def freshness(samples: DataFrame, as_of: Column, stale_hours: int = 48) -> DataFrame:
    """Per user: age of the newest sample in hours, and fresh or stale."""
    newest = samples.groupBy("user_id").agg(F.max("started_at").alias("newest"))
    age = (F.unix_micros(as_of) - F.unix_micros("newest")) / F.lit(3600e6)
    return newest.select("user_id", rounded(age, 1).alias("age_hours"), F.when(age <= stale_hours, "fresh").otherwise("stale").alias("status"))


def metric_inventory(samples: DataFrame) -> DataFrame:
    return samples.groupBy("metric_type").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"), F.unix_timestamp(F.min("started_at")).alias("earliest"), F.unix_timestamp(F.max("started_at")).alias("latest"))


def absence(users: DataFrame, catalog: DataFrame, in_window: DataFrame, ever: DataFrame) -> DataFrame:
    """Why a user has no rows of a metric: null where there are some, else the likely cause.

    users: user_id. catalog: metric_type, always_expected, wearable, evidence. in_window and ever: user_id,
    metric_type of rows in the window, and in either tier at any time. The catalog has MOST_METRICS rows at most.
    """
    entries = catalog.select("metric_type", "always_expected", "wearable", "evidence").limit(MOST_METRICS + 1).collect()
    if len(entries) > MOST_METRICS:
        raise ValueError(f"a catalog of more than {MOST_METRICS} metrics")
    evidence = [e["metric_type"] for e in entries if e["evidence"]]
    facts = ever.groupBy("user_id").agg(F.lit(True).alias("any_data"), F.bool_or(F.coalesce(F.col("metric_type").isin(*evidence or [""]), F.lit(False))).alias("has_wearable"))
    mark = lambda df, c: df.select("user_id", "metric_type").distinct().withColumn(c, F.lit(True))
    wanted = F.array(*[F.struct(*[F.lit(e[c]).alias(c) for c in ("metric_type", "always_expected", "wearable")]) for e in entries]) if entries else F.expr("CAST(array() AS array<struct<metric_type: string, always_expected: boolean, wearable: boolean>>)")
    grid = users.select("user_id", F.inline(wanted))  # one row per user and catalog entry
    out = grid.join(mark(in_window, "here"), ["user_id", "metric_type"], "left").join(mark(ever, "seen"), ["user_id", "metric_type"], "left").join(facts, "user_id", "left")
    reason = (
        F.when(F.col("here"), None).when(~F.col("always_expected") | F.col("seen"), "empty_window").when(F.col("any_data").isNull(), "no_data_yet")
        .when(F.col("wearable") & ~F.coalesce("has_wearable", F.lit(False)), "no_recording_device").otherwise("never_recorded")
    )
    return out.select("user_id", "metric_type", reason.alias("reason"))
