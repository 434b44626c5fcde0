"""Validation, de-duplication, merged hours and compaction, as pure functions of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import MERGED_METRICS
from ..functions.numbers import rounded
from ..functions.time import local_day, touched_hours
from ..schema import ISO_INSTANT, KEY, MAX_INTERVAL_DAYS, MAX_LIMIT, MAX_METADATA, MAX_TEXT, MERGED_SOURCE, PLACEHOLDERS


def user_key(user: Column) -> Column:
    """A user id in its one form: trimmed, lower case; null for blanks and placeholders."""
    u = F.lower(F.trim(user.cast("string")))
    return F.when(~u.isin(*PLACEHOLDERS), u)


def reject_reason(allowed_merged: tuple[str, ...] = (), pattern: str | None = None, texts: bool = False) -> Column:
    """The first rule that a sample row breaks, or null.

    pattern: what metric types have to match. texts: the row also has the columns started_text, ended_text and
    batch_rows of from_payloads, and the rules on the texts as they came are checked too.
    """
    long = lambda c: F.coalesce(F.length(c) > MAX_TEXT, F.lit(False))
    merged = F.col("source_device") == MERGED_SOURCE
    out = F.when(F.col("user_id").isNull(), "no user").when(F.coalesce(F.trim("metric_type"), F.lit("")) == "", "no metric").when(long("metric_type") | long("unit") | long("source_device"), "text too long")
    out = out.when(F.col("started_at").isNull(), "bad started_at").when(F.coalesce(F.octet_length("metadata") > MAX_METADATA, F.lit(False)), "metadata too large")
    no_object = F.col("metadata").isNotNull() & (~F.ltrim("metadata").startswith("{") | F.get_json_object("metadata", "$").isNull())
    out = out.when(no_object, "metadata is no object")
    out = out.when(F.coalesce(F.col("ended_at") > F.col("started_at") + F.expr(f"INTERVAL {MAX_INTERVAL_DAYS} DAYS"), F.lit(False)), "interval too long")
    if pattern:
        out = out.when(~F.col("metric_type").rlike(pattern), "bad metric type")
    if texts:
        out = out.when(F.col("ended_text").isNotNull() & F.col("ended_at").isNull(), "bad ended_at").when(F.col("batch_rows") > MAX_LIMIT, "batch too large")
        strict = F.col("started_text").rlike(ISO_INSTANT) & F.coalesce(F.col("ended_text").rlike(ISO_INSTANT), F.lit(False))
        out = out.when(merged & ~strict, "not a strict instant")
    whole = (F.date_trunc("hour", "started_at") == F.col("started_at")) & F.coalesce(F.col("ended_at") == F.col("started_at") + F.expr("INTERVAL 1 HOUR"), F.lit(False)) & F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    out = out.when(merged & ~F.col("metric_type").isin(*allowed_merged or ("",)), "metric is not merged").when(merged & ~whole, "not a whole hour")
    return out


def validate(samples: DataFrame, allowed_merged: tuple[str, ...] = (), mode: str = "row", batch_col: str = "batch_id", **rules) -> DataFrame:
    """Adds reject_reason; mode="batch" rejects all rows of a batch that has a bad one. rules: those of reject_reason."""
    out = samples.withColumn("reject_reason", reject_reason(allowed_merged, **rules))
    if mode == "batch":
        w = Window.partitionBy(batch_col)
        out = out.withColumn("reject_reason", F.coalesce("reject_reason", F.when(F.max("reject_reason").over(w).isNotNull(), "batch rejected")))
    return out


def dedupe_latest(samples: DataFrame, order: Column, key=KEY) -> DataFrame:
    """Per key the row that comes last."""
    return samples.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(order.desc()))).where("_rn = 1").drop("_rn")


def upserted(store: DataFrame, batch: DataFrame, key=KEY) -> DataFrame:
    """The store with the batch's rows in place of those of equal key; the batch's keys have to be unique."""
    return store.join(batch.select(*key), list(key), "left_anti").unionByName(batch)


def missing_only(store: DataFrame, batch: DataFrame, key=KEY) -> DataFrame:
    """The batch's rows whose key the store lacks."""
    return batch.join(store.select(*key), list(key), "left_anti")


def _hours(rows: DataFrame) -> DataFrame:
    return rows.select("user_id", "metric_type", F.date_trunc("hour", "started_at").alias("hour")).distinct()


def replace_merged_hours(store: DataFrame, merged: DataFrame) -> DataFrame:
    """Device rows of the merged rows' hours go; the merged rows come in (or replace themselves)."""
    device = F.col("source_device") != MERGED_SOURCE
    rest = store.where(device).withColumn("hour", F.date_trunc("hour", "started_at")).join(_hours(merged), ["user_id", "metric_type", "hour"], "left_anti").drop("hour")
    return upserted(rest.unionByName(store.where(~device)), merged)


def double_counted(store: DataFrame) -> DataFrame:
    """Device rows inside an hour that has a merged row."""
    device = F.col("source_device") != MERGED_SOURCE
    return store.where(device).withColumn("hour", F.date_trunc("hour", "started_at")).join(_hours(store.where(~device)), ["user_id", "metric_type", "hour"], "left_semi").drop("hour")


def hourly_totals(samples: DataFrame) -> DataFrame:
    """Whole-hour totals by the hour in which samples start; an hour without a value has total 0."""
    hour = F.date_trunc("hour", "started_at")
    return samples.groupBy("user_id", "metric_type", hour.alias("started_at"), "unit").agg(rounded(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("value"), F.count(F.lit(1)).alias("device_rows"))


_HOUR = ["user_id", "metric_type", "hour"]


def in_one_unit(samples: DataFrame, units: DataFrame) -> DataFrame:
    """Samples with `canon` and `amount`: their canonical unit and the value in it; a unit that isn't in units (unit, canonical, factor) is its own."""
    known = units.select(F.col("unit").alias("_unit"), F.col("canonical").alias("_canonical"), F.col("factor").alias("_factor"))
    out = samples.join(known, samples["unit"].eqNullSafe(F.col("_unit")), "left")
    return out.withColumns({"canon": F.coalesce("_canonical", "unit", F.lit("")), "amount": F.col("value") * F.coalesce("_factor", F.lit(1.0))}).drop("_unit", "_canonical", "_factor")


def merged_hours(store: DataFrame, batch: DataFrame, units: DataFrame, not_before: Column | None = None, priority: Column | None = None) -> DataFrame:
    """A whole merged row for every UTC hour that the batch's intervals touch, from the device rows that the store holds (the batch among them).

    An hour's total has one unit: that of most of its rows (ties: first by name) in canonical units; rows of other units
    don't count. An hour in which no row starts gets 0, in the batch's unit. Hours before the one of not_before are left
    out. With priority, rows that overlap a better source's row are dropped first (drop_overlaps).
    """
    every = in_one_unit(store.where(F.col("source_device") != MERGED_SOURCE), units)
    hours = hours_touched(in_one_unit(batch.where(F.col("source_device") != MERGED_SOURCE), units))
    if not_before is not None:
        hours = hours.where(F.col("hour") >= F.date_trunc("hour", not_before))
    hours = hours.groupBy(*_HOUR).agg(F.min("canon").alias("own_unit"))
    rows = every.withColumn("hour", F.date_trunc("hour", "started_at")).join(hours.select(*_HOUR), _HOUR, "left_semi")
    if priority is not None:
        # What may overlap a row of these hours touches an hour that such a row touches.
        near = hours_touched(rows).select(*_HOUR).distinct()
        beside = hours_touched(every).join(near, _HOUR, "left_semi").select(*KEY).distinct()
        rows = drop_overlaps(every.join(beside, list(KEY), "left_semi"), priority).withColumn("hour", F.date_trunc("hour", "started_at")).join(hours.select(*_HOUR), _HOUR, "left_semi")
    sums = rows.groupBy(*_HOUR, "canon").agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"), F.max("synced_at").alias("synced_at"))
    best = sums.groupBy(*_HOUR).agg(F.min_by(F.struct("total", "canon", "synced_at"), F.struct(-F.col("n"), F.col("canon"))).alias("s"))
    end = F.col("hour") + F.expr("INTERVAL 1 HOUR")
    return hours.join(best, _HOUR, "left").select(
        "user_id", "metric_type", rounded(F.coalesce("s.total", F.lit(0.0)), 4).alias("value"), F.coalesce("s.canon", "own_unit").alias("unit"), F.lit(MERGED_SOURCE).alias("source_device"), F.col("hour").alias("started_at"),
        end.alias("ended_at"), F.lit(None).cast("string").alias("metadata"), F.coalesce("s.synced_at", end).alias("synced_at"),
    )


def reemit_hours(store: DataFrame, batch: DataFrame, units: DataFrame, not_before: Column | None = None, priority: Column | None = None) -> DataFrame:
    """The store with the batch's merged_hours in place of those hours' device rows of the same unit; the store already holds the batch.

    Totals are of whole hours, by the hour in which rows start, so a repeated delivery gives them again alike. Device rows
    in a unit that the total hasn't stay beside it. Rows that have been replaced are gone, so an hour that may be touched
    again has to keep its device rows elsewhere, as ingest does.
    """
    device = F.col("source_device") != MERGED_SOURCE
    merged = merged_hours(store, batch, units, not_before, priority)
    taken = merged.select("user_id", "metric_type", F.col("started_at").alias("hour"), F.col("unit").alias("canon"))
    rows = in_one_unit(store.where(device), units).withColumn("hour", F.date_trunc("hour", "started_at"))
    rest = rows.join(taken, [*_HOUR, "canon"], "left_anti").select(*store.columns)
    return upserted(rest.unionByName(store.where(~device)), merged.select(*store.columns))


def hours_touched(samples: DataFrame) -> DataFrame:
    return samples.withColumn("hour", F.explode(touched_hours(F.col("started_at"), F.coalesce("ended_at", "started_at"))))


def drop_overlaps(samples: DataFrame, priority: Column, levels: int = 8) -> DataFrame:
    """Rows whose interval overlaps none of a better source (smaller priority, 0 to levels - 1) of the same user and metric.

    In each hour an interval touches, its start and its end are put in order of time; the latest end so far of each
    better level tells whether one that began before this row's end is still on after its start. No pairs are made.
    """
    end = F.coalesce("ended_at", "started_at")
    rows = hours_touched(samples.select(*KEY, "ended_at", priority.cast("int").alias("p"))).withColumn("end", end)
    marks = F.array(F.struct(F.col("end").alias("at"), F.lit(0).alias("kind")), F.struct(F.col("started_at").alias("at"), F.lit(1).alias("kind")))
    marks = rows.withColumn("p", F.when(F.col("p").between(0, levels - 1), F.col("p")).otherwise(F.raise_error(F.lit("priority outside the levels")).cast("int"))).select("*", F.inline(marks))
    w = Window.partitionBy("user_id", "metric_type", "hour").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = [F.max(F.when((F.col("kind") == 1) & (F.col("p") == i), F.col("end"))).over(w).alias(f"_{i}") for i in range(levels - 1)]
    seen = marks.select("*", *last)
    over = F.lit(False)
    for i in range(levels - 1):
        over = over | ((F.col("p") > i) & F.coalesce(F.col(f"_{i}") > F.col("started_at"), F.lit(False)))
    hit = seen.where((F.col("kind") == 0) & over).select(*KEY).distinct()
    return samples.join(hit, list(KEY), "left_anti")


def _points(samples: DataFrame, tz) -> DataFrame:
    return samples.withColumn("summary_date", local_day(F.col("started_at"), tz)).withColumn("unit", F.coalesce("unit", F.lit("")))


def _aggregated(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id", "metric_type", "summary_date", "unit").agg(
        F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.sum("value").alias("sum_value"), F.count("value").alias("sample_count")
    )


def recompute_summaries(samples: DataFrame, tz="UTC") -> DataFrame:
    """Days rebuilt from raw, only where every row of the day (all units) is merged."""
    rows = _points(samples, tz)
    clean = rows.groupBy("user_id", "metric_type", "summary_date").agg(F.bool_and(F.col("source_device") == MERGED_SOURCE).alias("clean")).where("clean").drop("clean")
    return _aggregated(rows.join(clean, ["user_id", "metric_type", "summary_date"])).where("sample_count > 0").withColumn("avg_value", F.col("sum_value") / F.col("sample_count"))


def summarizable(metric: Column) -> Column:
    """Quantities are summarised; categories and workouts never are."""
    return ~metric.startswith("HKCategory") & ~metric.startswith("HKWorkout")


def to_compact(cutoff: Column, as_of: Column, quiet_hours: int = 24, kept_raw: tuple[str, ...] = ()) -> Column:
    """Rows that compaction takes: of summarizable metrics that aren't kept raw, before the cutoff, and not synced within the quiet period."""
    m = F.col("metric_type")
    old = (F.col("started_at") < cutoff) & (F.col("synced_at") < as_of - F.expr(f"INTERVAL {quiet_hours} HOURS"))
    return F.coalesce(old & summarizable(m) & ~m.isin(*kept_raw or ("",)), F.lit(False))


def compact(samples: DataFrame, summaries: DataFrame, cutoff: Column, as_of: Column, tz="UTC", quiet_hours: int = 24, kept_raw: tuple[str, ...] = MERGED_METRICS) -> tuple[DataFrame, DataFrame]:
    """(samples that stay, summaries with the others merged in): one predicate decides both, so no row is lost or counted twice.

    Categories, workouts and the metrics of `kept_raw` stay raw; merged metrics are among these, since their days are
    rebuilt by recompute_summaries. compaction_plan tells which metrics that concerns.
    """
    rows = _points(samples, tz).withColumn("_go", to_compact(cutoff, as_of, quiet_hours, kept_raw))
    new = _aggregated(rows.where("_go")).where("sample_count > 0")
    parts = summaries.select("user_id", "metric_type", "summary_date", "unit", "min_value", "max_value", "sum_value", "sample_count").unionByName(new)
    merged = parts.groupBy("user_id", "metric_type", "summary_date", "unit").agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum_value").alias("sum_value"), F.sum("sample_count").alias("sample_count"))
    return rows.where("not _go").drop("_go", "summary_date"), merged.withColumn("avg_value", F.col("sum_value") / F.nullif(F.col("sample_count"), F.lit(0)))


def compaction_totals(samples: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per user and metric the rows and sums of both tiers, to be equal before and after compaction."""
    raw = samples.groupBy("user_id", "metric_type").agg(F.count("value").alias("raw_rows"), F.sum("value").alias("raw_sum"))
    done = summaries.groupBy("user_id", "metric_type").agg(F.sum("sample_count").alias("summary_rows"), F.sum("sum_value").alias("summary_sum"))
    zero = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return raw.join(done, ["user_id", "metric_type"], "full").select(
        "user_id", "metric_type", zero("raw_rows", 0), zero("summary_rows", 0), rounded(F.coalesce("raw_sum", F.lit(0.0)) + F.coalesce("summary_sum", F.lit(0.0)), 2).alias("total_sum")
    )


def recompute_mismatches(expected: DataFrame, summaries: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Expected summaries that the stored ones lack or contradict."""
    s = summaries.select("user_id", "metric_type", "summary_date", "unit", F.col("sum_value").alias("stored_sum"), F.col("sample_count").alias("stored_count"))
    return expected.join(s, ["user_id", "metric_type", "summary_date", "unit"], "left").where(
        F.col("stored_sum").isNull() | (F.abs(F.col("sum_value") - F.col("stored_sum")) > tolerance) | (F.col("sample_count") != F.col("stored_count"))
    )


def erase_users(table: DataFrame, requests: DataFrame) -> DataFrame:
    return table.join(requests.select("user_id"), ["user_id"], "left_anti")
