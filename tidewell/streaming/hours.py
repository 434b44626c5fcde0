"""Whole-hour totals of a sample stream with state: each UTC day keeps the device rows that matter to its hours.

The state is keyed by UTC day and by a bucket of users and metrics, so that a call of Python serves many of them. A row goes
to the days it touches and to that of `reach` hours before its start, whose rows it may overlap; no row lasts longer than
that. A new, late or repeated row puts itself into the state of its days, and each hour that it touches, or whose total it
changes, comes out once a batch as a whole: a total replaces the one before. By event time, rows that come more than `keep`
days after the newest one are too late and dropped, and a day's state ends when no row in time can matter to it any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.store import in_one_unit
from ..schema import MERGED_SOURCE, SAMPLES

TOTALS = "user_id string, metric_type string, started_at timestamp, value double, unit string, device_rows long"
_HOUR = 3_600_000_000
#: Buckets of users and metrics, a day's calls of Python in a batch. A checkpoint holds state by them: another number needs a new checkpoint.
_BUCKETS = 128


def _overlapped(start: np.ndarray, end: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Whether each interval overlaps one of a better level (a smaller number)."""
    out = np.zeros(len(start), bool)
    for p in np.unique(level)[1:]:
        better, own = np.flatnonzero(level < p), np.flatnonzero(level == p)
        better = better[np.argsort(start[better], kind="stable")]
        latest = np.concatenate([[np.iinfo(np.int64).min], np.maximum.accumulate(end[better])])
        out[own] = latest[np.searchsorted(start[better], end[own], side="left")] > start[own]
    return out


_STATE = "rows binary"
_HELD = pa.schema({"user_id": pa.string(), "metric_type": pa.string(), "source_device": pa.string(), "start": pa.int64(), "end": pa.int64(), "amount": pa.float64(), "canon": pa.string(), "level": pa.int64()})


def _packed(rows: dict[str, np.ndarray]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
        w.write_batch(pa.record_batch([pa.array(rows[f.name], f.type, from_pandas=True) for f in _HELD], schema=_HELD))
    return sink.getvalue().to_pybytes()


def _unpacked(state: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(state).read_next_batch()
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _HELD.names}


def _touched(start: np.ndarray, end: np.ndarray, day: int) -> tuple[np.ndarray, np.ndarray]:
    """The hours (0 to 23) of the day that each interval touches, and the interval's position beside each."""
    first, last = np.maximum(start // _HOUR * _HOUR, day), np.minimum(np.maximum(end - 1, start) // _HOUR * _HOUR, day + 23 * _HOUR)
    n = np.maximum((last - first) // _HOUR + 1, 0)
    at = np.repeat(np.arange(len(n)), n)
    return (first[at] - day) // _HOUR + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n), at


def _totals(who: np.ndarray, start: np.ndarray, end: np.ndarray, amount: np.ndarray, unit: np.ndarray, level: np.ndarray, day: int) -> tuple[np.ndarray, ...]:
    """Slots (24 * who + hour) that rows touch, in order, with the total, unit and number of rows of each one's most frequent unit."""
    if not len(who):
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    lot = who * (end.max() - start.min() + 1) - start.min()  # sets one's rows apart from the next one's
    hour, at = _touched(start, end, day)
    own = np.flatnonzero(~_overlapped(start + lot, end + lot, level) & (start >= day) & (start < day + 24 * _HOUR))
    kinds = unit.max() + 1
    pair = np.concatenate([(24 * who[at] + hour) * kinds + unit[at], (24 * who[own] + (start[own] - day) // _HOUR) * kinds + unit[own]])
    pair, of = np.unique(pair, return_inverse=True)
    n = np.bincount(of[len(at) :], minlength=len(pair))
    value = np.bincount(of[len(at) :], amount[own], len(pair))
    best = np.lexsort((pair % kinds, -n, pair // kinds))
    slot, first = np.unique(pair[best] // kinds, return_index=True)
    best = best[first]
    return slot, value[best], pair[best] % kinds, n[best]


def _day_totals(reach: int | None):
    def update(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """The state of a bucket's day: its device rows, one of a user, metric, source and start."""
        day = int(key[1])
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(parts)
        rows = {c: np.concatenate([part[c].to_numpy() for part in parts]) for c in _HELD.names}
        if rows["level"].dtype.kind == "f":  # as pandas has whole numbers with nulls
            raise ValueError("a sample has no priority")
        rows["amount"] = np.where(np.isnan(rows["amount"]), 0.0, rows["amount"])
        old = _unpacked(state.get[0]) if state.exists else {c: v[:0] for c, v in rows.items()}
        rows, new = {c: np.concatenate([old[c], v]) for c, v in rows.items()}, len(old["start"])
        user, metric, source = (pd.factorize(rows[c], use_na_sentinel=False)[0] for c in ("user_id", "metric_type", "source_device"))
        who = pd.factorize(user * (metric.max() + 1) + metric)[0].astype(np.int64)
        unit, units = pd.factorize(rows["canon"], sort=True)
        order = np.lexsort((rows["start"], source, who))  # of a row that came again the last one stays
        again = np.ones(len(who) - 1, bool)
        for c in (who, source, rows["start"]):
            again &= c[order[1:]] == c[order[:-1]]
        kept = np.ones(len(who), bool)
        kept[order[:-1][again]] = False
        moved = np.isin(who, who[new:])  # users and metrics with new rows
        columns = (who, rows["start"], rows["end"], rows["amount"], unit.astype(np.int64), rows["level"])
        was, now = (_totals(*(c[which] for c in columns), day) for which in (np.flatnonzero(moved[:new]), np.flatnonzero(moved & kept)))
        hour, at = _touched(rows["start"][new:], rows["end"][new:], day)
        slot = now[0]
        same = np.zeros(len(slot), bool)
        _, i, j = np.intersect1d(slot, was[0], assume_unique=True, return_indices=True)
        same[i] = (now[1][i] == was[1][j]) & (now[2][i] == was[2][j]) & (now[3][i] == was[3][j])
        out = np.flatnonzero(np.isin(slot, 24 * who[new:][at] + hour) | ~same)
        state.update((_packed({c: v[kept] for c, v in rows.items()}),))
        if reach is not None:
            state.setTimeoutTimestamp((day + (25 + reach) * _HOUR) // 1000)
        if len(out):
            first = np.unique(who, return_index=True)[1][slot[out] // 24]
            yield pd.DataFrame({"user_id": rows["user_id"][first], "metric_type": rows["metric_type"][first], "started_at": (day + slot[out] % 24 * _HOUR).astype("datetime64[us]"), "value": now[1][out], "unit": units[now[2][out]], "device_rows": now[3][out]})

    return update


def routed(samples: DataFrame, units: DataFrame, priority: Column, reach: int) -> DataFrame:
    """A row for every sample and day whose state it belongs to. A sample that lasts longer than `reach` hours (24 at most) is an error."""
    end = F.greatest(F.coalesce("ended_at", "started_at"), F.col("started_at"))
    rows = in_one_unit(samples.where(F.col("source_device") != MERGED_SOURCE), units).withColumns({"_end": end, "level": priority.cast("int")})
    fits = F.col("_end") <= F.col("started_at") + F.expr(f"INTERVAL {reach} HOURS")
    first = F.to_date(F.timestamp_add("HOUR", F.lit(-reach), F.date_trunc("hour", "started_at")))
    last = F.to_date(F.greatest(F.col("_end") - F.expr("INTERVAL 1 MICROSECOND"), F.col("started_at")))
    day = F.explode(F.when(fits, F.sequence(first, last)).otherwise(F.array(F.raise_error(F.lit("a sample lasts longer than the reach")).cast("date"))))
    out = rows.select("user_id", "metric_type", day.alias("_day"), "source_device", F.col("started_at").alias("event"), F.unix_micros("started_at").alias("start"), F.unix_micros("_end").alias("end"), "amount", "canon", "level")
    return out.select("user_id", "metric_type", F.unix_micros(F.col("_day").cast("timestamp")).alias("day"), "source_device", "event", "start", "end", "amount", "canon", "level")


def live_hours(spark: SparkSession, samples: str, out: str, checkpoint: str, units: DataFrame, priority: Column, reach: int = 24, keep: int | None = 30, max_files: int = 1000):
    """Drains Parquet files of samples (schema SAMPLES) into hour totals: each batch's hours go to a folder per batch of `out`.

    units: unit, canonical, factor. priority: as in drop_overlaps. reach: hours, 24 at most; keep: days that a row may be late
    (null: any, and state never ends). A restart goes on from the checkpoint; a batch that comes again is written again alike.
    """
    rows = routed(spark.readStream.schema(SAMPLES).option("maxFilesPerTrigger", max_files).parquet(samples), units, priority, reach)
    if keep is not None:
        rows = rows.withWatermark("event", f"{keep} days")
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("user_id", "metric_type"), F.lit(_BUCKETS)))
    totals = rows.groupBy("bucket", "day").applyInPandasWithState(_day_totals(None if keep is None else reach), TOTALS, _STATE, "Update", timeout)

    def put_hours(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return totals.writeStream.outputMode("update").foreachBatch(put_hours).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_hours(spark: SparkSession, out: str) -> DataFrame:
    """The newest total of each hour, as merged rows have them: user_id, metric_type, started_at, value, unit, device_rows."""
    rows = spark.read.schema(f"{TOTALS}, batch long").parquet(out)
    return rows.groupBy("user_id", "metric_type", "started_at").agg(F.max_by(F.struct("value", "unit", "device_rows"), "batch").alias("s")).select("user_id", "metric_type", "started_at", "s.*")
