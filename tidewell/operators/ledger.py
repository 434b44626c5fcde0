"""A ledger of compacted samples, so that history that is sent again is refused and not added a second time.

The ledger holds the keys of compacted rows by metric and month. Beside it stands a blocked Bloom filter: for every metric
and month blocks of 512 bits, some 13 bits a key. A row meets one block; only rows whose bits are all set are looked up
in the ledger itself, so false positives cost a look and nothing else, and new rows never meet the keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import MERGED_METRICS
from ..schema import KEY
from .store import _aggregated, _points, to_compact

LEDGER = "user_id string, metric_type string, source_device string, started_at timestamp, month string"
_GROUP = ("metric_type", "month")
_WORDS, _HASHES, KEYS_A_BLOCK = 8, 4, 40


def month(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def ledger_keys(rows: DataFrame) -> DataFrame:
    """The ledger rows of samples; to be stored by metric and month."""
    return rows.select(*KEY, month(F.col("started_at")).alias("month")).distinct()


def _key_hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in KEY])


def _bits() -> list[Column]:
    """The bits of a key, one column for each word of its block."""
    places = [F.pmod(_key_hash(1 + i), F.lit(64 * _WORDS)).cast("int") for i in range(_HASHES)]
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)
    zero = F.lit(0).cast("long")
    return [F.array(*[F.when(F.floor(p / 64) == w, bit(p)).otherwise(zero) for p in places]) for w in range(_WORDS)]


def _or(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def ledger_filter(ledger: DataFrame) -> DataFrame:
    """metric_type, month, blocks (how many there are), block, w0 to w7: the filter of a ledger."""
    sizes = ledger.groupBy(*_GROUP).agg(F.ceil(F.count(F.lit(1)) / KEYS_A_BLOCK).alias("blocks"))
    rows = ledger.join(sizes, list(_GROUP)).select(*_GROUP, "blocks", F.pmod(_key_hash(0), F.col("blocks")).alias("block"), *[_or(b).alias(f"w{w}") for w, b in enumerate(_bits())])
    return rows.groupBy(*_GROUP, "blocks", "block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(_WORDS)])


def _maybe_known(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (with month) and `maybe`: whether all bits of their key are set."""
    sizes = known.groupBy(*_GROUP).agg(F.max("blocks").alias("blocks"))  # one row for each metric and month
    asked = rows.join(sizes, list(_GROUP), "left").withColumn("block", F.pmod(_key_hash(0), F.col("blocks")))
    asked = asked.withColumns({f"_b{w}": _or(b) for w, b in enumerate(_bits())})
    met = asked.join(known, [*_GROUP, "blocks", "block"], "left")
    hit = F.lit(True)
    for w in range(_WORDS):
        hit = hit & (F.col(f"w{w}").bitwiseAND(F.col(f"_b{w}")) == F.col(f"_b{w}"))
    return met.withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*rows.columns, "maybe")


def split_known(rows: DataFrame, ledger: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that the ledger lacks, rows that it has). rows: samples; known: the ledger's filter."""
    told = _maybe_known(rows.withColumn("month", month(F.col("started_at"))), known)
    keys, asked = ["month", *KEY], told.where("maybe").drop("maybe")
    fresh = told.where("not maybe").drop("maybe").unionByName(asked.join(ledger, keys, "left_anti"))
    return fresh.select(*rows.columns), asked.join(ledger, keys, "left_semi").select(*rows.columns)


@dataclass(frozen=True)
class Compaction:
    """What a compaction gives: the samples that stay, all summaries, the ledger rows to append, refused samples, and counts by metric."""

    samples: DataFrame
    summaries: DataFrame
    ledger: DataFrame
    refused: DataFrame
    report: DataFrame


def compact_once(
    samples: DataFrame, summaries: DataFrame, ledger: DataFrame, known: DataFrame, cutoff: Column, as_of: Column, tz="UTC", quiet_hours: int = 24, kept_raw: tuple[str, ...] = MERGED_METRICS
) -> Compaction:
    """Compaction that takes each sample once: rows whose key the ledger has were summarised before and are refused, whatever their value.

    samples have unique keys. Refused rows leave the raw tier, too, so totals stay as they were. The report has mode, raw_rows,
    refused_rows and summary_rows (days and units written) for every metric with rows that were due. A second run without
    new rows writes nothing.
    """
    rows = samples.withColumn("_go", to_compact(cutoff, as_of, quiet_hours, kept_raw))
    due = rows.where("_go").drop("_go")
    fresh, again = split_known(due, ledger, known)
    new = _aggregated(_points(fresh, tz)).where("sample_count > 0")
    columns = ("user_id", "metric_type", "summary_date", "unit")
    parts = summaries.select(*columns, "min_value", "max_value", "sum_value", "sample_count").unionByName(new)
    merged = parts.groupBy(*columns).agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("sum_value").alias("sum_value"), F.sum("sample_count").alias("sample_count"))
    merged = merged.withColumn("avg_value", F.col("sum_value") / F.nullif(F.col("sample_count"), F.lit(0)))
    count = lambda df, c: df.groupBy("metric_type").agg(F.count(F.lit(1)).alias(c))
    report = count(due, "_due").join(count(fresh, "raw_rows"), "metric_type", "left").join(count(again, "refused_rows"), "metric_type", "left").join(count(new, "summary_rows"), "metric_type", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    report = report.select("metric_type", F.lit("compact").alias("mode"), zero("raw_rows"), zero("refused_rows"), zero("summary_rows"))
    return Compaction(rows.where("not _go").drop("_go"), merged, ledger_keys(fresh), again, report)
