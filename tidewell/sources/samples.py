"""Reading samples: payload files, XML exports, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import MERGED_METRICS, SKIPPED_PREFIXES, SLEEP_METRIC, STAGE_VALUES, UNKNOWN_STAGE
from ..schema import PAYLOAD, SUMMARY_COLUMNS


def from_payloads(raw: DataFrame) -> DataFrame:
    """Rows of {user_id, samples: [...]} objects (read with schema PAYLOAD), empty batches giving none; instants of any offset.

    started_text, ended_text and batch_rows keep the instants as they were written and the batch's size, for validate;
    payload is a hash of the whole object, by which rows of one batch are known.
    """
    rows = raw.select("user_id", F.size("samples").alias("batch_rows"), F.xxhash64("user_id", "samples").alias("payload"), F.posexplode("samples").alias("batch_seq", "s")).select("user_id", "batch_rows", "payload", "batch_seq", "s.*")
    at = lambda c: F.try_to_timestamp(F.when(F.length(c) <= 64, F.col(c)))
    return rows.withColumns({
        "started_text": F.col("started_at"), "ended_text": F.col("ended_at"), "started_at": at("started_at"), "ended_at": at("ended_at"), "source_device": F.coalesce("source_device", F.lit("")),
    })


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return from_payloads(spark.read.schema(PAYLOAD).json(path))


def stage_code(name: Column) -> Column:
    """The code of a sleep stage's name, null for other texts."""
    at = F.array_position(F.array(*[F.lit(v) for v in STAGE_VALUES]), name)
    return F.when(at > 0, (at - 1).cast("double"))


def with_stage_names(samples: DataFrame, metric: str = SLEEP_METRIC) -> DataFrame:
    """Sleep samples get sleep_stage in their JSON metadata, unless it is there; other fields stay as they are written."""
    unknown, m = F.lit(UNKNOWN_STAGE), F.col("metadata")
    name = F.coalesce(F.get(F.array(*[F.lit(v) for v in STAGE_VALUES]), F.col("value").try_cast("int")), unknown)
    field = F.concat(F.lit('"sleep_stage":"'), name, F.lit('"'))
    own = F.when(F.trim(m).rlike(r"^\{\s*[^}\s]"), F.concat(F.regexp_replace(F.trim(m), r"\s*\}$", ""), F.lit(","), field, F.lit("}"))).otherwise(F.concat(F.lit("{"), field, F.lit("}")))
    lacks = (F.col("metric_type") == metric) & F.get_json_object("metadata", "$.sleep_stage").isNull()
    return samples.withColumn("metadata", F.when(lacks, own).otherwise(m))


def read_export_xml(spark: SparkSession, path: str, skip: tuple[str, ...] = SKIPPED_PREFIXES, refuse: tuple[str, ...] = MERGED_METRICS, stages: bool = True) -> DataFrame:
    """Record elements of an export. reason tells why a row isn't to be taken: skipped prefix, refused type, bad start.

    Names of sleep stages become their codes (with stages); any other value that isn't a finite number becomes null.
    """
    fields = "_type string, _value string, _unit string, _sourceName string, _startDate string, _endDate string"
    raw = spark.read.format("xml").option("rowTag", "Record").schema(fields).load(path)
    at = lambda c: F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd HH:mm:ss Z"))
    number = F.expr("try_cast(_value as double)")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    finite = F.coalesce(finite, stage_code(F.col("_value"))) if stages else finite
    kind = F.col("_type")
    prefixed: Column = F.lit(False)
    for p in skip:
        prefixed = prefixed | kind.startswith(p)
    reason = F.when(prefixed, "skipped").when(kind.isin(*refuse or ("",)), "refused").when(at("_startDate").isNull(), "bad start")
    return raw.select(
        F.left(kind, F.lit(256)).alias("metric_type"), finite.alias("value"), F.coalesce(F.left("_unit", F.lit(256)), F.lit("")).alias("unit"), F.coalesce(F.left("_sourceName", F.lit(256)), F.lit("")).alias("source_device"),
        at("_startDate").alias("started_at"), at("_endDate").alias("ended_at"), reason.alias("reason"),
    )


def scan_samples(samples: DataFrame, metric: str | None = None, since=None, until=None, source: str | None = None, users: DataFrame | None = None) -> DataFrame:
    """Filters that reach the Parquet scan; source is a literal substring, case aside."""
    out = samples
    if metric is not None:
        out = out.where(F.col("metric_type") == metric)
    if since is not None:
        out = out.where(F.col("started_at") >= since)
    if until is not None:
        out = out.where(F.col("started_at") < until)
    if source is not None:
        out = out.where(F.contains(F.lower("source_device"), F.lit(source.lower())))
    return out if users is None else out.join(users.select("user_id"), "user_id", "left_semi")


def scan_summaries(spark: SparkSession, path: str, metric: str | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """The summary tier of a metric and of days from since to until (inclusive), or all; the older column name `date` is read as summary_date. The filters reach the scan."""
    df = spark.read.parquet(path)
    df = df.withColumnRenamed("date", "summary_date") if "summary_date" not in df.columns else df
    if metric is not None:
        df = df.where(F.col("metric_type") == metric)
    if since is not None:
        df = df.where(F.col("summary_date") >= since)
    if until is not None:
        df = df.where(F.col("summary_date") <= until)
    return df.select(*[c for c in SUMMARY_COLUMNS if c in df.columns])


def normalise_units(samples: DataFrame, units: DataFrame) -> DataFrame:
    """units: unit, canonical, factor. Values in canonical units; unknown units are marked unsupported and left as they are."""
    out = samples.join(units, "unit", "left")
    return out.withColumns({"value": F.col("value") * F.coalesce("factor", F.lit(1.0)), "unsupported": F.col("canonical").isNull(), "unit": F.coalesce("canonical", "unit")}).drop("canonical", "factor")


def to_preferred_units(samples: DataFrame, preferred: DataFrame, units: DataFrame) -> DataFrame:
    """Values in their metric's preferred unit if it has the dimension of theirs, else in the dimension's fallback.

    preferred: metric_type, preferred. units: unit, dimension, factor, offset, fallback (catalog.unit_tables). Values of
    unknown units stay and are marked unsupported.
    """
    aim = units.select(F.col("unit").alias("_to"), F.col("dimension").alias("_dim"), F.col("factor").alias("_by"), F.col("offset").alias("_plus"))
    wanted = preferred.join(aim, F.col("preferred") == F.col("_to")).select("metric_type", "_dim", "_to", "_by", "_plus")
    own = units.select("unit", F.col("dimension").alias("_own"), F.col("factor").alias("_f"), F.col("offset").alias("_o"), F.col("fallback").alias("_back"))
    fits = F.col("_dim") == F.col("_own")  # the factor of a fallback is 1 and its offset 0
    base = F.col("value") * F.col("_f") + F.col("_o")
    return samples.join(own, "unit", "left").join(wanted, "metric_type", "left").withColumns({
        "value": F.when(F.col("_own").isNull(), F.col("value")).when(fits, (base - F.col("_plus")) / F.col("_by")).otherwise(base),
        "unsupported": F.col("_own").isNull(), "unit": F.when(fits, F.col("_to")).otherwise(F.coalesce("_back", "unit")),
    }).select(*samples.columns, "unsupported")
