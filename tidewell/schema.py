"""Fixed schemas (as DDL) and constants."""
SAMPLES = (
    "user_id string, metric_type string, value double, unit string, source_device string, started_at timestamp, ended_at timestamp, metadata string, synced_at timestamp"
)
SUMMARIES = (
    "user_id string, metric_type string, summary_date date, unit string, avg_value double, min_value double, max_value double, sum_value double, sample_count long, summarized_at timestamp"
)
PAYLOAD = (
    "user_id string, samples array<struct<metric_type:string,value:double,unit:string,source_device:string,started_at:string,ended_at:string,metadata:string>>"
)
SAMPLE_COLUMNS = tuple(f.split()[0] for f in SAMPLES.split(", "))
SUMMARY_COLUMNS = tuple(f.split()[0] for f in SUMMARIES.split(", "))
KEY = ("user_id", "metric_type", "source_device", "started_at")
SUMMARY_KEY = ("user_id", "metric_type", "summary_date", "unit")
#: Source name of hourly totals that stand for all devices of their hour.
MERGED_SOURCE = "merged hourly total"
MAX_DAYS, MAX_MONTHS, MAX_LIMIT, MAX_TEXT, MAX_METADATA = 1825, 120, 1000, 256, 4096
#: Longest interval of a sample that ingest takes.
MAX_INTERVAL_DAYS = 31
#: Longer windows take daily summaries where there are any.
RAW_DAYS = 30
#: Sleep stage codes; 3, 4 and 5 count as sleep.
STAGES = {0: "inBed", 1: "asleep", 2: "awake", 3: "core", 4: "deep", 5: "rem"}
ASLEEP = (3.0, 4.0, 5.0)
#: Substrings of device names, best sleep source first.
SLEEP_SOURCES = ("oura", "apple watch", "whoop", "garmin", "withings")
#: Public form of metric identifiers, and of instants that merged hours have to be written in.
METRIC_PATTERN, ISO_INSTANT = r"^HK[A-Za-z0-9]+$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
#: User ids that stand for none.
PLACEHOLDERS = ("", "null", "none", "undefined", "unknown", "your-user-id")
