"""No answer of one user depends on another's rows: a query over one user's events gives what the query over all gives for that user."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ("tiered_daily", "metric_stats", "metric_trend", "period_table", "sleep_nights", "coaching_brief", "health_summary", "daily_snapshot", "recovery_score", "replace_merged_hours", "compact_samples", "maintained_summaries", "drop_overlaps", "baselines")


@pytest.fixture(scope="module")
def alone(tmp_path_factory):
    """The tables with the events of one user, who has many."""
    at = tmp_path_factory.mktemp("alone")
    con = duckdb.connect()
    user, n = con.execute(f"SELECT user_id, count(*) AS n FROM '{SF}/events.parquet' WHERE user_id % 6 = 0 GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1").fetchall()[0]
    assert n >= 10
    for t in ("events", "orders", "customer"):
        rows = f"SELECT * FROM '{SF}/{t}.parquet'" + (f" WHERE user_id = {user}" if t == "events" else "")
        con.execute(f"COPY ({rows}) TO '{at}/{t}.parquet' (FORMAT parquet)")
    return user, str(at)


@pytest.mark.parametrize("name", NAMES)
def test_a_user_alone_gets_the_same_rows(spark, alone, name):
    user, at = alone
    told = lambda df: sorted((str({k: v for k, v in r.asDict().items()}) for r in df.where(F.col("user_id") == user).collect()))
    every, own = told(registry.QUERIES[name](spark, SF)), told(registry.QUERIES[name](spark, at))
    assert every == own and every
