"""Periods by prefix sums against plain sums; the trend as it is defined."""

import datetime
import random

from pyspark.sql import functions as F

from tidewell.operators import daily, periods

D = datetime.date
POINTS = "user_id string, metric_type string, unit string, date date, avg_value double, sum_value double, sample_count long, tier string, day_value double"


def random_points(spark, seed, users=3, days=70):
    rng, rows = random.Random(seed), []
    for u in range(users):
        for m in ("steps", "hr"):
            for d in range(days):
                for unit in ("a", "b"):
                    if rng.random() < 0.5:
                        n, v = rng.randint(1, 9), round(rng.uniform(1, 100), 4)
                        rows.append((f"u{u}", m, unit, D(2024, 1, 1) + datetime.timedelta(d), v, round(v * n, 4), n, rng.choice(["raw", "summary"]), round(v * n, 4) if m == "steps" else v))
    return rows


def plain(rows, user, first, last, metric):
    half_up = lambda x, n: float(f"{round(round(x, 9) + 1e-12, n):.{n}f}")
    inside = [r for r in rows if r[0] == user and r[1] == metric and first <= r[3] <= last]
    if not inside:
        return None, 0, None, None, None, None
    unit = min({r[2] for r in inside}, key=lambda x: (-sum(r[2] == x for r in inside), x))
    own = [r for r in inside if r[2] == unit]
    mean = half_up(sum(r[5] for r in own) / len(own), 1) if metric == "steps" else half_up(sum(r[5] for r in own) / sum(r[6] for r in own), 2)
    return unit, len(own), mean, half_up(min(r[8] for r in own), 2), half_up(max(r[8] for r in own), 2), sum(r[7] == "summary" for r in own)


def test_periods_equal_plain_sums(spark):
    rows, rng = random_points(spark, 4), random.Random(5)
    asked = [(i, f"u{rng.randint(0, 2)}", D(2024, 1, 1) + datetime.timedelta(a := rng.randint(-5, 75)), D(2024, 1, 1) + datetime.timedelta(a + rng.choice([0, 1, 2, 3, 6, 13, 30, 64, 300]))) for i in range(200)]
    got = periods.period_stats(spark.createDataFrame(rows, POINTS), spark.createDataFrame(asked, "period_id int, user_id string, first_day date, last_day date"), ("steps",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    found = {(r.period_id, r.metric_type): r for r in got.collect()}
    assert len(found) == 400
    for i, user, first, last in asked:
        for m in ("steps", "hr"):
            r, want = found[i, m], plain(rows, user, first, last, m)
            assert (r.unit, r.n) == want[:2], (i, m)
            for a, b in zip((r.avg, r.min, r.max), want[2:5]):
                assert (a is None and b is None) or abs(a - b) < 0.0101, (i, m, a, b)
            if want[1]:
                assert r.summary_points == want[5] and r.raw_points == want[1] - want[5]


def test_bad_periods_are_told_apart(spark):
    asked = [("a", "u0", "2024-01-01", "2024-01-31"), ("b", "u0", "2024-13-01", "2024-01-31"), ("c", "u0", "2024-01-05", "2024-01-01"), ("d", "u0", "2010-01-01", "2024-01-01"), ("e", None, "2024-01-01", "2024-01-02"), ("f", "u0", "01/02/2024", "2024-01-31"), ("g", "nobody", "2024-01-01", "2024-01-02"), ("h", "u0", None, "2024-01-02")]
    points = spark.createDataFrame(random_points(spark, 1), POINTS)
    stats = periods.period_stats(points, spark.createDataFrame(asked, "period_id string, user_id string, first_day string, last_day string"), ("steps",))
    got = {r.period_id: r.reject_reason for r in stats.collect()}
    assert got == {"a": None, "b": "bad date", "c": "ends before it begins", "d": "longer than 1825 days", "e": "no user", "f": "bad date", "g": None, "h": "bad date"}
    assert {(r.period_id, r.metric_type, r.n) for r in stats.where("period_id in ('g', 'c')").collect()} == {("g", None, None), ("c", None, None)}
    assert periods.period_stats(points.limit(0), stats.select("period_id", "user_id", "first_day", "last_day").limit(0), ()).count() == 0


def test_a_period_has_its_longest_block(spark):
    rows = [("u", "hr", "a", D(2019, 1, 1) + datetime.timedelta(i), float(i % 700), 1.0, 1, "raw", float((i * 7919) % 1826)) for i in range(1826)]
    asked = [(1, "u", D(2019, 1, 1), D(2023, 12, 31)), (2, "u", D(2019, 1, 1), D(2019, 1, 1)), (3, "u", D(2020, 6, 1), D(2022, 2, 2))]
    got = {r.period_id: (r.n, r.min, r.max) for r in periods.period_stats(spark.createDataFrame(rows, POINTS), spark.createDataFrame(asked, "period_id int, user_id string, first_day date, last_day date"), ()).collect()}
    part = [r[8] for r in rows if D(2020, 6, 1) <= r[3] <= D(2022, 2, 2)]
    assert got == {1: (1826, 0.0, 1825.0), 2: (1, 0.0, 0.0), 3: (len(part), min(part), max(part))}


def test_trend_rounds_days_first_and_means_last(spark):
    day = lambda i, v: ("u", "hrv", "ms", D(2024, 1, 1) + datetime.timedelta(i), v, v, 1, "raw", v)
    flat = spark.createDataFrame([day(i, 1.004 if i < 7 else 1.045) for i in range(14)], POINTS)
    r = daily.trend_answer(flat).first()
    assert (r.delta, r.trend, r.latest, r.unit, r.days_with_data, r.raw_points) == (0.0, "stable", 1.0, "ms", 14, 14)
    up = spark.createDataFrame([day(i, 40.0 + i) for i in range(20)], POINTS)
    r = daily.trend_answer(up).first()
    assert (r.delta, r.trend, r.latest, r.avg) == (7.0, "improving", 59.0, 49.5)
    assert daily.trend_answer(up, F.lit("2024-01-10").cast("date")).first().trend is None
