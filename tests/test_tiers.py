"""Compaction with a ledger and summaries kept up by differences."""

import datetime
import random

from pyspark.sql import functions as F

from tidewell.operators import ledger, maintain, store
from tidewell.schema import MERGED_SOURCE, SAMPLES

T = datetime.datetime
SUMMARY = "user_id string, metric_type string, summary_date date, unit string, min_value double, max_value double, sum_value double, sample_count long"


def rows(spark, data):
    """(user, metric, value, unit, source, start)"""
    return spark.createDataFrame([(u, m, v, unit, s, at, at, None, at) for u, m, v, unit, s, at in data], SAMPLES)


def many(rng, n, metrics=("hr", "spo2"), sources=("a", "b")):
    seen = {}
    for _ in range(n):
        key = (rng.choice("uvw"), rng.choice(metrics), rng.choice(sources), T(2024, rng.randint(1, 3), rng.randint(1, 28), rng.randint(0, 23), rng.choice((0, 30))))
        seen[key] = (*key[:2], rng.choice([None, *[float(x) for x in range(60, 90)]]), rng.choice(("x", "x", "y")), *key[2:])
    return list(seen.values())


def totals(done):
    return sorted(map(tuple, store.compaction_totals(done.samples, done.summaries).collect()))


def twice(spark, data, more, known=None):
    cut, now = F.lit("2024-03-10").cast("timestamp"), F.lit("2024-04-01").cast("timestamp")
    none, empty = spark.createDataFrame([], ledger.LEDGER), spark.createDataFrame([], SUMMARY)
    first = ledger.compact_once(rows(spark, data), empty, none, ledger.ledger_filter(none), cut, now)
    keys = first.ledger
    second = ledger.compact_once(rows(spark, more), first.summaries, keys, known(keys) if known else ledger.ledger_filter(keys), cut, now)
    return first, second


def test_history_sent_again_is_refused(spark):
    data = many(random.Random(1), 400)
    first, second = twice(spark, data, data)
    assert totals(first) == totals(second)
    assert all(r.raw_rows == r.summary_rows == 0 and r.refused_rows > 0 for r in second.report.collect())
    due = sum(r.refused_rows for r in second.report.collect())
    assert due == first.ledger.count() == second.refused.count() and second.ledger.count() == 0


def test_new_rows_come_in_beside_those_sent_again(spark):
    data, late = many(random.Random(1), 300), many(random.Random(2), 300)
    keys = {(*r[:2], *r[4:]) for r in data}
    fresh = [r for r in late if (*r[:2], *r[4:]) not in keys]
    _, second = twice(spark, data, data + fresh)
    whole, _ = twice(spark, data + fresh, [])
    assert totals(second) == totals(whole)


def test_a_filter_that_lets_all_pass_loses_nothing(spark):
    data, late = many(random.Random(3), 200), many(random.Random(4), 200)
    keys = {(*r[:2], *r[4:]) for r in data}
    fresh = [r for r in late if (*r[:2], *r[4:]) not in keys]
    full = lambda k: ledger.ledger_filter(k).withColumns({f"w{i}": F.lit(-1).cast("long") for i in range(8)})
    assert totals(twice(spark, data, data + fresh, full)[1]) == totals(twice(spark, data + fresh, [])[0])


def test_the_filter_knows_its_keys_and_few_others(spark):
    data, other = many(random.Random(5), 3000, metrics=("m",), sources=tuple("abcdefgh")), many(random.Random(6), 3000, metrics=("m",), sources=tuple("ijklmnop"))
    keys = ledger.ledger_keys(rows(spark, data))
    marked = lambda d: ledger._maybe_known(rows(spark, d).withColumn("month", ledger.month(F.col("started_at"))), ledger.ledger_filter(keys)).where("maybe").count()
    assert marked(data) == len(data) and marked(other) < 0.06 * len(other)


def state_rows(df):
    return sorted((tuple(r) for r in df.select("user_id", "metric_type", "summary_date", "unit", *maintain.STATE).collect()), key=str)


def test_differences_equal_a_whole_recompute_after_random_batches(spark):
    rng = random.Random(8)
    held = {(*r[:2], *r[4:]): r for r in many(rng, 300, sources=("a", MERGED_SOURCE))}
    before = rows(spark, list(held.values()))
    state = maintain.summary_state(before)
    for _ in range(3):
        batch = {(*r[:2], *r[4:]): r for r in many(rng, 60, sources=("a", MERGED_SOURCE))}
        gone = set(rng.sample(sorted(held, key=str), 15))
        held = {k: r for k, r in held.items() if k not in gone} | batch
        after = rows(spark, list(held.values()))
        new = maintain.maintained(state, *maintain.changed_rows(before, after), after)
        assert state_rows(new) == state_rows(maintain.summary_state(after))
        columns = ["user_id", "metric_type", "summary_date", "unit", "sum_value", "sample_count"]
        whole = sorted(map(tuple, store.recompute_summaries(after).select(*columns).collect()), key=str)
        assert sorted(map(tuple, maintain.clean_summaries(new).select(*columns).collect()), key=str) == whole
        before, state = after, maintain.summary_state(after)


def test_only_lost_extremes_are_read_again_and_a_second_run_writes_nothing(spark):
    at = lambda h: T(2024, 1, 5, h)
    old = rows(spark, [("u", "steps", v, "count", MERGED_SOURCE, at(i)) for i, v in enumerate((5.0, 7.0, 9.0))] + [("u", "hr", 1.0, "bpm", "watch", at(1))])
    state = maintain.summary_state(old)
    middle = rows(spark, [("u", "steps", 8.0, "count", MERGED_SOURCE, at(1))])
    after = store.upserted(old, middle)
    blind = after.limit(0)  # nothing may be read here: the replaced 7 was no extreme
    new = maintain.maintained(state, *maintain.changed_rows(old, after), blind)
    assert state_rows(new) == state_rows(maintain.summary_state(after))
    top = store.upserted(old, rows(spark, [("u", "steps", 6.0, "count", MERGED_SOURCE, at(2))]))
    new = maintain.maintained(state, *maintain.changed_rows(old, top), top)
    assert new.where("metric_type = 'steps'").first().max_value == 7.0
    report = {r.metric_type: (r.mode, r.summary_rows, r.skipped_days) for r in maintain.recompute_report(state, new).collect()}
    assert report == {"steps": ("recompute", 1, 0), "hr": ("recompute", 0, 1)}
    again = maintain.maintained(new, *maintain.changed_rows(top, top), blind)
    assert all(r.summary_rows == 0 for r in maintain.recompute_report(new, again).collect()) and state_rows(again) == state_rows(new)
