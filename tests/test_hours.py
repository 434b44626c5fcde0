"""Stateful hour totals against the batch result."""

import datetime
import random

from pyspark.sql import functions as F

from tidewell.operators import store
from tidewell.schema import SAMPLES
from tidewell.streaming import hours

T = datetime.datetime


def priority():
    return F.when(F.col("source_device") == "watch", 0).when(F.col("source_device") == "ring", 1).otherwise(2)


def t(h, m=0):
    return T(2024, 1, 5, h, m)


class Feed:
    """Files of samples, drained one after the other, each time by a new query on the same checkpoint."""

    def __init__(self, spark, path):
        self.spark, self.path, self.n, self.seen, self.last = spark, path, 0, [], -1
        self.units = spark.createDataFrame([("g", "g", 1.0), ("kg", "g", 1000.0)], "unit string, canonical string, factor double")

    def send(self, data):
        """(user, metric, value, unit, source, start, minutes) → the totals that came out: {(user, hour): value}"""
        rows = [(u, m, v, unit, s, at, at + datetime.timedelta(minutes=n), None, at) for u, m, v, unit, s, at, n in data]
        self.seen = [r for r in self.seen if all((r[0], r[1], r[4], r[5]) != (x[0], x[1], x[4], x[5]) for x in rows)] + rows
        self.spark.createDataFrame(rows, SAMPLES).coalesce(1).write.parquet(f"{self.path}/in/{self.n}")
        hours.live_hours(self.spark, f"{self.path}/in/*", f"{self.path}/out", f"{self.path}/c", self.units, priority(), reach=3).awaitTermination()
        out = self.spark.read.schema(f"{hours.TOTALS}, batch long").parquet(f"{self.path}/out").where(F.col("batch") > self.last).collect()
        self.n, self.last = self.n + 1, max([self.last, *(r.batch for r in out)])
        got = [(r.user_id, r.started_at.hour, r.value) for r in out]
        assert len(got) == len({g[:2] for g in got})  # once a batch
        return {g[:2]: g[2] for g in got}

    def batch(self):
        s = self.spark.createDataFrame(self.seen, SAMPLES)
        return {(r.user_id, r.metric_type, r.started_at): (r.value, r.unit) for r in store.merged_hours(s, s, self.units, priority=priority()).collect()}

    def newest(self):
        return {(r.user_id, r.metric_type, r.started_at): (round(r.value, 4), r.unit) for r in hours.newest_hours(self.spark, f"{self.path}/out").collect()}


def test_late_repeated_and_overlapping_rows_give_the_whole_hour_again(spark, tmp_path):
    feed = Feed(spark, f"file://{tmp_path}")
    assert feed.send([("u", "m", 32.0, "g", "phone", t(1, 5), 5), ("u", "m", 0.032, "kg", "phone", t(1, 30), 10)]) == {("u", 1): 64.0}
    assert feed.send([("u", "m", 8.0, "g", "phone", t(1, 15), 5), ("v", "m", 1.0, "g", "ring", t(3), 90)]) == {("u", 1): 72.0, ("v", 3): 1.0, ("v", 4): 0.0}
    assert feed.send([("u", "m", 8.0, "g", "phone", t(1, 15), 5)]) == {("u", 1): 72.0}  # repeated
    assert feed.send([("u", "m", 5.0, "g", "watch", t(1, 32), 60)]) == {("u", 1): 45.0, ("u", 2): 0.0}  # overlaps the 32 g of 1:30
    assert feed.send([("v", "m", 2.0, "g", "watch", t(4, 10), 5)]) == {("v", 4): 2.0, ("v", 3): 0.0}  # of a later hour, but changes this one
    assert feed.newest() == feed.batch()


def test_random_feeds_equal_the_batch_result(spark, tmp_path):
    rng, feed = random.Random(3), Feed(spark, f"file://{tmp_path}")
    for _ in range(3):
        feed.send([(rng.choice("uv"), "m", float(rng.randint(1, 50)), rng.choice(("g", "kg")), rng.choice(("phone", "ring", "watch")), t(rng.randint(0, 6), rng.randint(0, 59)), rng.choice((0, 1, 20, 75, 130))) for _ in range(25)])
    assert feed.newest() == feed.batch()


def test_calls_of_python_and_state_grow_by_bucket_and_day_not_by_user(spark, tmp_path):
    rng, feed = random.Random(5), Feed(spark, f"file://{tmp_path}")
    for _ in range(2):
        keys = {(rng.randint(0, 499), rng.choice(("phone", "ring", "watch")), t(rng.choice((0, 1, 2, 20)), rng.choice((0, 20, 40)))) for _ in range(900)}
        feed.send([(f"u{u}", "mn"[u % 2], rng.choice((None, 3.0, 0.25)), rng.choice(("g", "kg", "lb")), source, at, (0, 1, 60, 180)[(u // 2 + at.hour) % 4]) for u, source, at in sorted(keys)])
    assert feed.newest() == {k: (round(v, 4), unit) for k, (v, unit) in feed.batch().items()}
    held = spark.read.format("statestore").load(f"{feed.path}/c").groupBy("key.day").count().collect()
    assert len(held) == 2 and all(r["count"] <= 128 for r in held)  # the day's 500 users, and its first hours' rows beside the day before
