"""Registered queries over periods that a table gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import daily, periods
from .registry import _table, _tiered, CUMULATIVE, query


def _points(spark, sf_dir):
    return daily.daily_value(_tiered(spark, sf_dir), CUMULATIVE)


def _own_periods(spark, sf_dir):
    """Each order as a period of its customer: up to 20 days from a day of January on, some of which end before they begin, one in 50 of six years."""
    o, k = _table(spark, sf_dir, "orders"), F.col("o_orderkey")
    first = F.date_add(F.lit("2024-01-01").cast("date"), (k % 29).cast("int"))
    length = F.when(k % 50 == 0, 2200).otherwise((k % 23) - 2).cast("int")
    return o.select(k.alias("period_id"), F.col("o_custkey").alias("user_id"), first.alias("first_day"), F.date_add(first, length).alias("last_day"))


_OWN = """, own AS (SELECT o_orderkey AS period_id, o_custkey AS user_id, (DATE '2024-01-01' + (o_orderkey % 29)::INTEGER)::DATE AS first_day,
  (DATE '2024-01-01' + (o_orderkey % 29)::INTEGER + CASE WHEN o_orderkey % 50 = 0 THEN 2200 ELSE o_orderkey % 23 - 2 END::INTEGER)::DATE AS last_day FROM orders),
judged AS (SELECT *, CASE WHEN first_day > last_day THEN 'ends before it begins' WHEN last_day - first_day > 1825 THEN 'longer than 1825 days' END AS reject_reason FROM own),
pts AS (SELECT *, CASE WHEN metric_type IN ('steps', 'active_energy') THEN sum_value ELSE avg_value END AS v FROM tiered),
inside AS (SELECT period_id, p.user_id, p.metric_type, p.unit, count(v) AS n, count(*) AS days, sum(sum_value) AS total, sum(sample_count) AS samples, round(min(v), 2) AS min, round(max(v), 2) AS max, count(*) FILTER (tier = 'summary') AS summary_points
  FROM judged j JOIN pts p ON p.user_id = j.user_id AND p.date BETWEEN j.first_day AND j.last_day WHERE reject_reason IS NULL GROUP BY ALL),
chosen_unit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period_id, metric_type ORDER BY days DESC, unit) AS nth FROM inside) WHERE nth = 1),
stats AS (SELECT j.*, m.metric_type, b.unit, CASE WHEN m.metric_type IS NOT NULL THEN coalesce(b.n, 0) END AS n, CASE WHEN b.metric_type IN ('steps', 'active_energy') THEN round(total / days, 1) ELSE round(total / nullif(samples, 0), 2) END AS avg,
  b.min, b.max, CASE WHEN m.metric_type IS NOT NULL THEN coalesce(summary_points, 0) END AS summary_points, CASE WHEN m.metric_type IS NOT NULL THEN coalesce(days - summary_points, 0) END AS raw_points
  FROM judged j LEFT JOIN (SELECT DISTINCT user_id, metric_type FROM pts) m ON m.user_id = j.user_id AND j.reject_reason IS NULL LEFT JOIN chosen_unit b ON b.period_id = j.period_id AND b.metric_type = m.metric_type)
"""


@query(_OWN + "SELECT * FROM stats")
def period_table(spark, sf_dir):
    """Every customer's own periods, thousands of them, against both tiers."""
    return periods.period_stats(_points(spark, sf_dir), _own_periods(spark, sf_dir), CUMULATIVE)


@query(_OWN + """SELECT a.period_id AS a, b.period_id AS b, a.metric_type, a.user_id AS a_user, a.n AS a_n, a.avg AS a_avg, b.user_id AS b_user, b.n AS b_n, b.avg AS b_avg, round(b.avg - a.avg, 2) AS delta,
round(100 * round(b.avg - a.avg, 2) / nullif(a.avg, 0), 1) AS pct_change, CASE WHEN round(b.avg - a.avg, 2) > 0 THEN 'higher' WHEN round(b.avg - a.avg, 2) < 0 THEN 'lower' WHEN b.avg - a.avg IS NOT NULL THEN 'the same' ELSE 'insufficient data' END AS verdict
FROM (SELECT period_id, lead(period_id) OVER (PARTITION BY user_id ORDER BY period_id) AS next_id FROM own) p JOIN stats a ON a.period_id = p.period_id JOIN stats b ON b.period_id = p.next_id AND b.metric_type = a.metric_type""")
def period_table_changes(spark, sf_dir):
    """Each period of a customer against the customer's next one."""
    from pyspark.sql import Window

    own = _own_periods(spark, sf_dir)
    pairs = own.select(F.col("period_id").alias("a"), F.lead("period_id").over(Window.partitionBy("user_id").orderBy("period_id")).alias("b")).where("b is not null")
    return periods.period_changes(periods.period_stats(_points(spark, sf_dir), own, CUMULATIVE), pairs)
