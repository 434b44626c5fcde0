"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import each_salt, salted, salts_seen, stored


def _settled(edges: DataFrame) -> bool:
    """Whether all links (u, v), v < u, lead from a node without other links to the smallest node of its component."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down")))))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count(F.lit(1)).alias("n"))
    return not nodes.agg(F.count_if(F.expr("down > 0 and n > 1"))).first()[0]


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with a link: root is the smallest node of its component; a root has a row too.

    links: columns u, v of one ordered type. Only a count reaches the driver; each round's links are written to the
    shared folder, and rounds end as soon as all links are stars. A node with a large share of all links is aggregated
    map-side, and what is known of it goes back to its links in SALTS shares, so it is never one key.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")

    def told(rows: DataFrame, least) -> DataFrame:
        """rows (u, v) with m, the least v of their u."""
        own = rows.withColumn("salt", salted(F.col("v")))
        known = own.groupBy("u").agg(least.alias("m"), salts_seen(F.col("salt")).alias("seen"))
        return own.join(known.select("u", "m", each_salt(F.col("seen")).alias("salt")), ["u", "salt"])

    for _ in range(most_rounds):
        if _settled(edges):
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = told(both, F.least(F.col("u"), F.min("v"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = told(large, F.min("v"))
        # The least v of a u goes on as the u's own link, every other v gets a link to it.
        edges = stored(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return out.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
