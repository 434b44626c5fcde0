"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a seeded pseudo-random order, are cut into blocks of `block` documents. With integer
weights k (sum K), block b of a source may run from slot floor(b*K/k) on, its release, and has to run before slot
ceil((b+1)*K/k), its deadline. Earliest-deadline-first over the released blocks meets all deadlines, so after any
number of slots each source is less than one block away from its target share.

The schedule repeats after K slots, so only one period is worked out, by a fold over K slots inside Spark; each
document then finds its slot by arithmetic and one lookup. When a source ends, the others go on with the same
weights among themselves in a new phase, from the next full period on: no document is left out or repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, packed

#: The sources of the slots 0 to kk - 1 as an array. Slots are gathered in arrays of 1000, so long periods copy little.
_SLOT = """(s, t) -> transform(array(array_min(transform(sequence(0, size(act) - 1), i ->
        if((s.done[i] * kk) div act[i].k <= t, named_struct('d', ((s.done[i] + 1) * kk + act[i].k - 1) div act[i].k, 'i', i), null))).i),
      p -> named_struct('done', transform(s.done, (d, i) -> if(i = p, d + 1L, d)), 'slots', concat(s.slots, array(p))))[0]"""
_PERIOD = f"""
aggregate(
  sequence(0L, (kk - 1) div 1000),
  named_struct('done', transform(act, a -> 0L), 'all', cast(array() as array<array<int>>)),
  (o, c) -> transform(array(aggregate(sequence(c * 1000, least(c * 1000 + 999, kk - 1)), named_struct('done', o.done, 'slots', cast(array() as array<int>)), {_SLOT})),
    r -> named_struct('done', r.done, 'all', concat(o.all, array(r.slots))))[0],
  o -> flatten(o.all))
"""


def _weight(source: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default).cast("long")
    for name in sorted(weights):
        out = F.when(source == name, F.lit(weights[name]).cast("long")).otherwise(out)
    return out


def schedule(docs: DataFrame, weights: dict[str, int], default_weight: int = 1, block: int = 16, seed: str = "mix", prefix: int = 3, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """One row per document: row (struct of all its columns), doc_id, source, block, phase, release, deadline, slot, mix_pos.

    mix_pos is the place in the mix: unique where ids are, increasing in training order, with gaps only in the
    period in which a source ends. release and deadline count slots of the whole mix within the document's phase.
    weights are positive whole numbers; sources not named get default_weight. A null source counts as the empty
    name, a null id as the empty id. Rows that repeat an id take neighbouring places. An empty table gives an
    empty result. The number of sources has to be small (a few hundred); any of them may hold any share of the
    rows: rows are ranked in 16^prefix ranges of their hash per source, and only range counts are added up.
    """
    if block < 1 or default_weight < 1 or any(k < 1 for k in weights.values()):
        raise ValueError("block and weights must be at least 1")
    source, doc_id = F.coalesce(col(source_col).cast("string"), F.lit("")), col(id_col)
    order = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    base = docs.select(source.alias("source"), order.alias("o"), doc_id.alias("doc_id"), packed(docs)).withColumn("range", F.substring("o", 1, prefix))

    counts = base.groupBy("source", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    within = Window.partitionBy("source", "range").orderBy("o", "doc_id")
    ranked = base.withColumn("r", F.row_number().over(within)).join(starts, ["source", "range"]).withColumn("rank", F.col("start") + F.col("r") - 1)

    sources = (
        counts.groupBy("source").agg(F.sum("n").alias("n"))
        .withColumn("k", _weight(F.col("source"), weights, default_weight))
        .withColumn("q", F.expr(f"(((n + {block - 1}) div {block}) + k - 1) div k"))
    )
    every = (
        sources.groupBy().agg(F.array_sort(F.collect_list(F.struct("source", "k", "q"))).alias("all"))  # one entry per source
        .select("all", F.expr("array_sort(array_distinct(transform(all, a -> a.q)))").alias("ends"))
    )
    ends = (
        every.select("all", "ends", F.posexplode("ends").alias("phase", "hi"))
        .select(
            F.col("phase").cast("long").alias("phase"),
            F.expr("if(phase = 0, 0L, ends[phase - 1])").alias("lo"),
            "hi",
            F.expr("filter(all, a -> a.q >= hi)").alias("act"),
            F.expr("aggregate(filter(all, a -> a.q >= hi), 0L, (x, a) -> x + a.k)").alias("kk"),
            F.expr("aggregate(filter(all, a -> a.q < hi), 0L, (x, a) -> x + a.k * a.q)").alias("over"),
        )
        .withColumn("first_slot", F.expr("over + lo * kk"))
    )
    pattern = ends.select("phase", "lo", "hi", "kk", "first_slot", "act", F.posexplode(F.expr(_PERIOD)).alias("at", "i")).select(
        "phase", "lo", "hi", "kk", "first_slot", "at", F.expr("act[i].source").alias("source"), F.expr("act[i].k").alias("k")
    )
    turn = Window.partitionBy("phase", "source").orderBy("at")
    pattern = pattern.withColumn("nth", (F.row_number().over(turn) - 1).cast("long"))

    # A block's phase follows from its period: as many phases as have ended by then lie before it.
    known = every.select("ends", F.explode("all").alias("a")).select("a.source", "a.k", "ends")
    blocks = ranked.join(known, "source").withColumn("block", F.expr(f"rank div {block}")).withColumn("period", F.expr("block div k")).withColumn("nth", F.expr("block % k"))
    blocks = blocks.withColumn("phase", F.expr("size(filter(ends, e -> e <= period))").cast("long"))
    placed = blocks.join(pattern.select("phase", "lo", "kk", "first_slot", "at", "source", "nth"), ["source", "phase", "nth"])
    slot = F.expr("first_slot + (period - lo) * kk + at")
    b = "(block - lo * k)"
    return placed.withColumn("slot", slot).select(
        "row", "doc_id", "source", "block", "phase",
        F.expr(f"first_slot + ({b} * kk) div k").alias("release"),
        F.expr(f"first_slot + (({b} + 1) * kk + k - 1) div k").alias("deadline"),
        "slot",
        F.expr(f"slot * {block} + rank % {block}").alias("mix_pos"),
    )


def mixed(docs: DataFrame, weights: dict[str, int], name: str = "mix_pos", **more) -> DataFrame:
    """The documents with their place in the mix in column `name` (replacing a column of that name)."""
    out = schedule(docs, weights, **more)
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != name], F.col("mix_pos").alias(name))
