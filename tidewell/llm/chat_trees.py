"""Chat formatting of reply trees.

Messages point to the message they answer. Iterative self-joins by pointer doubling give each message its depth
and the score of its path from the root, in log2(depth) rounds; leaves are ranked by that score, and the chosen
root-to-leaf paths are enumerated by going back through the stored rounds. Each path becomes one conversation.

Template, per message: <|im_start|>ROLE\\nTEXT<|im_end|>\\n. In texts and roles a backslash becomes two and <|
becomes <\\|, so no text can hold a control string; a newline in a role becomes \\n. All of it can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, each_salt, salted, salts_seen, stored

START, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 64


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    parts = F.transform(F.split(text, "\\\\\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\|"), F.lit("|")), F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def chains(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Messages whose conversations are plain lists, as reply trees: each answers the one before it.

    Order: turn (nulls first), then role, then text, so ties have a fixed result. Rows are ranked in ranges of
    CHUNK turns, and only the ranges' counts are added up over a whole conversation.
    """
    base = rows.select(
        col(conv_col).alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"),
    ).withColumn("tree", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))).withColumn("range", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(2**62))))
    counts = base.groupBy("tree", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("tree", "range", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("start"))
    own = Window.partitionBy("tree", "range").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = F.col("start") + F.col("r") - 1
    return (
        base.withColumn("r", F.row_number().over(own)).join(starts, ["tree", "range"])
        .select("conv_id", "tree", place.alias("node"), F.when(place > 0, place - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    )


def paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, depth, branch) of the `branches` best root-to-leaf paths of each tree; depth counts from 1.

    nodes: tree, node (unique in its tree), parent (null or unknown: a root), score. A path's score is the sum of
    its messages' scores; ties go to the longer path, then to the smaller leaf. Null scores count as 0. Messages on
    a cycle have no root and are left out. An empty table gives an empty result.
    """
    own = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")).withColumn("salt", salted(F.col("node")))

    def above(rows: DataFrame, up: str, targets: DataFrame) -> DataFrame:
        """rows with the columns of the message that `up` names, null where there is none. A message with a large share
        of all replies is told to them in SALTS shares."""
        asked = rows.where(F.col(up).isNotNull()).groupBy("tree", up).agg(salts_seen(F.col("salt")).alias("salts"))
        known = asked.join(targets.withColumnRenamed("node", up), ["tree", up]).select("tree", up, each_salt(F.col("salts")).alias("salt"), *[c for c in targets.columns if c not in ("tree", "node")])
        return rows.join(known, ["tree", up, "salt"], "left")

    inner = own.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    state = (
        above(own, "parent", own.select("tree", "node", F.lit(True).alias("known")))
        .join(inner.withColumn("inner", F.lit(True)), ["tree", "node"], "left")
        .select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("up"), F.lit(1).cast("long").alias("depth"), "score", F.col("inner").isNull().alias("leaf"), "salt")
    )
    levels = [stored(state, "paths")]
    while True:
        now = levels[-1]
        open_ones, least, rows = now.agg(F.count("up"), F.min(F.when(F.col("up").isNotNull(), F.col("depth"))), F.count(F.lit(1))).first()
        if not open_ones or least > rows:
            break
        told = above(now.where("up is not null"), "up", now.select("tree", "node", F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2")))
        moved = told.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score"), "leaf", "salt")
        moved = moved.unionByName(now.where("up is null"))
        levels.append(stored(moved, "paths"))
    total = levels[-1].where("up is null")
    leaves = total.where("leaf")
    ranked = leaves.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), F.col("depth").desc(), "node"))).where(F.col("branch") <= branches)
    chosen = ranked.select("tree", F.col("node").alias("leaf"), "node", "branch")
    for jump in reversed(levels[:-1]):
        up = jump.where("up is not null").select("tree", "node", "up")
        chosen = stored(chosen.unionByName(chosen.join(up, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), "branch")), "paths")
    return chosen.join(total.select("tree", "node", "depth"), ["tree", "node"]).select("tree", "leaf", "node", "depth", "branch")


def formatted(messages: DataFrame, on_paths: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per path: conv_id, branch, formatted, and loss_spans, the [start, end) code points of loss_role's texts.

    Messages are first joined in chunks of CHUNK, then the chunks of a path. Null roles and texts count as empty; other
    columns of the messages are ignored.
    """
    start = F.length(F.concat(F.lit(START), F.col("er"), F.lit("\n")))
    turn = F.concat(F.lit(START), F.col("er"), F.lit("\n"), F.col("et"), F.lit(END))
    messages = messages.select("conv_id", "tree", "node", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = messages.join(on_paths, ["tree", "node"]).withColumn("er", F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n"))).withColumn("et", escaped(F.col("text")))
    rows = rows.select(
        "conv_id", "tree", "leaf", "branch", "depth", F.floor(F.col("depth") / CHUNK).alias("chunk"), turn.alias("turn"),
        F.length(turn).cast("long").alias("n"), F.when(F.col("role") == loss_role, start).cast("long").alias("a"), F.length("et").cast("long").alias("m"),
    )
    spans = """aggregate(turns, named_struct('at', 0L, 'out', cast(array() as array<struct<a:bigint,b:bigint>>)),
        (s, x) -> named_struct('at', s.at + x.n, 'out', if(x.a is null, s.out, concat(s.out, array(named_struct('a', s.at + x.a, 'b', s.at + x.a + x.m))))))"""
    chunked = (
        rows.groupBy("conv_id", "tree", "leaf", "branch", "chunk").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "n", "a", "m"))).alias("turns"))
        .select("conv_id", "tree", "leaf", "branch", "chunk", F.expr("array_join(transform(turns, t -> t.turn), '')").alias("piece"), F.expr(spans).alias("s"))
    )
    joined = """aggregate(chunks, named_struct('at', 0L, 'out', cast(array() as array<struct<a:bigint,b:bigint>>)),
        (s, x) -> named_struct('at', s.at + x.s.at, 'out', concat(s.out, transform(x.s.out, y -> named_struct('a', s.at + y.a, 'b', s.at + y.b))))).out"""
    return chunked.groupBy("conv_id", "tree", "leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("chunk", "piece", "s"))).alias("chunks")).select(
        "conv_id", "branch", F.expr("array_join(transform(chunks, c -> c.piece), '')").alias("formatted"), F.expr(joined).alias("loss_spans")
    )


def read_back(formatted_text: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    segments = F.filter(F.split(formatted_text, "<\\|im_start\\|>", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            unescaped(F.substring_index(s, "\n", 1)).alias("role"),
            unescaped(F.substring(s, F.length(F.substring_index(s, "\n", 1)) + 2, F.length(s) - F.length(F.substring_index(s, "\n", 1)) - 1 - len(END))).alias("text"),
        ),
    )
