"""Exact de-duplication that no group of copies can unbalance.

Copies are combined three times, each time comparing the whole normalised text:

1. locally: Spark's map-side aggregate keeps one row per (digest, salt, content) of a task;
2. salted: what is left meets by (digest, salt), so a huge group spreads over SALTS tasks;
3. globally: at most SALTS winners per content meet by digest.

The group's winner then goes back to each document by (digest, salt), a join whose largest key is again
only a SALTS-th of a group. Nothing larger than SALTS rows of one group is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SALTS, col, each_salt, packed, salts_seen

WHITE = " \t\n\x0b\x0c\r"
_SPAN = "36893488147419103232"  # 2^65: room for any doc_id below the length in one sortable number
_TOP = "9223372036854775808"  # 2^63
_ALL = 2**SALTS - 1


def normalised(text: Column) -> Column:
    """The text without the characters \\x20 and \\x09 to \\x0D; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), WHITE, "")


def _merit(n_chars: Column, doc_id: Column) -> Column:
    """Larger for more code points, then for smaller doc_ids; a null doc_id comes last."""
    big = lambda c: c.cast("decimal(38,0)")
    rest = F.coalesce(big(F.lit(_TOP)) - big(doc_id), big(F.lit("0")))
    return (big(n_chars) * big(F.lit(_SPAN)) + rest).cast("decimal(38,0)")


def _winner(merit: Column) -> Column:
    rest = merit % F.lit(_SPAN).cast("decimal(38,0)")
    return F.when(rest != 0, (F.lit(_TOP).cast("decimal(38,0)") - rest).cast("long"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row (struct of all its columns), keep_id, group_size, kept, text_sha256.

    The row with the most code points in its original text stays, then the one of the smallest id.
    Null texts are empty texts and form a group like any other. A null id can stay only where all ids of its
    group are null. Rows that repeat an id within one group count as members; the longest of them alone has
    kept = true. An empty table gives an empty result. Input columns of any name are untouched in row.
    Two contents with one SHA-256 stop the job with an error instead of being merged.
    """
    content = normalised(col(text_col))
    doc_id = col(id_col).cast("long")
    base = docs.select(
        F.sha2(content.cast("binary"), 256).alias("digest"),
        # Null ids have no hash to spread by: they go anywhere, and their group's winner goes everywhere.
        F.when(doc_id.isNull(), F.floor(F.rand(1) * SALTS)).otherwise(F.pmod(F.xxhash64(doc_id), F.lit(SALTS))).cast("int").alias("salt"),
        content.alias("content"),
        F.char_length(F.coalesce(col(text_col).cast("string"), F.lit(""))).alias("n"),
        doc_id.alias("id"),
        packed(docs),
    )
    local_and_salted = base.groupBy("digest", "salt", "content").agg(F.max(_merit(F.col("n"), F.col("id"))).alias("merit"), F.count(F.lit(1)).alias("size"), F.bool_or(F.col("id").isNull()).alias("no_id"))
    by_content = (
        local_and_salted.repartition("digest")
        .groupBy("digest", "content")
        .agg(F.max("merit").alias("merit"), F.sum("size").alias("size"), F.bit_or(F.when(F.col("no_id"), F.lit(_ALL)).otherwise(F.lit(0).cast("long"))).alias("no_id"), salts_seen(F.col("salt")).alias("salts"))
    )
    winners = (
        by_content.groupBy("digest")
        .agg(F.max("merit").alias("merit"), F.max("size").alias("size"), F.bit_or(F.col("salts").bitwiseOR(F.col("no_id"))).alias("salts"), F.count(F.lit(1)).alias("contents"))
        .select(
            "digest",
            _winner(F.col("merit")).alias("keep_id"),
            F.when(F.col("contents") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two contents share a digest")).cast("long")).alias("group_size"),
            each_salt(F.col("salts")).alias("salt"),
        )
    )
    repeats = Window.partitionBy("digest", "salt", "id").orderBy(F.col("n").desc())
    return (
        base.select("digest", "salt", "n", "id", "row")
        .join(winners, ["digest", "salt"])
        .select(
            "row",
            F.col("id").alias("doc_id"),
            "keep_id",
            "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(repeats) == 1)).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their columns as they were."""
    groups = exact_groups(docs, id_col, text_col)
    return groups.where("kept").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
