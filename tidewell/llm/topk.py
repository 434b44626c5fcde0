"""Exact inner-product top-k by norm-bucketed retrieval.

Vectors are grouped by length into buckets (ranges of log-length), and each bucket into blocks by a hash; queries are
grouped too. A block meets a group in one task, so neither all queries nor all vectors of a bucket do.

1. The block of the longest vectors gives each query a floor under its k-th best score.
2. Queries of like floor / length form the groups; a group visits the blocks whose longest vector can reach the least
   of its floors.
3. In a block each query has a local cosine threshold, floor / (its length * longest vector). Above 1 it skips the
   block. From TURN on it prunes by coordinates: any vector of that cosine has its coordinates, relative to its length,
   inside known ranges, of which the narrowest of the query's FOCUS largest coordinates is looked up in a sorted list.
   Below TURN those ranges are wide, and it prunes by length: vectors shorter than floor / its length are cut.
4. What is left is verified by exact integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import col, partitions, released, stored

#: Fewest and most vectors of a block, most components of a block; queries of a group; shares of the plan; threshold of choice; coordinates looked at.
LEAST, MOST, COMPONENTS, QUERIES, SPREAD, TURN, FOCUS = 512, 65536, 1 << 22, 4096, 64, 0.6, 4
_SLACK = 1 + 1e-9
_FOUND = "query_row long, query_id long, vec_id long, score long"
_KEY = ("dim", "bucket", "block", "band", "part")


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component; vectors that are null or hold null or non-finite ones are left out."""
    x = col(vector_col).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & col(id_col).isNotNull()
    v = F.transform(x, lambda e: F.floor(e * float(scale)).cast("long"))
    rows = vectors.where(fine).select(col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))).withColumn("dim", F.size("v"))


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(1))


class Block:
    """Vectors of a block by falling length, with a sorted list of each coordinate that is asked for."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        length = _length(vectors)
        order = np.lexsort((ids, -length))
        self.rows, self.ids, self.v, self.length = rows[order], ids[order], vectors[order], length[order]
        self.most = float(np.abs(self.v).max(initial=0))
        self.fast = self.v.astype(np.float64) if self.most < 2**53 else None
        self.longest = float(self.length[0])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def share(self, f: int) -> np.ndarray:
        """Coordinate f of all vectors, relative to their length."""
        return self.v[:, f] / np.maximum(self.length, 1e-300)

    def listed(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            x = self.share(f)
            order = np.argsort(x, kind="stable")
            self.lists[f] = x[order], order
        return self.lists[f]

    def products(self, q: np.ndarray, at) -> np.ndarray:
        """Exact integer products with the vectors at `at`: by BLAS where doubles hold every partial sum, else in 64-bit integers."""
        most = float(np.abs(q).max(initial=0)) * self.most * max(1, q.shape[1])
        if most < 2**53:
            return (q.astype(np.float64) @ self.fast[at].T).astype(np.int64)
        if most < 2**63:
            return q @ self.v[at].T
        raise OverflowError("scores of these vectors don't fit in 64 bits")

    def near(self, unit: np.ndarray, threshold: float) -> np.ndarray:
        """Places of all vectors whose cosine with a unit vector can reach the threshold, and of few others."""
        focus = np.argsort(-np.abs(unit))[:FOCUS]
        own, turn = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(1.0, threshold))
        low = np.where(own + turn >= np.pi, -1.0, np.cos(np.minimum(own + turn, np.pi))) - 1e-7
        high = np.where(own <= turn, 1.0, np.cos(np.maximum(own - turn, 0))) + 1e-7
        ends = [np.searchsorted(self.listed(f)[0], (a, b), side="left") for f, a, b in zip(focus.tolist(), low, high)]
        best = min(range(len(focus)), key=lambda i: ends[i][1] - ends[i][0])
        at = self.listed(int(focus[best]))[1][ends[best][0] : ends[best][1]]
        for i, f in enumerate(focus.tolist()):
            if i != best and len(at):
                x = self.v[at, f] / np.maximum(self.length[at], 1e-300)
                at = at[(x >= low[i]) & (x <= high[i])]
        return at

    def answers(self, query: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the query, id, score) of each query's k best of the block among scores of at least its floor; ties to the smaller id; never its own row."""
        length, out = _length(q), []
        need = np.where(floor > 0, floor / np.maximum(length, 1e-300), -np.inf)
        threshold = np.where(floor > 0, need / max(self.longest, 1e-300), -1.0)
        alive = threshold <= _SLACK
        for i in np.flatnonzero(alive & (threshold >= TURN)).tolist():
            at = self.near(q[i] / length[i], threshold[i] / _SLACK)
            at = at[self.length[at] * _SLACK >= need[i]]
            out.append(self._top(i, query[i], floor[i], k, self.rows[at], self.ids[at], self.products(q[i : i + 1], at)[0]))
        rest = np.flatnonzero(alive & (threshold < TURN))
        rest = rest[np.argsort(need[rest], kind="stable")]
        for lo in range(0, len(rest), 256):
            some = rest[lo : lo + 256]
            keep = int(np.searchsorted(-self.length * _SLACK, -need[some[0]], side="right"))
            for i, row in zip(some.tolist(), self.products(q[some], slice(0, keep))):
                out.append(self._top(i, query[i], floor[i], k, self.rows[:keep], self.ids[:keep], row))
        return tuple(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int64) for j in range(3))

    @staticmethod
    def _top(i: int, query: int, floor: float, k: int, rows: np.ndarray, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ok = (rows != query) & (row >= floor)
        row, ids = row[ok], ids[ok]
        if len(row) > k:
            top = row >= np.partition(row, len(row) - k)[len(row) - k]
            row, ids = row[top], ids[top]
            first = np.lexsort((ids, -row))[:k]
            row, ids = row[first], ids[first]
        return np.full(len(row), i, np.int64), ids, row


def _visit(k: int):
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and role: a block's vectors (role 0), then the queries of the group that visits it (1)."""
        now, held, block = None, [], None
        for b in batches:
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if lo == hi:
                    continue
                key, role, n = tuple(keys[:5, lo]), keys[5, lo], hi - lo
                if key != now:
                    now, held, block = key, [], None
                ids, v = b.column(6).slice(lo, n).to_numpy(), b.column(7).slice(lo, n).flatten().to_numpy().reshape(n, int(key[0]))
                rows = b.column(9).slice(lo, n).to_numpy()
                if role == 0:
                    held.append((rows, ids, v))
                elif held:
                    block = block or Block(*(np.concatenate(x) for x in zip(*held)))
                    at, other, score = block.answers(rows, v, b.column(8).slice(lo, n).to_numpy(zero_copy_only=False), k)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (rows[at], ids[at], other, score)], names=["query_row", "query_id", "vec_id", "score"])

    return visit


def top_k(vectors: DataFrame, is_query, k: int = 5, scale: int = 256, block: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer products of each query with the other vectors.

    is_query: a condition on the column vec_id. Fewer than k others: all of them. Vectors that take no part: null
    ids, null vectors, and any with null or non-finite components; vectors of different lengths don't meet. A query is
    barred from meeting its own row only: rows that repeat its id are candidates, and as queries have a list each. An empty table gives an empty result. Other columns are ignored. `block`: vectors of a block; by
    default as many as give each shuffle partition two blocks, from LEAST to MOST, and at most COMPONENTS in all.
    """
    rows = quantised(vectors, scale, id_col, vector_col).withColumn("row", F.monotonically_increasing_id())
    bucket = F.when(F.col("norm") > 0, F.greatest(F.lit(0), F.floor(F.log2("norm") * 4))).otherwise(F.lit(-1)).cast("int")
    rows = stored(rows.withColumn("bucket", bucket), "vectors")
    size = F.lit(block or min(MOST, max(LEAST, rows.count() // (2 * partitions(rows.sparkSession)))))
    size = F.least(size, F.greatest(F.lit(1).cast("long"), F.floor(F.lit(COMPONENTS) / F.greatest("dim", F.lit(1)))))
    sizes = rows.groupBy("dim", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / size))
    sizes = sizes.select("dim", "bucket", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    spread = rows.withColumn("spread", F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD)).cast("int")).join(sizes, ["dim", "bucket", "spread"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).select("dim", "bucket", "block", "vec_id", "row", "v", "norm")
    blocks = spread.groupBy("dim", "bucket", "block").agg(F.max("norm").alias("longest"), F.count(F.lit(1)).alias("n"))

    asked = spread.where(is_query).select(F.col("vec_id").alias("id"), "row", "v", "dim", F.col("norm").alias("length"))

    def grouped(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(queries with band and part, one row a group with the least length it needs): a band is dealt into parts of QUERIES or so."""
        need = F.when(F.col("floor") > 0, F.col("floor") / F.col("length"))
        banded = queries.withColumns({"need": F.coalesce(need, F.lit(-1.0)), "band": F.coalesce(F.floor(F.log2(need) * 4), F.lit(-(10**6))).cast("int")})
        parts = banded.groupBy("dim", "band").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")).select("dim", "band", "parts", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
        dealt = banded.withColumn("spread", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).join(parts, ["dim", "band", "spread"])
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("id", F.lit(2)), F.col("parts")).cast("int")).select("dim", "band", "part", "id", "row", "v", "floor", "need")
        return dealt, dealt.groupBy("dim", "band", "part").agg(F.min("need").alias("need"))

    def visited(queries: DataFrame, visits: DataFrame) -> DataFrame:
        """visits: one row for each block and group that meet. Each meeting gets its own copy of the block and of the group."""
        own = spread.join(visits, ["dim", "bucket", "block"]).select(*_KEY, F.lit(0).alias("role"), F.col("vec_id").alias("id"), "v", F.lit(None).cast("double").alias("floor"), "row")
        other = queries.join(visits, ["dim", "band", "part"]).select(*_KEY, F.lit(1).alias("role"), "id", "v", "floor", "row")
        return own.unionByName(other).repartition(*_KEY).sortWithinPartitions(*_KEY, "role").mapInArrow(released(_visit(k)), _FOUND)

    # First pass: the block of the longest vectors that holds more than k of them gives each query a floor.
    first = blocks.where(F.col("n") > k).groupBy("dim").agg(F.max_by(F.struct("bucket", "block"), F.struct("longest", "n")).alias("at")).select("dim", "at.bucket", "at.block")
    queries, groups = grouped(asked.withColumn("floor", F.lit(float("-inf"))))
    seen = visited(queries, groups.join(first, "dim"))
    ranked = lambda found: found.withColumn("rank", F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")))
    floors = ranked(seen).where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    known = stored(asked.join(floors, "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "queries")
    queries, groups = grouped(known)
    # One row a block, repeated SPREAD times so that no key holds all groups.
    reachable = blocks.select("dim", "bucket", "block", "longest", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("spread"))
    visits = groups.withColumn("spread", F.pmod(F.xxhash64("band", "part"), F.lit(SPREAD)).cast("int")).join(reachable, ["dim", "spread"]).where(F.col("longest") * F.lit(_SLACK) >= F.col("need")).select(*_KEY)
    return ranked(visited(queries, visits)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
