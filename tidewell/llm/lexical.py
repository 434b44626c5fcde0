"""Ranked lexical search with hashed max-sketches.

A term's impact on a document is (10^9 tf) div (1000 tf + 8 m), where m grows with the document's share of the mean length.
A sketch folds the impacts of all terms of a document into COORDINATES numbers: a term falls on the coordinate of its hash,
and a coordinate keeps the largest impact that falls on it. So for every query, the sum of weight * sketch[coordinate] over
its terms is at least its score, whatever terms have met.

1. One scan counts the documents, their terms, and the documents that hold each term of the queries.
2. A second one makes the sketches of a batch of documents and looks all queries of a block up in them at once, as one
   product of sketches and query weights: the upper bounds. Each query then takes the documents by falling bound, scores
   them exactly by their term counts, and stops where the bound falls below its k-th best score so far (in this task).
   At most k results for each query leave a task; the best of these are the answer.

Queries come in blocks of BYTES of text or one query; each block is broadcast, and no text is moved.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewise import Words, hashes, raw, summed
from .shared import col, released, slices

COORDINATES, BYTES, STEP, SPAN = 1024, 1 << 20, 32, 4 << 20
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Counts:
    """The terms of a batch of texts: for each pair of document and term, in this order, how often it occurs."""

    def __init__(self, texts: pa.Array):
        words = Words(texts, _INSIDE)
        coded = words.strings().dictionary_encode()
        self.terms = coded.dictionary
        self.width = max(1, len(self.terms))
        keys, self.tf, _ = summed(words.row * self.width + coded.indices.to_numpy(), np.ones(len(words), np.int64))
        self.doc, self.term = keys // self.width, keys % self.width
        self.n = np.bincount(words.row, minlength=len(texts)).astype(np.int64)

    def places(self, known: pa.Array) -> np.ndarray:
        """The place of each term in `known`, or -1."""
        return pc.fill_null(pc.index_in(self.terms, value_set=known), -1).to_numpy().astype(np.int64)


def _counted(known: pa.Array):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = np.zeros(len(known), np.int64), 0, 0
        for b in batches:
            for part in slices(b, 0, SPAN):
                c = Counts(part.column(0))
                at = c.places(known)[c.term]
                df += np.bincount(at[at >= 0], minlength=len(known))
                documents, terms = documents + int((c.n > 0).sum()), terms + int(c.n.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at], pa.int64()), pa.array([documents, terms, *df[at]], pa.int64())], names=["term", "n"])

    return run


class Block:
    """Queries (lists of places in `known`, once each) with the weight of each term."""

    def __init__(self, ids: list, queries: list[np.ndarray], known: pa.Array, df: np.ndarray, documents: int, terms: int, k: int):
        self.ids, self.queries, self.known, self.documents, self.terms, self.k = ids, queries, known, documents, terms, k
        self.weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        data, at = raw(known)
        place = (hashes(data, at) % np.uint64(COORDINATES)).astype(np.int64)
        self.used, own = np.unique(place, return_inverse=True)
        self.lookup = np.zeros((len(self.used), len(queries)))
        for i, q in enumerate(queries):
            np.add.at(self.lookup[:, i], own[q], self.weight[q])

    def impacts(self, c: Counts) -> np.ndarray:
        m = 10 + (90 * c.n * self.documents) // self.terms
        return (1_000_000_000 * c.tf) // (1000 * c.tf + 8 * m[c.doc])

    def sketches(self, c: Counts, impacts: np.ndarray) -> np.ndarray:
        """A row of COORDINATES maxima for each document."""
        data, at = raw(c.terms)
        place = (hashes(data, at) % np.uint64(COORDINATES)).astype(np.int64)
        out = np.zeros((len(c.n), COORDINATES))
        np.maximum.at(out.reshape(-1), c.doc * COORDINATES + place[c.term], impacts)
        return out

    def bounds(self, sketches: np.ndarray) -> np.ndarray:
        """Documents by queries: no score is above them. Doubles hold these whole numbers exactly, up to queries of some 10^5 terms."""
        return sketches[:, self.used] @ self.lookup


class Best:
    """The k best documents of each query so far: higher scores, then smaller ids, those without id last."""

    def __init__(self, block: Block):
        self.block = block
        self.score = [np.zeros(0, np.int64) for _ in block.queries]
        self.place = [np.zeros(0, np.int64) for _ in block.queries]
        self.ids = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, texts: pa.Array, ids: np.ndarray, none: np.ndarray) -> None:
        block, k = self.block, self.block.k
        c = Counts(texts)
        if not len(c.n) or not block.terms:
            return
        impacts = block.impacts(c)
        bounds = block.bounds(block.sketches(c, impacts))
        at = c.places(block.known)[c.term]
        own = at >= 0
        keys = c.doc[own] * len(block.known) + at[own]
        order = np.argsort(keys, kind="stable")
        keys, impacts = keys[order], impacts[own][order]
        first = len(self.ids)  # documents are numbered through all batches of the task
        self.ids, self.none = np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        for q, terms in enumerate(block.queries):
            bound, weight = bounds[:, q], block.weight[terms]
            floor = self.score[q][-1] if len(self.score[q]) >= k else 1
            open_ = np.flatnonzero(bound >= max(floor, 1))
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            for lo in range(0, len(open_), STEP):
                some = open_[lo : lo + STEP]
                if len(self.score[q]) >= k and bound[some[0]] < self.score[q][-1]:
                    break
                wanted = some[:, None] * len(block.known) + terms
                found = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
                score = (np.where(keys[found] == wanted, impacts[found], 0) * weight).sum(1) if len(keys) else np.zeros(len(some), np.int64)
                self._put(q, score, first + some)
        self._forget()

    def _put(self, q: int, score: np.ndarray, place: np.ndarray) -> None:
        score, place = np.concatenate([self.score[q], score[score > 0]]), np.concatenate([self.place[q], place[score > 0]])
        best = np.lexsort((self.ids[place], self.none[place], -score))[: self.block.k]
        self.score[q], self.place[q] = score[best], place[best]

    def _forget(self) -> None:
        """Keeps the ids of the best documents only."""
        kept = np.unique(np.concatenate(self.place))
        self.place = [np.searchsorted(kept, p) for p in self.place]
        self.ids, self.none = self.ids[kept], self.none[kept]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.score)), [len(s) for s in self.score])
        place, score = np.concatenate([np.zeros(0, np.int64), *self.place]), np.concatenate([np.zeros(0, np.int64), *self.score])
        return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(self.ids[place], pa.int64(), mask=self.none[place]), pa.array(score, pa.int64())], names=["query", "doc_id", "score"])


def _searched(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.value)
        for b in batches:
            for part in slices(b, 0, SPAN):
                ids = part.column(1)
                best.add(part.column(0), pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False))
        yield best.rows()

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """The queries in blocks of BYTES of text, or one."""
    block, size = [], 0
    rows = items.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    for r in rows.toLocalIterator():
        if block and size + len(r["text"].encode()) > BYTES:
            yield block
            block, size = [], 0
        block.append((r["id"], r["text"]))
        size += len(r["text"].encode())
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k highest-scoring documents of each query, with a score above 0 (all, if fewer).

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case; a query counts each once.
    Equal scores: smaller doc_id first, rows without id last. Null texts have no terms; a query without terms, and any query
    on an empty table, gives no rows. Rows that repeat an id are documents each; items that repeat are queries each only if
    their ids differ (of equal ids one text is taken, the smallest). Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"), col(id_col).cast("long").alias("doc_id"))
    asked = items.groupBy(col(item_col).alias("id")).agg(F.min(F.coalesce(col(item_text).cast("string"), F.lit(""))).alias("text"))
    schema = f"item_id {dict(items.dtypes)[item_col]}, query long"
    done = None
    for block in _blocks(asked, "id", "text"):
        c = Counts(pa.array([t for _, t in block], pa.string()))
        known = c.terms
        counts = dict(source.select("text").mapInArrow(released(_counted(known)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())  # two rows and one for each term of the block
        df = np.array([counts.get(i, 0) for i in range(len(known))], np.int64)
        edges = np.searchsorted(c.doc, np.arange(len(block) + 1))
        queries = [c.term[a:b] for a, b in zip(edges[:-1], edges[1:])]
        shared = spark.sparkContext.broadcast(Block([i for i, _ in block], queries, known, df, counts.get(-1) or 0, counts.get(-2) or 0, k))
        found = source.mapInArrow(released(_searched(shared)), "query long, doc_id long, score long")
        names = spark.createDataFrame([(i, n) for n, (i, _) in enumerate(block)], schema)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("share", F.spark_partition_id() % 16)
        for keys in (("query", "share"), ("query",)):
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        found = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")  # one row for each query of the block
        done = found if done is None else done.unionByName(found)
    return done if done is not None else spark.createDataFrame([], f"item_id {dict(items.dtypes)[item_col]}, rank int, doc_id long, score long")
