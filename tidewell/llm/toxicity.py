"""Toxicity by a classifier chain.

One linear (logistic) model per category, in a fixed order; each later model also sees the probabilities that the
earlier ones give. For training these come from models that have not seen the row (out-of-fold), so the later
models meet them as they will be in use. A fold's model also uses only features that were chosen without the fold.

Features: whole lower-case words and word beginnings of 4 to 6 letters, hashed, log(1 + count), of which the
`keep` most telling ones per category are used; and the logarithm of the number of words.

The models are fitted on at most `sample` labelled documents, those of the smallest hash of their id (a
documented bound), a category's fold models and its whole model each in a Spark task of their own, to which the
sample's features are shuffled: they don't pass the driver; every document is scored, on its whole text, in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, give_back, packed, released, slices, stored

#: (category, condition on the label table), in the order of the chain.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"), ("toxic_prose", "toxic = 1 and quality = 1"))
WIDTH = 1 << 22
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    return [zlib.crc32(k.encode()) % WIDTH for k in (word, *(f"^{word[:n]}" for n in (4, 5, 6) if len(word) > n))]


class Counter:
    """Counts features of texts; the features of words seen before are remembered (`most` words)."""

    def __init__(self, wanted: np.ndarray | None = None, most: int = 100_000):
        self.wanted = None if wanted is None else {int(f): i for i, f in enumerate(wanted)}
        self.seen: dict[str, tuple[int, ...]] = {}
        self.most = most

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self.seen) >= self.most:
            self.seen.clear()
        found = word_features(word)
        self.seen[word] = out = tuple(found) if self.wanted is None else tuple(self.wanted[f] for f in found if f in self.wanted)
        return out

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray, float]:
        """(features, log(1 + count), log(1 + words))"""
        words = _WORD.findall(text.lower())
        get, learn = self.seen.get, self._of
        ids = list(chain.from_iterable([x if (x := get(w)) is not None else learn(w) for w in words]))
        kinds, n = np.unique(np.array(ids, np.int64), return_counts=True)
        return kinds, np.log1p(n), float(np.log1p(len(words)))


class Rows:
    """Sparse rows with a few dense columns."""

    def __init__(self, at: np.ndarray, feature: np.ndarray, value: np.ndarray, dense: np.ndarray, width: int):
        self.at, self.feature, self.value, self.dense, self.width = at, feature, value, dense, width

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self.value * w[self.feature], len(self.dense)) + self.dense @ w[self.width :]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, self.value * r[self.at], self.width), self.dense.T @ r])

    def some(self, rows: np.ndarray) -> Rows:
        new = np.full(len(self.dense), -1)
        new[rows] = np.arange(len(rows))
        on = new[self.at] >= 0
        return Rows(new[self.at[on]], self.feature[on], self.value[on], self.dense[rows], self.width)

    def plus(self, column: np.ndarray) -> Rows:
        return Rows(self.at, self.feature, self.value, np.column_stack([self.dense, column]), self.width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: Rows, y: np.ndarray, penalty: float = 1.0, rounds: int = 150) -> np.ndarray:
    """L2-penalised logistic regression by Nesterov's method with a step from the largest curvature; dense column 0 is the constant."""
    w = np.zeros(rows.width + rows.dense.shape[1])
    loose = np.full(len(w), penalty)
    loose[rows.width] = 1e-3
    v = np.random.default_rng(0).normal(size=len(w))
    for _ in range(12):
        v = rows.back(rows.times(v))
        size = np.linalg.norm(v) or 1.0
        v = v / size
    step = 1 / (0.3 * size + penalty)
    look, old = w.copy(), w.copy()
    for i in range(rounds):
        w = look - step * (rows.back(sigmoid(rows.times(look)) - y) + loose * look)
        look = w + i / (i + 3) * (w - old)
        old = w
    return w


def telling(counted: DataFrame, categories: int, keep: int, folds: int, least: int = 3) -> list[np.ndarray]:
    """For each fold the features chosen without its rows, and at last those chosen from all rows: of each category the
    `keep` whose presence differs most between its two kinds of rows, for their number."""
    marks = [F.element_at("marks", c + 1) for c in range(categories)]
    totals = counted.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(f"p{c}") for c, m in enumerate(marks)]).collect()
    stats = counted.select(F.explode("kinds").alias("f"), "marks", "fold").groupBy("f")
    of = lambda x, g: F.sum(x if g == folds else F.when(F.col("fold") != g, x).otherwise(F.lit(0)))
    stats = stats.agg(*[of(F.lit(1), g).alias(f"n{g}") for g in range(folds + 1)], *[of(m, g).alias(f"p{c}_{g}") for c, m in enumerate(marks) for g in range(folds + 1)])
    stats, scores = stored(stats.where(F.col(f"n{folds}") >= least), "features"), []
    for g in range(folds + 1):
        rows = max(sum(t["n"] for t in totals if t["fold"] != g), 1)
        for c in range(categories):
            share = sum(t[f"p{c}"] for t in totals if t["fold"] != g) / rows
            z = F.abs(F.col(f"p{c}_{g}") - F.col(f"n{g}") * share) / F.sqrt(F.col(f"n{g}") * (share * (1 - share)) + 1.0)
            scores.append(F.struct(F.lit(g).alias("g"), F.lit(c).alias("c"), F.when(F.col(f"n{g}") >= least, z).alias("z")))
    rank = F.row_number().over(Window.partitionBy("g", "c").orderBy(F.col("z").desc(), "f"))
    tops = stats.select("f", F.inline(F.array(*scores))).where("z > 1.5").withColumn("rank", rank).where(F.col("rank") <= keep)
    found = tops.select("g", "f").distinct().toPandas()  # at most keep * categories * (folds + 1) rows
    return [np.sort(found["f"][found["g"] == g].to_numpy(np.int64)) for g in range(folds + 1)]


def _only(wanted: np.ndarray, kinds: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each row's wanted features and their values."""
    sizes = [len(k) for k in kinds]
    on = np.isin(np.concatenate([np.zeros(0, np.int64), *kinds]), wanted)
    masks = np.split(on, np.cumsum(sizes)[:-1]) if sizes else []
    return [np.asarray(k)[m] for k, m in zip(kinds, masks)], [np.asarray(v)[m] for v, m in zip(values, masks)]


class Chain:
    """A fitted chain: features, weights of each category (sparse then dense), thresholds."""

    def __init__(self, names, wanted, weights, thresholds):
        self.names, self.wanted, self.weights, self.thresholds = names, wanted, weights, thresholds

    def probabilities(self, kinds: list[np.ndarray], values: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        at = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
        rows = Rows(at, np.concatenate(kinds) if len(kinds) else np.zeros(0, np.int64), np.concatenate(values) if len(values) else np.zeros(0), np.column_stack([np.ones(len(words)), words - 5]), len(self.wanted))
        out = []
        for w in self.weights:
            out.append(sigmoid(rows.times(w)))
            rows = rows.plus(out[-1])
        return np.column_stack(out) if out else np.zeros((len(words), 0))


def fit_one(kinds: list[np.ndarray], values: list[np.ndarray], words: np.ndarray, y: np.ndarray, fold: np.ndarray, earlier: list[np.ndarray], wanted: np.ndarray, allowed: np.ndarray, g: int, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """(weights, probabilities of the fold's own rows) of the model that leaves fold g out; of the whole model where no
    row has fold g. allowed: which of the wanted features it may use; earlier: probabilities of the earlier categories."""
    kinds, values = _only(wanted, kinds, values)
    at = np.repeat(np.arange(len(kinds)), [len(k) for k in kinds])
    feature = np.searchsorted(wanted, np.concatenate([np.zeros(0, np.int64), *kinds]))
    rows = Rows(at, feature, np.concatenate([np.zeros(0), *values]), np.column_stack([np.ones(len(words)), words - 5, *earlier]), len(wanted))
    # Common features would set the step for all: each is brought to a like size for the fit.
    scale = 1 / np.sqrt(np.bincount(rows.feature, rows.value**2, rows.width) / max(len(words), 1) + 0.01)
    on = allowed[rows.feature]
    usable = Rows(rows.at[on], rows.feature[on], (rows.value * scale[rows.feature])[on], rows.dense, rows.width)
    mine, usable = usable.some(np.flatnonzero(fold == g)), usable.some(rest := np.flatnonzero(fold != g))
    w = fit(usable, y[rest], penalty)
    p = sigmoid(mine.times(w))
    w[: len(wanted)] *= scale
    return w, p


def chained(names, wanted: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int, fit_all) -> Chain:
    """The categories in turn. fit_all(c, y, earlier) gives fit_one's results for the folds and at last for the whole
    model. A category with one kind of label only gets a constant model."""
    weights, thresholds, earlier = [], [], []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        if not len(y) or y.min() == y.max():
            w = np.zeros(len(wanted) + 2 + len(earlier))
            w[len(wanted)] = 8.0 if len(y) and y[0] == 1 else -8.0
            weights.append(w)
            thresholds.append(0.5)
            earlier.append(np.full(len(y), sigmoid(w[len(wanted)])))
            continue
        fitted, unseen = fit_all(c, y, earlier), np.zeros(len(y))
        for g in range(folds):
            unseen[fold == g] = fitted[g][1]
        weights.append(fitted[folds][0])
        thresholds.append(best_threshold(unseen, y))
        earlier.append(unseen)
    return Chain(tuple(names), wanted, weights, thresholds)


def fit_chain(kinds: list[np.ndarray], values: list[np.ndarray], words: np.ndarray, labels: np.ndarray, names, chosen: list[np.ndarray], fold: np.ndarray, penalty: float = 1.0) -> Chain:
    """A chain from rows at hand. kinds: features of each row; labels: a 0/1 column for each category; chosen: the
    features of each fold's models, then those of the whole models; fold: the fold of each row."""
    wanted = np.unique(np.concatenate(chosen))

    def fit_all(c: int, y: np.ndarray, earlier: list[np.ndarray]) -> list:
        return [fit_one(kinds, values, words, y, fold, earlier, wanted, np.isin(wanted, own), g, penalty) for g, own in enumerate(chosen)]

    return chained(names, wanted, labels, fold, len(chosen) - 1, fit_all)


def in_order(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values("id", ignore_index=True)


def as_spark_tasks(rows: DataFrame, wanted: np.ndarray, chosen: list[np.ndarray], penalty: float = 1.0):
    """A fit_all that fits each model in a task of its own, to which the sample's rows are shuffled; weights and probabilities come back."""
    allowed, models = [np.isin(wanted, own) for own in chosen], len(chosen)
    dealt = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(models - 1)))).repartitionById(models, "g")

    def fit_all(c: int, y: np.ndarray, earlier: list[np.ndarray]) -> list:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held := list(batches):
                b = in_order(pd.concat(held))
                g = int(b["g"].iloc[0])
                w, p = fit_one([np.asarray(k, np.int64) for k in b["kinds"]], [np.asarray(v, float) for v in b["values"]], b["words"].to_numpy(float), y, b["fold"].to_numpy(np.int64), earlier, wanted, allowed[g], g, penalty)
                yield pd.DataFrame({"g": [g], "w": [w], "p": [p]})

        got = dealt.mapInPandas(released(run), "g int, w array<double>, p array<double>").toPandas().sort_values("g")
        return [(np.array(w, float), np.array(p, float)) for w, p in zip(got["w"], got["p"])]

    return fit_all


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that gives the best F1 of out-of-fold predictions, midway to the next lower one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((p[order[i]] + (p[order[i + 1]] if i + 1 < len(y) else 0)) / 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, conditions=CHAIN, sample: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `sample` labelled documents: id, text and one 0/1 column per category.

    Ids without a document or without a usable label don't count; of contradicting labels the larger one is taken;
    of several texts of one id that of the smallest hash (then the smallest text).
    """
    there = docs.select(col(id_col).alias("id")).where("id is not null").distinct()
    marks = labels.groupBy(col(id_col).alias("id")).agg(*[F.max(F.expr(c).cast("double")).alias(n) for n, c in conditions]).dropna()
    marks = marks.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(sample)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("t")).join(F.broadcast(marks), "id")  # at most `sample` rows
    return rows.groupBy("id").agg(F.min("t").alias("t"), *[F.max(n).alias(n) for n, _ in conditions]).select("id", "t.text", *[n for n, _ in conditions])


def trained(docs: DataFrame, labels: DataFrame, conditions=CHAIN, sample: int = 6000, keep: int = 1000, folds: int = 4, id_col: str = "doc_id", text_col: str = "text", **more) -> Chain:
    """Features of the sample are counted and chosen by Spark and stay there; the driver gets ids, folds and labels of at
    most `sample` rows, the chosen features' numbers, and each model's weights and probabilities."""
    names = [n for n, _ in conditions]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = Counter()
        for b in batches:
            found = [counter.count(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "fold": b["fold"], "kinds": [f[0].astype(np.int32) for f in found], "values": [f[1].astype(np.float32) for f in found], "words": [f[2] for f in found], "marks": list(b[names].to_numpy(np.float64))})

    rows = labelled_sample(docs, labels, conditions, sample, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(folds)).cast("int"))
    schema = f"id {dict(rows.dtypes)['id']}, fold int, kinds array<int>, values array<float>, words double, marks array<double>"
    counted = stored(rows.repartition("id").mapInPandas(count, schema), "counted")
    chosen = telling(counted, len(names), keep, folds)
    wanted = np.unique(np.concatenate(chosen))

    def narrow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["kinds"], b["values"] = _only(wanted, list(b["kinds"]), list(b["values"]))
            yield b

    rows = stored(counted.mapInPandas(narrow, schema), "narrowed")
    got = in_order(rows.select("id", "fold", "marks").toPandas())
    marks = np.stack([np.asarray(m, float) for m in got["marks"]]) if len(got) else np.zeros((0, len(names)))
    return chained(names, wanted, marks, got["fold"].to_numpy(np.int64), folds, as_spark_tasks(rows, wanted, chosen, **more))


def scored(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: row (struct of all its columns), doc_id, a probability per category and a boolean is_<category>.

    Null texts count as empty. Repeated rows get equal results; an empty table gives an empty result. Input
    columns of any name are untouched in row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(packed(docs), col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    names = list(model.names)
    marks = [f"is_{n}" for n in names]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        counter = Counter(m.wanted)
        for texts in batches:
            done = [np.zeros((0, len(names)))]
            for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0, max_bytes):
                found = [counter.count(t) for t in part.column(0).to_pylist()]
                done.append(m.probabilities([f[0] for f in found], [f[1] for f in found], np.array([f[2] for f in found])))
            p = np.concatenate(done)
            yield pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(len(names))] + [pa.array(p[:, i] >= m.thresholds[i]) for i in range(len(names))], names=[*names, *marks])

    @F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names] + [T.StructField(n, T.BooleanType()) for n in marks]))
    def told(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return released(run)(texts)

    # Only texts go to Python and only probabilities come back: the rows stay where they are.
    return base.select("row", "doc_id", told("text").alias("told")).select("row", "doc_id", *[F.col("told").getField(n).alias(n) for n in (*names, *marks)])


def drop_toxic(docs: DataFrame, labels: DataFrame, category: str = "toxic", **more) -> DataFrame:
    """The documents that the chain does not put into `category`, with their columns as they were."""
    model = trained(docs, labels, **more)
    give_back()
    out = scored(docs, model)
    return out.where(~F.col(f"is_{category}")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
