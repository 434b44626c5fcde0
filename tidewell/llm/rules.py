"""Text quality by a sparse ensemble of rules.

1. Statistics of each whole text, as built-in column expressions.
2. A forest of shallow trees is fitted to the labels; every path from a root is a rule, a conjunction of comparisons.
3. Logistic regression with a lasso penalty gives each rule a weight and most of them none.
4. The rules that are left are compiled into one column expression, which scores any table without Python.

Trees and weights are fitted by Spark's machine-learning library on at most `sample` labelled documents, those of the
smallest hash of their id (a documented bound). All other work covers every row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import col, packed, stored

#: chars, words; letters per word; shares of capitals among letters, of digits, marks, symbols, other and white characters among all; sentence ends per word; shares of distinct words and of distinct lines; lines per word.
STATISTICS = ("chars", "words", "word_length", "capitals", "digits", "marks", "symbols", "white", "ends", "distinct_words", "distinct_lines", "lines")
Rule = tuple[tuple[int, str, float], ...]


def statistics(df: DataFrame, text: str) -> DataFrame:
    """df with one double column for each of STATISTICS, of the string column `text`; empty and null texts have zeros.

    Letters are cut out first, so that the other classes of characters are looked for in the short rest.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    left = lambda c, pattern: F.length(F.regexp_replace(c, pattern, ""))
    df = df.withColumns({"_rest": F.regexp_replace(t, r"\p{L}+", ""), "_n": F.length(t), "_capitals": left(t, r"\P{Lu}+"), "_words": F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""), "_lines": F.filter(F.split(t, "\n"), lambda x: x != "")})
    df = df.withColumns({"_w": F.size("_words"), "_dw": F.size(F.array_distinct("_words")), "_l": F.size("_lines"), "_dl": F.size(F.array_distinct("_lines")), "_r": F.length("_rest")})
    rest, n, w = F.col("_rest"), F.col("_n"), F.col("_w")
    of = lambda pattern: F.col("_r") - left(rest, pattern)
    letters = n - F.col("_r")
    values = {
        "chars": n.cast("double"), "words": w.cast("double"), "word_length": share(letters, w), "capitals": share(F.col("_capitals"), letters), "digits": share(of(r"\p{N}+"), n), "marks": share(of(r"[.,;:!?'\"()-]+"), n),
        "symbols": share(of(r"[^\p{N}\s.,;:!?'\"()-]+"), n), "white": share(of(r"\s+"), n), "ends": share(of(r"[.!?]+"), w), "distinct_words": share(F.col("_dw"), w), "distinct_lines": share(F.col("_dl"), F.col("_l")), "lines": share(F.col("_l"), w),
    }
    return df.withColumns(values).drop("_rest", "_n", "_capitals", "_words", "_lines", "_w", "_dw", "_l", "_dl", "_r")


def tightened(path: list[tuple[int, str, float]]) -> Rule:
    """A path's comparisons, the narrowest of each statistic and side, in a fixed order."""
    best: dict[tuple[int, str], float] = {}
    for f, side, x in path:
        best[f, side] = (min if side == "<=" else max)(x, best.get((f, side), x))
    return tuple((f, side, x) for (f, side), x in sorted(best.items()))


def paths(tree: str) -> list[Rule]:
    """The rules of a tree as Spark describes it: one for each node below the root."""
    out, path = [], []
    for line in tree.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            while path and path[-1][0] >= len(m[1]):
                path.pop()
            path.append((len(m[1]), (int(m[2]), m[3], float(m[4]))))
            out.append(tightened([c for _, c in path]))
    return out


def holds(rule: Rule, names: tuple[str, ...] = STATISTICS) -> Column:
    """1.0 where all comparisons of a rule hold, else 0.0."""
    out = F.lit(True)
    for f, side, x in rule:
        out = out & ((F.col(names[f]) <= x) if side == "<=" else (F.col(names[f]) > x))
    return out.cast("double")


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules."""

    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def probability(self) -> Column:
        """Over the columns of STATISTICS: the probability of label 1, from 0 to 1."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            total = total + F.lit(float(weight)) * holds(rule)
        return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), total))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: Column, sample: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_text and _label (0 or 1) of at most `sample` labelled documents. Of contradicting labels the smaller one is taken, of several texts of one id that of the smallest hash."""
    there = docs.select(col(id_col).alias("_id")).where("_id is not null").distinct()
    marks = labels.groupBy(col(id_col).alias("_id")).agg(F.min(label.cast("double")).alias("_label")).where("_label is not null")
    marks = marks.join(there, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(col(id_col).alias("_id"), F.struct(F.xxhash64(text).alias("h"), text.alias("text")).alias("_t")).join(F.broadcast(marks), "_id")  # at most `sample` rows
    return rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_label").alias("_label")).select(F.col("_t.text").alias("_text"), "_label")


def trained(docs: DataFrame, labels: DataFrame, label: Column | None = None, sample: int = 8000, trees: int = 30, depth: int = 3, penalty: float = 0.002, **columns) -> Ensemble:
    """Rules and their weights from labelled documents. label: what is 1 for good texts, by default the column `quality`.

    Without labels the score is 0.5 everywhere; with labels of one kind only it is 0.999 or 0.001. Other columns are ignored.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rows = statistics(labelled_sample(docs, labels, F.col("quality") if label is None else label, sample, **columns), "_text").select("_label", *STATISTICS)
    rows = stored(rows, "statistics")
    n, good = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if n == 0 or good in (0, n):
        return Ensemble(0.0 if n == 0 else 6.9 if good else -6.9, ())
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = RandomForestRegressor(labelCol="_label", numTrees=trees, maxDepth=depth, maxBins=64, minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=11).fit(vectors)
    found = sorted({r for tree in forest.trees for r in paths(tree.toDebugString)})
    if not found:
        return Ensemble(0.0, ())
    held = stored(rows.select("_label", F.array(*[holds(r) for r in found]).alias("held")), "rules").select("_label", array_to_vector("held").alias("features"))
    fitted = LogisticRegression(labelCol="_label", elasticNetParam=1.0, regParam=penalty, maxIter=100).fit(held)
    return Ensemble(float(fitted.intercept), tuple((float(w), r) for w, r in zip(fitted.coefficients.toArray(), found) if w))


def scored(docs: DataFrame, model: Ensemble, text_col: str = "text") -> DataFrame:
    """row (struct of all columns of docs, which may have any names), score: the probability that a text is good.

    Null texts count as empty; empty texts are scored like any other. Repeated rows get equal scores; an empty table gives an
    empty result.
    """
    rows = docs.select(packed(docs, "_row"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("_text"))
    return statistics(rows, "_text").select(F.col("_row").alias("row"), model.probability().alias("score"))
