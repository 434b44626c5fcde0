"""URL filter: fixed rules first, then the ratio of two character language models.

URLs that a rule accepts train one variable-order Markov model, URLs that a rule rejects the other (Witten-Bell
smoothing from order 0 to CONTEXT). The score of a URL is its log-likelihood difference per character; the
threshold is calibrated on a fifth of the rule-judged URLs that neither model has seen.

Bounds: characters fall into SYMBOLS classes, so a model has at most SYMBOLS^(CONTEXT+1) counts however many
URLs there are. Those counts, summed by Spark over all URLs, are all that reaches the driver, and the table of
log-ratios that goes back (10 MB) is as large for any input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import col, packed

#: (action, host, path prefix)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
CONTEXT, SYMBOLS = 3, 40
_CLASSES = "abcdefghijklmnopqrstuvwxyz0./-_?=&#:%+"  # class 0: before the start; 39: any other byte; digits share one


def _lookup() -> np.ndarray:
    to = np.full(256, SYMBOLS - 1, np.int64)
    for i, c in enumerate(_CLASSES):
        to[ord(c)] = i + 1
        to[ord(c.upper())] = i + 1
    to[ord("0") : ord("9") + 1] = to[ord("0")]
    return to


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host's A-Z in lower case; both empty for null and where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def judged(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits; nulls where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def encode(urls: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(classes of all URLs, each after CONTEXT zeros; position of each scored character; number of the URL it is in)."""
    raw = [("" if u is None else u).encode("utf-8", "surrogatepass") for u in urls]
    joined = np.frombuffer((b"\0" * CONTEXT).join([b"", *raw]) if raw else b"", np.uint8)
    sizes = np.array([len(r) for r in raw], np.int64)
    to = _lookup()
    codes = to[joined]
    owner = np.repeat(np.arange(len(raw)), sizes)
    begin = np.cumsum(sizes + CONTEXT) - sizes
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    pad = np.ones(len(codes), bool)
    pad[at] = False
    codes[pad] = 0
    return codes, at, owner


def grams(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The number of each character's full-length n-gram, in base SYMBOLS."""
    out = np.zeros(len(at), np.int64)
    for back in range(CONTEXT, -1, -1):
        out = out * SYMBOLS + codes[at - back]
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        codes, at, owner = encode(b["url"])
        g = grams(codes, at)
        good = (b["action"] == "allow").to_numpy()[owner]
        for flag in (True, False):
            kinds, n = np.unique(g[good == flag], return_counts=True)
            yield pd.DataFrame({"good": flag, "gram": kinds, "n": n.astype(np.int64)})


def model(counts: np.ndarray) -> np.ndarray:
    """log P(character | CONTEXT characters before it) for all SYMBOLS^(CONTEXT+1) n-grams, from their counts."""
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(CONTEXT + 1):
        c = counts.reshape(-1, SYMBOLS**order, SYMBOLS).sum(0).astype(np.float64)
        seen, total = (c > 0).sum(1, keepdims=True), c.sum(1, keepdims=True)
        lower = np.tile(p.reshape(-1, SYMBOLS), (c.shape[0] // max(1, p.size // SYMBOLS), 1))
        p = np.where(total > 0, (c + seen * lower) / np.maximum(total + seen, 1), lower)
    return np.log(p).reshape(-1)


def score(urls: pd.Series, ratio: np.ndarray) -> np.ndarray:
    """Mean log-ratio per character; 0 for empty URLs."""
    codes, at, owner = encode(urls)
    sums = np.bincount(owner, weights=ratio[grams(codes, at)], minlength=len(urls))
    return sums / np.maximum(np.bincount(owner, minlength=len(urls)), 1)


def calibrated(histogram: pd.DataFrame) -> float:
    """The threshold of best balanced accuracy, nearest to 0 among equals; histogram: bin (hundredths), good, n."""
    n = {g: histogram[histogram["good"] == g].groupby("bin")["n"].sum() for g in (True, False)}
    if n[True].sum() == 0 or n[False].sum() == 0:
        return 0.0
    cuts = sorted({0, *(int(b) for b in histogram["bin"]), *(int(b) + 1 for b in histogram["bin"])}, key=lambda b: (abs(b), b))
    hit = lambda t: n[True][n[True].index >= t].sum() / n[True].sum() + n[False][n[False].index < t].sum() / n[False].sum()
    return max(cuts, key=hit) / 100


def trained(spark: SparkSession, labelled: DataFrame) -> tuple[np.ndarray, float]:
    """(log-ratio table, threshold) from rows of url, action, held (true: for calibration only)."""
    rows = labelled.where("not held").select("url", "action").mapInPandas(_count, "good boolean, gram long, n long").groupBy("good", "gram").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for flag in (True, False):
        own, table = rows[rows["good"] == flag], np.zeros(SYMBOLS ** (CONTEXT + 1))
        table[own["gram"].to_numpy(np.int64)] = own["n"].to_numpy()
        tables.append(model(table))
    ratio = (tables[0] - tables[1]).astype(np.float32)
    scores = labelled.where("held").withColumn("s", scorer(spark, ratio)(F.col("url")))
    bins = scores.select((F.col("action") == "allow").alias("good"), F.floor(F.greatest(F.least(F.col("s"), F.lit(30.0)), F.lit(-30.0)) * 100).cast("int").alias("bin"))
    return ratio, calibrated(bins.groupBy("good", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas())


def scorer(spark: SparkSession, ratio: np.ndarray):
    shared = spark.sparkContext.broadcast(ratio)

    @F.pandas_udf("double")
    def of(urls: pd.Series) -> pd.Series:
        return pd.Series(score(urls, shared.value))

    return of


def filtered(pages: DataFrame, rules=RULES, url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """One row per page: row (struct of all its columns), page_id, host, path, rule, verdict, score.

    Where a rule fits, the longest one's action is the verdict; else it is allow if the score reaches the
    threshold. Null URLs and those without :// have an empty host and path, and are scored on what they have (0 for
    nothing). Repeated rows get equal verdicts; an empty table gives an empty result; without rule-judged URLs of
    both kinds the models are equal or uniform and the threshold is 0.
    """
    url = col(url_col).cast("string")
    host, path = parts(url)
    base = pages.select(packed(pages), col(id_col).alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, action = judged(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", rule).withColumn("action", action)
    labelled = base.where("action is not null").select("url", "action", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("held"))
    ratio, threshold = trained(pages.sparkSession, labelled)
    return base.withColumn("score", scorer(pages.sparkSession, ratio)(F.col("url"))).select(
        "row", "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score",
    )
