"""Phrases, rules and lexical search against brute force, with nulls, ties, repeats, long texts, empty tables and clashing names."""

import collections
import math
import re

import pytest
from pyspark.sql import functions as F

from tidewell.llm import lexical, phrases, queries, rules

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_phrases(rows, least, most):
    counts, words, out = collections.defaultdict(collections.Counter), collections.Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i : i + k])] += 1
    for lang, f in counts.items():
        good, dead = {p: a for p, a in f.items() if a >= least and len(p) > 1}, set()
        for p, a in good.items():
            dead |= {q for k in range(2, len(p)) for i in range(len(p) - k + 1) if a >= good[q := p[i : i + k]]}
        best = []
        for p, a in good.items():
            if p not in dead:
                score, _, left, right = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, words[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(best)[:most])]
    return sorted(out)


ODD = [("en", "a b c d e f g. A B c d e"), ("en", None), (None, "x x x x x x x x x x\x00 x y É é"), ("", "\n\n"), ("de", ""), ("en", "a\tb  c,d e f g a b c " * 50), (None, "x " * 3000), ("en", "a b c d e f g. A B c d e"), ("fr", "u" * 100_000 + " v" * 5)]


@pytest.mark.parametrize("least", [1, 2, 5])
def test_phrases_equal_brute_force(spark, least):
    df = spark.createDataFrame([(*r, 1, "z") for r in ODD], "lang string, text string, n long, chunk string").repartition(3)
    assert sorted(map(tuple, phrases.collocations(df, least, 30).collect())) == plain_phrases(ODD, least, 30)


def test_phrases_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = phrases.collocations(docs, 8, 2000)
    assert sorted(map(tuple, got.collect())) == plain_phrases([(r.lang, r.text) for r in docs.collect()], 8, 2000)
    assert phrases.collocations(docs.limit(0)).count() == 0


def test_chunks_are_cut_alike_and_count_words_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text")
    one, two = phrases.dictionary(docs), phrases.dictionary(docs.unionByName(docs))
    assert one.count() == two.count()
    words = sum(len(re.findall("[^\x20\x09.,;:!?\x0a-\x0d]+", r.text or "")) for r in docs.collect())
    total = lambda df: df.agg(F.sum(F.col("own") * F.col("weight"))).first()[0]
    assert total(one) == words and total(two) == 2 * words


def test_full_bitmaps_change_no_count(spark, monkeypatch):
    """Filters that let everything pass, as they would at a very large size."""
    monkeypatch.setattr(phrases, "_bitmap", lambda counted, least: phrases.np.full(1 << (phrases.BITS - 6), 2**64 - 1, phrases.np.uint64))
    df = spark.createDataFrame(ODD, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, 2, 30).collect())) == plain_phrases(ODD, 2, 30)


def terms(text):
    return [w.translate(LOW) for w in re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_search(docs, items, k):
    docs, out = [(i, c) for i, t in docs if (c := collections.Counter(terms(t)))], []
    n, total, df = len(docs), sum(sum(c.values()) for _, c in docs), collections.Counter(t for _, c in docs for t in c)
    for item, text in items:
        weight, scores = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in set(terms(text))}, []
        for i, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lexical, "BYTES", block)
    docs = [(3, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (2, ""), (4, "!!"), (5, "É é É x\x00y"), (6, "a " * 5000 + "zz"), (6, "zz A b"), (None, "a"), (3, "a b c"), (9, "q" * 100_000)]
    items = [(1, "a b c"), (2, ""), (3, None), (4, "É zz zz"), (5, "nothing here"), (None, "a"), (6, "q" * 100_000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score long, rank long").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, lexical.search(df, it, 3).collect()), key=str) == plain_search(docs, items, 3)


def test_search_of_empty_tables_and_bounds(spark):
    df, it = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(df.limit(0), it).count() == 0 and lexical.search(df, it.limit(0)).count() == 0
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    c = lexical.Counts(lexical.pa.array([t for _, t in texts]))
    block = lexical.Block([0, 1], [lexical.np.arange(40), lexical.np.arange(40, 90)], c.terms, lexical.np.bincount(c.term), 60, int(c.n.sum()), 5)
    impacts = block.impacts(c)
    bounds = block.bounds(block.sketches(c, impacts))
    for q, own in enumerate(block.queries):
        on = lexical.np.isin(c.term, own)
        exact = lexical.np.bincount(c.doc[on], (impacts * block.weight[c.term])[on], 60)
        assert (bounds[:, q] >= exact).all() and (bounds[:, q] < 1.5 * exact.max() + 1).any()


def test_search_of_a_table(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert sorted(map(tuple, queries.op13_lexical_search(spark, SF).collect()), key=str) == want


def plain_statistics(text):
    import regex

    letters, words, lines = regex.findall(r"\p{L}", text), [w for w in regex.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w], [x for x in text.split("\n") if x]
    over = lambda a, b: a / b if b else 0.0
    marks = sum(c in ".,;:!?'\"()-" for c in text)
    digits, white = len(regex.findall(r"\p{N}", text)), sum(c in " \t\n\x0b\f\r" for c in text)
    return (len(text), len(words), over(len(letters), len(words)), over(len(regex.findall(r"\p{Lu}", text)), len(letters)), over(digits, len(text)), over(marks, len(text)), over(len(text) - len(letters) - digits - marks - white, len(text)), over(white, len(text)),
            over(sum(c in ".!?" for c in text), len(words)), over(len(set(words)), len(words)), over(len(set(lines)), len(lines)), over(len(lines), len(words)))


def test_statistics_equal_plain_ones(spark):
    texts = ["", "a", "A1b2 c3. d!\n\nÉé ñ-ñ 'x' $$$ ###", "x " * 60_000, " \n\t ", "Und Und Und", "١٢ three", None]
    got = rules.statistics(spark.createDataFrame([(t,) for t in texts], "words string").withColumnRenamed("words", "t"), "t").select(*rules.STATISTICS).collect()
    for row, text in zip(got, texts, strict=True):
        assert tuple(row) == pytest.approx(plain_statistics(text or "")), text


def test_rules_of_a_tree():
    tree = "Tree\n  If (feature 1 <= 2.5)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 1 > 2.5)\n   If (feature 1 <= 4.0)\n    Predict: 1.0\n   Else (feature 1 > 4.0)\n    Predict: 0.5\n"
    assert rules.paths(tree) == [((1, "<=", 2.5),), ((0, "<=", 1.0), (1, "<=", 2.5)), ((0, ">", 1.0), (1, "<=", 2.5)), ((1, ">", 2.5),), ((1, "<=", 4.0), (1, ">", 2.5)), ((1, ">", 4.0),)]


def test_compiled_rules_equal_plain_ones(spark):
    model = rules.Ensemble(-0.5, ((1.5, ((3, ">", 0.2), (1, ">", 1.0))), (-2.0, ((9, "<=", 0.5),)), (0.25, ((0, "<=", 4.0),))))
    texts = ["", "AB CD ef", "Und Und Und", "quite a plain line", None, "x", "AB CD ef"]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts)], "row long, text string, score string, words long").repartition(2)
    out = rules.scored(df, model)
    for r in out.collect():
        x = plain_statistics(texts[r.row.row] or "")
        total = model.intercept + sum(w for w, rule in model.rules if all(x[f] <= c if side == "<=" else x[f] > c for f, side, c in rule))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))
    assert rules.scored(df.limit(0), model).count() == 0 and "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op12_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").dropDuplicates(["doc_id"]), "doc_id").where("held_out").toPandas()
    hit = out["predicted"] == out["quality"]
    assert hit.mean() > 0.93 and out["score"].between(0, 1).all()


def test_rules_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    none = spark.createDataFrame([(7, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert rules.trained(docs, none) == rules.Ensemble(0.0, ())
    assert rules.trained(docs, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")) == rules.Ensemble(6.9, ())
    both = rules.labelled_sample(docs, spark.createDataFrame([(1, 1), (1, 0), (2, 1)], "doc_id long, quality int"), F.col("quality"), 10)
    assert sorted(map(tuple, both.collect())) == [("a", 0.0), ("b", 1.0)]
