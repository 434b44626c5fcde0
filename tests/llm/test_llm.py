"""Operators on small tables: planted cases, nulls, empty tables, ties, repeated rows, clashing names, brute force."""

import collections
import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat_trees, exact_dedup, mixing, order_minhash, pii_crf, queries, sentencepiece_tok, topk, toxicity, url_filter, warc
from tidewell.llm.pii_labels import LABELLED

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, row string, kept string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in texts], DOCS).repartition(3)


def prose(seed, n=120):
    return " ".join(random.Random(seed).choices(WORDS, k=n))


def test_exact_copies(spark):
    texts = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " "), (7, "é"), (8, "a  b"), (None, "ab"), (9, "x" * 200_000), (7, "é")]
    got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs(spark, texts)).collect()))
    assert got == [(0, 3, 5, False), (1, 3, 5, False), (2, 3, 5, False), (3, 3, 5, True), (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 2, False), (7, 7, 2, True), (8, 3, 5, False), (9, 9, 1, True)]
    left = exact_dedup.drop_exact_copies(docs(spark, texts))
    assert left.columns == ["doc_id", "text", "source", "row", "kept"] and sorted(r.doc_id for r in left.collect()) == [3, 6, 7, 9]
    assert exact_dedup.exact_groups(docs(spark, texts).limit(0)).count() == 0


def test_mixing_keeps_all_and_stays_within_a_block(spark):
    rows = [(i, None, s, "", "") for i, s in enumerate(["a"] * 200 + ["b"] * 90 + ["c"] * 37 + [None] * 3)]
    out = mixing.schedule(spark.createDataFrame(rows, DOCS), {"a": 5, "b": 3}, block=4).toPandas()
    assert sorted(out["doc_id"]) == list(range(330)) and out["mix_pos"].is_unique
    assert ((out["release"] <= out["slot"]) & (out["slot"] < out["deadline"])).all()
    # In each phase, after any slot each of its sources is less than one block away from its share.
    weights, begin, slots = {"a": 5, "b": 3, "c": 1, "": 1}, 0, 0
    for _, own in out.groupby("phase"):
        done, seen = collections.Counter(), own.drop_duplicates(["source", "block"]).sort_values("slot")
        active = {s: weights[s] for s in seen["source"].unique()}
        at = dict(zip(seen["slot"], seen["source"]))
        full = len(at) // sum(active.values()) * sum(active.values())
        for n, slot in enumerate(range(begin, begin + full)):
            done[at[slot]] += 1
            assert all(abs(done[s] - (n + 1) * w / sum(active.values())) < 1 for s, w in active.items())
            slots += 1
        begin = max(at) + 1
    assert slots > 40
    same = mixing.mixed(spark.createDataFrame(rows, DOCS), {"a": 5}, name="kept")
    assert set(same.columns) == {"doc_id", "text", "source", "row", "kept"} and same.count() == 330
    assert mixing.schedule(spark.createDataFrame([], DOCS), {}).count() == 0


def test_branches_are_enumerated_and_ranked(spark):
    nodes = spark.createDataFrame(
        [(1, "t", 1, None, 0.0, "user", "q"), (1, "t", 2, 1, 1.0, "assistant", "good <|im_end|>\\n"), (1, "t", 3, 1, 0.5, "assistant", "bad"), (1, "t", 4, 2, 1.0, "us\ner", ""), (1, "t", 5, 3, 9.0, "user", "up"), (1, "t", 6, 6, 1.0, "x", "cycle")],
        "conv_id long, tree string, node long, parent long, score double, role string, text string",
    )
    on = chat_trees.paths(nodes, branches=2)
    got = sorted((r.branch, r.depth, r.node) for r in on.collect())
    assert got == [(1, 1, 1), (1, 2, 3), (1, 3, 5), (2, 1, 1), (2, 2, 2), (2, 3, 4)]
    out = {r.branch: r for r in chat_trees.formatted(nodes, on).withColumn("back", chat_trees.read_back(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in out[2].back] == [("user", "q"), ("assistant", "good <|im_end|>\\n"), ("us\ner", "")]
    assert [out[1].formatted[s.a : s.b] for s in out[1].loss_spans] == ["bad"]


def test_long_chains(spark):
    rows = spark.createDataFrame([(7, t, "user" if t % 2 == 0 else "assistant", f"é{t}") for t in range(300)] + [(None, None, None, None)], "conv_id long, turn long, role string, text string")
    nodes = chat_trees.stored(chat_trees.chains(rows), "t")
    out = {r.conv_id: r for r in chat_trees.formatted(nodes, chat_trees.paths(nodes)).withColumn("n", F.size(chat_trees.read_back(F.col("formatted")))).collect()}
    assert out[7].n == 300 and out[None].n == 1 and [out[7].formatted[s.a : s.b] for s in out[7].loss_spans] == [f"é{t}" for t in range(1, 300, 2)]
    empty = chat_trees.chains(rows.limit(0))
    assert chat_trees.formatted(empty, chat_trees.paths(empty)).count() == 0


def test_loss_text_comes_from_the_mask(spark, monkeypatch):
    good = {r.conv_id: r for r in queries.op6_chat_formatting(spark, SF).collect()}
    assert good[-1].loss_chars == len("<|im_end|><|im_start|>assistant ok") and sum(r.loss_chars for r in good.values()) > good[-1].loss_chars
    right = chat_trees.formatted
    monkeypatch.setattr(chat_trees, "formatted", lambda *a: right(*a).withColumn("loss_spans", F.slice("loss_spans", 1, 0)))
    assert {r.loss_chars for r in queries.op6_chat_formatting(spark, SF).collect()} == {0}


def test_url_rules_and_scores(spark):
    urls = ["http://A.com/x", "https://www.example.com/en/1", "http://example.com/en/", "http://b.net/es/?q", "http://b.net/fr", "http://c.org/p/1", None, "nothing", "http://spam.org"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)], "page_id long, url string, row string")
    got = {r.page_id: r for r in url_filter.filtered(pages).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(5)] == [("a.com", "/x", "com/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("example.com", "/en/", "example.com/en/"), ("b.net", "/es/", "net/es/"), ("b.net", "/fr", None)]
    assert (got[6].host, got[7].path, got[8].path) == ("", "", "") and {got[1].verdict, got[2].verdict} == {"allow", "block"}
    assert url_filter.filtered(pages.limit(0)).count() == 0
    # brute force: the interpolated model, character by character
    counts = np.random.default_rng(1).integers(0, 3, url_filter.SYMBOLS ** (url_filter.CONTEXT + 1))
    table, s, to = url_filter.model(counts), url_filter.SYMBOLS, url_filter._lookup()

    def slow(context, c):
        p = 1 / s
        for order in range(url_filter.CONTEXT + 1):
            cell = counts.reshape(-1, *[s] * (order + 1)).sum(0)
            for x in context[len(context) - order :]:
                cell = cell[x]
            p = (cell[c] + (cell > 0).sum() * p) / (cell.sum() + (cell > 0).sum()) if cell.sum() else p
        return math.log(p)

    text, codes = "http://é.com", [0, 0, 0]
    codes += [int(to[b]) for b in text.encode()]
    want = sum(slow(codes[i - 3 : i], codes[i]) for i in range(3, len(codes))) / (len(codes) - 3)
    assert abs(url_filter.score(pd.Series([text, ""]), table)[0] - want) < 1e-9 and url_filter.score(pd.Series([""]), table)[0] == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=24) * rng.choice([0.1, 1, 5])]) for i in range(400)] + [(1000 + i, [0.5] * 24) for i in range(60)]
    data += [(2000, None), (2001, [float("nan")] * 24), (2002, [None] + [0.0] * 23), (None, [1.0] * 24)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=5, block=64).toPandas()
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v in data[:460]}
    for q in (i for i in good if i % 50 == 0):
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        assert [(-s, v) for s, v in zip(own["score"], own["vec_id"])] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).count() == 0


def test_warc_round_trip(spark):
    html = [(1, "http://a\r\nX: y", "é" * 60), (2, None, "é" * 60), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", "z" * 300_000), (None, "u", "z" * 300_000)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string")
    index = warc.write_archive(pages)
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(got) == 7 and (got[2].record_type, got[2].refers_to, got[2].payload_bytes) == ("revisit", 1, 120) and got[None].refers_to == 6
    assert got[4].record_type == "response" and bytes(got[1].payload).decode() == "é" * 60 and got[5].payload_digest == hashlib.sha256(b"").hexdigest()
    assert [r.page_id for r in warc.read_records(index.where("url is null")).collect()] == [2]
    assert warc.archived(pages.limit(0)).count() == 0


def slow_base(text):
    import re

    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = [c for c in m[0] if c.isascii() and c.isdigit()]
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii_crf.luhn("".join(d)), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), kind, m.end()))
    return sorted(out, key=lambda s: (s[0], pii_crf.BASE.index(s[1])))


def test_base_patterns_equal_the_plain_ones():
    r = random.Random(5)
    parts = ["a@b.c", "@", "a@b", "..", "1.2.3.4", "1.2.3.400", "007.1.1.1.9", "+1 (974) 555-3436", "4539578763621486", "4111 1111-1111 1111", "é", " ", "-", "+", "5", "a.b+c@d-e.f", "\n"]
    for _ in range(3000):
        t = "".join(r.choices(parts, k=r.randint(1, 9)))
        assert pii_crf.base_spans(t) == slow_base(t), t
    assert pii_crf.base_spans("1" * 200_000 + "a" * 200_000) == []


def test_field_on_unseen_lines():
    hit = total = made = 0
    for fold in range(4):
        field = pii_crf.train([x for i, x in enumerate(LABELLED) if i % 4 != fold], rounds=150)
        for line in LABELLED[fold::4]:
            text, gold = pii_crf.marked(line)
            got = field.spans(text)
            made, total = made + len(got), total + len(gold)
            hit += sum(any(k == g[1] and g[0] < e and s < g[2] for s, k, e in got) for g in gold)
    assert hit / total > 0.9 and made < 1.1 * total


def test_viterbi_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, move, line = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([0, 0, 0, 0, 2, 2, 5])
    got = pii_crf.viterbi(emit, move, line)
    for part in ([0, 1, 2, 3], [4, 5], [6]):
        best = max(itertools.product(range(3), repeat=len(part)), key=lambda t: sum(emit[p, x] for p, x in zip(part, t)) + sum(move[a, b] for a, b in zip(t, t[1:])))
        assert tuple(got[part]) == best


def test_pii_rows(spark):
    got = {r.doc_id: r for r in pii_crf.found(docs(spark, [(1, None), (2, ""), (3, "x a@b.de y"), (3, "x a@b.de y")])).collect()}
    assert got[1].spans == got[2].base == "" and got[3].base == "email:2:8" and "email:2:8" in got[3].spans
    assert pii_crf.found(docs(spark, []).limit(0)).count() == 0


def test_sentencepiece_parity_and_round_trip(spark):
    raw = sentencepiece_tok.load_model(queries.TOKENIZER)
    texts = [None, "", " ", "a  b ", "Hello\n\nworld 😀 é", "日本語", "x" * 5000, "▁", "<s> </s>", "   "]
    got = {r.row.doc_id: r for r in sentencepiece_tok.tokenised(docs(spark, list(enumerate(texts))), raw).collect()}
    own = sentencepiece_tok._loaded(raw)[2]
    for i, t in enumerate(texts):
        assert got[i].ids == own.encode(t or "") and got[i].round_trip == (t != "▁") and got[i].parity
    back = sentencepiece_tok.decoded(spark.createDataFrame([(got[4].ids, 1), (None, 2)], "ids array<int>, text int"), raw).collect()
    assert [r.text for r in back] == [texts[4], None]


def test_unigram_models_are_rebuilt():
    pieces = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -2.2, 1), ("ab", -3.0, 1)] + [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    model = {"pieces": pieces, "model": 1, "byte_fallback": True, "charsmap": b"", "dummy_prefix": True, "trim": False, "escape": True, "suffix": False, "unk": 0}
    tok, cut = sentencepiece_tok.build(model)
    assert cut and tok.encode("ab ba").tokens == ["▁ab", "▁", "b", "a"] and tok.decode(tok.encode("ab é").ids) == "ab é"


def test_near_copies_equal_brute_force(spark):
    base, r = [prose(i) for i in range(12)], random.Random(9)

    def edited(t, n):
        w = t.split()
        for _ in range(n):
            w[r.randrange(len(w))] = r.choice(WORDS)
        return " ".join(w)

    texts = [edited(b, n) for b in base for n in (0, 1, 2, 3, 8)] + [edited(base[0], 3) for _ in range(40)] + [base[1]] * 5 + [None, "", "", "!!", "one two", "One two!", "one"]
    got = {x.doc_id: x.class_id for x in order_minhash.near_classes(docs(spark, list(enumerate(texts)))).collect()}
    found, parent = [order_minhash.kmers(order_minhash.words(t or "")) for t in texts], list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            equal = order_minhash.digest(texts[i] or "", order_minhash.words(texts[i] or "")) == order_minhash.digest(texts[j] or "", order_minhash.words(texts[j] or ""))
            if equal or (len(found[i]) and len(found[j]) and order_minhash.distance(found[i], found[j]) <= 0.2 + 1e-12):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    assert got == {i: top(i) for i in range(len(texts))}
    left = order_minhash.drop_near_copies(docs(spark, list(enumerate(texts))))
    assert left.columns[0] == "doc_id" and sorted(x.doc_id for x in left.collect()) == sorted(set(got.values()))
    assert order_minhash.near_classes(docs(spark, []).limit(0)).count() == 0


def test_repeated_ids_do_not_bring_near_copies_back(spark):
    text, other = prose(70), prose(71)
    near = " ".join([*text.split()[:-1], "changed"])
    d = docs(spark, [(3, text), (5, near), (5, other), (8, other + " more"), (9, text), (9, near), (None, prose(72)), (None, prose(73)), (None, prose(73) + " x")])
    left = order_minhash.drop_near_copies(d)
    got = sorted((x.doc_id or 0, x.text) for x in left.collect())
    assert got[2:] == [(3, text), (5, other)] and [i for i, _ in got[:2]] == [0, 0] and len(got) == 4
    twice = order_minhash.near_classes(docs(spark, [(5, text), (5, near), (5, near), (6, near)])).collect()
    assert sum(x.kept for x in twice) == 1 and {x.class_size for x in twice} == {4} and twice[0].asDict().keys() == {"doc_id", "class_id", "class_size", "kept"}


def test_toxicity_on_unseen_documents(spark):
    texts = [(i, prose(i) + (" vile rotten" if i % 4 == 0 else "")) for i in range(400)]
    d = docs(spark, texts + [(1000, None), (1001, "")])
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    left = toxicity.drop_toxic(d, labels)
    assert left.columns == d.columns
    ids = {r.doc_id for r in left.collect()}
    assert {1000, 1001} <= ids and not {i for i in range(200, 400) if i % 4 == 0} & ids and len([i for i in range(200, 400) if i % 4 and i in ids]) >= 147
    assert toxicity.drop_toxic(d.limit(0), labels.limit(0)).count() == 0


def test_toxicity_is_trained_without_features_at_the_driver(spark, monkeypatch):
    texts = [(i, prose(i) + (" vile rotten" if i % 4 == 0 else "")) for i in range(300)]
    d = docs(spark, texts).repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    sent, chosen, to_pandas, telling = [], [], type(d).toPandas, toxicity.telling
    monkeypatch.setattr(type(d), "toPandas", lambda self: sent.append(set(self.columns)) or to_pandas(self))
    monkeypatch.setattr(toxicity, "telling", lambda *a: chosen.extend(telling(*a)) or chosen)
    got = toxicity.trained(d, labels)
    assert sent and not {"kinds", "values", "text"} & set().union(*sent)
    # The same chain as from rows at hand.
    folds = dict(d.selectExpr("doc_id", "pmod(xxhash64(doc_id, 1), 4)").collect())
    counter = toxicity.Counter()
    found = [counter.count(t) for _, t in texts]
    marks = np.array([[i % 3 == 0, i % 4 == 0, i % 4 == 0 and i % 3 > 0] for i, _ in texts], float)
    right = toxicity.fit_chain([f[0] for f in found], [f[1].astype(np.float32).astype(float) for f in found], np.array([f[2] for f in found]), marks, got.names, chosen, np.array([folds[i] for i, _ in texts]))
    assert np.array_equal(got.wanted, right.wanted) and np.allclose(got.thresholds, right.thresholds)
    assert all(np.allclose(a, b) and len(a) == len(b) for a, b in zip(got.weights, right.weights, strict=True))


def test_pipeline_without_data(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def slow_exact(rows):
    """Of texts that are equal without blanks the longest stays, then the smallest id."""
    groups = collections.defaultdict(list)
    for i, t in rows.items():
        groups["".join(c for c in t if c not in " \t\n\v\f\r")].append(i)
    return {min(g, key=lambda i: (-len(rows[i]), i)) for g in groups.values()}


def slow_near(rows):
    """The smallest id of each document's component, links being found by comparing all pairs."""
    found, top = {i: order_minhash.kmers(order_minhash.words(t)) for i, t in rows.items()}, {i: i for i in rows}
    for i in rows:
        for j in rows:
            if j < i and top[i] != top[j] and order_minhash.distance(found[i], found[j]) <= 0.2 + 1e-12:
                a, b = sorted((top[i], top[j]))
                top = {k: a if v == b else v for k, v in top.items()}
    return top


def test_queries_and_pipeline_equal_brute_force_on_planted_documents(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = {i: prose(1000 + i) + (" vile rotten" if i % 4 == 0 else "") for i in range(240)}
    rows |= {300 + i: rows[4 * i + 1] for i in range(10)} | {400 + i: rows[4 * i + 2] + " more words" for i in range(10)} | {500: "mail a@b.de from 1.2.3.4"}
    spark.createDataFrame([(i, t, f"src{i % 3}") for i, t in rows.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    urls = ["http://a.com/x", "https://www.example.com/en/1", "nothing"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    own = sentencepiece_tok._loaded(sentencepiece_tok.load_model(queries.TOKENIZER))[2]
    planted = {i for i in range(240) if i % 4 == 0}

    scores = {r.doc_id: r for r in queries.op2_toxicity(spark, str(tmp_path)).collect()}
    assert scores.keys() == rows.keys() and all(scores[i].is_toxic or scores[i].is_toxic_prose for i in planted)
    pii = {r.doc_id: r for r in queries.op3_personal_data(spark, str(tmp_path)).collect()}
    assert pii.keys() == rows.keys() and all((r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for _, k, _ in slow_base(rows[i])) for x in ("email", "ip", "card", "phone")) for i, r in pii.items())
    assert {r.doc_id: list(r.ids) for r in queries.op4_sentencepiece(spark, str(tmp_path)).collect()} == {i: own.encode(t) for i, t in rows.items()}
    assert {r.page_id: (r.host, r.path) for r in queries.op5_url_filter(spark, str(tmp_path)).collect()} == {0: ("a.com", "/x"), 1: ("www.example.com", "/en/1"), 2: ("", "")}
    assert {r.doc_id: r.class_id for r in queries.op10_near_dedup(spark, str(tmp_path)).collect()} == slow_near(rows)

    clean = {r.doc_id: r.text for r in pipeline.toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()}
    assert not planted & clean.keys() and len(clean) > 0.95 * (len(rows) - len(planted))
    left = {i: clean[i] for i in slow_exact(clean)}
    left = {i: left[i] for i in set(slow_near(left).values())}
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: (list(r.ids), r.source) for i, r in got.items()} == {i: (own.encode(t), f"src{i % 3}") for i, t in left.items()}
    assert len({r.mix_pos for r in got.values()}) == len(got)


def test_mixing_of_fine_weights(spark):
    rows = [(i, None, s, "", "") for i, s in enumerate(["a"] * 3000 + ["b"] * 1700)]
    out = mixing.schedule(spark.createDataFrame(rows, DOCS), {"a": 1501, "b": 998}, block=1).toPandas().sort_values("slot")
    a = np.cumsum(out["source"] == "a").to_numpy()[:2499]
    assert (np.abs(a - np.arange(1, 2500) * 1501 / 2499) < 1).all() and ((out["release"] <= out["slot"]) & (out["slot"] < out["deadline"])).all()


def test_exact_copies_without_ids_spread(spark):
    rows = [(None, "same text")] * 200 + [(7, "same  text"), (None, "other")]
    got = exact_dedup.exact_groups(docs(spark, rows)).collect()
    assert len(got) == 202 and sum(r.kept for r in got) == 2 and {r.group_size for r in got} == {201, 1}


def slow_chain(kinds, values, words, labels, chosen, fold):
    """The chain by dense matrices, category after category."""
    wanted = np.unique(np.concatenate(chosen))
    x = np.zeros((len(words), len(wanted)))
    for i, (k, v) in enumerate(zip(kinds, values)):
        for f, value in zip(k, v):
            if f in wanted:
                x[i, np.searchsorted(wanted, f)] = value
    x /= np.sqrt((x**2).sum(0) / len(words) + 0.01)
    dense, out = np.column_stack([np.ones(len(words)), words - 5]), []
    for y in labels.T:
        def fitted(rows, allowed):
            m = np.column_stack([x[rows] * np.isin(wanted, allowed), dense[rows]])
            w, v, loose = np.zeros(m.shape[1]), np.random.default_rng(0).normal(size=m.shape[1]), np.ones(m.shape[1])
            loose[len(wanted)] = 1e-3
            for _ in range(12):
                v = m.T @ (m @ v)
                size = np.linalg.norm(v)
                v /= size
            look = old = w
            for i in range(150):
                w = look - (m.T @ (1 / (1 + np.exp(-np.clip(m @ look, -40, 40))) - y[rows]) + loose * look) / (0.3 * size + 1)
                look, old = w + i / (i + 3) * (w - old), w
            return w

        unseen = np.zeros(len(words))
        for g in np.unique(fold):
            w, own = fitted(np.flatnonzero(fold != g), chosen[g]), fold == g
            unseen[own] = 1 / (1 + np.exp(-np.column_stack([x[own] * np.isin(wanted, chosen[g]), dense[own]]) @ w))
        out.append((fitted(np.arange(len(words)), chosen[-1]), unseen))
        dense = np.column_stack([dense, unseen])
    return out


def test_the_chain_equals_a_plain_one():
    r = np.random.default_rng(4)
    n, fold = 120, np.arange(120) % 3
    kinds = [np.sort(r.choice(30, 6, replace=False)) for _ in range(n)]
    values = [np.log1p(r.integers(1, 4, 6)) for _ in range(n)]
    labels = np.column_stack([[float(3 in k) for k in kinds], [float(3 in k or 5 in k) for k in kinds]])
    chosen = [np.array([1, 3, 5, 8]), np.array([3, 5, 9]), np.array([2, 3, 5]), np.array([3, 5, 7])]
    words = r.normal(5, 1, n)
    chain = toxicity.fit_chain(kinds, values, words, labels, ("a", "b"), chosen, fold)
    for w, (want, unseen), y, t in zip(chain.weights, slow_chain(kinds, values, words, labels, chosen, fold), labels.T, chain.thresholds):
        wanted = np.unique(np.concatenate(chosen))
        scale = np.sqrt(np.array([sum(v[list(k).index(f)] ** 2 for k, v in zip(kinds, values) if f in k) for f in wanted]) / n + 0.01)
        assert np.allclose(w[: len(wanted)] * scale, want[: len(wanted)], atol=1e-6) and np.allclose(w[len(wanted) :], want[len(wanted) :], atol=1e-6)
        assert abs(t - toxicity.best_threshold(unseen, y)) < 1e-6
    # a fold's model has no weight on features that were not chosen for it
    alone = toxicity.fit_chain(kinds, values, words, labels, ("a", "b"), [*chosen[:3], np.array([7])], fold)
    assert not alone.weights[0][[list(alone.wanted).index(f) for f in (1, 3, 5, 8)]].any()


def test_labels_without_documents_and_repeated_ids(spark):
    d = docs(spark, [(1, "b text"), (1, "a text"), (2, None), (4, "x" * 300_000)])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(1, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.id: r for r in toxicity.labelled_sample(d, labels, sample=3).collect()}
    assert got.keys() == {1, 2, 4} and got[2].text == "" and got[1].toxic == 1 and len(got[4].text) == 300_000
    assert [r.text for r in toxicity.labelled_sample(d, labels, sample=3).where("id = 1").collect()] == [got[1].text]


def test_planted_secrets_are_found(spark):
    r = random.Random(8)
    rows = [(i, prose(i, 30) + f' token = "{r.getrandbits(160):040x}" ' + prose(i + 1, 20) + " AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) + " end") for i in range(60)]
    rows += [(100 + i, prose(i, 40)) for i in range(60)] + [(300, prose(3, 100_000) + " a@b.de")]
    got = {x.doc_id: x for x in pii_crf.found(docs(spark, rows)).collect()}
    assert sum(got[i].n_secret for i in range(60)) >= 108 and sum(got[100 + i].n_all for i in range(60)) <= 3 and got[300].n_email == 1


def test_url_verdicts_equal_brute_force(spark):
    r = random.Random(2)
    hosts = ["a.com", "www.example.com", "example.com", "x.net", "y.net", "good.org", "spam.biz", "A.COM", ""]
    rows = [(i, f"http://{r.choice(hosts)}{r.choice(['/en/', '/es/', '/fr/', '/p', ''])}{r.choice(['cheap-pills', 'article', '?q=1', '#f'])}{r.randint(0, 9)}", "r", "h") for i in range(600)]
    rows += [rows[0], rows[5], (None, None, "r", "h"), (900, "no scheme", "r", "h"), (901, "http://" + "x" * 100_000, "r", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, row string, host string")
    got = url_filter.filtered(pages).collect()
    assert len(got) == len(rows) and {x.row.host for x in got} == {"h"}

    def judged(url):
        rest = (url or "").partition("://")[2]
        host = rest.split("/")[0].split("?")[0].split("#")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        fits = [(h + p, a) for a, h, p in url_filter.RULES if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        return host.lower(), path, *(max(fits, key=lambda f: len(f[0])) if fits else (None, None))

    counts = {g: collections.Counter() for g in (True, False)}
    held = {x.url: x.h for x in pages.select("url", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("h")).collect()}
    for _, url, *_ in rows:
        if judged(url)[3] and not held[url]:
            codes, at, _ = url_filter.encode(pd.Series([url]))
            counts[judged(url)[3] == "allow"].update(url_filter.grams(codes, at).tolist())
    tables = []
    for g in (True, False):
        dense = np.zeros(url_filter.SYMBOLS ** (url_filter.CONTEXT + 1))
        for k, n in counts[g].items():
            dense[k] = n
        tables.append(url_filter.model(dense))
    ratio = (tables[0] - tables[1]).astype(np.float32)
    scores = {url: float(url_filter.score(pd.Series([url]), ratio)[0]) for _, url, *_ in rows}
    bins = [(math.floor(min(max(scores[u], -30), 30) * 100), judged(u)[3] == "allow") for _, u, *_ in rows if judged(u)[3] and held[u]]
    right = lambda t: sum(b >= t for b, g in bins if g) / sum(g for _, g in bins) + sum(b < t for b, g in bins if not g) / sum(not g for _, g in bins)
    cuts = sorted({0, *(b for b, _ in bins), *(b + 1 for b, _ in bins)}, key=lambda b: (abs(b), b))
    threshold = max(cuts, key=right) / 100
    for x in got:
        host, path, rule, action = judged(x.row.url)
        assert (x.host, x.path, x.rule) == (host, path, rule) and abs(x.score - scores[x.row.url]) < 1e-9
        assert x.verdict == (action or ("allow" if x.score >= threshold else "block"))


def test_trees_equal_brute_force(spark):
    r, rows = random.Random(6), []
    for tree in range(6):
        for i in range(40):
            rows.append((tree, f"t{tree}", i, r.randrange(i) if i and r.random() < 0.95 else None, float(r.randint(0, 3)), r.choice(["user", "assistant"]), f"m{i} <|x|> \\", "clash"))
    rows += [(9, "hot", 0, None, 0.0, "user", "root", "c")] + [(9, "hot", i, 0, i % 7 + 0.0, "assistant", "reply", "c") for i in range(1, 3000)]
    nodes = spark.createDataFrame(rows, "conv_id int, tree string, node long, parent long, score double, role string, text string, depth string")
    on = chat_trees.paths(nodes, branches=3)
    got = collections.defaultdict(list)
    for x in on.collect():
        got[x.tree, x.branch].append((x.depth, x.node))
    own = {(t, n): (p, s) for _, t, n, p, s, *_ in rows}
    for tree in {t for t, _ in own}:
        inner, paths = {p for (t, _), (p, _) in own.items() if t == tree}, []
        for n in (n for t, n in own if t == tree and n not in inner):
            path, score = [n], own[tree, n][1]
            while own[tree, path[-1]][0] is not None:
                path.append(own[tree, path[-1]][0])
                score += own[tree, path[-1]][1]
            paths.append((-score, -len(path), n, path[::-1]))
        for branch, (*_, path) in enumerate(sorted(paths)[:3], 1):
            assert [n for _, n in sorted(got[tree, branch])] == path
    text = {(t, n): (ro, te) for _, t, n, _, _, ro, te, _ in rows}
    for x in chat_trees.formatted(nodes, on).withColumn("back", chat_trees.read_back(F.col("formatted"))).collect():
        tree = "hot" if x.conv_id == 9 else f"t{x.conv_id}"
        assert [(b.role, b.text) for b in x.back] == [text[tree, n] for _, n in sorted(got[tree, x.branch])]


def test_top_k_prunes_both_ways_and_ignores_other_columns(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 32))
    data = [(i, [float(x) for x in (centres[i % 12] + 0.02 * rng.normal(size=32)) * rng.choice([0.02, 1, 30])], 1.0, 2) for i in range(600)]
    data += [(700 + i, [float(x) for x in rng.normal(size=32)], 1.0, 2) for i in range(300)] + [(1500, [0.0] * 32, 1.0, 2), (1550, [-9.0] * 32, 1.0, 2)] + [data[3]]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>, norm double, bucket int")
    got = topk.top_k(frame, F.col("vec_id") % 50 == 0, k=5, block=40).toPandas()
    good = {i: np.floor(256 * np.array(v)).astype(int) for i, v, *_ in data}
    every = [(i, good[i]) for i, *_ in data]  # rows that repeat an id are candidates each
    for q in (i for i in good if i % 50 == 0):
        want = sorted(((-int(good[q] @ v), i) for i, v in every if i != q))[:5]
        own = got[got["query_id"] == q].sort_values("rank")
        assert [(-s, v) for s, v in zip(own["score"], own["vec_id"])] == want
    twice = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [3.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, k=2)
    unit = 256 * 256
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in twice.collect()) == sorted([*[(0, 1, 0, 5 * unit), (0, 2, 0, 3 * unit)] * 2, (0, 1, 0, 3 * unit), (0, 2, 0, 3 * unit)])
    block = topk.Block(np.arange(600), np.arange(600), np.stack([good[i] for i in range(600)]))
    unit = good[5] / np.linalg.norm(good[5])
    near = block.near(unit, 0.95)
    cosines = (block.v @ unit) / block.length
    assert set(np.flatnonzero(cosines >= 0.95)) <= set(near.tolist()) and len(near) < 300
    wide = spark.createDataFrame([(i, [1.0 + i] * 20_000) for i in range(60)], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(wide, F.col("vec_id") % 50 == 0, k=1).orderBy("query_id").collect()] == [(0, 59), (50, 59)]
    assert topk.top_k(wide.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_warc_keeps_odd_urls_and_other_columns_out(spark):
    urls = ["http://a\r\nX: y", "http://é/\x7f%0D", "plain", None, ""]
    pages = spark.createDataFrame([(i, u, "p" * 200 * i, "x", "y") for i, u in enumerate(urls)] + [(4, "again", "p" * 800, "x", "y")], "page_id long, url string, html string, payload string, salt string")
    got = warc.archived(pages).collect()
    assert sorted((r.page_id, r.url or "") for r in got) == sorted([(i, u or "") for i, u in enumerate(urls)] + [(4, "again")])
    many = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 40).alias("html"))
    back = warc.read_records(warc.write_archive(many))
    assert back.count() == 3000 and back.rdd.getNumPartitions() > 1


def test_sentencepiece_long_and_repeated_texts(spark):
    raw = sentencepiece_tok.load_model(queries.TOKENIZER)
    own = sentencepiece_tok._loaded(raw)[2]
    texts = [prose(1, 200_000), "é" * 300_000, prose(2), prose(2)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    for verify in (True, False):
        got = sentencepiece_tok.tokenised(docs(spark, rows), raw, verify=verify, keep=("doc_id", "row")).collect()
        assert len(got) == 5 and all(r.round_trip and r.parity and list(r.ids) == own.encode(texts[r.row.doc_id]) for r in got)
    few = sentencepiece_tok.Encoder(raw, most=200)
    for i in range(30):
        text = prose(i, 60) + " the same words again"
        assert few.encode([text])[0][0].tolist() == own.encode(text) and len(few.seen) + len(few.older) < 600
    # a model with a normaliser is encoded text by text
    whole = sentencepiece_tok.Encoder(raw)
    whole.cut = False
    assert [x[0].tolist() for x in whole.encode([prose(3), "a  b"])] == own.encode([prose(3), "a  b"])


def test_near_copies_of_very_long_texts_and_clashing_columns(spark):
    long = prose(50, 60_000)
    other = long.split()
    other[5:9] = ["new"] * 4
    d = spark.createDataFrame([(1, long, 5, "a"), (2, " ".join(other), 6, "b"), (3, prose(51), 7, "c")], "doc_id long, text string, node long, salt string")
    assert sorted((r.doc_id, r.class_id) for r in order_minhash.near_classes(d).collect()) == [(1, 1), (2, 1), (3, 3)]
    left = order_minhash.drop_near_copies(d)
    assert left.columns == d.columns and sorted((r.doc_id, r.node, r.salt) for r in left.collect()) == [(1, 5, "a"), (3, 7, "c")]


def test_large_groups_are_cut_into_parts(spark, monkeypatch):
    for name, value in (("CHUNK", 8), ("LOT", 5)):
        monkeypatch.setattr(order_minhash, name, value)
    r, base = random.Random(12), [prose(400 + i, 40) for i in range(3)]
    texts = []
    for i in range(120):
        w = base[i % 3].split()
        for _ in range(r.choice([0, 1, 1, 2, 3])):
            w[r.randrange(len(w))] = r.choice(WORDS)
        texts.append(" ".join(w))
    rows = dict(enumerate(texts))
    assert {x.doc_id: x.class_id for x in order_minhash.near_classes(docs(spark, list(rows.items()))).collect()} == slow_near(rows)


def test_pipeline_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, prose(2000 + i), f"src{i % 2}", 1, "r", 7) for i in range(40)] + [(50, None, None, 1, "r", 7), (51, "", "src0", 1, "r", 7), (None, prose(2500), None, 1, "r", 7), (3, prose(2003), "src1", 1, "r", 7), (52, prose(2004) + " x", "src1", 1, "r", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, mix_pos int, row string, ids int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got) == sorted([-1, *range(40), 50]) and len({r.mix_pos for r in got}) == len(got)
    assert {r.doc_id: r.n_tokens for r in got}[50] == 0
