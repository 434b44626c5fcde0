"""The queries over the operators of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, exact_dedup, lexical, mixing, order_minhash, phrases, pii_crf, rules, sentencepiece_tok, topk, toxicity, url_filter, warc

#: Whole-number target weights of the mix; sources that are not named weigh 1.
MIX_WEIGHTS = {"src0": 5, "src1": 5, "src2": 5, "src3": 3, "src4": 3}
MIX_BLOCK = 16
#: A public SentencePiece model.
TOKENIZER = os.environ.get("TIDEWELL_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
      FROM n WINDOW g AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    nodes = chat_trees.stored(chat_trees.chains(rows), "chains")
    out = chat_trees.formatted(nodes, chat_trees.paths(nodes)).select("conv_id", "formatted", "loss_spans")
    turns = out.withColumn("turns", chat_trees.read_back(F.col("formatted")))
    cut = lambda s: F.substring(F.col("formatted"), (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))
    loss = F.array_join(F.transform("loss_spans", lambda s: chat_trees.unescaped(cut(s))), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, CASE WHEN t = 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er, replace(replace(text, '\', '\\'), '<|', '<\|') AS et FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(er) + length(et) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    out = mixing.schedule(docs, MIX_WEIGHTS, block=MIX_BLOCK)
    return out.select("doc_id", "source", "block", "phase", "release", "deadline", "slot", "mix_pos")


OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5('mix' || coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank FROM d),
s AS (SELECT source, count(*) AS n, CASE source {" ".join(f"WHEN '{s}' THEN {k}" for s, k in MIX_WEIGHTS.items())} ELSE 1 END AS k FROM d GROUP BY source),
q AS (SELECT source, k, ((n + {MIX_BLOCK - 1}) // {MIX_BLOCK} + k - 1) // k AS q FROM s),
e AS (SELECT hi, coalesce(lag(hi) OVER (ORDER BY hi), 0) AS lo, row_number() OVER (ORDER BY hi) - 1 AS phase FROM (SELECT DISTINCT q AS hi FROM q)),
p AS (SELECT phase, lo, hi, list(k ORDER BY source) AS ks, list(source ORDER BY source) AS names, sum(k)::BIGINT AS kk FROM e JOIN q ON q.q >= e.hi GROUP BY ALL),
f AS (SELECT *, coalesce(sum((hi - lo) * kk) OVER (ORDER BY hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot FROM p),
g(phase, t, kk, ks, done, pick) AS (
  SELECT phase, 0::BIGINT, kk, ks, list_transform(ks, lambda k: 0::BIGINT), 0::BIGINT FROM f
  UNION ALL
  SELECT phase, t + 1, kk, ks, list_transform(done, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
  FROM (SELECT *, list_min(list_transform(range(1, len(ks) + 1), lambda i: CASE WHEN (done[i] * kk) // ks[i] <= t
          THEN (((done[i] + 1) * kk + ks[i] - 1) // ks[i]) * 1000000 + i END)) % 1000000 AS best FROM g WHERE t < kk)),
o AS (SELECT g.phase, g.t - 1 AS nth_slot, f.names[g.pick] AS source, row_number() OVER (PARTITION BY g.phase, g.pick ORDER BY g.t) - 1 AS nth, f.lo, f.hi, f.kk, f.first_slot
      FROM g JOIN f USING (phase) WHERE g.t > 0),
b AS (SELECT r.doc_id, r.source, rank, rank // {MIX_BLOCK} AS block, k FROM r JOIN q USING (source))
SELECT doc_id, b.source, block, phase,
       first_slot + ((block - lo * k) * kk) // k AS release, first_slot + ((block - lo * k + 1) * kk + k - 1) // k AS deadline,
       first_slot + (block // k - lo) * kk + nth_slot AS slot, (first_slot + (block // k - lo) * kk + nth_slot) * {MIX_BLOCK} + rank % {MIX_BLOCK} AS mix_pos
FROM b JOIN o ON o.source = b.source AND o.nth = b.block % b.k AND b.block // b.k >= o.lo AND b.block // b.k < o.hi
"""

def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.scored(docs, toxicity.trained(docs, _table(spark, sf_dir, "labels")))
    return out.select("doc_id", *[F.round(n, 6).alias(n) for n, _ in toxicity.CHAIN], *[f"is_{n}" for n, _ in toxicity.CHAIN])


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii_crf.found(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_secret", "n_all")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_tok.tokenised(_table(spark, sf_dir, "documents").select("doc_id", "text"), sentencepiece_tok.load_model(TOKENIZER))
    return out.select("row.doc_id", "ids", "n_tokens", "round_trip", "parity")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filtered(_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("score", 4).alias("score"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5, scale=256)


OP8_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS nth, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.nth, p.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * p.v[i]))::BIGINT AS score
      FROM v q JOIN v p ON q.nth <> p.nth AND len(q.v) = len(p.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to FROM f
"""


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.near_classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"), least=100, most=2000)


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) t(k))),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM h WHERE words > 1),
e AS (SELECT lang, words, phrase, a, w, unnest(range(1, words)) AS cut FROM c),
k AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:words], ' ') AS rp FROM e),
s AS (SELECT k.lang, k.phrase, a, cut, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM k JOIN n ON n.lang = k.lang JOIN h l ON l.lang = k.lang AND l.phrase = lp JOIN h r ON r.lang = k.lang AND r.phrase = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS nth FROM s) WHERE nth = 1),
x AS (SELECT DISTINCT c.lang, array_to_string(w[i:j], ' ') AS phrase, a FROM (SELECT lang, a, w, words, i, unnest(range(i, words + 1)) AS j FROM (SELECT *, unnest(range(1, words + 1)) AS i FROM c)) c WHERE j - i + 1 < words),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN x ON x.lang = b.lang AND x.phrase = b.phrase AND x.a >= b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b ANTI JOIN d USING (lang, phrase)) WHERE rank <= 2000
"""


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = rules.scored(docs, rules.trained(docs, labels.where(~held_out(F.col("doc_id")))))
    doc_id, score = F.col("row.doc_id"), F.round("score", 9)
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"), k=10)


OP13_SQL = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), g),
m AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM d, g),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_personal_data": op3_personal_data,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_url_filter": op5_url_filter,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_source_mixing": op7_source_mixing,
    "op8_exact_topk": op8_exact_topk,
    "op9_warc": op9_warc,
    "op10_near_dedup": op10_near_dedup,
    "op11_phrase_mining": op11_phrase_mining,
    "op12_quality_rules": op12_quality_rules,
    "op13_lexical_search": op13_lexical_search,
}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op6_chat_formatting": OP6_SQL, "op7_source_mixing": OP7_SQL, "op8_exact_topk": OP8_SQL, "op9_warc": OP9_SQL, "op11_phrase_mining": OP11_SQL, "op13_lexical_search": OP13_SQL}
