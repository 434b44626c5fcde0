"""SentencePiece models run by the tokenizers library.

The model file's protobuf is parsed here; normaliser (character map, white space rules), the metaspace marker,
unigram scores or BPE merges, and byte fallback are rebuilt as a tokenizers pipeline. Batches are encoded by its
threads. Where no piece of the model holds a marker behind another character, texts are cut in front of runs of
markers and each task encodes equal cuts once; for other models whole texts are encoded.

A BPE model ranks merges by the score of the merged piece and takes the leftmost of equals, while tokenizers
ranks pairs; the two can differ where one piece can be made of different overlapping pairs. So parity is not
assumed: `verify` encodes each cut with the sentencepiece library too, and column parity tells where its ids differ
from the rebuilt tokenizer's, which are the result.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, released, slices

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
GROUP = 512
_CUTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message; varints as int, fixed32 as bytes, the rest as bytes."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out |= (raw[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if raw[i - 1] < 128:
                return out, i

    i = 0
    while i < len(raw):
        key, i = varint(i)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            n, i = varint(i)
            value, i = raw[i : i + n], i + n
        else:
            n = {1: 8, 5: 4}[wire]
            value, i = raw[i : i + n], i + n
        yield number, value


def parse_model(raw: bytes) -> dict:
    """pieces [(text, score, kind)], kind of model, byte fallback, unknown id and the normaliser's settings."""
    out = {"pieces": [], "model": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "trim": True, "escape": True, "suffix": False}
    for number, value in _fields(raw):
        if number == 1:
            p = dict(_fields(value))
            out["pieces"].append((p.get(1, b"").decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
        elif number == 2:
            t = dict(_fields(value))
            out |= {"model": t.get(3, UNIGRAM), "byte_fallback": bool(t.get(35, 0)), "suffix": bool(t.get(24, 0))}
        elif number == 3:
            n = dict(_fields(value))
            out |= {"charsmap": n.get(2, b""), "dummy_prefix": bool(n.get(3, 1)), "trim": bool(n.get(4, 1)), "escape": bool(n.get(5, 1))}
    out["unk"] = next((i for i, p in enumerate(out["pieces"]) if p[2] == UNKNOWN), 0)
    if out["model"] not in (UNIGRAM, BPE) or out["suffix"] or not out["escape"]:
        raise ValueError("only unigram and BPE models with a leading, escaped white space marker are supported")
    return out


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to make a normal piece of two pieces, by the made piece's score, then the shorter left part first."""
    usable = {t for t, _, k in pieces if k in (NORMAL, USER)}
    found = []
    for t, s, k in pieces:
        if k == NORMAL and len(t) > 1:
            found += [(-s, len(found) + i, t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in usable and t[i:] in usable]
    return [(a, b) for _, _, a, b in sorted(found)]


def build(model: dict):
    """(tokenizer, whether texts may be cut in front of runs of markers)."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    pieces = model["pieces"]
    if model["model"] == BPE:
        vocab = {t: i for i, (t, _, _) in enumerate(pieces)}
        core = models.BPE(vocab=vocab, merges=_merges(pieces), unk_token=pieces[model["unk"]][0], byte_fallback=model["byte_fallback"], fuse_unk=True)
    else:
        # Pieces that texts can't reach get a score no path will choose.
        core = models.Unigram([(t, s if k in (NORMAL, USER) else (0.0 if k == BYTE else -1e9)) for t, s, k in pieces], model["unk"], model["byte_fallback"])
    tok = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["trim"]:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tok.normalizer = normalizers.Sequence(steps)
    cut = not any(MARK in t.lstrip(MARK) for t, _, k in pieces if k in (NORMAL, USER))
    if cut:
        tok.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+"), "merged_with_next")
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else [])])
    return tok, cut


@lru_cache(2)
def _loaded(raw: bytes):
    """(tokenizer, the same without normaliser, sentencepiece's own, model, whether texts may be cut)."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    model = parse_model(raw)
    tok, cut = build(model)
    plain = Tokenizer(tok.model)
    if cut:
        plain.pre_tokenizer = tok.pre_tokenizer
    return tok, plain, SentencePieceProcessor(model_proto=raw), model, cut and model["dummy_prefix"] and not model["charsmap"] and not model["trim"]


class Encoder:
    """Encodes texts of one task; cuts seen before are looked up.

    Memory is two generations of at most `most` cuts or 32 times as many characters together: when the younger one has
    half of that, the older one is dropped and the younger one takes its place. A cut that is met again comes back into
    the younger one, so frequent cuts stay.

    Ids are kept as bytes of 32-bit integers, which join fast and which Python's garbage collector needn't visit.
    """

    def __init__(self, raw: bytes, verify: bool = True, most: int = 200_000):
        self.tok, self.plain, self.own, self.model, self.cut = _loaded(raw)
        self.verify, self.most = verify, most
        self.first = np.array([t.startswith(MARK) for t, _, _ in self.model["pieces"]])
        self.pieces = [chr(int(t[1:-1], 16)) if k == BYTE and int(t[1:-1], 16) < 128 else t for t, _, k in self.model["pieces"]]
        self.older, self.seen, self.other, self.lossy, self.chars = {}, {}, set(), set(), 0

    def _age(self) -> None:
        self.older, self.seen, self.chars = self.seen, {}, 0
        self.other &= self.older.keys()
        self.lossy &= self.older.keys()

    def _pieces(self, text: str) -> list[str]:
        return _CUTS.findall(MARK + text.replace(" ", MARK)) if text else []

    def _learn(self, cuts: list[str]) -> None:
        """Cuts of one marker and more are encoded joined, since each begins with the only piece that holds a marker;
        a group for which that, parity or the way back fails, and other cuts, are encoded one by one."""
        joined = [c for c in cuts if len(c) > 1 and c[1] != MARK]
        alone = [c for c in cuts if len(c) == 1 or c[1] == MARK]
        groups = [joined[i : i + GROUP] for i in range(0, len(joined), GROUP)]
        texts = ["".join(g) for g in groups]
        ids = [np.array(e.ids, np.int32) for e in self.plain.encode_batch_fast(texts, add_special_tokens=False)]
        true = self.own.encode([t[1:].replace(MARK, " ") for t in texts], num_threads=1) if self.verify else ids
        for group, text, a, b in zip(groups, texts, ids, true, strict=True):
            begin = np.flatnonzero(self.first[a])
            if len(begin) == len(group) and np.array_equal(a, b) and "".join([self.pieces[i] for i in a.tolist()]) == text:
                whole, at = a.tobytes(), (4 * np.append(begin, len(a))).tolist()
                self.seen.update(zip(group, [whole[x:y] for x, y in zip(at, at[1:])], strict=True))
            else:
                alone += group
        self.chars += sum(map(len, joined))
        self._one_by_one(alone)

    def _one_by_one(self, cuts: list[str]) -> None:
        ids = [e.ids for e in self.plain.encode_batch_fast(cuts, add_special_tokens=False)]
        texts = [c[1:].replace(MARK, " ") for c in cuts]
        true = self.own.encode(texts, num_threads=1) if self.verify else ids
        true = [t or i for t, i in zip(true, ids, strict=True)]  # sentencepiece has no ids for an empty text; a cut of one marker has
        back = self.tok.decode_batch(ids, skip_special_tokens=False)
        for c, t, a, b, r in zip(cuts, texts, ids, true, back, strict=True):
            self.seen[c] = np.array(a, np.int32).tobytes()
            self.chars += len(c)
            if a != b:
                self.other.add(c)
            if r != t:
                self.lossy.add(c)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """(ids, whether decoding gives the text again, parity with sentencepiece) of each text."""
        if not self.cut:
            return self._whole(texts)
        cut = [self._pieces(t) for t in texts]
        if len(self.seen) >= self.most // 2 or self.chars >= 16 * self.most:
            self._age()
        new = set().union(*cut).difference(self.seen)
        known = self.older.keys() & new
        self.seen.update((c, self.older[c]) for c in known)
        self.chars += sum(map(len, known))
        new -= known
        if new:
            self._learn(sorted(new))
        out, get = [], self.seen.__getitem__
        for text, cuts in zip(texts, cut, strict=True):
            same, trip = self.other.isdisjoint(cuts), MARK not in text and self.lossy.isdisjoint(cuts)
            out.append((np.frombuffer(b"".join(map(get, cuts)), np.int32), trip, same))
        return out

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        ids = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        true = self.own.encode(texts, num_threads=1) if self.verify else ids
        want = self.own.decode(true) if self.model["charsmap"] or self.model["trim"] else texts
        return [(np.array(a, np.int32), x == y, a == b) for a, b, x, y in zip(ids, true, self.decode(ids), want, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tok.decode_batch(ids, skip_special_tokens=False)


def load_model(path: str) -> bytes:
    """The model file's bytes; half a megabyte or so, sent to the executors with the function that uses it."""
    with open(path, "rb") as f:
        return f.read()


def tokenised(docs: DataFrame, model: bytes, verify: bool = True, keep: tuple[str, ...] = ("doc_id",), max_bytes: int = 1_000_000, text_col: str = "text") -> DataFrame:
    """One row per document: the columns of `keep` (as struct `row`), ids, n_tokens, round_trip, parity.

    ids are those of the rebuilt tokenizer; round_trip tells that decoding them gives the text again (for models that
    normalise: what sentencepiece decodes), parity that the sentencepiece library gives the same ids (with verify).
    A marker character in the text reads as a space, so its round_trip is false. Null and empty texts have no ids
    and a true round trip. Texts go to the encoder by at most max_bytes bytes, or one by one if longer.
    Repeated rows give repeated results; an empty table gives an empty result.
    """
    raw = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.struct(*[col(c) for c in keep]).alias("row"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([base.schema["row"], *T._parse_datatype_string("ids array<int>, n_tokens long, round_trip boolean, parity boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        encode = Encoder(raw.value, verify).encode
        for b in batches:
            for part in slices(b, 1, max_bytes):
                done = encode(part.column(1).to_pylist())
                sizes = np.fromiter((len(d[0]) for d in done), np.int32, len(done))
                flat = np.concatenate([d[0] for d in done])
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(sizes.astype(np.int64)), pa.array([d[1] for d in done]), pa.array([d[2] for d in done])], names=["row", "ids", "n_tokens", "round_trip", "parity"])

    return base.mapInArrow(released(run), schema)


def decoded(tokens: DataFrame, model: bytes, ids_col: str = "ids", name: str = "text") -> DataFrame:
    """Adds (or replaces) column `name`: the text of the ids; null ids give a null text."""
    raw = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        out = pd.Series([None] * len(ids), index=ids.index, dtype=object)
        out[known] = _loaded(raw.value)[0].decode_batch([list(map(int, x)) for x in ids[known]], skip_special_tokens=False)
        return out

    return tokens.withColumn(name, text(col(ids_col)))
