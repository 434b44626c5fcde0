"""Personal data: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags white-space tokens B/I/O per kind from their shape (first and last character class, digits, letters,
signs), its place in an address spelt with "at" and "dot", and the same of both neighbours. It is trained here on the small labelled table by gradient ascent on the
exact log-likelihood (forward-backward), and decoded by Viterbi in numpy over all lines of a batch at once. Every
line of every text is decoded whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pii_labels import KINDS, LABELLED
from .shared import col, packed, released, slices

BASE = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first digit of a run: later digits of a run lead to the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_EDGE = "\"'()[]{}<>,;:!?.|*&%$#="


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        if at >= last and (m := _DOMAIN.match(text, at + 1)):
            start = at
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, "email", m.end()))
                last = m.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), "ip", m.end()))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            out.append((m.start(), "phone", m.end()))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[1])))


# --- shapes -------------------------------------------------------------------------------------------------------

_SIGNS = '@.-()"=+:/_'
_SIZES = (64, 56, 512, 4, 8, 20, 3)  # of the templates: ends, lengths, signs, words that spell a sign, at and dots, mixture by size, place in a spelt address


def _classes() -> np.ndarray:
    """0 white, 1 lower, 2 upper, 3 digit, 4 sign of _SIGNS, 5 other; letters beyond ASCII count as lower."""
    to = np.full(0x3000, 1, np.uint8)
    to[:128] = 5
    to[ord("a") : ord("z") + 1], to[ord("A") : ord("Z") + 1], to[ord("0") : ord("9") + 1] = 1, 2, 3
    for c in _SIGNS:
        to[ord(c)] = 4
    for c in range(0x3000):
        if chr(c).isspace():
            to[c] = 0
    return to


_CLASS = _classes()


def _spelt(word: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Place of each token in a run `x at y dot z` (dot and one word again and again) of one line: 1 the first, 2 a later one, 0 none."""
    role, n = np.zeros(len(word), np.int64), len(word)
    at = np.flatnonzero(word == 1)
    at = at[(at >= 1) & (at + 3 < n)]
    at = at[(word[at + 2] == 2) & (line[at - 1] == line[at + 3])]
    role[at - 1] = 1
    for i in range(4):
        role[at + i] = 2
    last = at + 3
    while len(last):
        last = last[last + 2 < n]
        last = last[(word[last + 1] == 2) & (line[last] == line[last + 2])] + 2
        role[last - 1] = role[last] = 2
    return role


class Tokens:
    """The white-space tokens of texts joined by newlines: where they are and the shape templates of each."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        k = np.where(c < 0x3000, _CLASS[np.minimum(c, 0x2FFF)], 1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (k > 0).astype(np.int8), [0]])))
        self.start, self.end = edge[::2], edge[1::2]
        n = len(self.start)
        lines = np.cumsum(c == 10)
        self.line = lines[self.start] if n else np.zeros(0, np.int64)
        total = lambda mask: np.add.reduceat(np.concatenate([mask, [0]]).astype(np.int32), edge)[::2] if n else np.zeros(0, np.int32)
        digits, letters, upper = total(k == 3), total((k == 1) | (k == 2)), total(k == 2)
        ends = k[self.start] * 8 + k[self.end - 1] if n else np.zeros(0, np.int64)
        lengths = np.searchsorted([1, 2, 3, 4, 5, 8, 14, 20], digits, side="right") * 6 + np.searchsorted([1, 2, 3, 11, 24], letters, side="right")
        signs = (total(c == ord("@")) > 0) * 1 + np.minimum(total(c == ord(".")), 3) * 2 + (total(c == ord("-")) > 0) * 8 + ((total(c == ord("(")) + total(c == ord(")"))) > 0) * 16 + (total(c == ord('"')) > 0) * 32 + (total(c == ord("=")) > 0) * 64 + (total(c == ord("+")) > 0) * 128 + ((upper > 0) & (upper == letters)) * 256
        size = self.end - self.start
        wrapped = np.isin(c[self.start], [ord(x) for x in "([{<"]) & np.isin(c[self.end - 1], [ord(x) for x in ")]}>"]) if n else np.zeros(0, bool)
        inner = size - 2 * wrapped
        first, second, third = (c[np.minimum(self.start + wrapped + i, len(c) - 1)] if n else np.zeros(0, np.uint32) for i in range(3))
        word = np.where((inner == 2) & (first == ord("a")) & (second == ord("t")), 1, np.where((inner == 3) & (first == ord("d")) & (second == ord("o")) & (third == ord("t")), 2, 0))
        dots = (signs & 1) * 4 + (signs >> 1 & 3)
        mixture = ((digits > 0) * 2 + (letters > 0)) * 5 + np.searchsorted([6, 12, 20, 32], size, side="right")
        self.templates = np.stack([x.astype(np.int64) for x in (ends, lengths, signs, word, dots, mixture, _spelt(word, self.line))]) if n else np.zeros((len(_SIZES), 0), np.int64)

    def features(self) -> np.ndarray:
        """(21, tokens): the seven templates of the token, of the one before and of the one behind; the last value of a template stands for the line's edge."""
        t, out, at = self.templates, [], 0
        same = self.line[1:] == self.line[:-1]
        for shift in (0, -1, 1):
            for i, size in enumerate(_SIZES):
                own = t[i]
                if shift == -1:
                    own = np.concatenate([[size], np.where(same, t[i][:-1], size)])[: len(own)]
                elif shift == 1:
                    own = np.concatenate([np.where(same, t[i][1:], size), [size]])[: len(own)]
                out.append(own + at)
                at += size + 1
        return np.stack(out) if len(out) else np.zeros((3 * len(_SIZES), 0), np.int64)


WIDTH = 3 * sum(s + 1 for s in _SIZES)


def _lanes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines by falling length: (order of tokens by step, tokens per step, first token of each line in that order)."""
    if not len(line):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    size = np.diff(np.concatenate([begin, [len(line)]]))
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    return begin, size, np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")


def viterbi(emit: np.ndarray, move: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The best tag of each token; tokens of one line form a chain. All lines go forward together, longest first."""
    tags = np.zeros(len(line), np.int64)
    begin, size, active = _lanes(line)
    if not len(begin):
        return tags
    score = emit[begin].copy()
    back = np.zeros((len(line), emit.shape[1]), np.int8)
    for step in range(1, len(active)):
        n = active[step]
        at = begin[:n] + step
        best, arg = np.full((n, emit.shape[1]), -np.inf, emit.dtype), np.zeros((n, emit.shape[1]), np.int8)
        for a in range(emit.shape[1]):
            s = score[:n, a, None] + move[a]
            better = s > best
            best, arg = np.where(better, s, best), np.where(better, np.int8(a), arg)
        score[:n], back[at] = best + emit[at], arg
    now = score.argmax(1)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = begin[:n] + step
        tags[at] = now[:n]
        now[:n] = back[at, now[:n]] if step else now[:n]
    return tags


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis))


class Field:
    """Weights of a trained field."""

    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit.astype(np.float32), move.astype(np.float32)

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.emit[features[0]].copy() if features.shape[1] else np.zeros((0, len(TAGS)), np.float32)
        for f in features[1:]:
            out += self.emit[f]
        return out

    def spans(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) of tagged stretches, without signs at their edges."""
        tokens = Tokens(text)
        tags = viterbi(self.scores(tokens.features()), self.move, tokens.line)
        out, open_kind, begin, last, where = [], None, 0, 0, -1
        for i in np.flatnonzero(tags):
            b, kind = TAGS[tags[i]].split("-")
            if open_kind == kind and b == "I" and i == where + 1 and tokens.line[i] == tokens.line[where]:
                last = tokens.end[i]
            else:
                if open_kind:
                    out.append((begin, open_kind, last))
                open_kind, begin, last = kind, tokens.start[i], tokens.end[i]
            where = i
        if open_kind:
            out.append((begin, open_kind, last))
        trimmed = []
        for s, kind, e in out:
            s, e = int(s), int(e)
            while s < e and text[s] in _EDGE and not (kind == "phone" and text[s] == "("):
                s += 1
            while s < e and text[e - 1] in _EDGE:
                e -= 1
            if s < e:
                trimmed.append((s, kind, e))
        return trimmed


def marked(line: str) -> tuple[str, list[tuple[int, str, int]]]:
    """The text of a labelled line and its spans."""
    text, spans, at = "", [], 0
    for m in re.finditer(r"\[(\w+)\|([^\]]*)\]", line):
        text += line[at : m.start()]
        spans.append((len(text), m[1], len(text) + len(m[2])))
        text += m[2]
        at = m.end()
    return text + line[at:], spans


def train(labelled: list[str], rounds: int = 300, penalty: float = 0.02, rate: float = 0.3) -> Field:
    """Adagrad on the penalised log-likelihood of the labelled lines."""
    texts, spans, at = [], [], 0
    for line in labelled:
        t, s = marked(line)
        texts.append(t)
        spans += [(a + at, k, b + at) for a, k, b in s]
        at += len(t) + 1
    tokens = Tokens("\n".join(texts))
    gold = np.zeros(len(tokens.start), np.int64)
    for a, kind, b in spans:
        inside = np.flatnonzero((tokens.end > a) & (tokens.start < b))
        gold[inside] = TAGS.index(f"I-{kind}")
        gold[inside[:1]] = TAGS.index(f"B-{kind}")
    feats, k = tokens.features(), len(TAGS)
    begin, size, active = _lanes(tokens.line)
    emit, move = np.zeros((WIDTH, k)), np.zeros((k, k))
    ge, gm = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
    for _ in range(rounds):
        e = sum(emit[f] for f in feats)
        fwd, bwd = e.copy(), np.zeros_like(e)
        for step in range(1, len(active)):
            at = begin[: active[step]] + step
            fwd[at] = e[at] + _logsum(fwd[at - 1][:, :, None] + move[None], 1)
        for step in range(len(active) - 1, 0, -1):
            at = begin[: active[step]] + step
            bwd[at - 1] = _logsum(move[None] + (e[at] + bwd[at])[:, None, :], 2)
        whole = np.repeat(_logsum(fwd[begin + size - 1], 1), size)
        order = np.concatenate([np.arange(b, b + s) for b, s in zip(begin, size)])
        z = np.zeros(len(gold))
        z[order] = whole
        miss = -np.exp(fwd + bwd - z[:, None])
        miss[np.arange(len(gold)), gold] += 1
        de, dm = -penalty * emit, -penalty * move
        for f in feats:
            np.add.at(de, f, miss)
        for step in range(1, len(active)):
            at = begin[: active[step]] + step
            dm -= np.exp(fwd[at - 1][:, :, None] + move[None] + (e[at] + bwd[at])[:, None, :] - z[at][:, None, None]).sum(0)
            np.add.at(dm, (gold[at - 1], gold[at]), 1)
        ge, gm = ge + de**2, gm + dm**2
        emit, move = emit + rate * de / np.sqrt(ge), move + rate * dm / np.sqrt(gm)
    return Field(emit, move)


def all_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; added spans don't touch base ones."""
    joined, begin = "\n".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
    found = field.spans(joined)
    owner = np.searchsorted(begin, [s for s, _, _ in found], side="right") - 1
    added: list[list] = [[] for _ in texts]
    for (s, kind, e), i in zip(found, owner):
        added[i].append((s - int(begin[i]), kind, e - int(begin[i])))
    out = []
    for text, more in zip(texts, added):
        base = base_spans(text)
        # A base span touches an added one if, of those that begin before its end, one ends behind its start.
        starts, ends = [b[0] for b in base], [0, *accumulate((b[2] for b in base), max)]
        fresh = [x for x in more if ends[bisect_left(starts, x[2])] <= x[0]]
        out.append((base, sorted(base + fresh, key=lambda s: (s[0], KINDS.index(s[1])))))
    return out


def _said(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def found(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: row, doc_id, n_email, n_ip, n_card, n_phone (base spans), base (base spans joined), spans (all
    spans joined), n_secret (spans of that kind), n_all (all spans).

    Null texts count as empty and have no spans. Repeated rows give equal results; an empty table gives an empty
    result. Input columns of any name are untouched in row. Offsets are code points, ends exclusive.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(LABELLED))
    base = docs.select(packed(docs), col(id_col).alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = T._parse_datatype_string("n_email long, n_ip long, n_card long, n_phone long, base string, spans string, n_secret long, n_all long").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 2, max_bytes):
                done = all_spans(shared.value, part.column(2).to_pylist())
                counts = [pa.array([sum(s[1] == k for s in x) for x, _ in done], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *counts, pa.array([_said(x) for x, _ in done]), pa.array([_said(y) for _, y in done]), pa.array([sum(s[1] == "secret" for s in y) for _, y in done], pa.int64()), pa.array([len(y) for _, y in done], pa.int64())], names=["row", "doc_id", *(f.name for f in fields)])

    return base.mapInArrow(released(run), T.StructType([*base.drop("text").schema.fields, *fields]))
