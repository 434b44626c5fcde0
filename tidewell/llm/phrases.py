"""Phrase collocations by prefix-free parsing.

A text is a sequence of words, some of which begin a new piece. Content decides where it is cut: wherever the hash of
WINDOW words is 0 modulo PERIOD, a chunk ends with that window and the next one begins with it. So equal passages are cut
alike in whatever text they stand, and the corpus becomes a dictionary of distinct chunks with their parse frequencies.

Phrases are counted inside the distinct chunks only, times the chunk's frequency. A phrase of up to WINDOW + 1 words that
begins before the shared window lies in its chunk as a whole, so it is counted in the one chunk in which it begins: a chunk
owns its words but for the window it shares with the next chunk. No phrase crosses a piece.

Rare phrases are never written out. A phrase that occurs `least` times consists of phrases that do so, too: phrases of 1, 2
and 3 words are first counted by 40 bits of a hash, and those that reach `least` set a bit in a bitmap of 2^BITS bits, which all
tasks get. Only phrases whose parts have their bits are counted in the next pass. The last pass counts the texts
themselves, so hashes that meet, and bitmaps that fill up at a very large size, cost time and change no count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytewise import Words, joined, raw, hashes, summed
from .shared import col, released, salted, slices, stored

MOST, WINDOW, PERIOD, LEVELS, HASH, BITS = 5, 4, 64, 3, 40, 26
#: Most counts that a task holds before it passes them on.
HELD = 1_000_000
_U = np.uint64
_BREAKS = np.zeros(256, bool)
_BREAKS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
_INSIDE = ~_BREAKS
_INSIDE[[0x20, 0x09]] = False
NO_LANG = "und"


def _windows(h: np.ndarray, broken_row: np.ndarray) -> np.ndarray:
    """Whether WINDOW words from each place on are in one text and trigger a cut."""
    n = len(h) - WINDOW + 1
    out = np.zeros(len(h), bool)
    if n > 0:
        x, whole = h[:n], np.ones(n, bool)
        for i in range(1, WINDOW):
            x = joined(x, h[i : i + n])
            whole &= ~broken_row[i : i + n]
        out[:n] = whole & (x % _U(PERIOD) == 0)
    return out


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, text → the chunks of each text: lang, own (words that begin phrases of this chunk), chunk (words behind a space, or behind a line end where a piece begins)."""
    for b in batches:
        for part in slices(b, 1, 4 << 20):
            w = Words(part.column(1), _INSIDE, _BREAKS)
            new_row = np.ones(len(w), bool)
            new_row[1:] = w.row[1:] != w.row[:-1]
            begin = np.flatnonzero(new_row | _windows(w.hashes(), new_row))
            after = np.append(begin[1:], len(w))  # where the next chunk begins
            last = np.append(new_row[after[:-1]], True)[: len(begin)]
            end = np.where(last, after, after + WINDOW)
            text = np.empty(len(w.bytes) + len(w), np.uint8)
            text[w.at[:-1] + np.arange(len(w))] = np.where(w.broken, 10, 32)
            text[np.arange(len(w.bytes)) + np.repeat(np.arange(1, len(w) + 1), w.size)] = w.bytes
            place = w.at + np.arange(len(w) + 1)
            whole = text.tobytes()
            chunks = [whole[x + 1 : y] for x, y in zip(place[begin].tolist(), place[end].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(w.row[begin])), pa.array(after - begin, pa.int32()), pa.array(chunks, pa.binary()).cast(pa.string())], names=["lang", "own", "chunk"])


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, own, chunk, weight: the distinct chunks of all texts and how often each is parsed."""
    base = docs.select(F.coalesce(col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(released(_parsed), "lang string, own int, chunk string").groupBy("lang", "own", "chunk").agg(F.count(F.lit(1)).alias("weight"))


class _Phrases:
    """The phrases of a batch of chunks: hash of the phrase of n words at each word, whether it is in one piece, whether the chunk owns it."""

    def __init__(self, batch: pa.RecordBatch):
        self.langs = batch.column(0).dictionary_encode()
        self.words = w = Words(batch.column(2), _INSIDE, _BREAKS)
        self.weight = batch.column(3).to_numpy()[w.row]
        first = np.flatnonzero(np.concatenate([[True], w.row[1:] != w.row[:-1]])) if len(w) else np.zeros(0, np.int64)
        nth = np.arange(len(w)) - np.repeat(first, np.diff(np.append(first, len(w))))
        self.own = nth < batch.column(1).to_numpy()[w.row]
        data, at = raw(self.langs.dictionary)
        names = np.array([hashes(data[a:b], np.array([0, b - a]))[0] if b > a else _U(1) for a, b in zip(at[:-1], at[1:])], np.uint64)
        self.lang = self.langs.indices.to_numpy()[w.row]
        self.hash = {1: joined(w.hashes(), names[self.lang]) if len(w) else np.zeros(0, np.uint64)}
        self.whole = {1: np.ones(len(w), bool)}
        for n in range(2, MOST + 1):
            m = max(0, len(w) - n + 1)
            self.whole[n] = np.zeros(len(w), bool)
            self.whole[n][:m] = self.whole[n - 1][:m] & ~w.broken[n - 1 :][:m]

    def hashed(self, n: int) -> np.ndarray:
        if n not in self.hash:
            x = self.hashed(n - 1).copy()
            m = max(0, len(x) - n + 1)
            x[:m] = joined(x[:m], self.hash[1][n - 1 :][:m])
            self.hash[n] = x
        return self.hash[n]

    def known(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Whether the phrase of n words at each place is one that has its bit."""
        bit = self.hashed(n) >> _U(64 - BITS)
        return self.whole[n] & ((bits[bit >> _U(6)] >> (bit & _U(63))) & _U(1)).astype(bool)

    def likely(self, n: int, filters: list[np.ndarray]) -> np.ndarray:
        """Whether all parts of the phrase have their bits, as far as there are filters."""
        m = min(n - 1, len(filters))
        out = self.whole[n].copy()
        if m:
            part = self.known(m, filters[m - 1])
            for i in range(n - m + 1):
                out[: len(out) - i] &= part[i:]
        return out


def _hash_counts(n: int, filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        held, more, size = none, [none], 0
        for b in batches:
            for part in slices(b, 2, 8 << 20):
                p = _Phrases(part)
                at = np.flatnonzero(p.own & p.likely(n, filters.value))
                h, f, _ = summed(p.hashed(n)[at] >> _U(64 - HASH), p.weight[at])
                more.append((h, f))
                size += len(h)
                if size > HELD // 2:
                    held, more, size = _merged([held, *more]), [none], 0
                    if len(held[0]) > HELD:
                        yield _counts(*held)
                        held = none
        yield _counts(*_merged([held, *more]))

    return released(run)


def _merged(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h, f = (np.concatenate(x) for x in zip(*counts))
    return summed(h, f)[:2]


def _counts(h: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(f, pa.int64())], names=["h", "f"])


def _text_counts(filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up what a task counts before it passes it on."""
        held, size = [], 0
        for found in counted(batches):
            held.append(found)
            size += found.num_rows
            if size > HELD // 4:
                whole = _added(held)
                held, size = [whole], 0
                if whole.num_rows > HELD // 4:
                    yield from whole.to_batches()
                    held = []
        if held:
            yield from _added(held).to_batches()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            for part in slices(b, 2, 8 << 20):
                p = _Phrases(part)
                w, kinds = p.words, len(p.langs.dictionary)
                coded = w.strings().dictionary_encode()
                word = coded.indices.to_numpy().astype(np.int64)
                number, bytes_, spaced = word * kinds + p.lang, w.bytes.tobytes(), w.at
                for n in range(1, MOST + 1):
                    if n > 1:  # a phrase's number follows from that of its first words, which have all been numbered
                        number = number.copy()
                        m = max(0, len(word) - n + 1)
                        number[:m] = number[:m] * len(coded.dictionary) + word[n - 1 :][:m]
                    ok = p.known(n, filters.value[n - 1]) if n <= LEVELS else p.likely(n, filters.value)
                    at = np.flatnonzero(ok)
                    kind, inverse = np.unique(number[at], return_inverse=True)
                    number = np.zeros(len(number), np.int64)
                    number[at] = inverse
                    own = p.own[at]
                    keys, f, place = summed(inverse[own], p.weight[at][own])
                    place = at[own][place]
                    texts = [b" ".join(bytes_[spaced[i + j] : spaced[i + j + 1]] for j in range(n)) for i in place.tolist()]
                    yield pa.Table.from_arrays(
                        [p.langs.dictionary.take(pa.array(p.lang[place])), pa.array(np.full(len(place), n), pa.int32()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())],
                        names=["lang", "words", "phrase", "f"],
                    )

    return released(run)


def _added(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "words", "phrase"]).aggregate([("f", "sum")])
    return out.select(["lang", "words", "phrase", "f_sum"]).rename_columns(["lang", "words", "phrase", "f"]).combine_chunks()


def _bitmap(counted: DataFrame, least: int) -> np.ndarray:
    """The bits of the hashes that reach `least`; at most 2^(BITS - 6) rows come to the driver."""
    bit = F.shiftrightunsigned("h", HASH - BITS)
    often = counted.groupBy("h").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    rows = often.groupBy(F.shiftrightunsigned(bit, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[rows["at"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def frequent(chunks: DataFrame, least: int = 100) -> DataFrame:
    """lang, words, phrase, f: phrases of 1 to MOST words that occur `least` times or more, with their exact counts."""
    spark, filters = chunks.sparkSession, []
    # Each task passes on its own count of every frequent phrase: long tasks, two a core, pass on fewer.
    chunks = chunks.coalesce(2 * spark.sparkContext.defaultParallelism)
    for n in range(1, LEVELS + 1):
        known = spark.sparkContext.broadcast(list(filters))
        filters.append(_bitmap(chunks.mapInArrow(_hash_counts(n, known), "h long, f long"), least))
    known = spark.sparkContext.broadcast(filters)
    counted = chunks.mapInArrow(_text_counts(known), "lang string, words int, phrase string, f long")
    return counted.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per lang the `most` best phrases of 2 to MOST words: lang, rank, phrase, a, l, r, n, score.

    a: occurrences of the phrase (`least` or more); l and r: of its two parts at the cut that scores lowest (the first such
    cut); n: words of the lang; score: floor(1000 a n / (l r)), in whole numbers of 38 digits. A phrase that lies in a longer
    one of the same count is left out. Order: score and a falling, then the phrase by its bytes. Null lang is `und`, null text
    empty; texts without words and an empty table give nothing. Repeated rows count each time. Other columns are ignored.
    """
    chunks = stored(dictionary(docs, text_col, lang_col), "chunks", "zstd")
    f = stored(frequent(chunks, least), "phrases")
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("weight")).alias("n"))
    long = f.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda c: f.select("lang", F.col("phrase").alias(c + "_part"), F.col("f").alias(c))
    cut = long.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("l_part"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ").alias("r_part"))
    cut = cut.join(part("l"), ["lang", "l_part"]).join(part("r"), ["lang", "r_part"]).join(totals, "lang")
    score = F.call_function("div", _big(F.lit(1000)) * _big("a") * _big("n"), _big("l") * _big("r"))
    best = cut.select("lang", "phrase", "a", "n", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    # A phrase in a longer one of its count lies in one of a single word more of that count, too.
    inner = F.array(F.array_join(F.slice("w", F.lit(1), F.size("w") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.size("w") - 1), " "))
    covered = long.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    free = best.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("a")))
    rows = free.select("lang", "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"), salted(F.col("phrase")).alias("share"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    for keys in (("lang", "share"), ("lang",)):  # the best of each share first, so that no lang comes whole to one task
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
