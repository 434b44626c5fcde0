"""Near-duplicates by Order MinHash, verified by banded alignment.

k-mers are runs of five words; each is labelled with its occurrence number in the document, so all are distinct.
One sketch keeps the two labelled k-mers of smallest hash in the order in which they stand in the text, which makes
it sensitive to edits and moves and not only to the set of k-mers. BANDS bands of ROWS sketches find candidates.

Similarity of two documents: aligned k-mers / (k-mers of both - aligned k-mers), where the alignment is the longest
common subsequence of labelled k-mers inside the band that the threshold allows (labels make it a longest
increasing run of positions).

No group is expanded into pairs of rows:
1. equal word sequences become one node;
2. each node is compared with the smallest node it shares a bucket with; links give the first components;
3. in each bucket that still holds several components, the nodes outside its main component are compared with all
   nodes of that component, and then, if they still stand apart, with each other. Comparisons run in groups of CHUNK
   by LOT nodes or so, which yield links only. So every pair of a bucket is in one component, or compared.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from .components import components
from .shared import SALTS, col, each_salt, packed, released, salted, salts_seen, slices, stored

K, ROWS, BANDS, SIMILARITY, CHUNK, LOT, HELD, KEPT = 5, 4, 40, 0.8, 128, 64, 24_000_000, 2_000_000
_U = np.uint64
_MIX = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit numbers evenly (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORDY = np.array([chr(c).isalnum() for c in range(0x10000)])
_POWERS = np.cumprod(np.full(4096, 0x100000001B3 | 1, np.uint64))
_FUNCTIONS = np.random.default_rng(20240501).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
_TIMES, _XOR = (_FUNCTIONS[0] << _U(1)) | _U(1), _FUNCTIONS[1]


def words(text: str) -> np.ndarray:
    """A 64-bit hash of each word (run of letters and digits, lower case)."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    wordy = _WORDY[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], wordy.astype(np.int8), [0]])))
    if not len(edge):
        return np.zeros(0, np.uint64)
    start, size = edge[::2], edge[1::2] - edge[::2]
    at = np.arange(len(c)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(c)]])))
    value = np.where(wordy, _mixed((c.astype(np.uint64) + _U(1)) * _MIX + (at >> 12).astype(np.uint64)) * _POWERS[at & 4095], _U(0))
    return _mixed(np.add.reduceat(value, start) + size.astype(np.uint64) * _MIX)


def kmers(w: np.ndarray, k: int = K) -> np.ndarray:
    """Labelled k-mers in text order, all distinct; fewer than k words make one k-mer; no words none."""
    if not len(w):
        return w
    n = max(1, len(w) - k + 1)
    x = np.zeros(n, np.uint64)
    for i in range(min(k, len(w))):
        x = x * _U(0xD6E8FEB86659FD93) + w[i : i + n]
    x = _mixed(x)
    order = np.argsort(x, kind="stable")
    s = x[order]
    again = np.concatenate([[False], s[1:] == s[:-1]])
    if again.any():
        first = np.maximum.accumulate(np.where(again, 0, np.arange(n)))
        label = np.zeros(n, np.uint64)
        label[order] = np.arange(n) - first
        x = np.where(label > 0, _mixed(x + label * _MIX), x)
    return x


def bands(x: np.ndarray) -> np.ndarray:
    """The BANDS band hashes of labelled k-mers."""
    if not len(x):
        return np.zeros(0, np.int64)
    first, second, block = np.zeros(len(_TIMES), np.int64), np.zeros(len(_TIMES), np.int64), max(1, 1_000_000 // len(x))
    for lo in range(0, len(_TIMES), block):
        h = (x[None, :] ^ _XOR[lo : lo + block, None]) * _TIMES[lo : lo + block, None]
        a = h.argmin(1)
        h[np.arange(len(h)), a] = _U(2**64 - 1)
        first[lo : lo + block], second[lo : lo + block] = a, h.argmin(1)
    early, late = np.minimum(first, second), np.maximum(first, second)
    sketch = _mixed(x[early] + _mixed(x[late] + _MIX)).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for i in range(ROWS):
        out = _mixed(out * _MIX + sketch[:, i])
    return out.view(np.int64)


def _rising(positions: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(positions) < 2 or (np.diff(positions) > 0).all():
        return len(positions)
    tails: list[int] = []
    for p in positions.tolist():
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return len(tails)


def distance(x: np.ndarray, y: np.ndarray, similarity: float = SIMILARITY) -> float:
    """1 - similarity of two sequences of labelled k-mers; exact on either side of the threshold."""
    if not len(x) or not len(y):
        return 0.0 if len(x) == len(y) else 1.0
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    total, most = len(x) + len(y), len(i)
    if most >= similarity * (total - most):
        band = int((1 - similarity) / (1 + similarity) * total) + 1
        aligned = _rising(j[np.abs(i - j) <= band])
        if aligned >= similarity * (total - aligned):
            return 1 - aligned / (total - aligned)
    aligned = _rising(j)
    return 1 - aligned / (total - aligned)


NODE = "decimal(38,0)"


def digest(text: str, w: np.ndarray) -> bytes:
    """The node of a text: equal for equal word sequences (120 bits); for texts without words, for equal texts."""
    raw = w.tobytes() if len(w) else b"\0" + text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(raw, digest_size=15).digest()


def _numbers(digests: list[bytes]) -> pa.Array:
    """Digests as whole numbers of the type NODE, which Spark compares and aggregates without sorting."""
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(digests), [None, pa.py_buffer(b"\0".join([*digests, b""]))])


def _digests(nodes: pa.Array) -> list[bytes]:
    return [int(n).to_bytes(15, "little") for n in nodes.to_pylist()]


def source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, key: a hash of the text, which tells the rows of one id apart."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    return docs.select(col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, key, node, bands) of every document."""
    base = source(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, max_bytes):
                nodes, found = [], []
                for t in part.column(1).to_pylist():
                    w = words(t)
                    nodes.append(digest(t, w))
                    found.append(bands(kmers(w)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _numbers(nodes), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "bands"])

    return base.mapInArrow(released(run), f"doc_id long, key long, node {NODE}, bands array<long>")


class _Block:
    """Nodes that others are compared with, as lists of the nodes that hold each k-mer."""

    def __init__(self, nodes: list[int], roots: list[int], found: list[np.ndarray]):
        self.nodes, self.roots, self.found, self.joined = nodes, roots, found, {}
        self.sizes = np.array([len(x) for x in found])
        every, owner = np.concatenate(found), np.repeat(np.arange(len(found)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.kmers, self.owner = every[order], owner[order]

    def _root(self, r: int) -> int:
        while self.joined.get(r, r) != r:
            r = self.joined[r]
        return r

    def links(self, node: int, root: int, x: np.ndarray, similarity: float) -> list[int]:
        """Roots of the block's nodes similar to x, as far as they connect what is not connected yet."""
        low, high = np.searchsorted(self.kmers, x, "left"), np.searchsorted(self.kmers, x, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        shared = np.bincount(self.owner[at], minlength=len(self.nodes))
        out = []
        for i in np.flatnonzero((shared >= similarity * (self.sizes + len(x) - shared)) & ((shared > 0) | (self.sizes + len(x) == 0))):
            a, b = self._root(self.roots[i]), self._root(root)
            if a != b and self.nodes[i] != node and 1 - distance(self.found[i], x, similarity) >= similarity - 1e-12:
                self.joined[max(a, b)] = min(a, b)
                out.append(self.roots[i])
        return out


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, part, role): the nodes of the block (role 0), then the nodes to compare with them."""
        now, held, block = None, ([], [], []), None
        kept, size = {}, 0  # k-mers of nodes that stand in several blocks or parts of this task
        for b in batches:
            for piece in slices(b, 5, 8 << 20):
                us, vs = [], []
                for g, part, role, node, root, text in zip(*(piece.column(i).to_pylist() for i in range(6)), strict=True):
                    x = kept.get(node)
                    if x is None:
                        x = kmers(words(text))
                        if size + len(x) > KEPT:
                            kept, size = {}, 0
                        kept[node], size = x, size + len(x)
                    if (g, part) != now:
                        now, held, block = (g, part), ([], [], []), None
                    if role == 0:
                        for to, value in zip(held, (node, root, x), strict=True):
                            to.append(value)
                    elif held[0]:
                        block = block or _Block(*held)
                        for u in block.links(node, root, x, similarity):
                            us.append(u)
                            vs.append(root)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.decimal128(38, 0)), pa.array(vs, pa.decimal128(38, 0))], names=["u", "v"])

    return run


def compared(heads: DataFrame, asked: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between the roots of nodes of `heads` and of `asked` that have the same block; both: block, node, root.

    A block is a grid: its heads are dealt into parts of CHUNK nodes or HELD characters or so, its asked nodes into lots
    of as many as there are heads in a part, LOT at least; each part meets each lot in one group. Only blocks of several parts or lots are in `grid`, and they get
    to know it in SALTS shares, so no block comes whole to one task before it is cut.
    """
    sizes = heads.join(texts.select("node", "n"), "node").groupBy("block").agg(F.count(F.lit(1)).alias("heads"), F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("n") / HELD)).alias("parts"))
    lots = asked.groupBy("block").agg(F.count(F.lit(1)).alias("asked"))
    grid = sizes.join(lots, "block").withColumn("lots", F.ceil(F.col("asked") / F.greatest(F.lit(LOT), F.least("heads", F.lit(CHUNK))))).where("parts > 1 or lots > 1").select("block", "parts", "lots", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def dealt(rows: DataFrame, role: int, own: str, others: str) -> DataFrame:
        """Each row in its own part (or lot), once for every lot (or part) of its block."""
        known = rows.withColumn("salt", salted(F.col("node"))).join(grid, ["block", "salt"], "left")
        n, m = F.coalesce(own, F.lit(1).cast("long")), F.coalesce(others, F.lit(1).cast("long"))
        mine = F.pmod(F.xxhash64("node", F.lit(1)), n)
        cell = (lambda i: mine * m + i) if role == 0 else (lambda i: i * n + mine)
        return known.select("block", "node", "root", F.lit(role).alias("role"), F.explode(F.transform(F.sequence(F.lit(0).cast("long"), m - 1), cell)).alias("part"))

    both = dealt(heads, 0, "parts", "lots").unionByName(dealt(asked, 1, "lots", "parts"))
    rows = both.join(texts.select("node", "text"), "node").select("block", "part", "role", "node", "root", "text")
    done = rows.repartition("block", "part").sortWithinPartitions("block", "part", "role").mapInArrow(released(_compare(similarity)), f"u {NODE}, v {NODE}")
    return stored(done, "links")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size (documents in it), kept.

    A class is a connected component of links (similarity or more); its smallest doc_id is kept. Texts without
    words are in one class only if they are equal; null counts as empty. Texts of fewer than five words match only
    if their words are equal. A null id is the smallest only of a class that has no other. Rows that repeat an id
    count as members each; a class keeps one of its rows, of the smallest node. An empty table gives an empty result. Other columns are ignored.
    """
    return noded_classes(docs, similarity, id_col, text_col).drop("node")


def noded_classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_classes with the node of each row."""
    share = F.when(F.col("doc_id").isNull(), F.floor(F.rand(1) * SALTS).cast("int")).otherwise(salted(F.col("doc_id")))  # rows without id go anywhere
    seen = stored(sketches(docs, id_col, text_col).withColumns({"salt": share, "row_id": F.monotonically_increasing_id()}), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id", "key")
    nodes = seen.groupBy("node").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("size"), salts_seen(F.col("salt")).alias("salts"))
    one = seen.select("node", "bands").dropDuplicates(["node"])
    at = one.select("node", F.posexplode("bands").alias("band", "hash")).withColumn("part", salted(F.col("node")))
    star = at.groupBy("band", "hash").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("n"), salts_seen(F.col("part")).alias("parts")).where("n > 1")
    star = star.select("band", "hash", "centre", each_salt(F.col("parts")).alias("part"))
    held = at.join(star, ["band", "hash", "part"]).where("node <> centre").select("band", "hash", "centre", "node")
    heads = star.select("band", "hash", F.col("centre").alias("node")).distinct()
    held = stored(held.select("band", "hash", "node", "centre").unionByName(heads.select("band", "hash", "node", F.col("node").alias("centre"))), "buckets")

    # A node's text is that of its first row, found by id and text; of rows without id, equal texts are put together first.
    wanted = held.select("node").distinct().join(nodes.select("node", "first.doc_id", "first.key"), "node")
    rows = source(docs, id_col, text_col)
    found = rows.join(wanted, ["doc_id", "key"]).select("node", "text")
    bare = rows.where("doc_id is null").groupBy("key", "text").agg(F.lit(1).alias("one")).join(wanted.where("doc_id is null").select("node", "key"), "key").select("node", "text")
    found = found.unionByName(bare)
    texts = stored(found.mapInArrow(released(_own_texts), f"node {NODE}, text string").dropDuplicates(["node"]).withColumn("n", F.char_length("text")), "texts")

    first = held.where("node <> centre").groupBy("node").agg(F.min("centre").alias("centre"))
    asked = first.select(F.col("centre").alias("block"), "node", F.col("node").alias("root"))
    links = compared(first.select(F.col("centre").alias("block"), F.col("centre").alias("node"), F.col("centre").alias("root")).distinct(), asked, texts, similarity)
    root = components(links)

    # Buckets of several components: the main one (most nodes, then the smallest root) and the loose nodes outside it.
    placed = held.select("band", "hash", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("salt", salted(F.col("node")))
    parts = placed.groupBy("band", "hash", "root").agg(F.count(F.lit(1)).alias("n"), salts_seen(F.col("salt")).alias("salts"))
    main = parts.groupBy("band", "hash").agg(F.max_by("root", F.struct("n", -F.col("root"))).alias("main"), F.count(F.lit(1)).alias("roots"), F.bit_or("salts").alias("salts")).where("roots > 1")
    main = main.select("band", "hash", "main", each_salt(F.col("salts")).alias("salt"))
    loose = stored(placed.join(main, ["band", "hash", "salt"]).where("root <> main").select(F.col("main").alias("block"), "node", "root").distinct(), "loose")
    mains = loose.select(F.col("block").alias("root")).distinct()
    rooted = root.withColumn("salt", salted(F.col("node")))
    shares = rooted.groupBy("root").agg(salts_seen(F.col("salt")).alias("salts")).join(mains, "root").select("root", each_salt(F.col("salts")).alias("salt"))
    members = stored(rooted.join(shares, ["root", "salt"]).select("root", "node").unionByName(mains.select("root", F.col("root").alias("node"))).distinct(), "members")
    more = compared(members.select(F.col("root").alias("block"), "node", "root"), loose, texts, similarity)
    if not more.isEmpty():
        root = components(_links(root).unionByName(more))
    now = loose.select("block", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    main_now = mains.select(F.col("root").alias("block")).join(root.select(F.col("node").alias("block"), F.col("root").alias("main")), "block", "left")
    shares = now.withColumn("salt", salted(F.col("node"))).groupBy("block").agg(salts_seen(F.col("salt")).alias("salts"), F.min("root").alias("low"), F.max("root").alias("high"))
    # Where all loose nodes have one root there is nothing left to compare.
    told = shares.join(main_now, "block").select("block", F.coalesce("main", "block").alias("main"), (F.col("low") < F.col("high")).alias("several"), each_salt(F.col("salts")).alias("salt"))
    now = stored(now.withColumn("salt", salted(F.col("node"))).join(told, ["block", "salt"]).where("several").select("block", "node", "root", "main"), "loose")
    last = compared(now.select("block", "node", "root"), now.where("root <> main").select("block", "node", "root"), texts, similarity)
    if not last.isEmpty():
        root = components(_links(root).unionByName(last))

    placed = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).withColumn("share", salted(F.col("node")))
    classes = placed.groupBy("root").agg(F.min("first").alias("best"), F.sum("size").alias("class_size"), salts_seen(F.col("share")).alias("shares"))
    classes = classes.select("root", "best", "class_size", each_salt(F.col("shares")).alias("share"))
    told = placed.join(classes, ["root", "share"]).select("node", "best", "class_size", each_salt(F.col("salts")).alias("salt"))
    return seen.select("doc_id", "row_id", "node", "salt").join(told, ["node", "salt"]).select("doc_id", "node", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("row_id") == F.col("best.row_id")).alias("kept"))


def _links(root: DataFrame) -> DataFrame:
    """The components found so far as links, a star each."""
    return root.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only texts that belong to their node: an id may be repeated with another text."""
    for b in batches:
        keep = [digest(t, words(t)) == n for n, t in zip(_digests(b.column(0)), b.column(1).to_pylist(), strict=True)]
        yield b.filter(pa.array(keep, pa.bool_()))


@F.arrow_udf(DecimalType(38, 0))
def _nodes(texts: pa.Array) -> pa.Array:
    return _numbers([digest(t, words(t)) for t in texts.to_pylist()])


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, one of each class, with their columns as they were.

    Rows are found again by id and node, so an id may repeat with other texts; of rows of one id and node one stays.
    """
    at = [F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), F.col("doc_id").isNull().alias("no_id"), "node"]
    kept = noded_classes(docs, similarity, id_col, text_col).where("kept").select(*at)
    base = docs.select(packed(docs), col(id_col).cast("long").alias("doc_id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    base = base.select("row", F.xxhash64("text").alias("first"), "doc_id", _nodes("text").alias("node")).select("row", "first", *at)
    # Rows without id are dealt into shares, each of which gets to know what stays.
    base = base.withColumn("salt", F.when(F.col("no_id"), F.floor(F.rand(2) * SALTS).cast("int")).otherwise(F.lit(0)))
    kept = kept.withColumn("salt", F.explode(F.when(F.col("no_id"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    own = base.join(kept, ["id", "no_id", "node", "salt"], "left_semi")
    one = own.withColumn("rn", F.row_number().over(Window.partitionBy("id", "no_id", "node").orderBy("first"))).where("rn = 1")
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
