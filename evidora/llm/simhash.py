"""SimHash fingerprints and their exact comparison in tiles.

Fingerprints are 64 bits from word shingles. Equal ones are one node (with a likeness: only if the sets of
shingles are equal as well). Different ones are compared
exactly: a hash deals them into blocks of like size, every two blocks meet in a task, and inside a task, where they are in
order of their population counts, numpy compares tiles with exclusive-or and bit counts,
skipping tile pairs whose counts differ by more than the radius. A task gives back a spanning
forest of the links it found, never the pairs themselves, so that a large group of near copies
stays linear.

With a likeness, the radius and min-hash sketches only propose links. What they connect meets once more, now
with the sets of shingles, and a proposed link counts only if the exact Jaccard likeness is high enough.

Defined cases: a null text is the empty text; no words give the fingerprint zero, linked like any
other; fewer words than a shingle are one shingle; repeated rows and equal ids keep a row each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, materialize, text_slices
from .components import connected_components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Fingerprints in a block (of the mean; a hash deals them), up to so many blocks; then blocks grow to the second size. The tiles' sizes.
BLOCK, BLOCKS, LARGEST_BLOCK, TILE_ROWS, TILE_COLUMNS = 16_384, 64, 262_144, 256, 512
_BIT_ROWS = 1 << 16
#: Bins of a min-hash sketch, and the value of an empty one; how far an estimate may lie below the likeness asked for.
BINS, EMPTY, SLACK = 64, 0xFFFF, 0.15
#: Bytes of shingle sets in a block of proposed near copies (of the mean), and exact comparisons between looks at the forest.
SET_BYTES, EXACT_STEP = 8 << 20, 256


def shingle_hashes(text: str, words: int, seed: int) -> list[int]:
    """XXH64 of each shingle of the words between ASCII white space, letters A-Z lowered."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), seed)]
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    starts, ends, at = [], [], 0
    for w in found:
        starts.append(at)
        at += len(w)
        ends.append(at)
        at += 1
    return [h(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :])]


def fold(hashes: list[list[int]]) -> np.ndarray:
    """One 64-bit fingerprint for each list: the bits set in over half its hashes."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    first = 0
    while first < len(hashes):
        last, total = first + 1, int(sizes[first])
        while last < len(hashes) and total + sizes[last] <= _BIT_ROWS:
            total += int(sizes[last])
            last += 1
        if total:
            own = np.flatnonzero(sizes[first:last]) + first
            flat = np.array([v for x in hashes[first:last] for v in x], "<u8")
            starts = np.cumsum(sizes[own]) - sizes[own]
            counts = np.zeros((len(own), 64), np.int64)
            if len(own) == 1:  # one long text, bit rows in pieces
                for i in range(0, total, _BIT_ROWS):
                    counts[0] += np.unpackbits(flat[i : i + _BIT_ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            else:
                bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            out[own] = ((2 * counts > sizes[own][:, None]) * weights).sum(1, dtype=np.uint64)
        first = last
    return out


def sketches(hashes: list[list[int]]) -> np.ndarray:
    """One-permutation min-hash: the smallest 16 bits of the hashes in each of BINS bins; EMPTY where none is."""
    sizes = np.array([len(x) for x in hashes], np.int64)
    flat = np.fromiter((v for x in hashes for v in x), np.uint64, int(sizes.sum()))
    out = np.full(len(hashes) * BINS, EMPTY, np.uint16)
    at = np.repeat(np.arange(len(hashes)), sizes) * BINS + (flat % np.uint64(BINS)).astype(np.int64)
    np.minimum.at(out, at, ((flat >> np.uint64(8)) % np.uint64(EMPTY)).astype(np.uint16))
    return out.reshape(-1, BINS)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness of the sketches in each row."""
    some = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & some).sum(1) / np.maximum(1, some.sum(1))


def shingle_set(hashes: list[int]) -> np.ndarray:
    return np.unique(np.array(hashes, np.uint64))


def node_of(own: np.ndarray, fp: int) -> int:
    """A signed 64-bit name of a set of shingles and a fingerprint."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), int(fp) & (1 << 64) - 1)).view(np.int64))


def exact_likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42) -> DataFrame:
    """(doc_id, fp, sketch) with the fingerprint as a signed 64-bit number and an empty sketch. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2 << 20):
            hashes = [shingle_hashes(t, words, seed) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fold(hashes).view(np.int64)), pa.array([b""] * len(hashes), pa.binary())], ["doc_id", "fp", "sketch"])

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_texts(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint, sketch binary")


def sketched(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, fp, node, shingles, sketch): the fingerprint, the name and size of the set of shingles, its sketch. Map-only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2 << 20):
            hashes = [shingle_hashes(t, words, seed) for t in b.column(1).to_pylist()]
            fps, own = fold(hashes).view(np.int64), [shingle_set(x) for x in hashes]
            nodes = pa.array([node_of(x, f) for x, f in zip(own, fps.tolist())], pa.int64())
            columns = [b.column(0), pa.array(fps), nodes, pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in sketches(own)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "node", "shingles", "sketch"])

    source = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_texts(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, fp bigint, node bigint, shingles bigint, sketch binary")


class Forest:
    """Union-find over the indices of one task."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    def flatten(self) -> None:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return
            self.root = up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        ra, rb = self.root[a], self.root[b]
        other = ra != rb
        if not other.any():
            return
        pairs = np.unique(np.minimum(ra, rb)[other] * np.int64(len(self.root)) + np.maximum(ra, rb)[other])
        for p in pairs.tolist():
            x, y = self._find(p // len(self.root)), self._find(p % len(self.root))
            if x != y:
                self.root[max(x, y)] = min(x, y)
        self.flatten()


def _tiles(fps: np.ndarray, size: int) -> list[tuple[int, int, int, int]]:
    """(first, end, least and largest population count) of the tiles of fingerprints in order of their counts."""
    counts = np.bitwise_count(fps).tolist()
    return [(i, min(i + size, len(fps)), counts[i], counts[min(i + size, len(fps)) - 1]) for i in range(0, len(fps), size)]


def _ordered(fps: np.ndarray) -> np.ndarray:
    """Order by population count, so that a tile holds few different ones."""
    return np.argsort(np.bitwise_count(fps), kind="stable")


def tiled_links(left: np.ndarray, right: np.ndarray | None, radius: int, sketch: tuple[np.ndarray, np.ndarray | None] | None = None, least: float = 0.0, names: tuple[np.ndarray, np.ndarray | None] | None = None, exact=None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (ends of links) of the fingerprints within the radius, by exact comparison.

    ``right`` None: all pairs of ``left``; else pairs between the two. With sketches, a pair is a link
    only if its estimated likeness is at least ``least`` as well; with ``exact``, only if that agrees to the
    names of the two. The ends are names where there are any, else fingerprints.
    """
    order = _ordered(left)
    left, marks = left[order], sketch[0][order] if sketch else None
    both, other = left, left
    called = names[0][order] if names else left
    if right is not None:
        order = _ordered(right)
        other = right[order]
        both = np.concatenate([left, other])
        marks = np.concatenate([marks, sketch[1][order]]) if sketch else None
        called = np.concatenate([called, names[1][order] if names else other])
    forest, base = Forest(len(both)), 0 if right is None else len(left)
    columns = _tiles(other, TILE_COLUMNS)
    bits, ones = np.empty((TILE_ROWS, TILE_COLUMNS), np.uint64), np.empty((TILE_ROWS, TILE_COLUMNS), np.uint8)
    for i, j, low, high in _tiles(left, TILE_ROWS):
        rows = left[i:j, None]
        for k, m, low2, high2 in columns:
            if right is None and m <= i:
                continue
            if low - high2 > radius or low2 - high > radius:
                continue
            x, y = bits[: j - i, : m - k], ones[: j - i, : m - k]
            np.bitwise_xor(rows, other[k:m], out=x)
            near = np.bitwise_count(x, out=y) <= radius
            if right is None and k < j:  # the part on and below the diagonal
                near &= np.arange(k, m)[None, :] > np.arange(i, j)[:, None]
            a, b = np.divmod(np.flatnonzero(near), m - k)
            a, b = a + i, b + k + base
            step = 1 << 14
            for c in range(0, len(a), step):
                x, y = a[c : c + step], b[c : c + step]
                apart = forest.root[x] != forest.root[y]
                x, y = x[apart], y[apart]
                if marks is not None and len(x):
                    fits = alike(marks[x], marks[y]) >= least
                    x, y = x[fits], y[fits]
                if exact is None:
                    forest.link(x, y)
                    continue
                for e in range(0, len(x), EXACT_STEP):
                    u, v = x[e : e + EXACT_STEP], y[e : e + EXACT_STEP]
                    apart = forest.root[u] != forest.root[v]
                    u, v = u[apart], v[apart]
                    fits = np.array([exact(g, h) for g, h in zip(called[u].tolist(), called[v].tolist())], bool)
                    forest.link(u[fits], v[fits])
    root = forest.root
    ends = np.flatnonzero(root != np.arange(len(root)))
    return called[root[ends]], called[ends]


def near_links(distinct: DataFrame, radius: int, likeness: float | None = None) -> DataFrame:
    """(a, b): links that connect what lies within the radius among the rows of (fp, node, sketch), distinct by node.

    With ``likeness`` the links are proposals by estimates from the sketches.

    Blocks are packed into one binary value each, so that the copies for the pairs of blocks cost
    bytes but no rows. The driver sees the number of rows only.
    """
    n = distinct.count()
    blocks = max(1, min(-(-n // BLOCK), BLOCKS), -(-n // LARGEST_BLOCK))
    dealt = distinct.select("fp", "node", "sketch", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("r"))

    def pack(t: pa.Table) -> pa.Table:
        payload = t.column("fp").to_numpy().tobytes()
        if likeness is not None:
            payload += t.column("node").to_numpy().tobytes() + b"".join(t.column("sketch").to_pylist())
        return pa.table({"r": t.column("r")[:1], "payload": pa.array([payload], pa.binary())})

    packed = materialize(dealt.groupBy("r").applyInArrow(pack, "r int, payload binary"))
    met = packed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("r", "o").alias("r1"), F.greatest("r", "o").alias("r2"), (F.col("r") > F.col("o")).alias("side"), "payload")

    def meet(t: pa.Table) -> pa.Table:
        raw = [x for _, x in sorted(zip(t.column("side").to_pylist(), t.column("payload").to_pylist()))]
        if t.column("r1")[0].as_py() != t.column("r2")[0].as_py() and len(raw) < 2:  # the other block is empty
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if likeness is None:
            found = [np.frombuffer(x, np.uint64) for x in raw] + [None]
            a, b = tiled_links(found[0], found[1], radius)
        else:
            n = [len(x) // (16 + 2 * BINS) for x in raw]
            found = [np.frombuffer(x, np.uint64, k) for x, k in zip(raw, n)] + [None]
            names = [np.frombuffer(x, np.int64, k, 8 * k) for x, k in zip(raw, n)] + [None]
            marks = [np.frombuffer(x, np.uint16, offset=16 * k).reshape(-1, BINS) for x, k in zip(raw, n)] + [None]
            a, b = tiled_links(found[0], found[1], radius, (marks[0], marks[1]), likeness - SLACK, (names[0], names[1]))
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # A number of its own, as adaptive execution would join the pairs to a few tasks by their small size.
    return met.repartition(min(blocks * (blocks + 1) // 2, 4096), "r1", "r2").groupBy("r1", "r2").applyInArrow(meet, "a bigint, b bigint")


def exact_links(docs: DataFrame, proposed: DataFrame, words: int, radius: int, seed: int, likeness: float) -> DataFrame:
    """(a, b): links that connect the proposed pairs whose sets of shingles have at least that Jaccard likeness.

    ``proposed``: (doc_id, node, shingles, component), one row for each node that has a proposed link. A pair
    counts by the same radius and estimate as before, now checked exactly. Each component meets in one task, a
    large one in blocks of bounded bytes, of which each two meet.
    """
    sizes = materialize(proposed.groupBy("component").agg(F.ceil(F.sum("shingles") * 8 / SET_BYTES).cast("int").alias("parts")))
    wanted = proposed.join(sizes, "component").select(F.col("doc_id").alias("__d"), "node", "component", F.greatest("parts", F.lit(1)).alias("parts"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    met = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("__d"))).select("text", "node", "component", "parts")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, 2 << 20):
            hashes = [shingle_hashes(t, words, seed) for t in b.column(0).to_pylist()]
            fps, own = fold(hashes).view(np.int64), [shingle_set(x) for x in hashes]
            same = pa.array([node_of(x, f) == n for x, f, n in zip(own, fps.tolist(), b.column(1).to_pylist())], pa.bool_())
            columns = [*b.columns[1:], pa.array(fps), pa.array([x.tobytes() for x in sketches(own)], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "component", "parts", "fp", "sketch", "own"]).filter(same)

    rows = map_texts(met, sets, "node bigint, component bigint, parts int, fp bigint, sketch binary, own binary")
    rows = rows.withColumn("r", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("component", F.least("r", "o").alias("r1"), F.greatest("r", "o").alias("r2"), "r", "node", "fp", "sketch", "own")

    def meet(t: pa.Table) -> pa.Table:
        nodes, side = t.column("node").to_numpy(), t.column("r").to_numpy() != t.column("r1")[0].as_py()
        first = np.unique(nodes, return_index=True)[1]  # repeated rows bring a set again
        own = {n: np.frombuffer(x.as_buffer(), np.uint64) for n, x in zip(nodes.tolist(), t.column("own"))}
        fps, marks = t.column("fp").to_numpy().view(np.uint64), np.stack([np.frombuffer(x, np.uint16) for x in t.column("sketch").to_pylist()])
        left, right = first[~side[first]], first[side[first]]
        two = t.column("r1")[0].as_py() != t.column("r2")[0].as_py()
        ends = (np.array([], np.int64),) * 2
        if len(left) and (len(right) or not two):
            pick = lambda x: (x[left], x[right] if two else None)
            ends = tiled_links(*pick(fps), radius, pick(marks), likeness - SLACK, pick(nodes), lambda a, b: exact_likeness(own[a], own[b]) >= likeness)
        return pa.table({"a": ends[0], "b": ends[1]})

    return rows.groupBy("component", "r1", "r2").applyInArrow(meet, "a bigint, b bigint")


def near_components(docs: DataFrame, words: int = 5, radius: int = 4, seed: int = 42, likeness: float | None = None) -> DataFrame:
    """(doc_id, fp, component_id) for every row of (doc_id, text).

    The component is the smallest doc_id that links reach. With ``likeness`` a link also needs that Jaccard
    likeness of the sets of shingles. Min-hash sketches that travel with the fingerprints propose such links,
    so that the radius may be wide; only texts with a proposed link are read again, for the exact likeness.
    """
    if likeness is None:
        prints = materialize(fingerprints(docs, words, seed).withColumn("node", F.col("fp")))
        nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"))
        groups = connected_components(near_links(nodes.select("fp", "node", "sketch"), radius))
    else:
        prints = materialize(sketched(docs, words, seed))
        nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("shingles").alias("shingles"))
        close = connected_components(near_links(nodes.select("fp", "node", "sketch"), radius, likeness))
        proposed = materialize(nodes.select(F.col("least").alias("doc_id"), "node", "shingles").join(close, "node"))
        groups = connected_components(exact_links(docs, proposed, words, radius, seed, likeness))
    roots = nodes.select("node", "least").join(groups, "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = materialize(roots.select("node", "root").join(least, "root").select("node", "component_id"))
    return prints.join(of, "node").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 5, radius: int = 18, likeness: float = 0.8, seed: int = 42) -> DataFrame:
    """The documents without near copies: of each component the one with the smallest id stays, once.

    Rows are told apart by id and a hash of the text. The texts are shuffled once, to meet the decision.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("k"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("t")).alias("key"))
    found = near_components(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), words, radius, seed, likeness)
    found = found.where("doc_id = component_id").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(found, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
