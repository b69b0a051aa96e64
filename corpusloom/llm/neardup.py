"""Near-duplicate records with small edits: a forest of signature trees.

Two records belong together when at least ``threshold`` of the distinct
word sequences found in either are found in both (Jaccard).

1. *Records.*  Each text becomes its set of word-sequence hashes (tokens) and an exact set
   key ``k``; equal sets are one class.
2. *Token order.*  A count table of ``2**b`` cells, filled from the tokens of all
   records, orders tokens from rare to frequent (ties by hash).  The order steers the work only; any
   order gives the same result.
3. *Forest.*  Two records of the wanted similarity share at least one of their
   ``n - ceil(threshold * n) + 1`` rarest tokens each, so only these are indexed.  A
   range of token hashes is one signature tree; a record has an entry in the trees of its
   rare tokens.  Nothing is lost: no bands, no probabilities.
4. *Dual traversal.*  A node holds the OR of its entries' token bitmaps, the range
   of their set sizes and the largest number of tokens that follow the indexed
   one (itself included).  Two nodes without a common bit share no token; else
   their overlap is at most the smaller of these numbers.  A pair of nodes is dropped when
   that bound stays under the threshold for the sizes in range.  Bits lie in
   token order, so a node covers few bits and does not saturate.  Two entries are
   compared by the parities of the tokens behind theirs, too.
5. *Exact check*: parity bitmaps drop pairs that differ in too many bits, the
   others are compared on their full sets (64-bit hashes), then expanded to ids.

The trees work on 32-bit hashes, kept with repetition: a collision can only raise
an overlap, so it never loses a pair.

Tokens whose count exceeds ``HOT_GROUP`` are split into block pairs, each its own
tree task.  Classes of equal sets are expanded into all their pairs up to ``expand`` members; larger ones come out as
pairs with their representative, so nothing is lost and nothing is quadratic.

Defined results: null texts and texts under ``min_words`` words are left out;
rows of one id delivered twice count once; an id with two texts has the links
of both; a null id is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.keys import join_verdicts
from corpusloom.sources.tables import materialise

BITS = 2048
LEAF, FAN = 8, 8
#: Rows of one tree, and the count from which a token is split into blocks of about this many records.
TREE_ROWS, HOT_GROUP = 60_000, 20_000
#: Cells of the count table: one for 8 tokens, between 2**16 and 2**26 (one byte each after scaling).
CELL, LEAST_CELLS, MOST_CELLS = 8, 16, 26
SLICE = 1 << 16
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]


class _Words(dict):
    """Word hashes, kept while they are few."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


_WORDS = _Words()


def shingles(text: str, n: int, min_words: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the text's sequences of *n* words; None under *min_words* words."""
    words = text.lower().split()
    if len(words) < max(n, min_words):
        return None
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = len(h) - n + 1
    s = np.zeros(m, np.uint64)
    for i in range(n):
        s = (s ^ h[i : i + m]) * _M[i % 3]
        s ^= s >> np.uint64(29)
    s *= _M[3]
    s ^= s >> np.uint64(32)
    return np.unique(s)


def _set_key(s: np.ndarray, kind: int) -> int:
    x = s * _M[0]
    x ^= x >> np.uint64(31)
    return int((int((x * _M[1]).sum(dtype=np.uint64)) + len(s) * 0x9E3779B97F4A7C15 + kind * 0x632BE59BD9B4E019) & (2**64 - 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


_RECORD = "kind int, id string, k long, n int, s array<int>, parity binary"
#: Tokens around the threshold within which collisions of 32-bit hashes (some 1e-4 of a token a pair) might matter.
CLOSE = 3
#: Bits of a membership bitmap.
MARKS = 1 << 26


def _record_batches(n: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for kind, rid, text in zip(b.column("kind").to_pylist(), b.column("id").to_pylist(), b.column("text")):
                s = shingles(text.as_py(), n, min_words)
                if s is None:
                    continue
                k = _set_key(s, kind)
                fresh = k not in seen  # equal sets of one task are written once
                seen.add(k)
                rows.append((kind, rid, k, len(s), (s >> np.uint64(32)).astype(np.uint32) if fresh else None))
                held += len(s)
                if held > 300_000:
                    yield _records(rows)
                    rows, held = [], 0
            if rows:
                yield _records(rows)

    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kind, rid, k, n, s = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(kind, pa.int32()), pa.array(rid, pa.string()), pa.array(_signed(np.array(k, np.uint64))), pa.array(n, pa.int32()),
            pa.array([x if x is None else x.view(np.int32) for x in s], pa.list_(pa.int32())), pa.array([x if x is None else parity(x) for x in s], pa.binary()),
        ],
        names=["kind", "id", "k", "n", "s", "parity"],
    )


def parity(s: np.ndarray) -> bytes:
    """A bitmap of the parities of the tokens by cell, of some 1.2 to 2.4 bits a token.

    Two sets differ in at least as many tokens as bits.  Halves of a bitmap
    combine (by exclusive or) to the bitmap of half the width.
    """
    width = max(64, 1 << int(1.2 * len(s)).bit_length())
    cell = ((s * np.uint32(0x9E3779B1)) >> np.uint32(8)) & np.uint32(width - 1)
    return np.packbits((np.bincount(cell, minlength=width) & 1).astype(bool), bitorder="little").tobytes()


def _apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, at the smaller of their widths."""
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    out = np.zeros(len(a), np.int64)
    for wa, wb in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == wa) & (lb == wb))
        x, y = (np.frombuffer(b"".join(v[i] for i in at), np.uint64).reshape(len(at), -1) for v in (a, b))
        while x.shape[1] > y.shape[1]:
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
        while y.shape[1] > x.shape[1]:
            y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
        out[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def _alike_batches(t: float):
    """Pairs whose bitmaps allow the similarity: no more tokens may be shared than the differing bits leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = (b.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            apart = _apart(b.column("pa").to_pylist(), b.column("pb").to_pylist())
            keep = pa.array(_enough((na + nb - apart) / 2, na, nb, t))
            yield pa.RecordBatch.from_arrays([b.column("ka").filter(keep), b.column("kb").filter(keep)], names=["ka", "kb"])

    return run


def _cells(tokens: np.ndarray, bits: int) -> np.ndarray:
    return ((tokens.astype(np.uint64) * _M[1] << np.uint64(20)) >> np.uint64(64 - bits)).astype(np.int64)


def _sets(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all sets of a batch, and the sets' sizes."""
    column = b.column("s")
    return column.flatten().to_numpy().view(np.uint32), np.asarray(column.value_lengths(), np.int64)


def _count_batches(bits: int):
    """``(slice, counts)``: partial counts of the cells, in slices, on the scale of one byte.

    Compressed, so that a task sends about as much as it has seen however large the table is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for b in batches:
            cell, n = np.unique(_cells(_sets(b)[0], bits), return_counts=True)
            total[cell] += n.astype(np.uint32)
        for i in range(0, len(total), SLICE):
            if total[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE], pa.int32()), pa.array([pa.compress(scaled(total[i : i + SLICE]), "zstd", asbytes=True)], pa.binary())], names=["slice", "counts"])

    return run


def scaled(counts: np.ndarray) -> bytes:
    """Counts in eighths of a doubling, rounded up: one byte each."""
    return np.minimum(255, np.ceil(8 * np.log2(counts + 1.0))).astype(np.uint8).tobytes()


def at_most(level: np.ndarray) -> np.ndarray:
    """The largest count behind a scaled one."""
    return np.exp2(level / 8.0) - 1


def _scaled_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(slice, scaled)``: full counts of each slice (upper bounds)."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + at_most(np.frombuffer(pa.decompress(c, SLICE, "zstd", asbytes=True), np.uint8).astype(np.float32))
    rows = [(i, scaled(c)) for i, c in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["slice", "scaled"])


def token_counts(records: DataFrame) -> tuple[int, np.ndarray]:
    """Bits of a cell number and the scaled counts: at most ``2**MOST_CELLS`` bytes at any input size."""
    tokens = records.agg(F.sum(F.size("s"))).first()[0] or 0
    bits = min(MOST_CELLS, max(LEAST_CELLS, (tokens // CELL).bit_length()))
    out = np.zeros(1 << bits, np.uint8)
    parts = records.select("s").mapInArrow(_count_batches(bits), "slice int, counts binary").repartition("slice")
    for i, c in parts.mapInArrow(_scaled_batches, "slice int, scaled binary").collect():
        out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(c, np.uint8)
    return bits, out


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    """How many of its rarest tokens a set must offer so that no partner is missed."""
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _prefix_batches(shared, bits: int, t: float, hot: int, trees: int):
    """``(tree, part, entries)``: the rarest tokens of the sets, packed by tree.

    An entry is a token, the class, the set's size, how many tokens follow from
    this one on (itself included) and the parities of those behind it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in _with_end(batches):
            if b is not None:
                held.extend(_prefixes(b, shared.value, bits, t, hot))
                if sum(len(x[0]) for x in held) < 600_000:
                    continue
            if held:
                yield _packed([np.concatenate(c) for c in zip(*held)], trees)
                held = []

    return run


def _prefixes(b: pa.RecordBatch, count: np.ndarray, bits: int, t: float, hot: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (token, k, n, rest, tail, part) of a batch of sets; ``tail`` has the parities of the tokens after this one in 64 bits."""
    tokens, size = _sets(b)
    if not len(tokens):
        return
    # records of different kinds never meet; their tokens are counted together
    kind = np.repeat(b.column("kind").to_numpy().astype(np.uint32), size)
    level = count[_cells(tokens, bits)]
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((tokens, level, owner))
    place = np.arange(len(tokens)) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
    first = place < np.repeat(prefix_length(size, t), size)
    one = np.uint64(1) << ((tokens[order] * np.uint32(0xC2B2AE35)) >> np.uint32(26)).astype(np.uint64)
    upto = np.bitwise_xor.accumulate(one)
    last = upto[np.cumsum(size) - 1]
    tail = (upto ^ np.repeat(last, size))[first]
    at, place = order[first], place[first]
    owner = owner[at]
    blocks = np.maximum(1, np.ceil(at_most(level[at].astype(float)) / hot)).astype(np.int64)
    k = b.column("k").to_numpy()[owner]
    mine = (k.view(np.uint64) >> np.uint64(20)).astype(np.int64) % blocks
    # a block meets every block: part = the pair of block numbers
    copies = np.repeat(np.arange(len(at)), blocks)
    other = np.arange(len(copies)) - np.repeat(np.r_[0, np.cumsum(blocks)[:-1]], blocks)
    part = np.minimum(mine[copies], other) * blocks[copies] + np.maximum(mine[copies], other)
    token = (tokens[at] ^ kind[at] * np.uint32(0x85EBCA6B))[copies]
    yield token, k[copies], size[owner][copies].astype(np.uint32), (size[owner] - place)[copies].astype(np.uint32), tail[copies], part


def _packed(columns: list[np.ndarray], trees: int) -> pa.RecordBatch:
    token, part = columns[0], columns[5]
    order = np.lexsort((token, part, (token.astype(np.uint64) * np.uint64(trees)) >> np.uint64(32)))
    token, k, n, rest, tail, part = (c[order] for c in columns)
    tree = ((token.astype(np.uint64) * np.uint64(trees)) >> np.uint64(32)).astype(np.int32)
    cut = np.r_[0, np.flatnonzero((tree[1:] != tree[:-1]) | (part[1:] != part[:-1])) + 1, len(tree)]
    entries = []
    for i, j in zip(cut[:-1], cut[1:]):
        raw = b"".join((np.diff(token[i:j], prepend=np.uint32(0)).tobytes(), n[i:j].tobytes(), rest[i:j].tobytes(), k[i:j].tobytes(), tail[i:j].tobytes()))
        entries.append(len(raw).to_bytes(4, "little") + pa.compress(raw, "zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(tree[cut[:-1]]), pa.array(part[cut[:-1]].astype(np.int32)), pa.array(entries, pa.binary())], names=["tree", "part", "entries"])


def _unpacked(entries: bytes) -> tuple[np.ndarray, ...]:
    raw = pa.decompress(entries[4:], int.from_bytes(entries[:4], "little"), "zstd", asbytes=True)
    m = len(raw) // 28
    small = np.frombuffer(raw, np.uint32, 3 * m).reshape(3, m)
    return np.cumsum(small[0], dtype=np.uint32), np.frombuffer(raw, np.int64, m, 12 * m), small[1].astype(np.int64), small[2].astype(np.int64), np.frombuffer(raw, np.uint64, m, 20 * m)


def _with_end(batches: Iterator):
    yield from batches
    yield None


def _enough(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, t: float) -> np.ndarray:
    return overlap * (1 + t) >= t * (na + nb) - 1e-9


class SignatureTree:
    """Entries (token, size, rest) packed bottom-up, in token order, into nodes of OR-ed bitmaps, size ranges and largest rests."""

    def __init__(self, token: np.ndarray, n: np.ndarray, rest: np.ndarray, tail: np.ndarray | None = None) -> None:
        self.order = np.lexsort((n, token))
        self.token, self.n, self.rest = token[self.order], n[self.order], rest[self.order]
        self.tail = np.zeros(len(n), np.uint64) if tail is None else tail[self.order]
        rank = np.cumsum(np.r_[True, self.token[1:] != self.token[:-1]]) - 1
        bit = rank * BITS // (rank[-1] + 1)
        bits = np.zeros((-(-len(bit) // LEAF), BITS // 64), np.uint64)
        np.bitwise_or.at(bits, (np.arange(len(bit)) // LEAF, bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        off = np.arange(0, len(bit), LEAF)
        lo, hi, most = np.minimum.reduceat(self.n, off), np.maximum.reduceat(self.n, off), np.maximum.reduceat(self.rest, off)
        self.levels = [(lo, hi, most, bits)]
        while len(lo) > FAN:
            off = np.arange(0, len(lo), FAN)
            lo, hi, most = np.minimum.reduceat(lo, off), np.maximum.reduceat(hi, off), np.maximum.reduceat(most, off)
            bits = np.bitwise_or.reduceat(bits, off, axis=0)
            self.levels.append((lo, hi, most, bits))
        self.tested = np.zeros(len(self.levels) + 1, np.int64)
        self.kept = np.zeros(len(self.levels) + 1, np.int64)

    def pairs(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: index pairs (into the input) of entries with the same token that may reach *t*.

        ``tested`` and ``kept`` count the pairs of each level (0: entries, 1: leaves, ...).
        """
        top = len(self.levels) - 1
        a, b = np.triu_indices(len(self.levels[top][0]))
        stack = [(top, a, b)]
        while stack:
            level, a, b = stack.pop()
            lo, hi, most, bits = self.levels[level]
            ok = _enough(np.minimum(most[a], most[b]), lo[a], lo[b], t) & (lo[a] * t <= hi[b] + 1e-9) & (lo[b] * t <= hi[a] + 1e-9)
            self.tested[level + 1] += len(a)
            a, b = a[ok], b[ok]
            ok = (bits[a] & bits[b]).any(axis=1)
            a, b = a[ok], b[ok]
            self.kept[level + 1] += len(a)
            below, fan = (len(self.levels[level - 1][0]), FAN) if level else (len(self.n), LEAF)
            for i in range(0, len(a), 2048):
                x = (a[i : i + 2048, None] * fan + np.repeat(np.arange(fan), fan)).ravel()
                y = (b[i : i + 2048, None] * fan + np.tile(np.arange(fan), fan)).ravel()
                ok = (x < below) & (y < below) & ((x < y) if not level else (x <= y))
                x, y = x[ok], y[ok]
                if level:
                    stack.append((level - 1, x, y))
                    continue
                self.tested[0] += len(x)
                ok = self.token[x] == self.token[y]
                x, y = x[ok], y[ok]
                # if this is the first common token, the others lie behind it in both sets
                rx, ry = self.rest[x], self.rest[y]
                apart = np.bitwise_count(self.tail[x] ^ self.tail[y]).astype(np.int64)
                ok = _enough(np.minimum(np.minimum(rx, ry), (rx + ry - apart) / 2), self.n[x], self.n[y], t)
                self.kept[0] += int(ok.sum())
                if ok.any():
                    yield self.order[x[ok]], self.order[y[ok]]


def _tree_batches(t: float, report: bool = False):
    """Candidates of each tree (rows sorted by tree and part), or the traversal's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in _with_end(batches):
            rows = [(None, None)] if b is None else zip(zip(b.column("tree").to_pylist(), b.column("part").to_pylist()), b.column("entries"))
            for key, entries in rows:
                if key != at:
                    if held:
                        yield from _grow([np.concatenate(c) for c in zip(*held)], t, report)
                    at, held = key, []
                if entries is not None:
                    held.append(_unpacked(entries.as_py()))

    return run


def _grow(entries: list[np.ndarray], t: float, report: bool) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((-entries[3], entries[1], entries[0]))
    token, k, n, rest, tail = (x[order] for x in entries)
    new = np.r_[True, (token[1:] != token[:-1]) | (k[1:] != k[:-1])]  # a class written by several tasks, or a repeated hash (its first place counts)
    token, k, n, rest, tail = (x[new] for x in (token, k, n, rest, tail))
    same = token[1:] == token[:-1]
    keep = np.r_[False, same] | np.r_[same, False]
    if not keep.any():
        return
    k = k[keep]
    tree = SignatureTree(token[keep], n[keep], rest[keep], tail[keep])
    for a, b in tree.pairs(t):
        if not report:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(k[a], k[b])), pa.array(np.maximum(k[a], k[b]))], names=["ka", "kb"])
    if report:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tree.tested), dtype=np.int32)), pa.array(tree.tested), pa.array(tree.kept)], names=["level", "tested", "kept"])


def _marks(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of ``MARKS`` bits in which the hashes of all keys are set: 8 MB at any input size."""
    at = F.pmod(F.col(column), F.lit(MARKS))
    words = keys.select(F.shiftright(at, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(MARKS // 64, np.uint64)
    if words.num_rows:
        out[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
    return out


def _marked(b: pa.RecordBatch, column: str, marks: np.ndarray) -> pa.RecordBatch:
    """Rows whose hash is marked; the others cannot be among the keys."""
    at = b.column(column).to_numpy().view(np.uint64) % np.uint64(MARKS)
    return b.filter(pa.array((marks[at // np.uint64(64)] >> (at % np.uint64(64)) & np.uint64(1)).astype(bool)))


def _marked_batches(shared, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _marked(b, column, shared.value)

    return run


def _set_batches(shared, n: int, min_words: int):
    """``(h, k, s)`` of the texts whose hash is marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _marked(b, "h", shared.value)
            hs, ks, sets = [], [], []
            for h, kind, text in zip(b.column("h").to_pylist(), b.column("kind").to_pylist(), b.column("text")):
                s = shingles(text.as_py(), n, min_words)
                if s is not None:
                    hs.append(h)
                    ks.append(_set_key(s, kind))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(_signed(np.array(ks, np.uint64))), pa.array(sets, pa.list_(pa.int64()))], names=["h", "k", "s"])

    return run


class NearDuplicates:
    """Pairs and classes of near-duplicate records of ``texts(kind int, id string, text string)``."""

    def __init__(self, texts: DataFrame, words: int = 3, threshold: float = 0.6, min_words: int = 20, tree_rows: int = TREE_ROWS, hot_group: int = HOT_GROUP) -> None:
        self.texts = texts.where("id is not null and text is not null")
        self.words, self.threshold, self.min_words = words, threshold, min_words
        self.tree_rows, self.hot_group = tree_rows, hot_group
        self.records = materialise(self.texts.mapInArrow(_record_batches(words, min_words), _RECORD), "dup-records")

    def _trees(self) -> DataFrame:
        """``(tree, part, entries)``, each tree and part in one task."""
        sets = self.records.where("s is not null")
        bits, counts = token_counts(sets)
        shared = sets.sparkSession.sparkContext.broadcast(counts)
        rows = sets.agg(F.sum(F.size("s") - F.ceil(F.size("s") * self.threshold) + 1)).first()[0] or 0
        trees = max(1, math.ceil(rows / self.tree_rows))
        entries = sets.select("kind", "k", "s").mapInArrow(_prefix_batches(shared, bits, self.threshold, self.hot_group, trees), "tree int, part int, entries binary")
        # a hot token is spread over tree tasks, one a pair of blocks
        return entries.repartition("tree", "part").sortWithinPartitions("tree", "part")

    def candidates(self) -> DataFrame:
        """``(ka, kb)``: pairs of classes that the trees could not rule out."""
        pairs = self._trees().mapInArrow(_tree_batches(self.threshold), "ka long, kb long")
        return pairs.repartition("ka").groupBy("ka", "kb").agg(F.lit(1).alias("one")).drop("one")  # this partitioning serves the next join, too

    def pruning(self) -> DataFrame:
        """``(level, tested, kept)`` of the dual traversal (level 0: entries, 1: leaves, ...)."""
        counts = self._trees().mapInArrow(_tree_batches(self.threshold, True), "level int, tested long, kept long")
        return counts.groupBy("level").agg(F.sum("tested").alias("tested"), F.sum("kept").alias("kept"))

    def class_pairs(self) -> DataFrame:
        """``(ka, kb)`` of different classes that reach the threshold, checked on their full sets.

        Their 32-bit sets decide, except for pairs within ``CLOSE`` tokens of the threshold,
        which are decided by their 64-bit sets.
        """
        cand = materialise(self._alike(self.candidates()), "dup-alike")
        asked = cand.select(F.explode(F.array("ka", "kb")).alias("k")).distinct()
        context = self.records.sparkSession.sparkContext
        marks = context.broadcast(_marks(asked, "k"))  # keeps most other sets out of the shuffle
        sets = self.records.where("s is not null").select("k", "s").mapInArrow(_marked_batches(marks, "k"), "k long, s array<int>")
        sets = sets.join(asked, "k", "left_semi").groupBy("k").agg(F.first("s").alias("s"))
        by32 = materialise(self._overlaps(cand, sets).where(F.col("over") >= -CLOSE), "dup-by32")
        close = by32.where(F.col("over") < CLOSE).select("ka", "kb")
        reps = self.records.join(close.select(F.explode(F.array("ka", "kb")).alias("k")).distinct(), "k", "left_semi").groupBy("k").agg(F.min(F.struct("kind", "id")).alias("r"))
        reps = materialise(reps.select("k", F.xxhash64("r.kind", "r.id").alias("h")), "dup-close")
        texts = self.texts.select("kind", "text", F.xxhash64("kind", "id").alias("h"))
        full = texts.mapInArrow(_set_batches(context.broadcast(_marks(reps, "h")), self.words, self.min_words), "h long, k long, s array<long>")
        full = full.join(reps, ["h", "k"], "left_semi").groupBy("k").agg(F.first("s").alias("s"))
        checked = self._overlaps(close, full).where(F.col("over") >= -1e-9)
        return by32.where(F.col("over") >= CLOSE).select("ka", "kb").unionByName(checked.select("ka", "kb"))

    def _over(self, both: Column, na: Column, nb: Column) -> Column:
        """By how many tokens an overlap exceeds what the threshold asks for."""
        return both - (na + nb) * (self.threshold / (1 + self.threshold))

    def _overlaps(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("k").alias(f"k{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
        both = F.size(F.array_intersect("sa", "sb"))
        return pairs.join(a, "ka").join(b, "kb").select("ka", "kb", self._over(both, F.size("sa"), F.size("sb")).alias("over"))

    def _alike(self, cand: DataFrame) -> DataFrame:
        """Candidates whose parity bitmaps allow the similarity: no more tokens may differ than bits do."""
        sign = self.records.where("s is not null").groupBy("k").agg(F.first("n").alias("n"), F.first("parity").alias("p"))
        a, b = (sign.select(F.col("k").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
        return cand.join(a, "ka").join(b, "kb").select("ka", "kb", "na", "nb", "pa", "pb").mapInArrow(_alike_batches(self.threshold), "ka long, kb long")

    def members(self) -> DataFrame:
        """``(kind, id, k, size, rep)``: the class of every record (an id may have two texts)."""
        rows = self.records.select("kind", "id", "k").distinct()
        classes = rows.groupBy("k").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("rep"))
        return join_verdicts(rows, classes, ["k"], "size")

    def pairs(self, expand: int = 200) -> DataFrame:
        """``(kind, id_a, id_b)``: all pairs of ids; classes above *expand* members stand as pairs with their representative."""
        members = materialise(self.members(), "dup-members")
        few = members.where((F.col("size") <= expand) | (F.col("id") == F.col("rep")))
        a = few.select("kind", F.col("id").alias("ia"), F.col("k").alias("ka"))
        b = few.select(F.col("id").alias("ib"), F.col("k").alias("kb"))
        between = self.class_pairs().join(a, "ka").join(b, "kb").select("kind", "ia", "ib")
        several = members.where(F.col("size").between(2, expand))
        within = several.select("kind", F.col("id").alias("ia"), "k").join(several.select(F.col("id").alias("ib"), "k"), "k").select("kind", "ia", "ib")
        star = members.where(F.col("size") > expand).select("kind", F.col("rep").alias("ia"), F.col("id").alias("ib"))
        every = between.unionByName(within).unionByName(star).where("ia <> ib")
        return every.select("kind", F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b")).distinct()

    def groups(self) -> DataFrame:
        """``(kind, id, group_id, members)``: connected groups of two or more records; ``group_id`` is the smallest id."""
        members = materialise(self.members(), "dup-members")
        label = connected(self.class_pairs().select("ka", "kb"))
        classes = members.groupBy("k").agg(F.first("size").alias("size"), F.first("rep").alias("rep"))
        classes = materialise(classes.join(label, "k", "left").select("k", "size", "rep", F.coalesce("root", "k").alias("root")), "dup-classes")
        whole = classes.groupBy("root").agg(F.sum("size").alias("members"), F.min("rep").alias("group_id")).where("members > 1")
        verdict = classes.join(whole, "root").select("k", "size", "group_id", "members")
        return join_verdicts(members.select("kind", "id", "k"), verdict, ["k"], "size").select("kind", "id", "group_id", "members").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``(k, root)`` of every node of ``edges(ka, kb)``: the smallest key of its component.

    Alternates the large-star and the small-star step until nothing changes, so a
    component of n nodes takes about log(n) rounds and no task holds one;
    labels and links stay in tables of the shared folder.
    """
    e = materialise(edges.select(F.greatest("ka", "kb").alias("a"), F.least("ka", "kb").alias("b")).where("a <> b").distinct(), "dup-edges")
    while True:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: larger neighbours hang on the least one
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.where("b < a")
        low = lower.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours and the node itself hang on the least one
        small = lower.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        new = materialise(small, "dup-edges")
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("k"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("k"), "root").distinct())


def corpus_texts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents (kind 0, raw_markdown) and chunks (kind 1, content)."""
    return documents.select(F.lit(0).alias("kind"), "id", F.col("raw_markdown").alias("text")).unionByName(
        chunks.select(F.lit(1).alias("kind"), "id", F.col("content").alias("text"))
    )
