"""Most similar vectors for every vector, by additive quantisation.

A vector is written as a sum of full-dimensional codewords: two coarse ones
that name its *cell*, then ``STAGES`` codewords of residual codebooks chosen by a beam
search.  The norm of the sum is stored beside the codes.  A query visits the
``probes`` cells whose coarse sums lie nearest, scores their members by table
look-ups (query times codeword, summed over the codes, divided by the stored
norm), and reranks a short list by the exact cosine.

The residual codebooks are fitted stage by stage and then jointly, by least squares
on the codes of the beam search.  The codebooks are fitted on at most ``SAMPLE`` vectors (the smallest id hashes
of a hash slice, so the sample is the same on every run); every vector is indexed and every
vector is a query.  The second coarse codebook grows with the number of
vectors, so a cell keeps about ``PER_CELL`` members; cells far above that are
split into blocks of members and of queries.

``probes`` and the short list are lower bounds: the true neighbours of at most
``QUERIES`` vectors are found by an exact scan, and both are doubled until
``RECALL`` of them would be found.

Equal vectors are searched once: a class of equal vectors is represented by
its smallest ids (k + 1 are enough for any list of k), so a vector that a
third of the rows share costs one search.  Ties go to the smaller id.

Defined results: a vector is usable if it has ``dim`` components, all finite
and not all zero; others (null, empty, other sizes, null ids) neither ask nor
answer.  Rows of one id delivered twice count once.  Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.keys import join_verdicts
from corpusloom.sources.tables import materialise

SAMPLE, PER_CELL, STAGES, WORDS, BEAM = 40_000, 1024, 4, 256, 4
#: Joint fits of all residual codebooks after the stage by stage one.
REFITS = 2
#: Members and queries of one task of a large cell.
BLOCK = 8192
#: Vectors whose true neighbours are found exactly to set probes and short list, and the share of these that must be found.
QUERIES, RECALL = 512, 0.95


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's method; an empty cluster takes a random point."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T * 2 - (c * c).sum(1)).argmax(1) for i in range(0, len(x), 8192)])
        order = np.argsort(near, kind="stable")
        found, start = np.unique(near[order], return_index=True)
        c[found] = np.add.reduceat(x[order], start, axis=0) / np.diff(np.r_[start, len(x)])[:, None]
        lost = np.setdiff1d(np.arange(k), found)
        if len(lost):
            c[lost] = x[rng.choice(len(x), len(lost))]
    return c


@dataclass
class Codebooks:
    """Coarse codebooks (first, second) and the residual stages, all full-dimensional float32."""

    first: np.ndarray
    second: np.ndarray
    stages: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, seconds: int) -> Codebooks:
        first = kmeans(x, min(WORDS, max(1, len(x) // 8)), 8, 1)
        r = x - first[_nearest(x, first)]
        second = kmeans(r, seconds, 6, 2) if seconds > 1 else np.zeros((1, x.shape[1]), np.float32)
        r = r - second[_nearest(r, second)]
        stages = []
        for s in range(STAGES):
            stages.append(kmeans(r, min(WORDS, len(r)), 6, 3 + s))
            r = r - stages[-1][_nearest(r, stages[-1])]
        books = cls(first, second, stages)
        for _ in range(REFITS):
            books._refit(x[: 64 * STAGES * WORDS // 4])
        return books

    def _refit(self, x: np.ndarray) -> None:
        """All residual codewords at once by least squares, given the beam search's codes."""
        cell = self.cells(x, 1)[:, 0]
        codes = np.concatenate([self.encode(x[i : i + 2048], cell[i : i + 2048])[0] for i in range(0, len(x), 2048)]).astype(np.int64)
        start = np.cumsum([0, *(len(b) for b in self.stages)])
        at = codes + start[:-1]
        n = int(start[-1])
        pairs = np.zeros((n, n))
        for a in range(at.shape[1]):
            for b in range(at.shape[1]):
                np.add.at(pairs, (at[:, a], at[:, b]), 1.0)
        sums = np.zeros((n, x.shape[1]))
        left = x - self.centre(cell)
        for a in range(at.shape[1]):
            np.add.at(sums, at[:, a], left)
        old = np.concatenate(self.stages)
        # a little weight on the old codewords keeps unused ones in place
        new = np.linalg.solve(pairs + 0.1 * np.eye(n), sums + 0.1 * old).astype(np.float32)
        self.stages = [new[i:j] for i, j in zip(start, start[1:])]

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The *probes* nearest cells of each vector, nearest first (first codeword x second codeword)."""
        n2 = len(self.second)
        d1 = (self.first * self.first).sum(1) - 2 * x @ self.first.T
        top = min(len(self.first), max(probes, 8))
        pick = np.argpartition(d1, top - 1, axis=1)[:, :top]
        cross = 2 * self.first @ self.second.T + (self.second * self.second).sum(1)
        d = np.take_along_axis(d1, pick, 1)[:, :, None] + cross[pick] - 2 * (x @ self.second.T)[:, None, :]
        d = d.reshape(len(x), -1)
        p = min(probes, d.shape[1])
        best = np.argpartition(d, p - 1, axis=1)[:, :p]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(pick, best // n2, 1) * n2 + best % n2

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.first[cell // len(self.second)] + self.second[cell % len(self.second)]

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n x STAGES, uint8) by beam search, and the norms of the decoded vectors."""
        base = self.centre(cell)
        n = len(x)
        left = (x - base)[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for book in self.stages:
            beam = left.shape[1]
            d = (book * book).sum(1) - 2 * (left.reshape(n * beam, -1) @ book.T)
            d = d.reshape(n, beam, -1) + (left * left).sum(2)[:, :, None]
            d = d.reshape(n, -1)
            keep = min(BEAM, d.shape[1])
            best = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            parent, word = best // len(book), best % len(book)
            left = left[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        best = (left * left).sum(2).argmin(1)
        decoded = x - left[np.arange(n), best]
        return codes[np.arange(n), best], np.sqrt((decoded * decoded).sum(1))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    n = (c * c).sum(1)
    return np.concatenate([(x[i : i + 8192] @ c.T * 2 - n).argmax(1) for i in range(0, len(x), 8192)])


def usable(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[list[str], np.ndarray]:
    """Ids and float64 rows of the usable vectors of a batch."""
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    ok = np.flatnonzero((size == dim) & np.asarray(ids.is_valid()))
    if not len(ok):
        return [], np.zeros((0, dim))
    take = vectors.take(pa.array(ok))
    x = take.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return ids.take(pa.array(ok[good])).to_pylist(), x[good]


def pack(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes: half precision where that is exact, else single, else double."""
    with np.errstate(over="ignore"):
        half, single = x.astype(np.float16), x.astype(np.float32)
    h, s = (half == x).all(1), (single == x).all(1)
    return [half[i].tobytes() if h[i] else single[i].tobytes() if s[i] else x[i].tobytes() for i in range(len(x))]


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors of :func:`pack`-ed rows, float32 (computed in double precision)."""
    kinds = {2 * dim: np.float16, 4 * dim: np.float32, 8 * dim: np.float64}
    if len({len(r) for r in rows}) == 1:
        x = np.frombuffer(b"".join(rows), kinds[len(rows[0])]).reshape(len(rows), dim).astype(np.float64)
    else:
        x = np.stack([np.frombuffer(r, kinds[len(r)]).astype(np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def _encode_batches(books: Codebooks, dim: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = usable(b.column("id"), b.column("v"), dim)
            for i in range(0, len(ids), 2048):
                part = x[i : i + 2048]
                u = _unit(part)
                cells = books.cells(u, probes)
                codes, norm = books.encode(u, cells[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[i : i + 2048], pa.string()),
                        pa.array(pack(part), pa.binary()),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(norm, pa.float32()),
                        pa.array(list(cells.astype(np.int32)), pa.list_(pa.int32())),
                    ],
                    names=["id", "v", "codes", "norm", "cells"],
                )

    return run


def _cell_batches(books: Codebooks, dim: int, probes: int):
    """The cells of coded vectors again, for more probes."""
    step = max(16, 8_000_000 // (min(len(books.first), max(probes, 8)) * len(books.second)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, step):
                rows = b.slice(i, step)
                cells = books.cells(unpack(rows.column("v").to_pylist(), dim), probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("vh"), rows.column("v"), pa.array(list(cells), pa.list_(pa.int32()))], names=["vh", "v", "cells"])

    return run


def _true_batches(asked: np.ndarray, q: np.ndarray, dim: int, k: int, least: float):
    """``(q, vh, cosine, ...)``: of each batch the k members nearest to every asked vector, exactly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vh, first = np.unique(b.column("vh").to_numpy(), return_index=True)
            if not len(vh):
                continue
            x = unpack(b.column("v").take(pa.array(first)).to_pylist(), dim)
            score = q @ x.T
            score[asked[:, None] == vh[None, :]] = -2
            s = min(k, len(vh))
            pick = np.argpartition(-score, s - 1, axis=1)[:, :s]
            found = np.take_along_axis(score, pick, 1).ravel()
            r, c = np.repeat(np.arange(len(q)), s), pick.ravel()
            good = (found >= least) & (found > -1.5)
            rows = b.take(pa.array(first[c[good]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(r[good].astype(np.int32)), pa.array(found[good].astype(np.float64)), *(rows.column(n) for n in ("vh", "codes", "norm", "cell"))], names=["q", "cosine", "vh", "codes", "norm", "cell"]
            )

    return run


def _scores(q: np.ndarray, books: Codebooks, cell: int, codes: list[bytes], norm: np.ndarray) -> np.ndarray:
    """Look-up scores (queries x members) of members of one cell."""
    c = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, len(books.stages))
    score = np.repeat((q @ books.centre(np.array([cell]))[0])[:, None], len(c), axis=1)
    for m, book in enumerate(books.stages):
        score += (q @ book.T)[:, c[:, m]]
    return score / np.maximum(norm, 1e-12)


def _ahead_batches(books: Codebooks, wanted: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """``(pair, n)``: members of its cell that score above the true neighbour of a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = b.column("cell").to_numpy()
            for c in np.unique(cell):
                if int(c) in wanted:
                    pair, q, own = wanted[int(c)]
                    rows = b.take(pa.array(np.flatnonzero(cell == c)))
                    above = (_scores(q, books, int(c), rows.column("codes").to_pylist(), rows.column("norm").to_numpy()) > own[:, None] + 1e-6).sum(1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair.astype(np.int32)), pa.array(above.astype(np.int64))], names=["pair", "n"])

    return run


def _widths(coded: DataFrame, n: int, books: Codebooks, dim: int, k: int, least: float, probes: int, short: int) -> tuple[int, int]:
    """Probes and short list that find ``RECALL`` of the true neighbours of a bounded query set."""
    slices = max(1, n // (4 * QUERIES))
    some = coded.where(F.pmod(F.xxhash64("vh"), F.lit(slices)) == 0).select("vh", "v").dropDuplicates(["vh"]).orderBy(F.xxhash64("vh"), "vh").limit(QUERIES).toArrow()
    if not some.num_rows:
        return probes, short
    asked, q = some.column("vh").to_numpy(), unpack(some.column("v").to_pylist(), dim)
    rows = coded.select("vh", "v", "codes", "norm", F.col("cells")[0].alias("cell"))
    near = rows.mapInArrow(_true_batches(asked, q, dim, k, least), "q int, cosine double, vh long, codes binary, norm float, cell int").dropDuplicates(["q", "vh"])
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "vh")
    true = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).toArrow()  # at most k * QUERIES rows
    if not true.num_rows:
        return probes, short
    who, cell, codes, norm = true.column("q").to_numpy(), true.column("cell").to_numpy(), true.column("codes").to_pylist(), true.column("norm").to_numpy()
    wanted = {}
    for c in np.unique(cell):
        at = np.flatnonzero(cell == c)
        wanted[int(c)] = (at, q[who[at]], np.array([_scores(q[who[i]][None], books, int(c), [codes[i]], norm[i : i + 1])[0, 0] for i in at]))
    one = rows.select("vh", "codes", "norm", "cell").where(F.col("cell").isin(*wanted)).dropDuplicates(["vh"])
    place = np.ones(len(who), np.int64)
    for r in one.mapInArrow(_ahead_batches(books, wanted), "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        place[r.pair] += r.n
    cells = len(books.first) * len(books.second)
    while True:
        seen = np.concatenate([(books.cells(q[i : i + 16], probes)[who[(who >= i) & (who < i + 16)] - i] == cell[(who >= i) & (who < i + 16), None]).any(1) for i in range(0, len(q), 16)])
        seen = seen[np.argsort(np.concatenate([np.flatnonzero((who >= i) & (who < i + 16)) for i in range(0, len(q), 16)]))]
        listed = place <= short
        if (seen & listed).mean() >= RECALL:
            return probes, short
        if seen.mean() <= listed.mean() and probes < cells or listed.all():
            probes = min(cells, 2 * probes)
        else:
            short *= 2


def _search_batches(books: Codebooks, dim: int, k: int, short: int, least: float):
    """Groups of rows sorted by (cell, part, role): members (role 0) first, then queries (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        members: list[tuple] = []
        ready = None
        for b in batches:
            cell, part, role = (b.column(c).to_numpy() for c in ("cell", "part", "role"))
            cut = np.flatnonzero((cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (role[1:] != role[:-1])) + 1
            for s, e in zip(np.r_[0, cut], np.r_[cut, b.num_rows]):
                key = (int(cell[s]), int(part[s]))
                if key != at:
                    at, members, ready = key, [], None
                rows = b.slice(s, e - s)
                if role[s] == 0:
                    members.append((rows.column("vh").to_numpy(), rows.column("v").to_pylist(), rows.column("codes").to_pylist(), rows.column("norm").to_numpy()))
                    continue
                if ready is None:
                    ready = _prepare(members, books, dim)
                if ready is not None:
                    yield from _search(rows, ready, books, key[0], dim, k, short, least)

    return run


def _prepare(members: list[tuple], books: Codebooks, dim: int):
    if not members:
        return None
    codes = np.frombuffer(b"".join(c for m in members for c in m[2]), np.uint8).reshape(-1, len(books.stages))
    return np.concatenate([m[0] for m in members]), unpack([v for m in members for v in m[1]], dim), codes.astype(np.intp), np.concatenate([m[3] for m in members])


def _search(rows: pa.RecordBatch, ready: tuple, books: Codebooks, cell: int, dim: int, k: int, short: int, least: float) -> Iterator[pa.RecordBatch]:
    vh, x, codes, norm = ready
    inverse = (1 / np.maximum(norm, 1e-12)).astype(np.float32)
    centre = books.centre(np.array([cell]))[0]
    asked = rows.column("vh").to_numpy()
    queries = rows.column("v").to_pylist()
    words = [book.T.copy() for book in books.stages]
    for i in range(0, len(asked), 256):
        q = unpack(queries[i : i + 256], dim)
        mine = asked[i : i + 256]
        score = np.repeat((q @ centre)[:, None], len(vh), axis=1)
        for m, w in enumerate(words):
            score += np.take(q @ w, codes[:, m], axis=1)
        score *= inverse
        s = min(short, len(vh))
        pick = np.argpartition(-score, s - 1, axis=1)[:, :s] if s < len(vh) else np.tile(np.arange(s), (len(q), 1))
        exact = np.einsum("qd,qsd->qs", q, x[pick], dtype=np.float32)
        ok = (exact >= least) & (vh[pick] != mine[:, None])
        if not ok.any():
            continue
        keep = min(k, s)
        order = np.argsort(np.where(ok, -exact, 9.0), axis=1, kind="stable")[:, :keep]
        r = np.repeat(np.arange(len(q)), keep)
        c = np.take_along_axis(pick, order, 1).ravel()
        good = np.take_along_axis(ok, order, 1).ravel()
        r, c = r[good], c[good]
        yield pa.RecordBatch.from_arrays(
            [pa.array(mine[r]), pa.array(vh[c]), pa.array(np.take_along_axis(exact, order, 1).ravel()[good].astype(np.float64))], names=["qa", "qb", "cosine"]
        )


def most_similar(vectors: DataFrame, k: int = 5, min_cosine: float = -1.0, dim: int = 64, probes: int = 6, short: int = 24) -> DataFrame:
    """``(id, other_id, cosine, rank)``: the k most similar other ids of every id of ``vectors(id string, v array<float|double>)``.

    Only neighbours with a cosine of at least *min_cosine* come out.  *probes*
    and *short* grow where the measured recall asks for it.
    """
    rows = vectors.where("id is not null and v is not null").where(F.size("v") == dim)
    n = rows.count()
    slices = max(1, n // SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(slices)) == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v").toArrow()
    _, x = usable(sample.column("id").combine_chunks(), sample.column("v").combine_chunks(), dim) if sample.num_rows else ([], np.zeros((0, dim)))
    spark = vectors.sparkSession
    if not len(x):
        return spark.createDataFrame([], "id string, other_id string, cosine double, rank int")
    seconds = 1
    while WORDS * seconds * PER_CELL < n and seconds < WORDS:
        seconds *= 2
    books = Codebooks.fit(_unit(x), seconds)
    schema = "id string, v binary, codes binary, norm float, cells array<int>"
    coded = materialise(rows.select("id", "v").mapInArrow(_encode_batches(books, dim, 1), schema).withColumn("vh", F.xxhash64("v")), "similar-codes")
    probes, short = _widths(coded, n, books, dim, k, min_cosine, probes, short)
    # classes of equal vectors, by their k + 2 smallest ids
    named = coded.select("vh", "id").distinct().withColumn("rn", F.row_number().over(Window.partitionBy("vh").orderBy("id"))).where(F.col("rn") <= k + 2)
    found = materialise(_neighbours(coded, books, dim, k, probes, short, min_cosine), "similar-found")
    other = found.join(named.select(F.col("vh").alias("qb"), F.col("id").alias("other_id")), "qb").select("qa", "other_id", "cosine")
    twins = coded.groupBy("vh").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("vh")
    same = named.join(twins, "vh", "left_semi").select(F.col("vh").alias("qa"), F.col("id").alias("other_id"), F.lit(1.0).alias("cosine"))
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "other_id"))), 1, k + 1)  # at most 2k + 2 rows a class
    lists = other.unionByName(same).groupBy("qa").agg(best.alias("near"))
    ids = coded.select("id", F.col("vh").alias("qa")).distinct()
    verdicts = materialise(ids.groupBy("qa").agg(F.count(F.lit(1)).alias("n")).join(lists, "qa"), "similar-lists")
    # back to the ids: the largest classes by a broadcast, the rest by a shuffle
    near = F.slice(F.filter("near", lambda x: x["other_id"] != F.col("id")), 1, k)
    rows = join_verdicts(ids, verdicts, ["qa"], "n").select("id", F.posexplode(near).alias("place", "x"))
    return rows.select("id", "x.other_id", (-F.col("x.far")).alias("cosine"), (F.col("place") + 1).cast("int").alias("rank"))


def _neighbours(coded: DataFrame, books: Codebooks, dim: int, k: int, probes: int, short: int, least: float) -> DataFrame:
    """``(qa, qb, cosine)``: of each class of equal vectors, the k nearest classes."""
    one = coded.dropDuplicates(["vh"])
    wide = one.select("vh", "v").mapInArrow(_cell_batches(books, dim, probes), "vh long, v binary, cells array<int>")
    sizes = one.groupBy(F.col("cells")[0].alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    asked = wide.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    # at most 65,536 cells exist, so this list is bounded; it holds those that need splitting
    large = sizes.join(asked, "cell", "full").where((F.coalesce("n", F.lit(0)) > BLOCK) | (F.coalesce("q", F.lit(0)) > 8 * BLOCK))
    large = large.select("cell", F.ceil(F.coalesce("n", F.lit(1)) / BLOCK).cast("int").alias("mb"), F.ceil(F.coalesce("q", F.lit(1)) / (8 * BLOCK)).cast("int").alias("qb"))
    large = F.broadcast(large)
    mb, qb = F.coalesce("mb", F.lit(1)), F.coalesce("qb", F.lit(1))
    mine = F.pmod(F.xxhash64("vh"), mb).cast("int")
    yours = F.pmod(F.xxhash64("vh"), qb).cast("int")
    members = (
        one.select(F.col("cells")[0].alias("cell"), "vh", "v", "codes", "norm")
        .join(large, "cell", "left")
        .select("cell", F.explode(F.transform(F.sequence(F.lit(0), qb - 1), lambda j: mine * qb + j)).alias("part"), F.lit(0).alias("role"), "vh", "v", "codes", "norm")
    )
    queries = (
        wide.select(F.explode("cells").alias("cell"), "vh", "v")
        .join(large, "cell", "left")
        .select(
            "cell",
            F.explode(F.transform(F.sequence(F.lit(0), mb - 1), lambda j: j * qb + yours)).alias("part"),
            F.lit(1).alias("role"),
            "vh",
            "v",
            F.lit(None).cast("binary").alias("codes"),
            F.lit(None).cast("float").alias("norm"),
        )
    )
    tasks = members.unionByName(queries).repartition("cell", "part").sortWithinPartitions("cell", "part", "role")
    near = tasks.mapInArrow(_search_batches(books, dim, k, short, least), "qa long, qb long, cosine double")
    w = Window.partitionBy("qa").orderBy(F.desc("cosine"), "qb")
    return near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
