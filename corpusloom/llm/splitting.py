"""Splitting oversized items at natural boundaries, by pointer doubling.

An item longer than ``max_tokens`` becomes overlapping pieces.  The steps:

1. every legal boundary of an oversized text becomes a row: paragraph (4),
   line (3), sentence (2); where two of them lie more than half an overlap
   apart also the word ends (1) between them, and where even two of these lie
   that far apart hard cuts (0) on a grid;
2. each boundary, as the start of a piece, is joined to its *farthest legal
   end* (the farthest boundary of the strongest kind in the second half of the
   allowed length) and, from there back by the overlap, to the start of the
   next piece: one successor per boundary.  With an overlap above 0 every two
   successive pieces share text, whatever the boundaries are;
3. the successor table is squared again and again.  After round *k* the set of
   reached starts holds the first 2**k greedy cuts of every item at once, so a
   text with n pieces needs log2(n) joins instead of n steps.

Successors are found by range windows over blocks of ``block`` characters with
a halo, so a huge text is spread over many tasks.  One token is
``chars_per_token`` characters (code points), a text has floor(chars / that).

Defined results: null and empty texts, and texts within the limit, yield no
piece (``split_oversized``); repeated rows of one id and content count once;
two different contents under one id are both split, told apart by
``content_key``; a null id is an id of its own.  A text without any natural
boundary is cut hard.  Pieces never exceed the limit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import materialise

MAX_TOKENS, OVERLAP_TOKENS, CHARS_PER_TOKEN = 1500, 200, 4

_STRONG = re.compile(r"(?P<p>\r?\n[ \t]*\r?\n\s*)|(?P<l>\r?\n[ \t]*)|(?P<s>[.!?;]['\")\]]*[ \t]+|[。！？、])")
_WORD = re.compile(r"[ \t]+")
_RANK = {"p": 4, "l": 3, "s": 2}
#: Words that end in a dot without ending a sentence (lower case, fixed values).
_ABBREVIATIONS = frozenset("no nr cf e.g i.e etc art abs vgl bzw z.b p.ej sr sra dr mr mrs ms st fig vol pp pg ca approx".split())


def boundaries(text: str, gap: int, wide: int) -> list[tuple[int, int]]:
    """``(position, rank)`` of the legal cuts of *text*, with both ends (rank 5)."""
    strong = [(0, 5)]
    for m in _STRONG.finditer(text):
        rank, at = _RANK[m.lastgroup], m.end()
        if rank == 2 and m.group()[0] == ".":
            word = text[max(0, m.start() - 12) : m.start()].rsplit(None, 1)[-1:] or [""]
            if word[0].lower().lstrip("(") in _ABBREVIATIONS or word[0].isdigit() and len(word[0]) < 3:
                continue
        if at < len(text):
            strong.append((at, rank))
    strong.append((len(text), 5))
    out = strong[:1]
    for at, rank in strong[1:]:
        last = out[-1][0]
        if at - last > wide:
            for m in _WORD.finditer(text, last + 1, at):
                if m.end() < at:
                    _fill(out, m.end(), gap)
                    out.append((m.end(), 1))
        _fill(out, at, gap)
        out.append((at, rank))
    return out


def _fill(out: list[tuple[int, int]], at: int, gap: int) -> None:
    last = out[-1][0]
    out.extend((x, 0) for x in range(last + gap, at, gap))


def _boundary_batches(gap: int, wide: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column("item"), b.column("text")
            for i in range(b.num_rows):  # one text at a time keeps memory at one text's boundaries
                cuts = boundaries(texts[i].as_py(), gap, wide)
                item = keys[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(cuts), pa.binary()), pa.array([p for p, _ in cuts], pa.int64()), pa.array([r for _, r in cuts], pa.int32())],
                    names=["item", "pos", "rank"],
                )

    return run


def split_oversized(
    items: DataFrame,
    max_tokens: int = MAX_TOKENS,
    overlap_tokens: int = OVERLAP_TOKENS,
    chars_per_token: int = CHARS_PER_TOKEN,
    block_pieces: int = 16,
) -> DataFrame:
    """Pieces of the oversized rows of ``items(item_kind, item_id, content)``.

    Returns ``(item_kind, item_id, content_key, piece_no, start_offset,
    end_offset, piece)``; offsets count code points of the content.
    """
    longest = max_tokens * chars_per_token + chars_per_token - 1  # most characters whose floor stays within the limit
    back = overlap_tokens * chars_per_token
    gap = max(1, min(longest // 4, back // 2 or longest // 4))  # every overlap window holds a legal start
    if back >= longest // 2:  # else a piece need not advance
        raise ValueError("the overlap must be under half of the limit")
    key = F.unhex(F.substring(F.sha2(F.concat_ws("\x1f", F.col("item_kind"), F.coalesce("item_id", F.lit("\x00")), F.col("content")), 256), 1, 32))
    big = (
        items.where(F.length("content") > longest)
        .select("item_kind", "item_id", F.col("content").alias("text"), key.alias("item"))
        .dropDuplicates(["item"])
    )
    big = materialise(big, "split-items")
    at = materialise(big.select("item", "text").mapInArrow(_boundary_batches(gap, gap), "item binary, pos long, rank int"), "split-boundaries")
    block = longest * block_pieces
    ends = materialise(_successors(at, longest, back, block), "split-successors")
    size = big.agg(F.max(F.length("text"))).first()[0]
    starts = _reached(ends, size or 0, longest // 2 - back)
    cut = starts.join(ends, ["item", "pos"]).groupBy("item").agg(F.sort_array(F.collect_list(F.struct("pos", "end"))).alias("cuts"))
    # one row a text: the cuts of n characters are n / 2,000 pairs of numbers beside the text itself
    schema = "item_kind string, item_id string, content_key string, piece_no int, start_offset long, end_offset long, piece string"
    return big.join(cut, "item").select("item_kind", "item_id", F.lower(F.hex("item")).alias("content_key"), "text", "cuts").mapInArrow(_piece_batches, schema)


def coverage(pieces: DataFrame, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, chars_per_token: int = CHARS_PER_TOKEN) -> DataFrame:
    """``(item_kind, item_id, chars_covered, sizes_ok, overlaps_ok)`` of every text that was cut.

    ``chars_covered`` is the length of the union of its pieces; ``overlaps_ok``
    says that each piece starts inside the one before and shares at most the overlap with it.
    """
    w = Window.partitionBy("item_kind", "item_id", "content_key").orderBy("piece_no")
    shared = F.lag("end_offset").over(w) - F.col("start_offset")
    rows = pieces.withColumn("shared", shared).groupBy("item_kind", "item_id", "content_key").agg(
        F.sum(F.col("end_offset") - F.col("start_offset") - F.coalesce("shared", F.lit(0))).alias("chars_covered"),
        F.min((F.length("piece") == F.col("end_offset") - F.col("start_offset")) & (F.floor(F.length("piece") / chars_per_token) <= max_tokens)).alias("sizes_ok"),
        F.coalesce(F.min(F.col("shared").between(1 if overlap_tokens else 0, overlap_tokens * chars_per_token)), F.lit(True)).alias("overlaps_ok"),
    )
    return rows.drop("content_key")


def _piece_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            text, cuts = b.column("text")[i].as_py(), b.column("cuts")[i].as_py()
            same = [pa.repeat(b.column(c)[i], len(cuts)) for c in ("item_kind", "item_id", "content_key")]
            start, end = [c["pos"] for c in cuts], [c["end"] for c in cuts]
            yield pa.RecordBatch.from_arrays(
                [*same, pa.array(range(len(cuts)), pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array([text[x:y] for x, y in zip(start, end)], pa.string())],
                names=["item_kind", "item_id", "content_key", "piece_no", "start_offset", "end_offset", "piece"],
            )


def _successors(at: DataFrame, longest: int, back: int, block: int) -> DataFrame:
    """``(item, pos, end, next)``: the piece that starts at each boundary and the start of the one after it."""
    own = F.floor(F.col("pos") / block).cast("long")
    both = F.when(own > 0, F.array(own, own - 1)).otherwise(F.array(own))
    spread = at.select("item", "pos", "rank", F.explode(both).alias("block"))
    near = Window.partitionBy("item", "block").orderBy("pos")
    half = near.rangeBetween(longest // 2, longest)
    whole = near.rangeBetween(1, longest)
    best = F.coalesce(
        F.max(F.when(F.col("rank") == 5, F.col("pos"))).over(whole),
        *[F.max(F.when(F.col("rank") >= r, F.col("pos"))).over(half) for r in (4, 2, 1)],
        F.max("pos").over(whole),
    )
    ends = spread.withColumn("end", best).where((F.floor(F.col("pos") / block) == F.col("block")) & F.col("end").isNotNull())
    return ends.join(_starts(at, back, block), ["item", "end"]).select("item", "pos", "end", "next")


def _starts(at: DataFrame, back: int, block: int) -> DataFrame:
    """``(item, end, next)``: where the piece after one that ends at a boundary starts (null at the end of the text).

    The first sentence, else word, else hard cut within the overlap before the end, never the end itself.
    """
    own = F.floor(F.col("pos") / block).cast("long")
    spread = at.select("item", "pos", "rank", F.explode(F.array(own, own + 1)).alias("block"))
    first = F.col("pos")
    if back:
        behind = Window.partitionBy("item", "block").orderBy("pos").rangeBetween(-back, -1)
        first = F.coalesce(*[F.min(F.when(F.col("rank") >= r, F.col("pos"))).over(behind) for r in (2, 1, 0)], first)
    first = F.when((F.col("rank") < 5) | (F.col("pos") == 0), first)
    return spread.withColumn("next", first).where(F.floor(F.col("pos") / block) == F.col("block")).select("item", F.col("pos").alias("end"), "next")


def _reached(ends: DataFrame, size: int, advance: int) -> DataFrame:
    """Starts reached from 0, by squaring the successor table.

    *advance* is the least distance of two starts: an end lies at
    ``longest // 2`` or later (a hard cut at ``longest - gap``, which is
    farther) and the next start at most the overlap before it.
    """
    rounds = (max(0, size - 1) // advance).bit_length()  # 2**rounds starts are reached, (size - 1) // advance + 1 can exist
    step = ends.where("next is not null").select("item", F.col("pos").alias("a"), F.col("next").alias("b"))
    reached = ends.where("pos = 0").select("item", "pos")
    for k in range(rounds):
        ahead = reached.join(step, (reached.item == step.item) & (reached.pos == step.a)).select(reached.item, F.col("b").alias("pos"))
        reached = reached.unionByName(ahead)
        if k + 1 < rounds:
            other = step.select(F.col("item").alias("item2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
            step = step.join(other, (F.col("item") == F.col("item2")) & (F.col("b") == F.col("a2"))).select("item", "a", F.col("b2").alias("b"))
            if k % 2 == 1:
                step, reached = materialise(step, "split-squared"), materialise(reached, "split-reached")
    return reached.distinct()


def corpus_items(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sections and stored chunks as items."""
    return sections.select(F.lit("section").alias("item_kind"), F.col("id").alias("item_id"), "content").unionByName(
        chunks.select(F.lit("chunk").alias("item_kind"), F.col("id").alias("item_id"), "content")
    )
