"""Filling fixed-capacity containers: bounded-space online best-fit.

Items arrive one by one; ``open_bins`` containers are open.  A bitset has bit
*f* set while some open container has *f* tokens free, so the best fit of an
item is the lowest set bit at or above its size.  When no container fits and
all are open, the fullest closes.  Only an item above the capacity is divided:
into full containers and a rest, which is packed like any item.

The stream is cut into shards of about ``shard_tokens`` tokens, each packed by
one task; the space lost to a shard's last containers is at most
``open_bins * capacity`` per shard and independent of the number of shards in
proportion.  Shards are drawn by row, not by key, so a hot key spreads.

Defined results: null texts are left out; empty texts take no space but are
assigned; every row is an item, so repeated rows are packed repeatedly;
capacities below 1 or null raise ``ValueError``.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.tokens import TOKENIZER, with_token_counts
from corpusloom.sources.tables import materialise

OPEN_BINS, SHARD_TOKENS = 256, 2_000_000


class BestFit:
    """The packer of one shard."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.free = 0  # the bitset
        self.bins: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _new(self) -> int:
        self.made += 1
        return self.made - 1

    def _put(self, number: int, space: int) -> None:
        if space:  # a full container closes at once
            self.bins.setdefault(space, []).append(number)
            self.free |= 1 << space
            self.open += 1

    def _take(self, space: int) -> int:
        stack = self.bins[space]
        number = stack.pop()
        if not stack:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return number

    def add(self, size: int) -> list[tuple[int, int, int]]:
        """``(bin, first token, tokens)`` of each piece of an item."""
        out = []
        start = 0
        while size - start > self.capacity:
            out.append((self._new(), start, self.capacity))
            start += self.capacity
        rest = size - start
        above = self.free >> rest
        if above:
            space = rest + (above & -above).bit_length() - 1
            number = self._take(space)
        else:
            if self.open >= self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            number, space = self._new(), self.capacity
        self._put(number, space - rest)
        out.append((number, start, rest))
        return out


def _pack_batches(open_bins: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = packer = None
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("budget_name", "bin_id", "doc_id", "piece_no", "token_start", "tokens")}
            for name, cap, shard, doc, n in zip(*(b.column(c).to_pylist() for c in ("budget_name", "capacity", "shard", "doc_id", "tokens"))):
                if (name, shard) != at:
                    at, packer = (name, shard), BestFit(cap, open_bins)
                for i, (number, start, size) in enumerate(packer.add(n)):
                    for c, v in zip(out, (name, f"{shard}-{number}", doc, i, start, size)):
                        out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_OUT)

    return run


_OUT = pa.schema([("budget_name", pa.string()), ("bin_id", pa.string()), ("doc_id", pa.int64()), ("piece_no", pa.int32()), ("token_start", pa.int64()), ("tokens", pa.int64())])


def pack_documents(documents: DataFrame, budgets: DataFrame, tokenizer: str = TOKENIZER, open_bins: int = OPEN_BINS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``(budget_name, bin_id, doc_id, piece_no, token_start, tokens)`` for ``documents(doc_id, text)`` and every budget."""
    wanted = [(r["budget_name"], r["capacity_tokens"]) for r in budgets.select("budget_name", "capacity_tokens").distinct().limit(1001).collect()]
    if len(wanted) > 1000:
        raise ValueError("more than 1,000 budgets")
    if any(c is None or c < 1 for _, c in wanted):
        raise ValueError("a capacity must be at least 1")
    sized = with_token_counts(documents.where("text is not null").select("doc_id", "text"), "text", tokenizer)
    items = materialise(sized.withColumn("seq", F.monotonically_increasing_id()), "pack-items")
    total = items.agg(F.sum("tokens")).first()[0] or 0
    shards = max(1, math.ceil(total / shard_tokens))
    each = F.array(*[F.struct(F.lit(n).alias("budget_name"), F.lit(c).cast("long").alias("capacity")) for n, c in wanted]) if wanted else F.array().cast("array<struct<budget_name:string,capacity:bigint>>")
    rows = (
        items.withColumn("shard", F.pmod(F.xxhash64("seq", "doc_id"), F.lit(shards)).cast("int"))
        .select("doc_id", "tokens", "seq", "shard", F.explode(each).alias("b"))
        .select("b.budget_name", "b.capacity", "shard", "doc_id", "seq", "tokens")
    )
    order = ("budget_name", "shard", F.xxhash64("seq"), "seq")
    return rows.repartition("budget_name", "shard").sortWithinPartitions(*order).mapInArrow(_pack_batches(open_bins), "budget_name string, bin_id string, doc_id long, piece_no int, token_start long, tokens long")


def fill_report(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget_name, capacity_tokens, bins, tokens, fill)`` per budget."""
    used = packed.groupBy("budget_name", "bin_id").agg(F.sum("tokens").alias("tokens")).groupBy("budget_name").agg(F.count(F.lit(1)).alias("bins"), F.sum("tokens").alias("tokens"))
    return used.join(budgets.select("budget_name", "capacity_tokens").distinct(), "budget_name").select(
        "budget_name", "capacity_tokens", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 4).alias("fill")
    )


def check(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """``(budget_name, capacity_tokens, documents, overfull, needless)``: items placed, containers above the capacity, items divided although they fit."""
    capacity = F.broadcast(budgets.select("budget_name", "capacity_tokens").distinct())  # at most 1,000 rows
    bins = packed.groupBy("budget_name", "bin_id").agg(F.sum("tokens").alias("t")).join(capacity, "budget_name").groupBy("budget_name").agg(F.sum((F.col("t") > F.col("capacity_tokens")).cast("long")).alias("overfull"))
    items = packed.groupBy("budget_name", "doc_id").agg(F.sum("tokens").alias("t"), F.max("piece_no").alias("last"), F.sum((F.col("piece_no") == 0).cast("long")).alias("n"))
    split = (F.col("last") > 0) & (F.col("n") == 1) & (F.col("t") <= F.col("capacity_tokens"))
    items = items.join(capacity, "budget_name").groupBy("budget_name", "capacity_tokens").agg(F.sum("n").alias("documents"), F.sum(split.cast("long")).alias("needless"))
    return items.join(bins, "budget_name").select("budget_name", "capacity_tokens", "documents", "overfull", "needless")
