"""Mixing sources to target weights: subset-sum budget fitting.

The total is the largest at which every source that has documents can give
its share with no document used more than its ``max_repeats`` times (or a
given total, if that is smaller).  A source's budget is met by whole passes
over its documents plus a selection for the rest of the budget:

1. documents are counted by exact token length (one row per source and length,
   not per document);
2. of every length the proportional part is taken, then whole counts of the
   longest lengths while more than ``DP_TOKENS`` tokens remain;
3. a bounded knapsack over the lengths still available fits the remaining
   budget exactly where a subset sum exists, otherwise as closely from below
   as any subset of that choice can;
4. of every length the required number of documents with the smallest seeded
   hashes is selected.  Hashes are bucketed first, so only the one bucket in
   which the count is reached is ranked, and a length that a third of the
   documents share costs no large sort.

The shares of sources without documents are spread over the others in
proportion; the report shows both.  Source names agree after trimming and
ignoring case.  Documents without a listed source, null and empty texts take
no part; rows of one ``doc_id`` count once.  Targets that are null or not
positive, or ``max_repeats`` under 1, exclude a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokens import TOKENIZER, with_token_counts
from corpusloom.sources.tables import materialise

DP_TOKENS, BUCKETS, MAX_LENGTHS = 32_768, 1024, 2_000_000
#: Rows of a length table that are still broadcast.
FEW_LENGTHS = 50_000


@dataclass
class Plan:
    """What one source gives: *passes* uses of every document and one more of some, by length."""

    source: str
    budget: int
    passes: int
    by_length: dict[int, int]


def fit_budget(counts: dict[int, int], budget: int, dp_tokens: int = DP_TOKENS) -> dict[int, int]:
    """How many items of each length (> 0) to take so that their sum is as near *budget* from below as found."""
    total = sum(n * c for n, c in counts.items())
    if budget >= total:
        return dict(counts)
    if budget <= 0:
        return {}
    taken = {n: c * budget // total for n, c in counts.items()}
    left = budget - sum(n * c for n, c in taken.items())
    for n in sorted(counts, reverse=True):
        if left <= dp_tokens:
            break
        more = min(counts[n] - taken[n], (left - dp_tokens // 2) // n)
        if more > 0:
            taken[n] += more
            left -= n * more
    for n, c in _knapsack({n: counts[n] - taken[n] for n in counts if n <= left and counts[n] > taken[n]}, left).items():
        taken[n] += c
    return {n: c for n, c in taken.items() if c}


def _knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded subset sum: bit *s* of ``sums`` is set while s is a reachable total."""
    sums, full = 1, (1 << budget + 1) - 1
    steps: list[tuple[int, int, int]] = []
    for n in sorted(counts, reverse=True):
        c, part = min(counts[n], budget // n), 1
        while c > 0:  # binary splitting of the count
            m = min(part, c)
            grown = (sums | sums << n * m) & full
            if grown != sums:
                steps.append((n, m, sums))
                sums = grown
            c -= m
            part *= 2
        if sums >> budget & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            out[n] = out.get(n, 0) + m
            at -= n * m
    return out


def plan_mix(lengths: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    """The plan of every source that has a target and documents."""
    size = {s: sum(n * c for n, c in h.items()) for s, h in lengths.items()}
    active = {s: t for s, t in targets.items() if size.get(s)}
    share = sum(t for t, _ in active.values())
    if not active:
        return []
    most = min(size[s] * r / (t / share) for s, (t, r) in active.items())
    goal = most if total is None else min(total, most)
    out = []
    for s, (t, r) in sorted(active.items()):
        budget = int(goal * t / share + 1e-6)
        passes = min(r, budget // size[s])
        rest = budget - passes * size[s] if passes < r else 0
        out.append(Plan(s, budget, passes, fit_budget(lengths[s], rest)))
    return out


class SourceMix:
    """The mix of ``documents(doc_id, source, text)`` for ``targets(source, target_share, max_repeats)``."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> None:
        self.spark = documents.sparkSession
        key = F.lower(F.btrim("source", F.lit(" \t\r\n")))
        # a fixed table: one row per source
        rows = targets.select(key.alias("source"), "target_share", "max_repeats").limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("more than 10,000 targets")
        self.targets = {r[0]: (float(r[1]), int(r[2])) for r in rows if r[0] and r[1] and r[1] > 0 and r[2] and r[2] >= 1}
        self.listed = sorted({(r[0], None if r[1] is None else float(r[1]), r[2]) for r in rows if r[0]}, key=str)
        mine = documents.where("text is not null and doc_id is not null").select("doc_id", key.alias("source"), "text").where(F.col("source").isin(list(self.targets)))
        sized = with_token_counts(mine, "text", tokenizer).where("tokens > 0").dropDuplicates(["doc_id"])
        self.docs = materialise(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")), "mix-documents")
        counted = self.docs.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LENGTHS + 1).toArrow()
        if counted.num_rows > MAX_LENGTHS:
            raise ValueError(f"more than {MAX_LENGTHS} different lengths")
        self.lengths: dict[str, dict[int, int]] = {}
        for s, n, c in zip(*(counted.column(i).to_pylist() for i in range(3))):
            self.lengths.setdefault(s, {})[n] = c
        self.plans = plan_mix(self.lengths, self.targets, total)

    def selection(self) -> DataFrame:
        """``(source, doc_id, tokens, uses)`` of the documents that are used."""
        def small(df: DataFrame) -> DataFrame:
            return F.broadcast(df) if sum(len(p.by_length) for p in self.plans) <= FEW_LENGTHS else df

        passes = self.spark.createDataFrame([(p.source, p.passes) for p in self.plans], "source string, passes int")
        wanted = self.spark.createDataFrame([(p.source, n, c) for p in self.plans for n, c in p.by_length.items()], "source string, tokens long, want long")
        bucket = F.shiftrightunsigned("h", 54).cast("int")
        rows = self.docs.withColumn("bucket", bucket)
        size = rows.groupBy("source", "tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("source", "tokens").orderBy("bucket")  # at most 1,024 rows each
        edge = (
            size.join(small(wanted), ["source", "tokens"])
            .withColumn("upto", F.sum("n").over(order))
            .where("upto >= want and upto - n < want")
            .select("source", "tokens", F.col("bucket").alias("edge"), (F.col("want") - F.col("upto") + F.col("n")).alias("need"))
        )
        # one row per source and length: a broadcast up to FEW_LENGTHS, else a shuffle
        marked = rows.join(small(edge), ["source", "tokens"], "left")
        below = marked.where("bucket < edge").select("source", "doc_id", F.lit(1).alias("once"))
        rank = F.row_number().over(Window.partitionBy("source", "tokens").orderBy("h", "doc_id"))
        at = marked.where("bucket = edge").withColumn("rank", rank).where("rank <= need").select("source", "doc_id", F.lit(1).alias("once"))
        extra = below.unionByName(at).select("doc_id", "once")
        uses = F.col("passes") + F.coalesce("once", F.lit(0))
        return self.docs.join(F.broadcast(passes), "source").join(extra, "doc_id", "left").select("source", "doc_id", "tokens", uses.alias("uses")).where("uses > 0")

    def check(self) -> DataFrame:
        """``(source, used, within_cap)`` of every listed source."""
        caps = self.spark.createDataFrame([(s, c) for s, _, c in self.listed], "source string, max_repeats int")
        return self.report().join(caps, "source").select("source", (F.col("documents") > 0).alias("used"), (F.col("max_uses") <= F.coalesce("max_repeats", F.lit(0))).alias("within_cap"))

    def report(self) -> DataFrame:
        """``(source, target_share, actual_share, documents, max_uses, tokens)``, one row per listed source."""
        listed = self.spark.createDataFrame([(s, t) for s, t, _ in self.listed], "source string, target_share double")
        used = self.selection().groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.max("uses").alias("max_uses"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"))
        every = Window.partitionBy()  # one row per source
        zero = F.lit(0).cast("long")
        return (
            listed.join(used, "source", "left")
            .withColumn("tokens", F.coalesce("tokens", zero))
            .withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(every), 6))
            .select("source", "target_share", "actual_share", F.coalesce("documents", zero).alias("documents"), F.coalesce("max_uses", F.lit(0)).alias("max_uses"), "tokens")
        )
