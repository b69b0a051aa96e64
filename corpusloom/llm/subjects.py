"""Subject areas of documents: labelling functions and a latent accuracy model.

1. Every document is tokenised once into word hashes with sentence and paragraph marks.
2. A *lexicon* (word -> subject) is fitted on the hand labels (at most
   ``MAX_LABELS`` of them) and then ``ROUNDS`` times on all documents, under
   the subjects the previous lexicon gives them.
3. *Labelling functions* look at each document and subject, each at evidence of its own,
   and answer with a level or abstain:

   ``lexicon``  number and share of the document's sentences the subject leads (two words or more);
   ``section``  number and share of the sections (paragraphs) in which it leads two sentences or more;
   ``title``    words of the title: this subject, another one, none;
   ``address``  words of path and name: this subject, another one, none;
   ``source``   whether the source's labelled documents have the subject more or less often than all.

4. *Accuracies.*  How each function answers for documents that are and are not about a
   subject is learned per subject, shrunk towards all subjects, by expectation maximisation over the counts of
   answer patterns of all documents.  Hand labels only steer the fit;
   every document, labelled or not, is assigned the subjects whose posterior under its answers is at least one half.

The lexicon is a model of at most ``LEXICON`` words (those most specific to a
subject); everything else covers all documents.

Defined results: null and empty texts have no subject; labels count after
trimming and ignoring case, unknown ones are ignored; a repeated ``doc_id``
counts once per distinct text.  Without labels nothing is assigned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import materialise

MAX_LABELS, ROUNDS, LEXICON, MIN_COUNT, PURITY = 20_000, 2, 500_000, 3, 0.55
#: Functions and their numbers of levels, in the order of a pattern's digits.
FUNCTIONS = {"lexicon": 25, "section": 25, "title": 3, "address": 3, "source": 3}
COUNTS, SECTIONS, SHARES = (1, 2, 3, 6), (1, 2, 3, 5), (0.1, 0.2, 0.35, 0.6)
#: Marks in a token array; word hashes lie above.
SENTENCE, PARAGRAPH = 0, 1

_WORD = re.compile(r"[^\W\d_]{3,}")
_SENTENCE = re.compile(r"[.!?]\s+|\n(?=[-#|])")
_PARAGRAPH = re.compile(r"\n\s*\n")


class _Hashes(dict):
    """Word hashes, kept while they are few."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = (xxhash.xxh3_64_intdigest(w) >> 1) | 2
        return h


_HASHES = _Hashes()


def tokens(text: str) -> list[int]:
    """Word hashes of a text, a mark after each sentence and paragraph."""
    out: list[int] = []
    of = _HASHES.__getitem__
    for paragraph in _PARAGRAPH.split(text.lower()):
        for sentence in _SENTENCE.split(paragraph):
            out.extend(map(of, _WORD.findall(sentence)))
            out.append(SENTENCE)
        out[-1] = PARAGRAPH
    return out


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int64())
    for b in batches:
        text, title, address = (b.column(c).to_pylist() for c in ("text", "title", "address"))
        for i in range(0, b.num_rows, 500):
            arrays = [
                pa.array([tokens(t) for t in text[i : i + 500]], kind),
                pa.array([[_HASHES[w] for w in _WORD.findall((t or "").lower())] for t in title[i : i + 500]], kind),
                pa.array([[_HASHES[w] for w in _WORD.findall((t or "").lower().replace("_", " "))] for t in address[i : i + 500]], kind),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 500), b.column("source").slice(i, 500), *arrays], names=["doc_id", "source", "w", "title", "address"])


class Lexicon:
    """Sorted word hashes and their subjects."""

    def __init__(self, words: np.ndarray, subjects: np.ndarray) -> None:
        order = np.argsort(words)
        self.words, self.subjects = words[order], subjects[order].astype(np.int8)

    def of(self, w: np.ndarray) -> np.ndarray:
        """Subject of each word, -1 for others."""
        if not len(self.words):
            return np.full(len(w), -1, np.int8)
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, self.subjects[at], np.int8(-1))


def _flat(b: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    c = b.column(column)
    return c.flatten().to_numpy(), np.repeat(np.arange(len(c)), np.asarray(c.value_lengths(), np.int64))


def _table(rows: np.ndarray, subject: np.ndarray, n: int, k: int) -> np.ndarray:
    """Counts by row and subject; a subject of -1 is left out."""
    ok = subject >= 0
    return np.bincount(rows[ok].astype(np.int64) * k + subject[ok], minlength=n * k).reshape(n, k)


def leading(counts: np.ndarray, least: int) -> np.ndarray:
    """Per row the subject with the single largest count of at least *least*, else -1."""
    ranked = np.sort(counts, axis=1)
    second = ranked[:, -2] if counts.shape[1] > 1 else 0
    return np.where((ranked[:, -1] >= least) & (ranked[:, -1] > second), counts.argmax(1), -1)


def document_subjects(w: np.ndarray, rows: np.ndarray, n: int, lexicon: Lexicon, k: int) -> np.ndarray:
    """Subjects (n x k) by share of the sentences with two or more words of one subject (used between rounds)."""
    c = _led(w, lexicon.of(w), rows, n, k)[0]
    return (c >= 2) & (c >= 0.3 * c.sum(1, keepdims=True))


def _led(w: np.ndarray, s: np.ndarray, rows: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document and subject: sentences it leads with two or more words, paragraphs with two or more such sentences."""
    if not len(w):
        return np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
    ends, stops = w <= PARAGRAPH, w == PARAGRAPH
    part, paragraph = np.cumsum(ends) - ends, np.cumsum(stops) - stops
    lead = leading(_table(part, s, int(part[-1]) + 1, k), 2)
    sentence = np.flatnonzero(ends)
    passages = _table(paragraph[sentence], lead, int(paragraph[-1]) + 1, k) >= 2
    at, which = np.nonzero(passages)
    return _table(rows[sentence], lead, n, k), _table(rows[stops][at], which, n, k)


def _count_batches(k: int, shared):
    """``(word, s, n)``: documents with the word by subject (word 0: all documents), of one subject each or with the given labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            w, rows = _flat(b, "w")
            if shared is None:
                mine = np.zeros((b.num_rows, k), bool)
                s, r = _flat(b, "subjects")
                mine[r, s] = True
            else:
                mine = document_subjects(w, rows, b.num_rows, shared.value, k)
                mine &= mine.sum(1, keepdims=True) == 1
            weight = mine / np.maximum(mine.sum(1, keepdims=True), 1)
            word = w > PARAGRAPH
            order = np.lexsort((w[word], rows[word]))
            w, rows = w[word][order], rows[word][order]
            new = np.r_[True, (w[1:] != w[:-1]) | (rows[1:] != rows[:-1])] if len(w) else np.zeros(0, bool)
            w, rows = np.r_[w[new], np.zeros(b.num_rows, np.int64)], np.r_[rows[new], np.arange(b.num_rows)]
            distinct, at = np.unique(w, return_inverse=True)
            for s in range(k):
                n = np.bincount(at, weight[rows, s], len(distinct))
                ok = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(distinct[ok]), pa.array(np.full(ok.sum(), s, np.int32)), pa.array(n[ok])], names=["word", "s", "n"])

    return run


def _fitted(counted: DataFrame, k: int, least: int = MIN_COUNT) -> Lexicon:
    """Words whose documents, in proportion to the subjects' sizes, belong to one subject."""
    sums = counted.groupBy("word").agg(*[F.sum(F.when(F.col("s") == i, F.col("n")).otherwise(0.0)).alias(f"c{i}") for i in range(k)])
    sums = materialise(sums.where(" + ".join(f"c{i}" for i in range(k)) + f" >= {least} or word = 0"), "subject-words")
    row = sums.where("word = 0").first()
    if row is None:
        return Lexicon(np.zeros(0, np.int64), np.zeros(0))
    rate = F.array(*[F.col(f"c{i}") / F.lit(max(float(row[f"c{i}"]), 1.0)) for i in range(k)])
    best = sums.where("word <> 0").select("word", rate.alias("r")).withColumn("m", F.array_max("r")).withColumn("all", F.aggregate("r", F.lit(0.0), lambda a, x: a + x))
    best = best.where(F.col("m") > PURITY * F.col("all")).select("word", (F.array_position("r", F.col("m")) - 1).cast("int").alias("s"), "m")
    top = best.orderBy(F.desc("m"), "word").limit(LEXICON).select("word", "s").toArrow()
    return Lexicon(top.column(0).to_numpy(), top.column(1).to_numpy())


def answers(b: pa.RecordBatch, lexicon: Lexicon, k: int) -> np.ndarray:
    """Per document and subject the answers of all functions but the source, as one number (digits by ``FUNCTIONS``)."""
    n = b.num_rows
    w, rows = _flat(b, "w")
    s = lexicon.of(w)
    sentences, sections = _led(w, s, rows, n, k)
    out = _level(sentences, COUNTS)
    out = out * FUNCTIONS["section"] + _level(sections, SECTIONS)
    for column in ("title", "address"):
        words, r = _flat(b, column)
        named = _table(r, lexicon.of(words), n, k) > 0
        out = out * 3 + np.where(named, 2, np.where(named.any(1, keepdims=True), 0, 1))
    return out


def _level(counts: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    return np.searchsorted(steps, counts, "right") * (len(SHARES) + 1) + np.searchsorted(SHARES, share, "right")


def _answer_batches(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                rows = list(answers(b, shared.value, k).astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "source", "answers"])

    return run


def learn_accuracies(patterns: dict[tuple[int, int, int], int], rounds: int = 25, shrink: float = 20.0, functions: dict[str, int] | None = None) -> dict[tuple[int, int], float]:
    """Posterior of each (subject, pattern) from counts of (subject, pattern, label).

    Two latent classes a subject, functions independent given the class.  *label* is 1
    (labelled with the subject), -1 (labelled with others) or 0; it holds the responsibility
    of labelled documents near 1 or 0 while the accuracies are fitted and does not enter the posterior.
    """
    sizes = list((functions or FUNCTIONS).values())
    keys = sorted({(s, c) for s, c, _ in patterns})
    at = {x: i for i, x in enumerate(keys)}
    weight = np.zeros((3, len(keys)))
    for (s, c, label), n in patterns.items():
        weight[label + 1, at[s, c]] += n
    given = weight[0].sum() + weight[2].sum()
    if given:  # few labels weigh as much as all other documents
        weight[[0, 2]] *= max(1.0, weight[1].sum() / given)
    subject = np.array([s for s, _ in keys])
    rest = np.array([c for _, c in keys])
    digits = np.zeros((len(keys), len(sizes)), int)
    for j in range(len(sizes) - 1, -1, -1):
        digits[:, j], rest = rest % sizes[j], rest // sizes[j]
    k = int(subject.max()) + 1
    post = np.full(len(keys), 0.5)
    for step in range(rounds):
        # the first step sees labelled documents only
        yes = weight[2] * 0.95 + weight[0] * 0.05 + (weight[1] * post if step else 0)
        no = weight[2] * 0.05 + weight[0] * 0.95 + (weight[1] * (1 - post) if step else 0)
        y, n = np.bincount(subject, yes, k) + 1, np.bincount(subject, no, k) + 1
        score = np.log(y / n)[subject]
        for j, size in enumerate(sizes):
            odds = []
            for mass in (yes, no):
                own = np.bincount(subject * size + digits[:, j], mass, k * size).reshape(k, size)
                pooled = own.sum(0) + 1
                own = own + shrink * pooled / pooled.sum()
                odds.append(own / own.sum(1, keepdims=True))
            score += np.log(odds[0] / odds[1])[subject, digits[:, j]]
        post = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return {x: float(p) for x, p in zip(keys, post)}


def subject_posteriors(documents: DataFrame, areas: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, subject, posterior)`` of every subject assigned to ``documents(doc_id, text, title, source, source_path, name)``."""
    spark = documents.sparkSession
    named = [r[0] for r in areas.select("subject").where("subject is not null").distinct().orderBy("subject").limit(101).collect()]
    if len(named) > 100:
        raise ValueError("more than 100 subjects")
    k = len(named)
    nothing = spark.createDataFrame([], documents.select("doc_id").schema.add("subject", "string").add("posterior", "double"))
    if not k:
        return nothing
    key = {s.strip().lower(): i for i, s in enumerate(named)}
    number = F.create_map(*[F.lit(x) for p in key.items() for x in p])[F.lower(F.trim("subject"))]
    labelled = labels.select("doc_id", number.alias("s")).where("s is not null and doc_id is not null").distinct().groupBy("doc_id").agg(F.sort_array(F.collect_set("s")).alias("subjects"))
    fit = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.where("text is not null and text <> ''").select(
        "doc_id", "text", "title", F.concat_ws(" ", "source_path", "name").alias("address"), F.lower(F.trim("source")).alias("source")
    )
    docs = materialise(docs.mapInArrow(_token_batches, f"doc_id {id_type}, source string, w array<long>, title array<long>, address array<long>"), "subject-tokens")
    counted = "word long, s int, n double"
    lexicon = _fitted(docs.join(F.broadcast(fit), "doc_id").select("w", "subjects").mapInArrow(_count_batches(k, None), counted), k, 2)
    for _ in range(ROUNDS):
        if len(lexicon.words):
            lexicon = _fitted(docs.select("w").mapInArrow(_count_batches(k, spark.sparkContext.broadcast(lexicon)), counted), k)
    if not len(lexicon.words):
        return nothing
    answered = docs.mapInArrow(_answer_batches(spark.sparkContext.broadcast(lexicon), k), f"doc_id {id_type}, source string, answers array<int>")
    answered = answered.join(_leanings(docs, labelled, k), "source", "left").join(labelled, "doc_id", "left")
    own = F.transform("answers", lambda a, i: F.struct(i.alias("s"), (a * 3 + F.coalesce(F.get("leanings", i), F.lit(1))).cast("int").alias("pattern"), _label(i).alias("label")))
    flat = materialise(answered.select("doc_id", F.explode(own).alias("x")).select("doc_id", "x.s", "x.pattern", "x.label"), "subject-answers")
    # at most 3 x 16,875 patterns a subject exist, some hundreds occur
    patterns = {(r[0], r[1], r[2]): r[3] for r in flat.groupBy("s", "pattern", "label").count().collect()}
    sure = [(s, c, p) for (s, c), p in learn_accuracies(patterns).items() if p >= 0.5] or [(-1, -1, 1.0)]
    sure = spark.createDataFrame(sure, "s int, pattern int, posterior double")
    return flat.join(F.broadcast(sure), ["s", "pattern"]).groupBy("doc_id", "s").agg(F.max("posterior").alias("posterior")).select(
        "doc_id", F.element_at(F.array(*[F.lit(x) for x in named]), F.col("s") + 1).alias("subject"), F.round("posterior", 6).alias("posterior")
    )


def _label(i: Column) -> Column:
    return F.when(F.col("subjects").isNull(), 0).when(F.array_contains("subjects", i), 1).otherwise(-1)


def _leanings(docs: DataFrame, labelled: DataFrame, k: int) -> DataFrame:
    """``(source, leanings)``: per subject 2 if the source's labelled documents have it twice as often as all, 0 if half as often, else 1."""
    rows = docs.select("doc_id", "source").where("source is not null").join(labelled, "doc_id").select("source", F.explode("subjects").alias("s"))
    counts = [F.sum((F.col("s") == i).cast("long")).alias(f"c{i}") for i in range(k)]
    every = rows.agg(*[c.alias(f"a{i}") for i, c in enumerate(counts)], F.count(F.lit(1)).alias("all"))
    by = rows.groupBy("source").agg(*counts, F.count(F.lit(1)).alias("n")).where("n >= 10").join(F.broadcast(every))
    lift = [F.col(f"c{i}") / F.col("n") * F.col("all") / F.greatest(F.col(f"a{i}"), F.lit(1)) for i in range(k)]
    return by.select("source", F.array(*[F.when(x >= 2, 2).when(x <= 0.5, 0).otherwise(1) for x in lift]).alias("leanings"))


def composition(documents: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(subject, documents, share)`` over all documents; documents without a subject count under ``(none)``."""
    every = documents.select("doc_id").distinct().join(assigned.select("doc_id", "subject").distinct(), "doc_id", "left")
    counted = every.groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count(F.lit(1)).alias("documents"))
    total = documents.select(F.count_distinct("doc_id").alias("total"))
    return counted.join(F.broadcast(total)).select("subject", "documents", F.round(F.col("documents") / F.col("total"), 6).alias("share"))
