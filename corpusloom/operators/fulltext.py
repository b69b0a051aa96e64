"""Full-text search with a query language, ranked by BM25.

Terms are runs of letters and digits, lower-cased, without Latin diacritics,
reduced by Porter's stemmer.  A query is words, ``"phrases"`` (``a + b`` is one too), prefixes
(``pay*``), ``^first`` words of a column, ``NEAR(a b, 10)``, column filters (``title : x``,
``{a b} : x``, ``- a : x``), ``AND``, ``OR``, ``NOT`` and parentheses.  Words side
by side must all occur and bind tighter than the operators; ``NOT`` binds tighter than ``AND``, ``AND`` than ``OR``.

One pass over the rows evaluates any number of queries and yields only matches and
the statistics, so nothing but matches is shuffled.  :class:`Index` stores postings
by term bucket for repeated queries; a query then reads the buckets of its terms.

Defined results: null columns have no terms but their rows count; a null id
never matches; repeated ids are separate rows; a query without terms matches nothing; bad syntax raises
:class:`QuerySyntaxError` (or quotes every word in *safe* mode).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.tables import materialise

K1, B, BUCKETS = 1.2, 0.75, 256
_RUN = re.compile(r"[^\W_]+")
_VOWELS = "aeiou"


class QuerySyntaxError(ValueError):
    """The query string is not of the language."""


# ---------------------------------------------------------------- terms


def _consonants(w: str) -> str:
    """*w* as a string of c and v (y is a vowel after a consonant)."""
    out = ""
    for i, ch in enumerate(w):
        out += "v" if ch in _VOWELS or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _consonants(w)))


def _star_o(w: str) -> bool:
    return _consonants(w)[-3:] == "cvc" and w[-1] not in "wxy"


#: Suffixes of the steps of the stemmer and what they become (fixed values).
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e",
    "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, suffixes) -> str | None:
    return max((s for s in suffixes if w.endswith(s)), key=len, default=None)


def porter(w: str) -> str:
    """Stem of a lower-case word; words under 3 or over 64 bytes stay."""
    if not 3 <= len(w.encode()) <= 64:
        return w
    if len(w) > 4 and w.endswith("sses") or len(w) > 3 and w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        end = "ed" if w.endswith("ed") else "ing" if w.endswith("ing") else None
        if end and "v" in _consonants(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _consonants(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _star_o(w):
                w += "e"
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _star_o(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


class _Terms(dict):
    """Word -> term, kept while they are few."""

    def __missing__(self, w: str) -> str:
        if len(self) > 300_000:
            self.clear()
        plain = "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))
        t = self[w] = porter(plain)
        return t


_TERMS = _Terms()


def terms(text: str | None) -> list[str]:
    """Terms of a text in order."""
    return [_TERMS[w] for w in _RUN.findall(text)] if text else []


# ---------------------------------------------------------------- query language


@dataclass(frozen=True)
class Phrase:
    """Successive terms; the last one may be a prefix, the first one may have to open its column."""

    terms: tuple[str, ...]
    prefix: bool = False
    first: bool = False
    columns: frozenset[int] | None = None


@dataclass(frozen=True)
class Near:
    """One phrase, or several within *distance* terms of each other."""

    phrases: tuple[Phrase, ...]
    distance: int = 10


@dataclass(frozen=True)
class Both:
    """``and``, ``or`` or ``not`` of two expressions."""

    op: str
    left: object
    right: object


_LEX = re.compile(r'\s*(?:"((?:[^"]|"")*)"|([\w\x80-\U0010ffff]+)|([(){}:+*^,-]))')


class _Parser:
    def __init__(self, query: str, columns: list[str]) -> None:
        self.columns = [c.lower() for c in columns]
        self.items: list[tuple[str, str]] = []
        at = 0
        while query[at:].strip():
            m = _LEX.match(query, at)
            if not m:
                raise QuerySyntaxError(f"unexpected sign in {query!r} at {at}")
            kind = "string" if m.group(1) is not None else "word" if m.group(2) is not None else "sign"
            self.items.append((kind, m.group(m.lastindex).replace('""', '"') if kind == "string" else m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self, *signs: str, ahead: int = 0) -> bool:
        return self.at + ahead < len(self.items) and self.items[self.at + ahead][1] in signs and self.items[self.at + ahead][0] != "string"

    def take(self, sign: str) -> None:
        if not self.peek(sign):
            raise QuerySyntaxError(f"expected {sign!r}")
        self.at += 1

    def parse(self):
        out = self.binary(("OR", "AND", "NOT"))
        if self.at < len(self.items):
            raise QuerySyntaxError(f"unexpected {self.items[self.at][1]!r}")
        return out

    def binary(self, ops: tuple[str, ...]):
        if not ops:
            return self.implicit()
        left = self.binary(ops[1:])
        while self.peek(ops[0]):
            self.at += 1
            left = Both(ops[0].lower(), left, self.binary(ops[1:]))
        return left

    def implicit(self):
        columns = self.column_filter()
        if self.peek("("):
            self.at += 1
            out = self.binary(("OR", "AND", "NOT"))
            self.take(")")
            return _limited(out, columns)
        out = self.near(columns)
        while self.at < len(self.items) and not self.peek("OR", "AND", "NOT", ")", "("):
            more = self.near(self.column_filter())
            if not any(p.terms for p in more.phrases):
                continue
            out = Both("and", out, more) if not isinstance(out, Near) or any(p.terms for p in out.phrases) else more
        return out

    def column_filter(self) -> frozenset[int] | None:
        start, negative, names = self.at, False, []
        if self.peek("-"):
            negative = True
            self.at += 1
        if self.peek("{"):
            self.at += 1
            while not self.peek("}"):
                names.append(self.name())
            self.at += 1
        elif self.at < len(self.items) and self.items[self.at][0] != "sign":
            names.append(self.name())
        if not self.peek(":"):
            if negative:
                raise QuerySyntaxError("a column filter is incomplete")
            self.at = start
            return None
        self.at += 1
        for n in names:
            if n.lower() not in self.columns:
                raise QuerySyntaxError(f"no such column: {n}")
        found = {self.columns.index(n.lower()) for n in names}
        return frozenset(set(range(len(self.columns))) - found if negative else found)

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] == "sign":
            raise QuerySyntaxError("a column name is missing")
        self.at += 1
        return self.items[self.at - 1][1]

    def near(self, columns: frozenset[int] | None) -> Near:
        if self.peek("NEAR") and self.peek("(", ahead=1):
            self.at += 2
            phrases, distance = [], 10
            while not self.peek(")", ","):
                phrases.append(self.phrase(columns))
            if self.peek(","):
                self.at += 1
                number = self.items[self.at][1] if self.at < len(self.items) else ""
                if not number.isdigit():
                    raise QuerySyntaxError("NEAR needs a number")
                self.at, distance = self.at + 1, int(number)
            self.take(")")
            return Near(tuple(p for p in phrases if p.terms) or (Phrase(()),), distance)
        return Near((self.phrase(columns),))

    def phrase(self, columns: frozenset[int] | None) -> Phrase:
        first = self.peek("^")
        self.at += first
        found: list[str] = []
        while True:
            if self.at >= len(self.items) or self.items[self.at][0] == "sign" or self.peek("AND", "OR", "NOT"):
                raise QuerySyntaxError("a word is missing")
            found += terms(self.items[self.at][1])
            self.at += 1
            prefix = self.peek("*")
            self.at += prefix
            if prefix or not self.peek("+"):
                return Phrase(tuple(found), prefix, first, columns)
            self.at += 1


def _limited(node, columns: frozenset[int] | None):
    if columns is None:
        return node
    if isinstance(node, Both):
        return Both(node.op, _limited(node.left, columns), _limited(node.right, columns))
    return Near(tuple(replace(p, columns=columns if p.columns is None else p.columns & columns) for p in node.phrases), node.distance)


def parse(query: str, columns: list[str], safe: bool = False):
    """The expression of a query string; *safe* quotes every word of a string that is not of the language."""
    try:
        if not query.strip():
            raise QuerySyntaxError("the query is empty")
        return _Parser(query, columns).parse()
    except QuerySyntaxError:
        if not safe:
            raise
        return _Parser(" ".join(f'"{w}"' for w in _RUN.findall(query)) or '""', columns).parse()


def phrases(node) -> list[Phrase]:
    """All phrases of an expression, in order."""
    return phrases(node.left) + phrases(node.right) if isinstance(node, Both) else list(node.phrases)


# ---------------------------------------------------------------- evaluation of one row


Places = dict[str, list[tuple[int, int]]]


def _occurrences(p: Phrase, places: Places) -> list[tuple[int, int]]:
    """Starts (column, position) of a phrase."""
    if not p.terms:
        return []

    def of(i: int) -> set[tuple[int, int]]:
        if p.prefix and i == len(p.terms) - 1:
            return {x for t, v in places.items() if t.startswith(p.terms[i]) for x in v}
        return set(places.get(p.terms[i], ()))

    starts = of(0)
    for i in range(1, len(p.terms)):
        ahead = of(i)
        starts = {(c, x) for c, x in starts if (c, x + i) in ahead}
    return sorted((c, x) for c, x in starts if (p.columns is None or c in p.columns) and not (p.first and x))


def _close(found: list[list[tuple[int, int]]], sizes: list[int], distance: int) -> list[list[tuple[int, int]]]:
    """Of each phrase the occurrences that take part in a clump."""
    out: list[set] = [set() for _ in found]
    for c in {c for c, _ in found[0]}:
        every = sorted((x, i) for i, f in enumerate(found) for d, x in f if d == c)
        for a in range(len(every)):  # clumps by their first phrase
            x0, i0 = every[a]
            inside = [e for e in every[a:] if e[0] <= x0 + sizes[i0] + distance]
            if {i for _, i in inside} == set(range(len(found))):
                for x, i in inside:
                    out[i].add((c, x))
    return [sorted(s) for s in out]


def evaluate(node, places: Places) -> tuple[bool, list[int], list[bool]]:
    """Whether a row matches, how often each phrase counts in it, and whether each phrase occurs at all."""
    if isinstance(node, Both):
        a, fa, oa = evaluate(node.left, places)
        b, fb, ob = evaluate(node.right, places)
        ok = a and b if node.op == "and" else a or b if node.op == "or" else a and not b
        return ok, (fa if a else [0] * len(fa)) + (fb if b else [0] * len(fb)), oa + ob
    found = [_occurrences(p, places) for p in node.phrases]
    there = [bool(f) for f in found]
    if len(found) > 1:
        found = _close(found, [len(p.terms) for p in node.phrases], node.distance) if all(there) else [[] for _ in found]
    return all(found), [len(f) for f in found], there


# ---------------------------------------------------------------- search


@dataclass
class Query:
    """A numbered query of a search."""

    qid: int
    node: object
    words: frozenset[str] = field(init=False)
    starts: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        own = phrases(self.node)
        self.words = frozenset(t for p in own for t in (p.terms[:-1] if p.prefix else p.terms))
        self.starts = tuple({p.terms[-1] for p in own if p.prefix and p.terms})


_HIT = "qid int, id {id}, matched boolean, f array<int>, there array<boolean>, len long, n long"


def _hits(queries: list[Query], ident, rows: Iterator[tuple[object, int, Places]], n: int) -> pa.RecordBatch:
    out: list[tuple] = []
    total = 0
    for i, size, places in rows:
        total += size
        if places and i is not None:
            for q in queries:
                ok, f, there = evaluate(q.node, places)
                if any(there):
                    out.append((q.qid, i, ok, f, there, size, None))
    if n:
        out.append((None, None, None, None, None, total, n))
    types = (pa.int32(), ident, pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.int64(), pa.int64())
    cols = list(zip(*out)) if out else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["qid", "id", "matched", "f", "there", "len", "n"])


def _scan_batches(queries: list[Query], columns: list[str]):
    wanted = frozenset().union(*[q.words for q in queries])
    starts = tuple({s for q in queries for s in q.starts})

    def one(values: tuple) -> tuple[int, Places]:
        places: Places = {}
        size = 0
        for c, text in enumerate(values):
            own = terms(text)
            size += len(own)
            for x, t in enumerate(own):
                if t in wanted or starts and t.startswith(starts):
                    places.setdefault(t, []).append((c, x))
        return size, places

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("_id").to_pylist(), zip(*(b.column(f"_c{i}").to_pylist() for i in range(len(columns)))))
            yield _hits(queries, b.schema.field("_id").type, ((i, *one(v)) for i, v in rows), b.num_rows)

    return run


def _ranked(hits: DataFrame, limit: int) -> DataFrame:
    """Scores and ranks of hits and statistics."""
    stats = hits.where("qid is null").agg(F.sum("n").alias("rows"), (F.sum("len") / F.sum("n")).alias("avg"))
    own = hits.where("qid is not null")
    df = own.select("qid", F.posexplode("there").alias("p", "t")).groupBy("qid", "p").agg(F.sum(F.col("t").cast("long")).alias("df"))
    df = df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "df"))), lambda x: x["df"]).alias("df"))
    # one row a query, and one row
    rows = own.where("matched").join(F.broadcast(df), "qid").join(F.broadcast(stats))
    idf = F.transform("df", lambda n: F.greatest(F.log((F.col("rows") - n + 0.5) / (n + 0.5)), F.lit(1e-6)))
    norm = K1 * (1 - B + B * F.col("len") / F.col("avg"))
    parts = F.zip_with("f", idf, lambda f, i: F.when(f > 0, i * f * (K1 + 1) / (f + norm)).otherwise(0.0))
    scored = rows.select("qid", "id", F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 9).alias("score"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= limit)


def search(rows: DataFrame, ident: str, columns: list[str], queries: list[str], limit: int = 50, safe: bool = False, skip_bad: bool = False) -> DataFrame:
    """``(qid, id, score, rank)``: the best *limit* rows of every query string (qid: its place in the list).

    *skip_bad* leaves out queries that are not of the language.
    """
    wanted = []
    for i, q in enumerate(queries):
        try:
            wanted.append(Query(i, parse(q, columns, safe)))
        except QuerySyntaxError:
            if not skip_bad:
                raise
    kind = rows.schema[ident].dataType.simpleString()
    if not wanted:
        return rows.sparkSession.createDataFrame([], f"qid int, id {kind}, score double, rank int")
    source = rows.select(F.col(ident).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    return _ranked(materialise(source.mapInArrow(_scan_batches(wanted, columns), _HIT.format(id=kind)), "search-hits"), limit)


# ---------------------------------------------------------------- stored index


def _posting_batches(columns: list[str]):
    """``(term, id, col, places, len)``: one row a term, row and column, and one without a term for the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, *values in zip(b.column("_id").to_pylist(), *(b.column(f"_c{j}").to_pylist() for j in range(len(columns)))):
                size = 0
                for c, text in enumerate(values):
                    places: dict[str, list[int]] = {}
                    for x, t in enumerate(terms(text)):
                        places.setdefault(t, []).append(x)
                        size += 1
                    out += [(t, i, c, v, None) for t, v in places.items()]
                out.append((None, i, None, None, size))
            types = (pa.string(), b.schema.field("_id").type, pa.int32(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, types)], names=["term", "id", "col", "places", "len"])

    return run


class Index:
    """Postings of a table in a folder, partitioned by term bucket.

    Each load is a generation of its own folder, so a retried load overwrites
    itself; :meth:`remove` records ids whose postings no longer count.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], id_type: str = "string") -> None:
        self.spark, self.path, self.columns, self.id_type = spark, path.rstrip("/"), columns, id_type

    def add(self, rows: DataFrame, ident: str, generation: int) -> None:
        """Index *rows*; ids indexed before must be removed first."""
        source = rows.select(F.col(ident).cast(self.id_type).alias("_id"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(self.columns)])
        made = source.mapInArrow(_posting_batches(self.columns), f"term string, id {self.id_type}, col int, places array<int>, len long")
        made = made.withColumn("bucket", F.coalesce(F.pmod(F.crc32("term"), F.lit(BUCKETS)).cast("int"), F.lit(-1)))
        # the buckets of frequent terms spread over tasks by id
        spread = made.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        spread.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/generation={generation}")

    def remove(self, ids: DataFrame, generation: int) -> None:
        """Forget ``ids(id)`` of generations before *generation*."""
        ids.select(F.col("id").cast(self.id_type).alias("id")).distinct().write.mode("overwrite").parquet(f"{self.path}/removed/generation={generation}")

    def _read(self, buckets: list[int]) -> DataFrame:
        schema = f"term string, id {self.id_type}, col int, places array<int>, len long, generation int, bucket int"
        rows = self.spark.read.option("basePath", f"{self.path}/postings").schema(schema).parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets))
        removed = f"{self.path}/removed"
        fs = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(removed)
        if not fs.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
            return rows
        gone = self.spark.read.option("basePath", removed).schema(f"id {self.id_type}, generation int").parquet(removed).groupBy("id").agg(F.max("generation").alias("until"))
        return rows.join(gone, "id", "left").where("until is null or generation >= until").drop("until")

    def search(self, queries: list[str], limit: int = 50, safe: bool = False) -> DataFrame:
        """As :func:`search`, from the postings of the queried terms."""
        import zlib

        wanted = [Query(i, parse(q, self.columns, safe)) for i, q in enumerate(queries)]
        words, starts = frozenset().union(*[q.words for q in wanted]), tuple({s for q in wanted for s in q.starts})
        buckets = list(range(BUCKETS)) if starts else sorted({zlib.crc32(w.encode()) % BUCKETS for w in words})
        hit = F.col("term").isin(*words) if words else F.lit(False)
        for s in starts:
            hit = hit | F.col("term").startswith(s)
        lens = self._read([-1]).select("id", "len")
        found = self._read(buckets).where(hit).groupBy("id").agg(F.collect_list(F.struct("term", "col", "places")).alias("hits"))  # the hits of one row
        matched = found.join(lens, "id").select("id", "len", "hits").mapInArrow(_index_batches(wanted), _HIT.format(id=self.id_type))
        stats = lens.agg(F.sum("len").alias("len"), F.count(F.lit(1)).alias("n"))
        hits = matched.unionByName(stats, allowMissingColumns=True)
        return _ranked(materialise(hits, "search-hits"), limit)


def _index_batches(queries: list[Query]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch):
            for i, size, hits in zip(*(b.column(c).to_pylist() for c in ("id", "len", "hits"))):
                places: Places = {}
                for h in hits:
                    places.setdefault(h["term"], []).extend((h["col"], x) for x in h["places"])
                yield i, size, places

        for b in batches:
            yield _hits(queries, b.schema.field("id").type, rows(b), 0)

    return run
