"""Noise in text from scanned pages: found line by line and repaired.

1. *Statistics* over all documents in one pass: words, the two halves of words at line ends, and
   the masked forms of short lines with the places they stand in.
2. *Skip-gram vectors*: (word, context) pairs are counted over all documents, and the
   vectors of the ``VECTORS`` most frequent words are trained with negative sampling by
   rounds of the full gradient over these counts.  Every other word gets
   a vector by a linear map of its mean context, fitted on the frequent words.
3. *Links*: a rare word is linked to a frequent one (``RATIO`` times its count) by
   undoing one to three plausible glyph edits (``rn`` for m, ``1`` for l, ...), found by a join of
   both sides' edits, if the frequent word is among its nearest: closer than
   ``NEAR`` of a sample of the vocabulary.
4. *Correction in context*: at each occurrence the linked word that fits the surrounding words
   best replaces it, if it fits them better than most words would.
5. *Furniture* (running headers, page numbers) is recognised by place and repetition:
   lines that interrupt a sentence, stand beside a page number, repeat in the document or its title, and
   lines of a masked form that mostly stands in such places in all documents.
6. Furniture is removed, cut words are joined, misread words corrected and
   lines reflowed into paragraphs.  Headings, tables, lists and code keep their lines.

What is learned about words, cuts and forms is a table of *facts*.  Up to
``FACTS`` of them are broadcast; beyond that each document gets the facts of its own
words by a join.  Both ways give the same result.

Defined results: null and empty texts give no noise and are repaired to
themselves; carriage returns count as white space; a repeated ``doc_id`` gives
the lines of each of its texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.sources.tables import materialise

DIM, VECTORS, WINDOW, NEGATIVE = 24, 20_000, 3, 4
#: Rounds and step of the training, and noise words drawn for a round.
ROUNDS, RATE, DRAWN = 20, 0.1, 1024
MIN_COUNT, RATIO, NEAR = 8, 20, 0.5
FACTS = 200_000

#: What a scanner reads (left) for what was printed (right): fixed values.
GLYPHS = (
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("9", "g"), ("6", "b"), ("|", "l"), ("!", "l"), ("ﬁ", "fi"),
    ("rn", "m"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("c", "e"), ("e", "c"), ("li", "h"), ("h", "b"), ("b", "h"), ("nn", "m"), ("tl", "d"),
)
_CONJUNCTIONS = frozenset("and or und oder y o et ou u e bis to nor".split())
_TOKEN = re.compile(r"[^\s.,;:?()\[\]{}\"“”„«»/—–-]+")
_CODE = re.compile(r"^[A-Z]{1,4}\d*$|\d{2,}|_")
_MARK = re.compile(r"(\w+)([-‐‑¬­])[ \t\r]*$")
_TAIL = re.compile(r"(?:^|[\s(\"'-])([^\W\d_]{2,})[ \t\r]*$")
_HEAD = re.compile(r"^[ \t]*([^\W_][\w'’]*)")
_PAGE = re.compile(
    r"(?:page|pg|seite|página|pagina|p|s)\.? ?\d+(?: ?(?:of|von|de|sur|/) ?\d+)?|[—–-] ?\d+ ?[—–-]|\[\d+\]|\d{1,4} ?/ ?\d{1,4}|\d{1,4}|[ivxl]{1,6}", re.I
)
_PAGE_AT = re.compile(rf"(?:^(?P<a>{_PAGE.pattern})\s{{2,}}|\s{{2,}}(?P<b>{_PAGE.pattern})$)", re.I)
_STRUCTURE = re.compile(r"^\s{0,3}(?:#{1,6}\s|\||>|```|[-*+] |\d+[.)] )")
_HEADING = re.compile(r"\s{0,3}(#{1,6}\s|\|)")
_RUN = re.compile(r"[^\W_]+")


def _end(line: str) -> re.Match | None:
    """The last word of a line (of at most 200 characters), with a mark (``_MARK``) or without (``_TAIL``)."""
    s = line.rstrip(" \t\r")
    if not s:
        return None
    return (_MARK if s[-1] in "-‐‑¬\xad" else _TAIL).search(s, max(0, len(s) - 200))


def _marked(line: str) -> re.Match | None:
    m = _end(line)
    return m if m is not None and m.re is _MARK else None


def _plain(line: str) -> str:
    s = re.sub(r"\s+", " ", line.strip())
    parts = line.split()
    if len(parts) >= 4 and all(len(p) == 1 for p in parts):  # letter-spaced
        s = re.sub(r"\s+", " ", re.sub(r"(?<=\S) (?=\S)", "", re.sub(r"\s{2,}", "\x00", line.strip())).replace("\x00", " "))
    return s.lower()


def _fold(s: str) -> str:
    """*s* in lower case with every glyph replaced by what it may have been, so that misread copies agree."""
    s = _plain(s)
    for read, true in _FOLDS:
        s = s.replace(read, true)
    return re.sub(r"\W+", "", s)


#: One representative for glyphs that are confused with each other, in order of replacement (fixed values).
_FOLDS = (("ﬁ", "fi"), ("rn", "m"), ("nn", "m"), ("cl", "d"), ("tl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("li", "h"), ("1", "i"), ("l", "i"), ("|", "i"), ("!", "i"), ("0", "o"), ("5", "s"), ("8", "b"), ("6", "b"), ("9", "g"), ("e", "c"), ("h", "b"))


def masked(line: str) -> str:
    """The form of a line: words and numbers are masked, signs stay."""
    return " ".join(_RUN.sub(_mask, line).split())


def _mask(m: re.Match) -> str:
    run = m.group()
    if run.isdigit():
        return "#"
    word = "w" if run[0].islower() or run[0].isdigit() else "W"
    return word + "#" if run[1:].isdigit() else word  # a digit within a word is taken for a misread letter


def short_lines(lines: list[str], title: str | None) -> tuple[set[int], list[tuple[int, str, bool, bool]]]:
    """Page numbers (line indexes), and ``(index, form, evident, placed)`` of the short lines that may be running headers.

    *evident*: title or repetition in such a place settles it; *placed*: it
    interrupts a sentence, stands beside a page number or holds one.
    """
    numbers: set[int] = set()
    rest: dict[int, tuple[str, bool]] = {}
    code = False
    for i, raw in enumerate(lines):
        s = raw.strip()
        if s.startswith("```"):
            code = not code
        if not s or code or len(s) > 110 or _STRUCTURE.match(raw) and not _PAGE.fullmatch(s):
            continue
        if _PAGE.fullmatch(s):
            numbers.add(i)
            continue
        paged = _PAGE_AT.search(s)
        own = (s[: paged.start()] + s[paged.end() :]).strip() if paged else s
        if own and own[-1] not in ".;,!?:":
            rest[i] = own, bool(paged)
    numbers = {i for i in numbers if not any(_next(lines, i, d) in numbers for d in (-1, 1))}  # a column of numbers is content
    width = sorted(len(x.rstrip()) for x in lines if x.strip())
    width = width[len(width) * 3 // 4] if width else 0
    wanted = _fold(title or "")
    folds = {i: re.sub(r"\d+", "#", _fold(own)) for i, (own, _) in rest.items()}
    times = Counter(folds.values())
    out = []
    for i, (own, paged) in rest.items():
        f = folds[i]
        spaced = len(own.split()) >= 4 and all(len(w) == 1 for w in own.split())
        titled = len(wanted) >= 4 and (f == wanted or len(f) >= 8 and wanted.startswith(f) or f.startswith(wanted) and len(f) < len(wanted) + 25)
        if not (titled or spaced or paged) and len(own) > 0.7 * width:
            continue
        beside = _next(lines, i, -1) in numbers or _next(lines, i, 1) in numbers
        placed = titled or paged or beside or not own[0].islower() and _breaks(lines, i)
        out.append((i, masked(own), titled or spaced or placed and times[f] >= 2 and ":" not in own, placed))
    return numbers, out


def furniture(lines: list[str], title: str | None, facts: dict[str, list] | None = None) -> set[int]:
    """Indexes of lines that are a running header, a page number or both."""
    found, short = short_lines(lines, title)
    for i, form, evident, placed in short:
        known = facts.get("\x01" + form) if facts else None
        if evident or known and (placed or known[0][0] == "furniture"):
            found.add(i)
    return found


def _next(lines: list[str], i: int, d: int) -> int:
    i += d
    while 0 <= i < len(lines) and not lines[i].strip():
        i += d
    return i


def _breaks(lines: list[str], i: int) -> bool:
    a, b = _next(lines, i, -1), _next(lines, i, 1)
    return 0 <= a and b < len(lines) and lines[a].rstrip()[-1:] not in ".:!?" and not _STRUCTURE.match(lines[a]) and lines[b].lstrip()[:1].islower()


@dataclass
class Model:
    """Frequent words, their context vectors, and mean and covariance of their word vectors."""

    words: dict[str, int]
    contexts: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def fit(self, around: list[str], vector: np.ndarray) -> float | None:
        """How much better than an average word a vector fits the words around (in standard deviations), None without known words."""
        ids = [self.words[x] for x in around if x in self.words]
        if not ids:
            return None
        c = self.contexts[ids].mean(0)
        width = float(c @ self.spread @ c)
        return float(c @ (vector - self.mean)) / width**0.5 if width > 0 else None


def linkable(token: str) -> str | None:
    """The word of a token that may be a misreading."""
    w = token.lower().strip("'’*`")
    if len(w) < 3 or _CODE.search(token) or not any(c.isalpha() for c in w) or ord(w[0]) > 0x2E80:
        return None
    return w


class Reader:
    """Model and facts; inspects and repairs one text at a time."""

    def __init__(self, model: Model, facts: dict[str, list[tuple[str, bytes | None]]]) -> None:
        self.model, self.facts = model, facts

    def correct(self, token: str, around: list[str]) -> str | None:
        """What *token* was before it was misread, or None."""
        options = self.facts.get(token.lower().strip("'’*`"))
        if not options or linkable(token) is None:
            return None
        best = None
        for f, vector in options:
            fit = self.model.fit(around, np.frombuffer(vector, np.float32))
            if fit is not None and fit > 0 and (best is None or fit > best[0]):
                best = fit, f
        return best and best[1]

    def _says(self, a: str, b: str, what: str) -> bool:
        return any(f == what for f, _ in self.facts.get(f"{a}\x00{b}", ()))

    def inspect(self, text: str, title: str | None) -> tuple[list[tuple[int, str]], dict[int, list[tuple[str, str]]], dict[int, int]]:
        """``(line index, kind)`` of the noise, the corrections by line, and for each cut line the line that goes on."""
        lines = text.split("\n")
        gone = furniture(lines, title, self.facts)
        noise = [(i, "furniture") for i in sorted(gone)]
        fixes: dict[int, list[tuple[str, str]]] = {}
        cuts: dict[int, int] = {}
        code = False
        running = []
        begun: set[int] = set()
        for i, raw in enumerate(lines):
            if raw.strip().startswith("```"):
                code = not code
                continue
            if i not in gone and raw.strip() and not code and not re.match(r"\s{0,3}(#{1,6}\s|\|)", raw):
                running.append(i)
        after = dict(zip(running, running[1:]))
        headings = {i for i, x in enumerate(lines) if re.match(r"\s{0,3}(#{1,6}\s|\||```)", x)}
        for i in running:
            j = after.get(i)
            if j is not None and not any(k in headings for k in range(i + 1, j)):
                between = [k for k in range(i + 1, j)]
                if (not between or any(k in gone for k in between) or _marked(lines[i])) and self._cut(lines[i], lines[j]):
                    cuts[i] = j
                    begun.add(j)
                    noise.append((i, "hyphen"))
            tokens = _TOKEN.findall(lines[i])
            low = [t.lower() for t in tokens]
            last = len(tokens) - 1
            for k, t in enumerate(tokens):
                if low[k].strip("'’*`") not in self.facts or k == last and i in cuts or k == 0 and i in begun:
                    continue
                right = self.correct(t, low[max(0, k - 3) : k] + low[k + 1 : k + 4])
                if right:
                    fixes.setdefault(i, []).append((t, right))
            if i in cuts:
                m = _end(lines[i])
                h = _HEAD.match(lines[cuts[i]])
                for part in (m, h):
                    word = part.group(1) if part else ""
                    if any(c.isdigit() for c in word) and any(c.isalpha() for c in word) and not _CODE.search(word):
                        fixes.setdefault(i if part is m else cuts[i], [])
        noise += [(i, "misread") for i in fixes]
        return noise, fixes, cuts

    def _cut(self, line: str, following: str) -> bool:
        h = _HEAD.match(following)
        if not h:
            return False
        b = h.group(1)
        m = _end(line)
        if m and m.re is _MARK:
            if m.group(2) != "-":
                return True
            return b.lower() not in _CONJUNCTIONS and (b[0].islower() or b[0].isdigit() and any(c.isalpha() for c in b)) and any(c.isalpha() for c in m.group(1))
        if not m or not b[0].islower() or not b.isalpha():
            return False
        return self._says(m.group(1).lower(), b, "cut")

    def repair(self, text: str, title: str | None) -> str:
        """Continuous paragraphs without the noise."""
        noise, fixes, cuts = self.inspect(text, title)
        gone = {i for i, k in noise if k == "furniture"}
        lines = [x.rstrip("\r") for x in text.split("\n")]
        for i, pairs in fixes.items():
            for wrong, right in pairs:
                cased = right.upper() if wrong.isupper() and len(wrong) > 1 else right.capitalize() if wrong[:1].isupper() else right
                lines[i] = re.sub(rf"(?<!\w){re.escape(wrong)}(?!\w)", cased, lines[i], count=1)
        out: list[str] = []
        open_line = joined = code = broken = False
        for i, line in enumerate(lines):
            if i in gone:
                broken = True
                continue
            s = line.strip()
            if s.startswith("```"):
                code = not code
            if not s:
                if not (broken or i + 1 in gone or joined):
                    open_line = False
                    if out and out[-1] != "":
                        out.append("")
                continue
            broken = False
            keep = code or s.startswith("```") or bool(_STRUCTURE.match(line))
            if i in cuts:
                m = _marked(line)
                own = m is not None and m.group(2) == "-" and self._compound(line, lines[cuts[i]])
                s = (line[: m.end(1)] + ("-" if own else "") if m else line).strip()
            if open_line and not keep:
                out[-1] += s if joined else " " + s
            else:
                out.append(line if keep else s)
            open_line, joined = not (code or s.startswith(("#", "|", "```"))), i in cuts
        return "\n".join(out).strip("\n") if out else text

    def _compound(self, line: str, following: str) -> bool:
        a = (_marked(line) or [None, ""])[1].lower()
        b = (_HEAD.match(following) or [None, ""])[1].lower()
        return self._says(a + "-", b, "compound")


def _places(w: str, part: str) -> Iterator[int]:
    i = w.find(part)
    while i >= 0:
        yield i
        i = w.find(part, i + 1)


def line_ends(lines: list[str]) -> Iterator[tuple[str, str]]:
    """The last word of each line with the first one of the next lines of text (two lines of furniture may lie between)."""
    for i, line in enumerate(lines):
        m = _end(line)
        if m is None or _HEADING.match(line):
            continue
        j = i
        for _ in range(3):
            j = _next(lines, j, 1)
            if j >= len(lines):
                break
            h = _HEAD.match(lines[j])
            if h and (h.group(1)[0].islower() or m.re is _MARK):
                yield m.group(1).lower() + ("-" if m.re is _MARK else ""), h.group(1).lower()


def _statistics_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, n)``: words, line ends (two halves), forms (``\\x01``) and forms in a place of furniture (``\\x02``)."""
    counts: Counter = Counter()
    for b in batches:
        for t, title in zip(b.column("text").to_pylist(), b.column("title").to_pylist()):
            counts.update(_TOKEN.findall(t.lower()))
            lines = t.split("\n")
            counts.update(f"{x}\x00{y}" for x, y in line_ends(lines))
            for _, form, evident, placed in short_lines(lines, title)[1]:
                counts["\x01" + form] += 1
                if placed:
                    counts["\x02" + form] += 1
        if len(counts) > 200_000:
            yield _counted(counts)
            counts = Counter()
    yield _counted(counts)


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["key", "n"])


def undone(word: str) -> set[str]:
    """*word* with one glyph edit undone."""
    return {word[:i] + true + word[i + len(read) :] for read, true in GLYPHS for i in _places(word, read)}


def misread(word: str) -> set[str]:
    """*word* with one glyph misread."""
    return {word[:i] + read + word[i + len(true) :] for read, true in GLYPHS for i in _places(word, true)}


def _edit_batches(rare: bool):
    """``(form, word, n, edits)``: what a rare word may have been, or how a frequent one may be misread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
                if rare:
                    if linkable(w) is None:
                        continue
                    first = undone(w)
                    rows += [(f, w, n, 1) for f in first]
                    if any(c.isdigit() or c in "|!ﬁ" for c in w):  # no word has these: one edit more
                        rows += [(f, w, n, 2) for f in {y for x in first for y in undone(x)} - first]
                else:
                    rows += [(w, w, n, 0), *((f, w, n, 1) for f in misread(w))]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int32()))], names=["form", "word", "n", "edits"])

    return run


def candidate_links(words: DataFrame) -> DataFrame:
    """``(word, was)``: glyph neighbours of ``words(word, n)`` that are ``RATIO`` times as frequent, with the fewest edits."""
    schema = "form string, word string, n long, edits int"
    asked = words.mapInArrow(_edit_batches(True), schema)
    frequent = words.where(F.col("n") >= RATIO).where(F.col("word").rlike(r"^\p{L}+$")).mapInArrow(_edit_batches(False), schema)
    both = asked.join(frequent.select("form", F.col("word").alias("was"), F.col("n").alias("m"), F.col("edits").alias("more")), "form")
    both = both.where((F.col("word") != F.col("was")) & (F.col("m") >= RATIO * F.col("n"))).select("word", "was", (F.col("edits") + F.col("more")).alias("edits"))
    least = both.groupBy("word", "was").agg(F.min("edits").alias("edits"))
    per = least.groupBy("word").agg(F.min("edits").alias("e"), F.collect_list(F.struct("edits", "was")).alias("x"))  # a word has some dozen edits
    return per.select("word", F.explode(F.expr("filter(x, y -> y.edits = e)")).alias("y")).select("word", "y.was")


def _outside(word: str) -> int:
    return -(xxhash.xxh3_64_intdigest(word) >> 1) - 1


def _pair_batches(shared):
    """``(w, c, n)``: how often word *w* has the frequent word *c* near it.

    Frequent words go by number, all others that may be misreadings (or are plain
    words) by a negative hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, int] = dict(shared.value)
        known = len(words)
        held: list[np.ndarray] = []
        outside: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            code, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = [(code // known, code % known, n)]
            o = np.concatenate(outside, axis=1) if outside else np.zeros((2, 0), np.int64)
            if o.shape[1]:
                o = o[:, np.lexsort((o[1], o[0]))]
                new = np.flatnonzero(np.r_[True, (o[:, 1:] != o[:, :-1]).any(axis=0)])
                rows.append((o[0, new], o[1, new], np.diff(np.r_[new, o.shape[1]])))
            for w, c, m in rows:
                if len(w):
                    yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c.astype(np.int32)), pa.array(m.astype(np.int64))], names=["w", "c", "n"])
            held.clear()
            outside.clear()

        for b in batches:
            flat: list[int] = []
            for t in b.column("text").to_pylist():
                for w in _TOKEN.findall(t.lower()):
                    i = words.get(w)
                    if i is None:
                        if len(words) > known + 500_000:
                            words = dict(shared.value)
                        own = linkable(w)
                        # 2**62 stands for what is no word; a context must be known
                        i = words[w] = 1 << 62 if own is None else words[own] if own in words else _outside(own)
                    flat.append(i)
                flat.extend([1 << 62] * WINDOW)
            x = np.array(flat, np.int64)
            for d in range(1, WINDOW + 1):
                for w, c in ((x[:-d], x[d:]), (x[d:], x[:-d])):
                    inside = (c >= 0) & (c < known)
                    a = inside & (w >= 0) & (w < known)
                    held.append(w[a] * known + c[a])
                    a = inside & (w < 0)
                    outside.append(np.stack([w[a], c[a]]))
            size += len(flat)
            if size > 700_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


def _by_word(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    w = b.column("w").to_numpy()
    off = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    return w, b.column("c").to_numpy(), b.column("n").to_numpy().astype(np.float32), off


def _sum_batches(step, shared):
    """``(w, s)``: per batch and word the sums of *step* over its pairs (rows sorted by w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                w, c, n, off = _by_word(b)
                s = np.add.reduceat(step(shared.value, w, c, n), off, axis=0).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(w[off]), pa.array([r.tobytes() for r in s], pa.binary())], names=["w", "s"])

    return run


def _gradient(state, w, c, n):
    """The part of the gradient that the seen pairs give, for word and for context vectors (pairs are symmetric)."""
    vec, ctx = state
    p = n / (1 + np.exp(np.clip(np.einsum("nd,nd->n", vec[w], ctx[c]), -15, 15)))
    q = n / (1 + np.exp(np.clip(np.einsum("nd,nd->n", vec[c], ctx[w]), -15, 15)))
    return np.concatenate([p[:, None] * ctx[c], q[:, None] * vec[c]], axis=1)


def _counts(state, w, c, n):
    return n[:, None]


def _mean_context(state, w, c, n):
    return np.concatenate([n[:, None] * state[c], n[:, None]], axis=1)


def _sums(pairs: DataFrame, step, state, v: int, width: int) -> np.ndarray:
    """*step* summed per frequent word over all pairs: v x width numbers, v at most ``VECTORS``."""
    shared = pairs.sparkSession.sparkContext.broadcast(state)
    got = pairs.mapInArrow(_sum_batches(step, shared), "w long, s binary").toArrow()
    out = np.zeros((v, width), np.float32)
    if got.num_rows:
        np.add.at(out, got.column("w").to_numpy(), np.frombuffer(b"".join(got.column("s").to_pylist()), np.float32).reshape(-1, width))
    shared.unpersist()
    return out


def skip_grams(pairs: DataFrame, v: int, dim: int = DIM, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors of the v frequent words from ``pairs(w, c, n)`` sorted by w.

    Each round sums the gradient of all seen pairs in the tasks; the driver adds the
    expected part of the noise words (drawn anew each round) and takes one step.
    """
    rng = np.random.default_rng(seed)
    n = np.maximum(_sums(pairs, _counts, None, v, 1)[:, 0].astype(float), 0.5)
    often = n / n.sum()
    noise = n**0.75 / (n**0.75).sum()
    tables = [((rng.random((v, dim)) - 0.5) * 4 / dim).astype(np.float32) for _ in range(2)]
    first, second = ([np.zeros((v, dim), np.float32) for _ in range(2)] for _ in range(2))
    for t in range(1, ROUNDS + 1):
        vec, ctx = tables
        g = _sums(pairs, _gradient, (vec, ctx), v, 2 * dim) / n[:, None]
        c, w = rng.choice(v, min(v, DRAWN), p=noise), rng.choice(v, min(v, DRAWN), p=often)
        gv = g[:, :dim] - NEGATIVE / len(c) * _sigmoid(vec @ ctx[c].T) @ ctx[c]
        gc = g[:, dim:] - NEGATIVE / len(w) * (noise / often)[:, None] * (_sigmoid(ctx @ vec[w].T) @ vec[w])
        for i, grad in enumerate((gv, gc)):  # Adam
            first[i] = 0.9 * first[i] + 0.1 * grad
            second[i] = 0.95 * second[i] + 0.05 * grad * grad
            tables[i] = tables[i] + (RATE * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.95**t)) + 1e-6)).astype(np.float32)
    return tables[0], tables[1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -15, 15)))


def _vector_batches(shared):
    """``(w, vector)`` of words outside the frequent ones (rows sorted by w; a word may span batches)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx, centre, turn, base = shared.value
        last, carry = None, None
        for b in _with_end(batches):
            if b is not None and not b.num_rows:
                continue
            if b is None:
                words, s = np.zeros(0, np.int64), np.zeros((0, ctx.shape[1] + 1), np.float32)
            else:
                w, c, n, off = _by_word(b)
                words, s = w[off], np.add.reduceat(_mean_context(ctx, w, c, n), off, axis=0)
            if last is not None:
                if len(words) and words[0] == last:
                    s[0] += carry
                else:
                    words, s = np.r_[last, words], np.concatenate([carry[None], s])
            if b is not None:
                last, carry = words[-1], s[-1]
                words, s = words[:-1], s[:-1]
            if len(words):
                v = ((s[:, :-1] / s[:, -1:] - centre) @ turn + base).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([x.tobytes() for x in v], pa.binary())], names=["w", "vector"])

    return run


def _with_end(batches: Iterator):
    yield from batches
    yield None


def _near_batches(shared):
    """Keeps the links whose frequent word is nearer than ``NEAR`` of a sample of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample, base = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v, f = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.float32).reshape(b.num_rows, -1) - base for c in ("vector", "goal"))
            mine = np.einsum("nd,nd->n", v, f) / np.maximum(np.linalg.norm(f, axis=1), 1e-9)
            ahead = (v @ sample.T > mine[:, None]).mean(axis=1)
            keep = pa.array((mine > 0) & (ahead <= 1 - NEAR))
            yield pa.RecordBatch.from_arrays([b.column("word").filter(keep), b.column("was").filter(keep), b.column("goal").filter(keep)], names=["key", "fact", "vector"])

    return run


def learn(documents: DataFrame) -> tuple[Model, DataFrame]:
    """The model (at most ``VECTORS`` words) and the facts ``(key, fact, vector)`` of all ``documents(text, title)``."""
    spark = documents.sparkSession
    counted = documents.select("text", "title").mapInArrow(_statistics_batches, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "scan-counts")
    words = counted.where(~F.col("key").rlike(r"[\x00-\x02]")).select(F.col("key").alias("word"), "n")
    top = words.where((F.col("n") >= MIN_COUNT) & ~F.col("word").rlike(r"^[0-9]+$")).orderBy(F.desc("n"), "word").limit(VECTORS).toArrow()
    number = {w: i for i, w in enumerate(top.column(0).to_pylist())}
    forms = _form_facts(counted)
    cuts = _cut_facts(counted, words)
    if not number:
        empty = np.zeros((0, DIM), np.float32)
        return Model({}, empty, np.zeros(DIM, np.float32), np.zeros((DIM, DIM), np.float32)), materialise(forms.unionByName(cuts), "scan-facts")
    links = materialise(candidate_links(words), "scan-links")
    pairs = documents.select("text").mapInArrow(_pair_batches(spark.sparkContext.broadcast(number)), "w long, c int, n long").repartition("w").groupBy("w", "c").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.sortWithinPartitions("w"), "scan-pairs")
    inside = pairs.where("w >= 0")
    vec, ctx = skip_grams(inside, len(number))
    # words outside: a linear map from the mean context, fitted on the frequent words
    s = _sums(inside, _mean_context, ctx, len(number), DIM + 1)
    seen = s[:, -1] > 0
    centre = s[seen, :-1] / s[seen, -1:] if seen.any() else np.zeros((1, DIM), np.float32)
    middle, base = centre.mean(0), vec.mean(0)
    turn = np.linalg.lstsq(centre - middle, vec[seen] - base if seen.any() else np.zeros((1, DIM)), rcond=1e-4)[0].astype(np.float32)
    hashed = F.udf(_outside, "long")
    known = spark.createDataFrame(pa.table({"word": list(number), "w": pa.array(range(len(number)), pa.int64()), "own": pa.array([x.tobytes() for x in vec], pa.binary())}))
    asked = links.select(F.explode(F.array("word", "was")).alias("word")).distinct().join(F.broadcast(known), "word", "left")
    asked = materialise(asked.select("word", "own", F.when(F.col("w").isNull(), hashed("word")).alias("w")), "scan-linked")
    outside = pairs.where("w < 0").join(asked.where("w is not null").select("w").distinct(), "w", "left_semi")
    shared = spark.sparkContext.broadcast((ctx, middle, turn, base))
    found = outside.repartition("w").sortWithinPartitions("w").mapInArrow(_vector_batches(shared), "w long, vector binary")
    vectors = asked.join(found, "w", "left").select("word", F.coalesce("own", "vector").alias("vector")).where("vector is not null")
    step = max(1, len(vec) // 512)
    sample = vec[::step] - base
    sample /= np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-9)
    both = links.join(vectors, "word").join(vectors.select(F.col("word").alias("was"), F.col("vector").alias("goal")), "was").select("word", "was", "vector", "goal")
    near = both.mapInArrow(_near_batches(spark.sparkContext.broadcast((sample, base))), "key string, fact string, vector binary")
    facts = materialise(near.unionByName(cuts).unionByName(forms), "scan-facts")
    return Model(number, ctx, base, np.cov((vec - base).T).astype(np.float32)), facts


def _form_facts(counted: DataFrame) -> DataFrame:
    """Forms that mostly stand where furniture stands."""
    form = F.substring("key", 2, 1 << 20)
    sums = counted.where(F.col("key").rlike(r"^[\x01\x02]")).groupBy(form.alias("form")).agg(
        F.sum(F.when(F.col("key").startswith("\x01"), F.col("n"))).alias("n"), F.sum(F.when(F.col("key").startswith("\x02"), F.col("n"))).alias("placed")
    )
    fact = F.when(F.col("placed") >= 0.6 * F.col("n"), "furniture").when(F.col("placed") >= 0.3 * F.col("n"), "likely")
    return sums.where(F.col("placed") >= 4).select(F.concat(F.lit("\x01"), "form").alias("key"), fact.alias("fact"), F.lit(None).cast("binary").alias("vector")).where("fact is not null")


def _cut_facts(counted: DataFrame, words: DataFrame) -> DataFrame:
    """Unmarked line ends whose halves make a frequent word (``cut``), marked ones whose halves are words and make none (``compound``)."""
    half = F.split("key", "\x00")
    ends = counted.where(F.contains("key", F.lit("\x00"))).select("key", half[0].endswith("-").alias("marked"), F.rtrim(half[0], F.lit("-")).alias("a"), half[1].alias("b"))
    for name, word in (("na", F.col("a")), ("nb", F.col("b")), ("nw", F.concat("a", "b"))):
        ends = ends.withColumn("word", word).join(words.withColumnRenamed("n", name), "word", "left").drop("word")
    na, nb, nw = (F.coalesce(c, F.lit(0)) for c in ("na", "nb", "nw"))
    cut, compound = (nw >= MIN_COUNT) & (F.least(na, nb) * 5 < nw), (nw < MIN_COUNT) & (na >= MIN_COUNT) & (nb >= MIN_COUNT)
    fact = F.when(~F.col("marked") & cut, "cut").when(F.col("marked") & compound, "compound")
    return ends.select("key", fact.alias("fact"), F.lit(None).cast("binary").alias("vector")).where("fact is not null")


def _gathered(rows) -> dict[str, list[tuple[str, bytes | None]]]:
    facts: dict[str, list] = {}
    for key, fact, vector in sorted(rows, key=lambda r: (r[0], r[1])):
        facts.setdefault(key, []).append((fact, vector))
    return facts


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, key)``: what a document may need facts about."""
    for b in batches:
        for row, t, title in zip(*(b.column(c).to_pylist() for c in ("row", "text", "title"))):
            lines = t.split("\n")
            keys = {w for x in _TOKEN.findall(t) if (w := linkable(x))} | {f"{x}\x00{y}" for x, y in line_ends(lines)} | {"\x01" + form for _, form, _, _ in short_lines(lines, title)[1]}
            yield pa.RecordBatch.from_arrays([pa.array([row] * len(keys), pa.int64()), pa.array(list(keys), pa.string())], names=["row", "key"])


def _with_facts(documents: DataFrame, limit: int):
    """Documents (with their own facts where there are too many to broadcast) and the broadcast model."""
    docs = documents.where("raw_markdown is not null").select("doc_id", F.col("raw_markdown").alias("text"), "title")
    model, facts = learn(docs)
    context = documents.sparkSession.sparkContext
    # the model holds at most VECTORS words, the facts at most *limit* rows
    if facts.limit(limit + 1).count() <= limit:
        return docs.withColumn("facts", F.lit(None).cast("array<struct<key:string,fact:string,vector:binary>>")), context.broadcast((model, _gathered(facts.collect())))
    keyed = docs.withColumn("row", F.xxhash64("doc_id", "text", "title"))
    keys = keyed.select("row", "text", "title").mapInArrow(_key_batches, "row long, key string").distinct()
    own = keys.join(facts, "key").groupBy("row").agg(F.collect_list(F.struct("key", "fact", "vector")).alias("facts"))
    return keyed.join(own, "row", "left").select("doc_id", "text", "title", F.coalesce("facts", F.array().cast("array<struct<key:string,fact:string,vector:binary>>")).alias("facts")), context.broadcast((model, {}))


def _readers(b: pa.RecordBatch, shared) -> Iterator[tuple]:
    model, facts = shared.value
    common = Reader(model, facts)
    for i, text, title, own in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "title", "facts"))):
        yield i, text, title, common if own is None else Reader(model, _gathered((x["key"], x["fact"], x["vector"]) for x in own))


def _inspect_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, line, kind = [], [], []
            for i, text, title, reader in _readers(b, shared):
                for n, k in sorted(set(reader.inspect(text, title)[0])):
                    ids.append(i)
                    line.append(n + 1)
                    kind.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(line, pa.int32()), pa.array(kind, pa.string())], names=["doc_id", "line_no", "kind"])

    return run


def _repair_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fixed = [reader.repair(text, title) for _, text, title, reader in _readers(b, shared)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fixed, pa.string())], names=["doc_id", "text"])

    return run


def noisy_lines(documents: DataFrame, limit: int = FACTS) -> DataFrame:
    """``(doc_id, line_no, kind)`` for ``documents(doc_id, raw_markdown, title)``."""
    docs, shared = _with_facts(documents, limit)
    return docs.mapInArrow(_inspect_batches(shared), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, line_no int, kind string")


def repaired(documents: DataFrame, limit: int = FACTS) -> DataFrame:
    """``(doc_id, text)``: the readable paragraphs of every document."""
    docs, shared = _with_facts(documents, limit)
    return docs.mapInArrow(_repair_batches(shared), f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string")
