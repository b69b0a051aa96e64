"""Heading tree of Markdown: lexer on Arrow batches, hierarchy by windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)
_FENCE = re.compile(r"```.*?```", re.S)


def lex(text: str) -> Iterator[tuple[int, int, str, str, int, int]]:
    """``(ordinal, level, title, content, start_line, end_line)``; ordinal -1 is the text before the first heading."""
    fences = [m.span() for m in _FENCE.finditer(text)]
    heads, f = [], 0
    for m in _HEADING.finditer(text):
        while f < len(fences) and fences[f][1] <= m.start():
            f += 1
        if f < len(fences) and fences[f][0] <= m.start():
            continue
        heads.append(m)
    total = text.count("\n") + 1
    if not heads:
        yield -1, 0, "Document Root", text, 0, total
        return
    lines, at, n = [], 0, 0
    for m in heads:
        n += text.count("\n", at, m.start())
        at = m.start()
        lines.append(n)
    lead = text[: heads[0].start()].strip()
    if lead:
        yield -1, 0, "Document Root", lead, 0, total
    for i, m in enumerate(heads):
        stop = heads[i + 1].start() if i + 1 < len(heads) else len(text)
        yield i, len(m.group(1)), m.group(2).strip(), text[m.end() : stop].strip(), lines[i], lines[i + 1] if i + 1 < len(heads) else total


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["ordinal", "level", "title", "content", "start_line", "end_line"]
    for b in batches:
        docs, rows = [], []
        for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
            for r in lex(t):
                docs.append(d)
                rows.append(r)
        cols = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), *(pa.array(list(c), t) for c, t in zip(cols, types))], names=["doc", *names])


def headings(docs: DataFrame) -> DataFrame:
    """Headings of ``docs(doc string, text string)``; null texts have none."""
    return docs.where("text is not null").select("doc", "text").mapInArrow(_batches, "doc string, ordinal int, level int, title string, content string, start_line int, end_line int")


def section_tree(heads: DataFrame) -> DataFrame:
    """Adds ``parent_ordinal``, ``position`` (0-based) and ``path`` to headings of level 1 or more.

    The parent is the nearest earlier heading of a smaller level.  One sort by
    document serves all windows but the sibling count.
    """
    before = Window.partitionBy("doc").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    rows = heads.where("level > 0")
    for n in range(1, 6):
        rows = rows.withColumn(f"_o{n}", F.last(F.when(F.col("level") == n, F.col("ordinal")), True).over(before))
    above = [F.when(F.col("level") > n, F.col(f"_o{n}")) for n in range(1, 6)]
    rows = rows.withColumn("parent_ordinal", F.greatest(*above))
    rows = rows.withColumn("position", (F.row_number().over(Window.partitionBy("doc", "parent_ordinal").orderBy("ordinal")) - 1).cast("int"))
    upto = Window.partitionBy("doc").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    for n in range(1, 7):
        rows = rows.withColumn(f"_l{n}", F.last(F.when(F.col("level") == n, F.struct("ordinal", "position")), True).over(upto))
    parts = []
    for n in range(1, 7):
        live = F.lit(True)
        for m in range(1, n):
            live = live & (F.col(f"_l{m}").isNull() | (F.col(f"_l{n}.ordinal") > F.col(f"_l{m}.ordinal")))
        parts.append(F.when((F.col("level") >= n) & F.col(f"_l{n}").isNotNull() & live, (F.col(f"_l{n}.position") + 1).cast("string")))
    return rows.withColumn("path", F.concat_ws(".", *parts)).select("doc", "ordinal", "level", "title", "content", "start_line", "end_line", "parent_ordinal", "position", "path")


def outline(tree: DataFrame, include_content: bool = False) -> DataFrame:
    """``(doc, outline)``: indented ``path. title`` lines in document order, with the first 100 characters if asked."""
    indent = F.repeat(F.lit(" "), 2 * (F.col("level") - 1))
    line = F.concat(indent, "path", F.lit(". "), "title")
    if include_content:
        some = F.concat(F.lit("\n"), indent, F.lit("   ["), F.translate(F.substring("content", 1, 100), "\n", " "), F.lit("...]"))
        line = F.concat(line, F.when(F.length("content") > 0, some).otherwise(""))
    return tree.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("x")).select("doc", F.array_join("x.line", "\n").alias("outline"))


def leaves(tree: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Sections without children; with *heads* also the roots of documents without headings."""
    parents = tree.select("doc", F.col("parent_ordinal").alias("ordinal")).where("ordinal is not null").distinct()
    found = tree.join(parents, ["doc", "ordinal"], "left_anti").select("doc", "ordinal", "path")
    if heads is None:
        return found
    bare = heads.where("ordinal < 0").join(tree.select("doc").distinct(), "doc", "left_anti")
    return found.unionByName(bare.select("doc", "ordinal", F.lit("").alias("path")))


def at_path(tree: DataFrame, path: str) -> DataFrame:
    """The section at a path of each document."""
    return tree.where(F.col("path") == path)


def _nested_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for doc, text in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
            root = {"id": f"{doc}_root", "level": 0, "title": "Document Root", "content": "", "path": "", "start_line": 0, "end_line": text.count("\n") + 1, "children": []}
            stack = [root]
            for ordinal, level, title, content, start, end in lex(text):
                if ordinal < 0:
                    root["content"] = content
                    continue
                while stack[-1]["level"] >= level:
                    stack.pop()
                up = stack[-1]
                place = str(len(up["children"]) + 1)
                node = {"id": f"{doc}_{ordinal}", "level": level, "title": title, "content": content, "path": f"{up['path']}.{place}" if up["path"] else place, "start_line": start, "end_line": end, "children": []}
                up["children"].append(node)
                stack.append(node)
            out.append(json.dumps(root, ensure_ascii=False))
        yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.string())], names=["doc", "tree"])


def nested(docs: DataFrame) -> DataFrame:
    """``(doc, tree)``: the heading tree of ``docs(doc, text)`` as JSON, children inside their parents."""
    return docs.where("text is not null").select("doc", "text").mapInArrow(_nested_batches, "doc string, tree string")


def siblings(tree: DataFrame) -> DataFrame:
    """``(doc, ordinal, sibling)``: other children of the same parent."""
    other = tree.select("doc", F.coalesce("parent_ordinal", F.lit(-1)).alias("p"), F.col("ordinal").alias("sibling"))
    return tree.select("doc", "ordinal", F.coalesce("parent_ordinal", F.lit(-1)).alias("p")).join(other, ["doc", "p"]).where("ordinal <> sibling").select("doc", "ordinal", "sibling")
