"""Paragraph packing into chunks (a fold over one text, on Arrow batches)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_TOKENS, MIN_TOKENS, OVERLAP_TOKENS = 1500, 50, 200


def token_estimate(c):
    """floor(characters / 4)."""
    return F.floor(F.length(c) / 4).cast("int")


def pack(text: str, limit: int, overlap: int) -> list[str]:
    """Greedy packing of blank-line paragraphs; an oversized paragraph is packed by sentences.

    The last unit of a closed chunk opens the next one if it is below the
    overlap.  Sizes are sums over units without separators.
    """
    done: list[str] = []
    held: list[str] = []
    size = 0

    def close(carry: bool) -> None:
        nonlocal held, size
        done.append("\n\n".join(held))
        last = held[-1]
        held = [last] if carry and len(last) // 4 < overlap else []
        size = sum(len(u) // 4 for u in held)

    for paragraph in text.split("\n\n"):
        n = len(paragraph) // 4
        if n > limit:
            if held:
                close(False)
            units = re.sub(r"\. ", ".\n", paragraph).split("\n")
        else:
            units = [paragraph]
        for u in units:
            m = len(u) // 4
            if size + m > limit and held:
                close(True)
            held.append(u)
            size += m
    if held:
        done.append("\n\n".join(held))
    return done


def packed(c, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS):
    """Array column of the chunks of a text."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else pack(t, limit, overlap))

    return run(c)


def section_chunks(sections: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of ``sections(doc, node, ordinal, content)`` in document order.

    A section within the limit stays whole; else it is packed and pieces under
    50 tokens are dropped.  ``chunk_index`` is dense over the document;
    offsets add up the lengths of the emitted pieces.  Blank sections give none;
    text outside any section has a null ``node``.
    """
    rows = sections.where(F.length(F.regexp_replace("content", r"(?U)^\s+|\s+$", "")) > 0)
    whole = rows.where(token_estimate("content") <= limit).select("doc", "node", "ordinal", F.lit(0).alias("i"), "content")
    split = (
        rows.where(token_estimate("content") > limit)
        .select("doc", "node", "ordinal", F.posexplode(packed("content", limit, overlap)).alias("i", "content"))
        .where(token_estimate("content") >= MIN_TOKENS)
    )
    node = Window.partitionBy("doc", "node").orderBy("i")
    doc = Window.partitionBy("doc").orderBy("ordinal", "i")
    end = F.sum(F.length("content")).over(node)
    return whole.unionByName(split).select(
        F.concat_ws("_", "doc", "node", "i").alias("chunk_id"), "doc", F.when(F.col("ordinal") >= 0, F.col("node")).alias("node"), (F.row_number().over(doc) - 1).cast("int").alias("chunk_index"), "content",
        (end - F.length("content")).cast("int").alias("char_offset_start"), end.cast("int").alias("char_offset_end"),
    )


def unstructured_chunks(docs: DataFrame, limit: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks of ``docs(doc, text)`` without regard to headings; the index keeps the gaps of dropped pieces."""
    rows = docs.select("doc", F.posexplode(packed("text", limit, overlap)).alias("chunk_index", "content")).where(token_estimate("content") >= MIN_TOKENS)
    end = F.sum(F.length("content")).over(Window.partitionBy("doc").orderBy("chunk_index"))
    return rows.select(
        F.concat(F.col("doc"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "doc", "chunk_index", "content",
        (end - F.length("content")).cast("int").alias("char_offset_start"), end.cast("int").alias("char_offset_end"),
    )


def with_metadata(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks with path, title, summary, type and the enriched text of their sections ``(doc, node, path, title, ...)``.

    Missing enrichment columns of *sections* count as absent; chunks outside any section keep their content as enriched text.
    """
    have = set(sections.columns)
    extra = {"summary": "string", "semantic_type": "string", "key_terms": "array<string>", "hypothetical_questions": "array<string>"}
    own = sections.select("doc", "node", "path", "title", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in extra.items()])
    text = enriched_text(F.col("path"), F.col("title"), F.col("semantic_type"), F.col("summary"), F.col("key_terms"), F.col("content"), F.col("hypothetical_questions"))
    return chunks.join(own, ["doc", "node"], "left").select(
        *chunks.columns, F.col("path").alias("section_path"), F.col("title").alias("section_title"), F.col("summary").alias("section_summary"), "semantic_type",
        F.when(F.col("node").isNull(), F.col("content")).otherwise(text).alias("enriched_content"),
    )


def enriched_text(path, title, kind, summary, key_terms, content, questions=None):
    """Content under its labels; absent labels are skipped."""
    def some(c):
        return F.when(F.length(c) > 0, c)

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Section: "), some(path), F.lit(" - "), some(title)),
        F.concat(F.lit("Type: "), some(kind)),
        F.concat(F.lit("Summary: "), some(summary)),
        F.when(F.size(key_terms) > 0, F.concat(F.lit("Key Terms: "), F.array_join(key_terms, ", "))),
        *([F.when(F.size(questions) > 0, F.concat(F.lit("Questions this section answers:\n"), F.array_join(F.transform(questions, lambda q: F.concat(F.lit("Q: "), q)), "\n")))] if questions is not None else []),
        F.lit(""),
        F.lit("Content:"),
        content,
    )
