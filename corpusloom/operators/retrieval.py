"""Full-text (BM25), vector and fused retrieval, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import fulltext
from corpusloom.sources.tables import materialise

FTS_COLUMNS = ["content", "enriched_content", "section_title"]
K1, B, RRF_K, MIN_COSINE = 1.2, 0.75, 60, 0.25


def terms(c: str | Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _count(t: str, word: str) -> Column:
    return F.size(F.filter(t, lambda x: x == F.lit(word)))


def bm25(docs: DataFrame, query: list[str], mode: str = "or", without: list[str] | None = None) -> DataFrame:
    """``(id, score)`` of ``docs(id, text)`` for query terms as they are (:mod:`fulltext` has the query language); ``and`` needs them all, *without* excludes.

    One scan: only rows with a queried term are kept, with the statistics of each
    task in one row more, so the shuffle carries matches, not the corpus.
    """
    t = docs.select("id", terms("text").alias("t"))
    hit = t.select("id", F.size("t").alias("len"), *[_count("t", q).alias(f"f{i}") for i, q in enumerate(query)], *([F.exists("t", lambda x: x.isin(without)).alias("no")] if without else [F.lit(False).alias("no")]))
    hit = materialise(hit.where("len >= 0"), "bm25-terms")  # lengths and frequencies, no texts
    stats = hit.agg(F.count(F.lit(1)).alias("N"), F.avg("len").alias("avg"), *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in range(len(query))])
    score = F.lit(0.0)
    for i in range(len(query)):
        n, f = F.col(f"n{i}"), F.col(f"f{i}")
        idf = F.log((F.col("N") - n + 0.5) / (n + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(1e-6))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg")))).otherwise(0.0)
    found = [F.col(f"f{i}") > 0 for i in range(len(query))]
    ok = found[0]
    for x in found[1:]:
        ok = (ok & x) if mode == "and" else (ok | x)
    return hit.where(ok & ~F.col("no")).join(F.broadcast(stats)).select("id", F.round(score, 9).alias("score"))  # stats: one row


def phrase(docs: DataFrame, words: list[str]) -> DataFrame:
    """Ids of ``docs(id, text)`` with the words in succession."""
    joined = F.concat(F.lit(" "), F.array_join(terms("text"), " "), F.lit(" "))
    return docs.where(F.contains(joined, F.lit(" " + " ".join(words) + " "))).select("id")


def prefix(docs: DataFrame, start: str) -> DataFrame:
    """Ids of ``docs(id, text)`` with a term that starts so."""
    return docs.where(F.exists(terms("text"), lambda x: x.startswith(start))).select("id")


def _matrix(ids: pa.Array, vectors: pa.Array, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and double rows of the vectors that have *dim* finite components."""
    size = np.asarray(vectors.value_lengths().fill_null(-1))
    ok = np.flatnonzero((size == dim) & np.asarray(ids.is_valid()))
    x = vectors.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    return ids.take(pa.array(ok[good])), x[good]


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines (queries x rows) in double precision, 0 where a norm is 0."""
    nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    n = nq[:, None] * nx[None, :]
    return np.where(n > 0, (q @ x.T) / np.where(n > 0, n, 1), 0.0)


def _search_batches(shared, limit: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        for b in batches:
            ids, x = _matrix(b.column("id"), b.column("v"), q.shape[1])
            if not len(ids):
                continue
            for i in range(0, len(q), 512):
                score = np.round(cosines(q[i : i + 512], x), 6)
                # the best of this batch; rows level with the last of them stay for the order by id
                last = np.partition(score, -limit, axis=1)[:, -limit] if score.shape[1] > limit else np.full(len(score), -2.0)
                r, c = np.nonzero((score >= np.maximum(last, least)[:, None]))
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(i + r)), ids.take(pa.array(c)), pa.array(score[r, c])], names=["qid", "id", "score"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int, least: float = MIN_COSINE, block: int = 20_000) -> DataFrame:
    """``(qid, id, score, rank)``: best *limit* of ``vectors(id, v)`` for each row of ``queries(qid, q)``.

    Queries go out as matrices of at most *block* rows, one pass over the
    vectors each; a pass keeps the best of every batch before anything is
    shuffled.  Null vectors and ids, vectors with a component that is not
    finite and those of another dimension than the first usable query neither ask nor answer; a zero
    vector has score 0 with all.
    """
    spark, kind = vectors.sparkSession, {c: d.schema[c].dataType.simpleString() for d, c in ((vectors, "id"), (queries, "qid"))}
    schema = f"qid {kind['qid']}, id {kind['id']}, score double"
    asked = queries.where("qid is not null and q is not null and size(q) > 0 and not exists(q, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    asked = materialise(asked.select("qid", "q"), "vector-queries")
    n, dim = asked.count(), asked.agg(F.min_by(F.size("q"), "qid")).first()[0]
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    passes = -(-n // block)
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    found = None
    for i in range(passes):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == i).toArrow()  # about *block* rows
        matrix = _matrix(part.column("qid").combine_chunks(), part.column("q").combine_chunks(), dim)
        near = vectors.where("v is not null").mapInArrow(_search_batches(spark.sparkContext.broadcast(matrix), limit, least), schema)
        near = near.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= limit)
        found = near if found is None else found.unionByName(near)
    return found


def ranked(scores: DataFrame, limit: int) -> DataFrame:
    """``(id, score, rank)`` of the best rows."""
    top = scores.orderBy(F.desc("score"), "id").limit(limit)
    return top.select("id", "score", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "id")).cast("int").alias("rank"))


def fuse(text: DataFrame, vector: DataFrame, limit: int, text_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists ``(id, score, rank)``; a missing rank counts as list length + 100.

    ``(id, score, text_score, text_rank, vector_score, vector_rank)``.
    """
    sides = text.select("id", F.lit(0).alias("side"), "score", "rank").unionByName(vector.select("id", F.lit(1).alias("side"), "score", "rank"))
    every = Window.partitionBy()  # the lists hold some thousand rows at most
    n = [F.sum((F.col("side") == i).cast("int")).over(every).alias(f"n{i}") for i in range(2)]
    pick = [F.max(F.when(F.col("side") == i, F.struct("score", "rank"))).alias(c) for i, c in enumerate(("t", "v"))]
    both = sides.select("*", *n).groupBy("id").agg(*pick, F.max("n0").alias("nt"), F.max("n1").alias("nv"))
    score = text_weight / (RRF_K + F.coalesce("t.rank", F.col("nt") + 100)) + vector_weight / (RRF_K + F.coalesce("v.rank", F.col("nv") + 100))
    cols = [F.col(f"{a}.{b}").alias(f"{c}_{b}") for a, c in (("t", "text"), ("v", "vector")) for b in ("score", "rank")]
    return both.select("id", F.round(score, 9).alias("score"), *cols).orderBy(F.desc("score"), "id").limit(limit)


def preview(c: str | Column) -> Column:
    """The first 300 characters, with dots if there are more."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.length(c) > 300, F.concat(F.substring(c, 1, 300), F.lit("..."))).otherwise(c)


def hydrate(fused: DataFrame, chunks: DataFrame, documents: DataFrame, limit: int, semantic_types: list[str] | None = None) -> DataFrame:
    """Results of a fused candidate list: chunk and document columns, type filter, preview, the best *limit*.

    *chunks* has one row an id.  Candidates without chunk or document drop out;
    a chunk without a type passes no filter.
    """
    wanted = F.broadcast(fused)  # at most twice the limit
    found = chunks.join(wanted, "id").join(documents.select(F.col("id").alias("document_id"), F.col("name").alias("document_name")), "document_id")
    if semantic_types:
        found = found.where(F.col("semantic_type").isin(semantic_types))
    return found.select(
        "id", "document_id", "document_name", "section_path", "section_title", "section_summary", "semantic_type", preview("content").alias("preview"), "score", "text_score", "text_rank", "vector_score", "vector_rank"
    ).orderBy(F.desc("score"), "id").limit(limit)


def hybrid_search(
    chunks: DataFrame, documents: DataFrame, query: str, vector: DataFrame, limit: int = 20, text_weight: float = 1.0, vector_weight: float = 1.0, semantic_types: list[str] | None = None
) -> DataFrame:
    """Text and vector search over chunks, fused; ``vector(qid, q)`` is the query's embedding.

    Each list and the fused one hold ``2 * limit`` rows; the type filter comes after that cut.
    """
    return expanded_search(chunks, documents, [query], vector, limit, text_weight, vector_weight, semantic_types, 2 * limit, False)


def expanded_search(
    chunks: DataFrame, documents: DataFrame, queries: list[str], vectors: DataFrame, limit: int = 20, text_weight: float = 1.0, vector_weight: float = 1.0, semantic_types: list[str] | None = None, each: int | None = None, skip_bad: bool = True
) -> DataFrame:
    """Hybrid search with all variants of a query: ``vectors(qid, q)`` numbers the vector variants.

    Every variant gives its best *each* (default *limit*) rows; a chunk keeps its highest
    score and the rank that came with it.  Text variants that are not of the query language are skipped.
    """
    text = fulltext.search(chunks, "id", FTS_COLUMNS, queries, each or limit, skip_bad=skip_bad)
    near = vector_search(chunks.select("id", F.col("embedding").alias("v")), vectors, each or limit)
    merged = [merge_variants(x.withColumnRenamed("qid", "variant")) for x in (text, near)]
    return hydrate(fuse(*merged, 2 * limit, text_weight, vector_weight), chunks, documents, limit, semantic_types)


def search_documents(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Documents by name, title and text, with all their columns; the score is negative, the best first."""
    found = fulltext.search(documents, "id", ["name", "title", "raw_markdown"], [query], limit)
    return documents.join(F.broadcast(found.select("id", (-F.col("score")).alias("score"), "rank")), "id")  # at most *limit* rows


def context(results: DataFrame, sections: DataFrame) -> DataFrame:
    """Parent summary and sorted titles below the parent for ``results(id, document_id, path)`` with a dotted path.

    Every section names each of its ancestors once and the titles are gathered
    by (document, ancestor), so a large document without depth costs nothing.
    """
    up = results.where(F.contains("path", F.lit("."))).withColumn("parent", F.regexp_replace("path", r"\.[^.]*$", ""))
    s = sections.select("document_id", F.col("path").alias("sp"), "title", "summary").distinct()
    parent = s.select("document_id", F.col("sp").alias("parent"), F.expr("nullif(summary, '')").alias("parent_summary"))
    parent = parent.groupBy("document_id", "parent").agg(F.min("parent_summary").alias("parent_summary"))
    parts = F.split("sp", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    below = s.where(F.contains("sp", F.lit("."))).select("document_id", F.explode(above).alias("parent"), "title", "sp")
    below = below.groupBy("document_id", "parent").agg(F.sort_array(F.collect_list(F.struct("title", "sp"))).alias("below"))
    found = up.join(parent, ["document_id", "parent"], "left").join(below, ["document_id", "parent"], "left")
    near = F.filter("below", lambda x: x["sp"] != F.col("path"))
    titles = F.when(F.size(near) > 0, F.array_join(F.transform(near, lambda x: x["title"]), "; "))
    return found.select("id", "path", "parent_summary", titles.alias("sibling_titles"))


def merge_variants(lists: DataFrame) -> DataFrame:
    """Of ``(variant, id, score, rank)`` per id the highest score with its own rank; ties go to the earliest variant."""
    best = F.max_by(F.struct("score", "rank"), F.struct("score", -F.col("variant")))
    return lists.groupBy("id").agg(best.alias("b")).select("id", "b.score", "b.rank")
