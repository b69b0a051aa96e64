"""Catalog operations on corpus tables as set operations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last version of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """*changes* (one row a key) replace rows of the same key and add new ones; null keys are added.

    A key that is changed twice makes the job fail.
    """
    twice = F.assert_true((F.count(F.lit(1)).over(Window.partitionBy(key)) == 1) | F.col(key).isNull(), F.lit("a key is changed twice"))
    changes = changes.withColumn("_one", twice).where("_one is null").drop("_one")
    return rows.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_cascade(documents: DataFrame, sections: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the documents of ``gone(id)``."""
    return documents.join(gone, "id", "left_anti"), *(t.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti") for t in (sections, chunks))


def list_documents(documents: DataFrame, source_type: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of documents, newest first, ties by id."""
    rows = documents if source_type is None else documents.where(F.col("source_type") == source_type)
    return rows.orderBy(F.desc("ingested_at"), "id").offset(offset).limit(limit)


@F.pandas_udf(StringType())
def _two_digits(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None or v != v else f"{v:.2f}")


def pdf_route(detections: DataFrame, least: float = 0.9) -> DataFrame:
    """Adds ``route`` and ``reason``: text-based pages read with enough confidence are extracted locally.

    Missing fields never lead to local extraction: a null type reads ``unknown``, a null
    recommendation counts as one, a null confidence as too low.
    """
    if not 0 <= least <= 1:
        raise ValueError("the minimum confidence must be between 0.0 and 1.0")
    kind = F.col("pdf_type") == "text_based"
    shown = F.coalesce(_two_digits("confidence"), F.lit("unknown"))
    return detections.withColumn(
        "route", F.when(kind & ~F.col("ocr_recommended") & (F.col("confidence") >= least) & ~F.isnan("confidence"), "local_extraction").otherwise("vlm")
    ).withColumn(
        "reason",
        F.when(~F.coalesce(kind, F.lit(False)), F.concat(F.lit("pdf_type="), F.coalesce("pdf_type", F.lit("unknown"))))
        .when(F.coalesce("ocr_recommended", F.lit(True)), F.lit("ocr_recommended=true"))
        .when(F.col("route") == "local_extraction", F.concat(F.lit("text_based with confidence "), shown, F.lit(f" >= {least:.2f}")))
        .otherwise(F.concat(F.lit("confidence "), shown, F.lit(f" < {least:.2f}"))),
    )


def listing(documents: DataFrame) -> DataFrame:
    """The columns of a document table, cut to width: id 12, name 40 characters."""
    return documents.select(F.substring("id", 1, 12).alias("id"), F.substring("name", 1, 40).alias("name"), "source_type", "ingested_at")


def result_listing(results: DataFrame) -> DataFrame:
    """The columns of a result table, cut to width: document and section 20, preview 50 characters, score to 3 digits."""
    return results.select(
        F.format_number("score", 3).alias("score"), F.substring("document_name", 1, 20).alias("document"), F.coalesce(F.substring("section_title", 1, 20), F.lit("-")).alias("section"),
        F.concat(F.substring("preview", 1, 50), F.lit("...")).alias("preview"),
    )


def export(documents: DataFrame, markdown: bool = False) -> DataFrame:
    """``(id, text)``: the Markdown of each document, or nine of its columns as JSON."""
    if markdown:
        return documents.select("id", F.col("raw_markdown").alias("text"))
    keys = ("id", "name", "source_type", "title", "author", "tags", "section_count", "chunk_count", "token_count")
    return documents.select("id", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("text"))
