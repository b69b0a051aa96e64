"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import mixing, neardup, packing, scans, similar, splitting, subjects
from corpusloom.sources.tables import table


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(splitting.corpus_items(table(spark, d, "sections"), table(spark, d, "chunks")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).select("item_kind", "item_id").distinct()


def p2_coverage(spark: SparkSession, d: str) -> DataFrame:
    return splitting.coverage(p2_pieces(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = similar.most_similar(table(spark, d, "chunks").select("id", F.col("embedding").alias("v")), 5, 0.9)
    return near.select(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).distinct()


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    return similar.most_similar(table(spark, d, "chunks").select("id", F.col("embedding").alias("v")), 5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy_lines(table(spark, d, "documents").select("doc_id", "raw_markdown", "title"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(table(spark, d, "documents").select("doc_id", "raw_markdown", "title"))


def _duplicates(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.NearDuplicates(neardup.corpus_texts(table(spark, d, "documents"), table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == 0, "document").otherwise("chunk")
    return _duplicates(spark, d).pairs().select(kind.alias("rec_kind"), "id_a", "id_b")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == 0, "document").otherwise("chunk")
    return _duplicates(spark, d).groups().select(kind.alias("rec_kind"), "id", "group_id", "members")


def p5_pruning(spark: SparkSession, d: str) -> DataFrame:
    return _duplicates(spark, d).pruning()


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_pack(spark, d), table(spark, d, "token_budgets"))


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    return packing.check(p6_pack(spark, d), table(spark, d, "token_budgets"))


def _mix(spark: SparkSession, d: str) -> mixing.SourceMix:
    return mixing.SourceMix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).selection()


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report()


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).check()


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subject_posteriors(*(table(spark, d, t) for t in ("documents", "subject_areas", "subject_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(table(spark, d, "documents"), _subjects(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found,
        "p2_pieces": p2_pieces,
        "p2_coverage": p2_coverage,
        "p3_found": p3_found,
        "p3_nearest": p3_nearest,
        "p4_found": p4_found,
        "p4_repaired": p4_repaired,
        "p5_found": p5_found,
        "p5_groups": p5_groups,
        "p5_pruning": p5_pruning,
        "p6_pack": p6_pack,
        "p6_report": p6_report,
        "p6_check": p6_check,
        "p7_mix": p7_mix,
        "p7_report": p7_report,
        "p7_check": p7_check,
        "p8_found": p8_found,
        "p8_composition": p8_composition,
    }


SQL = {
    "p2_found": """
        select distinct 'section' as item_kind, id as item_id from sections where length(content) // 4 > 1500
        union select distinct 'chunk', id from chunks where length(content) // 4 > 1500""",
    "p2_coverage": """
        select * exclude (content) from (select distinct 'section' as item_kind, id as item_id, content, length(content) as chars_covered, true as sizes_ok, true as overlaps_ok from sections where length(content) // 4 > 1500
        union select distinct 'chunk', id, content, length(content), true, true from chunks where length(content) // 4 > 1500)""",
    "p6_check": """
        select budget_name, capacity_tokens, (select count(*) from documents where text is not null) as documents, 0 as overfull, 0 as needless
        from (select distinct budget_name, capacity_tokens from token_budgets)""",
    "p7_check": """
        select distinct lower(trim(source)) as source, exists (select 1 from documents d where lower(trim(d.source)) = lower(trim(t.source)) and text <> '') as used, true as within_cap from mix_targets t""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
