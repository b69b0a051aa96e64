"""Queries of dangling references (problem 1) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.references import composite_chunk_references, corpus_references
from corpusloom.sources.tables import table


def _failing(spark: SparkSession, d: str) -> DataFrame:
    return corpus_references(*(table(spark, d, t) for t in ("documents", "sections", "chunks", "catalog_log")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _failing(spark, d).select("ref_field", "row_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _failing(spark, d).groupBy("ref_field", "month", "reason").agg(F.count(F.lit(1)).alias("n"))


def p1_composite(spark: SparkSession, d: str) -> DataFrame:
    return composite_chunk_references(table(spark, d, "sections"), table(spark, d, "chunks"), "partial")


_FAILING = r"""
    with deleted as (
        select table_name, rid from (
            select table_name, lower(trim(record_id, e' \t\r\n')) as rid, op, row_number() over (partition by table_name, lower(trim(record_id, e' \t\r\n')) order by op_at desc, log_id desc) as k
            from catalog_log where op in ('delete', 'restore')) where k = 1 and op = 'delete'),
    parents as (
        select 'documents' as t, lower(trim(id, e' \t\r\n')) as rid, min(ingested_at) as at from documents group by 2
        union all select 'sections', lower(trim(id, e' \t\r\n')), min(loaded_at) from sections group by 2),
    refs as (
        select 'sections.document_id' as ref_field, 'documents' as t, id as row_id, lower(trim(document_id, e' \t\r\n')) as rid, min(loaded_at) as at from sections group by id, 4
        union all select 'chunks.document_id', 'documents', id, lower(trim(document_id, e' \t\r\n')), min(loaded_at) from chunks group by id, 4
        union all select 'chunks.section_id', 'sections', id, lower(trim(section_id, e' \t\r\n')), min(loaded_at) from chunks group by id, 4),
    failing as (
        select r.ref_field, r.row_id, strftime(r.at, '%Y-%m') as month,
            case when p.rid is null then 'missing' when x.rid is not null then 'deleted' else 'late' end as reason
        from refs r left join parents p on p.t = r.t and p.rid = r.rid left join deleted x on x.table_name = r.t and x.rid = r.rid
        where r.rid <> '' and (p.rid is null or x.rid is not null or p.at > r.at))
"""

SQL = {
    "p1_found": _FAILING + "select distinct ref_field, row_id from failing",
    "p1_report": _FAILING + "select ref_field, month, reason, count(*) as n from failing group by all",
    "p1_composite": r"""
        with c as (
            select id, nullif(lower(trim(document_id, e' \t\r\n')), '') as d, nullif(lower(trim(section_id, e' \t\r\n')), '') as s, min(loaded_at) as seen from chunks group by 1, 2, 3),
        p as (select distinct lower(trim(document_id, e' \t\r\n')) as d, lower(trim(id, e' \t\r\n')) as s from sections)
        select case when d is null then '-' else 'd' end || case when s is null then '-' else 's' end as null_mask, strftime(seen, '%Y-%m') as month, 'missing' as reason, count(*) as n
        from c where (d is not null or s is not null) and not exists (select 1 from p where (c.d is null or p.d = c.d) and (c.s is null or p.s = c.s))
        group by all""",
}

QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_composite": p1_composite}
