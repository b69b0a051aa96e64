"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.keys import strip
from corpusloom.operators import catalog, chunking, retrieval, structure
from corpusloom.sources import providers
from corpusloom.sources.tables import table


def _docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("raw_markdown is not null")


def _heads(s: SparkSession, d: str) -> DataFrame:
    return structure.headings(_docs(s, d).select(F.col("id").alias("doc"), F.col("raw_markdown").alias("text")))


def _tree(s: SparkSession, d: str) -> DataFrame:
    return structure.section_tree(_heads(s, d))


def _text(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("id"), "text")


def chunk_sections(s: SparkSession, d: str) -> DataFrame:
    return chunking.section_chunks(_heads(s, d).withColumn("node", F.when(F.col("ordinal") < 0, "root").otherwise(F.col("ordinal").cast("string"))))


def chunk_enriched(s: SparkSession, d: str) -> DataFrame:
    tree = _tree(s, d).select("doc", F.col("ordinal").cast("string").alias("node"), "path", "title")
    return chunking.with_metadata(chunk_sections(s, d), tree).select("chunk_id", "section_path", "section_title", F.md5("enriched_content").alias("enriched"))


def context_lookup(s: SparkSession, d: str) -> DataFrame:
    sec = catalog.latest(table(s, d, "sections"), "id", "loaded_at")
    return retrieval.context(sec.select("id", "document_id", "path"), sec)


def delete_cascade(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    a, b, c = catalog.delete_cascade(docs.select("id"), table(s, d, "sections").select("document_id"), table(s, d, "chunks").select("document_id"), docs.where("source_type = 'email'").select("id"))
    n = F.count(F.lit(1)).alias("n")
    return a.select(F.lit("documents").alias("t"), "id").groupBy("t").agg(n).unionByName(b.groupBy(F.lit("sections").alias("t")).agg(n)).unionByName(c.groupBy(F.lit("chunks").alias("t")).agg(n))


def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    one = [table(s, d, t).agg(F.count(F.lit(1)).alias(t)) for t in ("documents", "sections", "chunks")]
    meta = table(s, d, "corpus_meta").where("meta_key = 'embedding_model'").agg(F.coalesce(F.max("meta_value"), F.lit("unknown")).alias("embedding_model"))
    return one[0].join(one[1]).join(one[2]).join(meta)


QUERIES = {
    "doc_list_page": lambda s, d: catalog.list_documents(table(s, d, "documents").select("id", "name", "source_type", "ingested_at"), "file", 20, 10).select("id", "name"),
    "doc_lookup": lambda s, d: table(s, d, "documents").where("doc_id = 15").select("doc_id", "name", "source_type"),
    "corpus_stats": corpus_stats,
    "section_counts": lambda s, d: table(s, d, "sections").groupBy("document_id").agg(F.count_distinct("id").alias("n")),
    "chunk_counts": lambda s, d: table(s, d, "chunks").groupBy("document_id").agg(F.count_distinct("id").alias("n")),
    "token_estimate": lambda s, d: table(s, d, "documents").select("doc_id", chunking.token_estimate("text").alias("tokens")),
    "preview": lambda s, d: table(s, d, "chunks").select("id", F.when(F.length("content") > 300, F.concat(F.substring("content", 1, 300), F.lit("..."))).otherwise(F.col("content")).alias("preview")).distinct(),
    "suffix_filter": lambda s, d: table(s, d, "documents").where(providers.suffix("source_path").isin(*providers.SUFFIXES)).select("doc_id", "source_path"),
    "enriched_text": lambda s, d: table(s, d, "sections").select("id", chunking.enriched_text(F.col("path"), F.col("title"), F.col("semantic_type"), F.col("summary"), F.col("key_terms"), F.col("content")).alias("enriched")).distinct(),
    "section_tree": lambda s, d: _tree(s, d).select("doc", "ordinal", "level", "title", "start_line", "end_line", "parent_ordinal", "position", "path"),
    "outline": lambda s, d: structure.outline(_tree(s, d)),
    "outline_content": lambda s, d: structure.outline(_tree(s, d), True),
    "at_path": lambda s, d: structure.at_path(_tree(s, d), "1.1").select("doc", "ordinal", "title"),
    "tree_json": lambda s, d: structure.nested(_docs(s, d).select(F.col("id").alias("doc"), F.col("raw_markdown").alias("text"))),
    "leaves": lambda s, d: structure.leaves(_tree(s, d), _heads(s, d)),
    "siblings": lambda s, d: structure.siblings(_tree(s, d)),
    "chunk_sections": chunk_sections,
    "chunk_unstructured": lambda s, d: chunking.unstructured_chunks(table(s, d, "documents").select(F.col("id").alias("doc"), "text")),
    "chunk_enriched": chunk_enriched,
    "sections_by_path": lambda s, d: catalog.latest(table(s, d, "sections"), "id", "loaded_at").select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("path").asc_nulls_first(), "id")).alias("place")),
    "chunks_by_index": lambda s, d: catalog.latest(table(s, d, "chunks"), "id", "loaded_at").select("document_id", "id", F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("chunk_index").asc_nulls_first(), "id")).alias("place")),
    "document_listing": lambda s, d: catalog.listing(table(s, d, "documents")),
    "detection_dimension": lambda s, d: table(s, d, "chunks").where("embedding is not null").groupBy(F.size("embedding").alias("dimension")).agg(F.count_distinct("id").alias("n")),
    "bm25_or": lambda s, d: retrieval.ranked(retrieval.bm25(_text(s, d), ["quantum", "crystal"]), 20),
    "bm25_and": lambda s, d: retrieval.ranked(retrieval.bm25(_text(s, d), ["quantum", "crystal"], "and"), 20),
    "bm25_not": lambda s, d: retrieval.ranked(retrieval.bm25(_text(s, d), ["quantum"], "or", ["crystal"]), 20),
    "phrase": lambda s, d: retrieval.phrase(_text(s, d), ["without", "further", "notice"]),
    "prefix": lambda s, d: retrieval.prefix(_text(s, d), "quant"),
    "export_json": lambda s, d: catalog.export(table(s, d, "documents")),
    "export_markdown": lambda s, d: catalog.export(table(s, d, "documents"), True),
    "context_lookup": context_lookup,
    "pdf_route": lambda s, d: catalog.pdf_route(table(s, d, "pdf_detections")).groupBy("route", "reason").agg(F.count(F.lit(1)).alias("n")),
    "latest_sections": lambda s, d: catalog.latest(table(s, d, "sections").select("id", "loaded_at"), "id", "loaded_at"),
    "delete_cascade": delete_cascade,
    "cache_key": lambda s, d: table(s, d, "documents").select("doc_id", F.md5(F.lower(strip("title"))).alias("k")),
}

_BM25 = """
    with t as (select doc_id as id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as t from documents where text is not null),
    l as (select id, len(t) as len, len(list_filter(t, lambda x: x = 'quantum')) as f0, len(list_filter(t, lambda x: x = 'crystal')) as f1 from t),
    st as (select count(*) as n, avg(len) as av, count(*) filter (f0 > 0) as n0, count(*) filter (f1 > 0) as n1 from l),
    sc as (select id, round(
        (case when f0 > 0 then greatest(ln((n - n0 + 0.5) / (n0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * len / av)) else 0 end) + {second}, 9) as score
        from l, st where {where}),
    txt as (select id, score, cast(row_number() over (order by score desc, id) as int) as rank from sc qualify rank <= {k})
"""
_SECOND = "(case when f1 > 0 then greatest(ln((n - n1 + 0.5) / (n1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * len / av)) else 0 end)"
_OR = _BM25.format(second=_SECOND, where="f0 > 0 or f1 > 0", k=20)

SQL = {
    "doc_list_page": "select id, name from (select * from documents where source_type = 'file' order by ingested_at desc, id limit 20 offset 10)",
    "doc_lookup": "select doc_id, name, source_type from documents where doc_id = 15",
    "corpus_stats": "select (select count(*) from documents) as documents, (select count(*) from sections) as sections, (select count(*) from chunks) as chunks, (select coalesce(max(meta_value), 'unknown') from corpus_meta where meta_key = 'embedding_model') as embedding_model",
    "section_counts": "select document_id, count(distinct id) as n from sections group by 1",
    "chunk_counts": "select document_id, count(distinct id) as n from chunks group by 1",
    "token_estimate": "select doc_id, cast(length(text) // 4 as int) as tokens from documents",
    "preview": "select distinct id, case when length(content) > 300 then substr(content, 1, 300) || '...' else content end as preview from chunks",
    "suffix_filter": r"select doc_id, source_path from documents where lower(regexp_extract(source_path, '(\.[^./]+)$', 1)) in ('.pdf', '.docx', '.doc', '.pptx', '.ppt', '.xlsx', '.xls', '.odt', '.odp', '.ods', '.png', '.jpg', '.jpeg', '.md', '.txt')",
    "enriched_text": r"""select distinct id, concat_ws(e'\n', 'Section: ' || nullif(path, '') || ' - ' || nullif(title, ''), 'Type: ' || nullif(semantic_type, ''), 'Summary: ' || nullif(summary, ''),
        case when len(key_terms) > 0 then 'Key Terms: ' || array_to_string(key_terms, ', ') end, '', 'Content:', content) as enriched from sections""",
    "bm25_or": _OR + "select * from txt",
    "bm25_and": _BM25.format(second=_SECOND, where="f0 > 0 and f1 > 0", k=20) + "select * from txt",
    "bm25_not": _BM25.format(second="0", where="f0 > 0 and f1 = 0", k=20) + "select * from txt",
    "phrase": r"select doc_id as id from documents where contains(' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') || ' ', ' without further notice ')",
    "prefix": r"select doc_id as id from documents where len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: starts_with(x, 'quant'))) > 0",
    "pdf_route": """select case when pdf_type = 'text_based' and not ocr_recommended and confidence >= 0.9 then 'local_extraction' else 'vlm' end as route,
        case when pdf_type is distinct from 'text_based' then 'pdf_type=' || coalesce(pdf_type, 'unknown') when coalesce(ocr_recommended, true) then 'ocr_recommended=true'
        when confidence >= 0.9 then 'text_based with confidence ' || printf('%.2f', confidence) || ' >= 0.90' else 'confidence ' || coalesce(printf('%.2f', confidence), 'unknown') || ' < 0.90' end as reason, count(*) as n from pdf_detections group by all""",
    "latest_sections": "select id, max(loaded_at) as loaded_at from sections group by 1",
    "delete_cascade": """with g as (select id from documents where source_type = 'email') select 'documents' as t, count(*) as n from documents where id not in (from g)
        union all select 'sections', count(*) from sections s where not exists (select 1 from g where g.id = s.document_id) union all select 'chunks', count(*) from chunks s where not exists (select 1 from g where g.id = s.document_id)""",
    "cache_key": "select doc_id, md5(lower(trim(title, e' \t\n\r\f\v\u00a0'))) as k from documents",
}

_LINES = r"""lines as (select id as doc, unnest(string_split(raw_markdown, chr(10))) as line, generate_subscripts(string_split(raw_markdown, chr(10)), 1) - 1 as no, len(string_split(raw_markdown, chr(10))) as total from documents where raw_markdown is not null),
    ticks as (select *, (length(line) - length(replace(line, '```', ''))) // 3 as own, sum((length(line) - length(replace(line, '```', ''))) // 3) over (partition by doc order by no) as upto, sum((length(line) - length(replace(line, '```', ''))) // 3) over (partition by doc) as every from lines),
    heads as (select doc, no, total, length(regexp_extract(line, '^(#{1,6})[ \t\r\f\v]+(.+)$', 1)) as level, trim(regexp_extract(line, '^(#{1,6})[ \t\r\f\v]+(.+)$', 2), e' \t\r\n\f\v') as title,
        row_number() over (partition by doc order by no) - 1 as ordinal, lead(no) over (partition by doc order by no) as next
        from ticks where regexp_matches(line, '^(#{1,6})[ \t\r\f\v]+(.+)$') and not ((upto - own) % 2 = 1 and every > upto - own)),
    up as (select h.*, (select max(p.ordinal) from heads p where p.doc = h.doc and p.ordinal < h.ordinal and p.level < h.level) as parent from heads h),
    placed as (select *, row_number() over (partition by doc, parent order by ordinal) as place from up),
    tree as (select doc, ordinal, cast(place as varchar) as path from placed where parent is null union all select p.doc, p.ordinal, t.path || '.' || p.place from tree t join placed p on p.doc = t.doc and p.parent = t.ordinal),
    sec as (select p.doc, cast(p.ordinal as int) as ordinal, cast(p.level as int) as level, p.title, cast(p.no as int) as start_line, cast(coalesce(p.next, p.total) as int) as end_line, cast(p.parent as int) as parent_ordinal, cast(p.place - 1 as int) as position, t.path
        from placed p join tree t on t.doc = p.doc and t.ordinal = p.ordinal)"""
_WITH = "with recursive " + _LINES
_LATEST_SECTIONS = "l as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last) as k from sections) where k = 1)"

SQL |= {
    "section_tree": f"{_WITH} select * from sec",
    "outline": f"{_WITH} select doc, string_agg(repeat(' ', 2 * (level - 1)) || path || '. ' || title, chr(10) order by ordinal) as outline from sec group by 1",
    "outline_content": f"""{_WITH}, body as (select s.*, trim((select string_agg(line, chr(10) order by no) from lines l where l.doc = s.doc and l.no > s.start_line and l.no < s.end_line), e' \\t\\r\\n\\f\\v') as content from sec s)
        select doc, string_agg(repeat(' ', 2 * (level - 1)) || path || '. ' || title || case when length(content) > 0 then chr(10) || repeat(' ', 2 * (level - 1)) || '   [' || replace(substr(content, 1, 100), chr(10), ' ') || '...]' else '' end, chr(10) order by ordinal) as outline from body group by 1""",
    "at_path": f"{_WITH} select doc, ordinal, title from sec where path = '1.1'",
    "leaves": f"""{_WITH} select doc, ordinal, path from sec s where not exists (select 1 from sec c where c.doc = s.doc and c.parent_ordinal = s.ordinal)
        union all select id, -1, '' from documents where raw_markdown is not null and id not in (select doc from sec)""",
    "siblings": f"{_WITH} select a.doc, a.ordinal, b.ordinal as sibling from sec a join sec b on a.doc = b.doc and a.parent_ordinal is not distinct from b.parent_ordinal and a.ordinal <> b.ordinal",
    "context_lookup": f"""with {_LATEST_SECTIONS},
        d as (select distinct document_id, path as sp, title, nullif(summary, '') as summary from l),
        r as (select id, document_id, path, regexp_replace(path, '\\.[^.]*$', '') as up from l where contains(path, '.'))
        select r.id, r.path, (select min(summary) from d where d.document_id = r.document_id and d.sp = r.up) as parent_summary,
            (select string_agg(title, '; ' order by title, sp) from (select distinct title, sp from d where d.document_id = r.document_id and starts_with(d.sp, r.up || '.') and d.sp <> r.path)) as sibling_titles from r""",
    "sections_by_path": f"with {_LATEST_SECTIONS} select document_id, id, cast(row_number() over (partition by document_id order by path nulls first, id) as int) as place from l",
    "chunks_by_index": "with l as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last) as k from chunks) where k = 1) select document_id, id, cast(row_number() over (partition by document_id order by chunk_index nulls first, id) as int) as place from l",
    "document_listing": "select substr(id, 1, 12) as id, substr(name, 1, 40) as name, source_type, ingested_at from documents",
    "detection_dimension": "select cast(len(embedding) as int) as dimension, count(distinct id) as n from chunks where embedding is not null group by 1",
    "export_json": "select id, cast(to_json({'id': id, 'name': name, 'source_type': source_type, 'title': title, 'author': author, 'tags': tags, 'section_count': section_count, 'chunk_count': chunk_count, 'token_count': token_count}) as varchar) as text from documents",
    "export_markdown": "select id, raw_markdown as text from documents",
}
