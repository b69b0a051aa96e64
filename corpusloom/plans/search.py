"""Queries of text, vector and hybrid search over chunks and documents, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import catalog, fulltext, retrieval
from corpusloom.sources.tables import table


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return catalog.latest(table(s, d, "chunks"), "id", "loaded_at")


def _fts(query: str, limit: int = 20):
    def run(s: SparkSession, d: str) -> DataFrame:
        return fulltext.search(_chunks(s, d), "id", retrieval.FTS_COLUMNS, [query], limit).select("id", "score", "rank")

    return run


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))


def chunk_vector_topk(s: SparkSession, d: str) -> DataFrame:
    """The chunks of all documents whose number is divisible by 20 ask all chunks."""
    rows = _chunks(s, d).select("id", "document_id", F.col("embedding").alias("v"))
    docs = table(s, d, "documents").where("doc_id % 20 = 0").select(F.col("id").alias("document_id"))
    asked = rows.join(docs, "document_id", "left_semi").select(F.col("id").alias("qid"), F.col("v").alias("q")).where("size(q) = 64")
    return retrieval.vector_search(rows.select("id", "v"), asked, 10)


def _question(s: SparkSession, d: str, n: int = 1) -> DataFrame:
    """The embeddings of the first usable chunks stand for those of a question and its variants."""
    usable = "size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = float('infinity')) and exists(embedding, x -> x <> 0)"
    first = _chunks(s, d).where(usable).select("id", "embedding").orderBy("id").limit(n)
    rank = F.rank().over(retrieval.Window.orderBy("id")) - 1
    return first.select(rank.alias("qid"), F.col("embedding").alias("q"))


def _hybrid(types: list[str] | None = None, w: float = 1.0):
    def run(s: SparkSession, d: str) -> DataFrame:
        return retrieval.hybrid_search(_chunks(s, d), table(s, d, "documents"), "quantum OR crystals", _question(s, d), 20, w, 1.0, types).drop("section_summary")

    return run


def expanded_hybrid(s: SparkSession, d: str) -> DataFrame:
    queries = ["quantum OR crystals", "quantum OR crystals", "quantum crystals", "magnetic AND", "field"]  # the fourth is not of the language
    return retrieval.expanded_search(_chunks(s, d), table(s, d, "documents"), queries, _question(s, d, 3), 20).drop("section_summary")


def search_documents(s: SparkSession, d: str) -> DataFrame:
    return retrieval.search_documents(table(s, d, "documents"), "quantum crystals").select("id", "name", "score", "rank")


QUERIES = {
    "fts_or": _fts("quantum OR crystals"),
    "fts_and": _fts("quantum crystals"),
    "fts_not": _fts("quantum NOT crystals"),
    "fts_column": _fts("content : quantum AND section_title : review"),
    "fts_phrase": _fts('"without further notice"'),
    "fts_prefix": _fts("quant*"),
    "fts_near": _fts("NEAR(quantum field, 5)"),
    "fts_grouping": _fts("(quantum OR field) NOT (crystals AND content : quantum)"),
    "search_documents": search_documents,
    "vector_topk": lambda s, d: retrieval.vector_search(_vectors(s, d), _asked(s, d), 20),
    "chunk_vector_topk": chunk_vector_topk,
    "merge_variants": lambda s, d: retrieval.merge_variants(retrieval.vector_search(_vectors(s, d), _asked(s, d), 20).withColumnRenamed("qid", "variant")),
    "hybrid_chunks": _hybrid(),
    "hybrid_weighted": _hybrid(None, 2.0),
    "hybrid_semantic_filter": _hybrid(["definitions", "obligations", "procedures", "requirements", "exceptions", "rights", "other"]),
    "expanded_hybrid": expanded_hybrid,
}

_LATEST = "latest as (select * from (select *, row_number() over (partition by id order by loaded_at desc nulls last) as k from chunks) where k = 1)"
#: Words of these tables that share a stem with the query's words.
_FORMS = {"quantum": ("quantum",), "crystal": ("crystal", "crystals"), "field": ("field", "fields"), "review": ("review", "reviews", "reviewed"), "notice": ("notice", "notices", "noticed"), "further": ("further",), "without": ("without",)}


def _tokens(column: str) -> str:
    return rf"coalesce(list_filter(regexp_split_to_array(lower(strip_accents({column})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), [])"


def _is(x: str, word: str) -> str:
    return f"{x} in ({', '.join(repr(w) for w in _FORMS[word])})"


def _count(word: str, columns=("c0", "c1", "c2")) -> str:
    return " + ".join(f"len(list_filter({c}, lambda x: {_is('x', word)}))" for c in columns)


def _near(a: str, b: str, n: int) -> str:
    def one(c: str) -> str:
        at = f"list_filter(range(1, len({c}) + 1), lambda i: {_is(f'{c}[i]', a)})"
        other = f"list_filter(range(1, len({c}) + 1), lambda j: {_is(f'{c}[j]', b)})"
        return f"len(list_filter({at}, lambda i: len(list_filter({other}, lambda j: abs(i - j) - 1 <= {n})) > 0))"

    return " + ".join(one(c) for c in ("c0", "c1", "c2"))


def _phrase(*words: str) -> str:
    def one(c: str) -> str:
        return f"len(list_filter(range(1, len({c}) + 1), lambda i: {' and '.join(_is(f'coalesce({c}[i + {k}], '')', w) for k, w in enumerate(words))}))"

    return " + ".join(one(c) for c in ("c0", "c1", "c2"))


def _bm25(frequencies: list[str], where: str, limit: int = 20, occurs: list[str] | None = None, columns=tuple(retrieval.FTS_COLUMNS), source: str = "latest", name: str = "txt") -> str:
    """CTEs that end in *name* (id, score, rank); *occurs* are frequencies for the document counts where these differ."""
    n = range(len(frequencies))
    parts = " + ".join(f"case when f{i} > 0 then greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * size / av)) else 0 end" for i in n)
    return f"""{name}_t as (select id, {", ".join(f"{_tokens(c)} as c{i}" for i, c in enumerate(columns))} from {source}),
        {name}_f as (select id, {" + ".join(f"len(c{i})" for i in range(len(columns)))} as size, {", ".join(f"{f} as f{i}" for i, f in enumerate(frequencies))}, {", ".join(f"{f} as o{i}" for i, f in enumerate(occurs or frequencies))} from {name}_t),
        {name}_s as (select count(*) as n, avg(size) as av, {", ".join(f"count(*) filter (o{i} > 0) as n{i}" for i in n)} from {name}_f),
        {name}_r as (select id, round({parts}, 9) as score from {name}_f, {name}_s where {where}),
        {name} as (select id, score, cast(row_number() over (order by score desc, id) as int) as rank from {name}_r qualify rank <= {limit})"""


_USABLE = "len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
_COSINE = "round(coalesce(if(isnan(list_cosine_similarity(a.e, b.e)), 0, list_cosine_similarity(a.e, b.e)), 0), 6)"


def _vector(questions: int, limit: int) -> str:
    """CTE ``near`` (qid, id, score, rank) for the first usable chunks as questions."""
    return f"""v as (select id, embedding::double[] as e from latest where {_USABLE}),
        ask as (select id, e, row_number() over (order by id) - 1 as qid from v where len(list_filter(e, lambda x: x <> 0)) > 0 order by id limit {questions}),
        near as (select qid, b.id, {_COSINE} as score, cast(row_number() over (partition by qid order by {_COSINE} desc, b.id) as int) as rank
            from ask a, v b where {_COSINE} >= 0.25 qualify rank <= {limit})"""


def _hydrated(w: float = 1.0, types: str | None = None, text: str = "txt", vec: str = "near") -> str:
    where = f" where semantic_type in ({types})" if types else ""
    return f""" , fused as (select coalesce(t.id, v.id) as id, round({w} / (60 + coalesce(t.rank, (select count(*) from {text}) + 100)) + 1.0 / (60 + coalesce(v.rank, (select count(*) from {vec}) + 100)), 9) as score,
            t.score as text_score, t.rank as text_rank, v.score as vector_score, v.rank as vector_rank from {text} t full join {vec} v on t.id = v.id order by score desc, id limit 40)
        select f.id, c.document_id, d.name as document_name, c.section_path, c.section_title, c.semantic_type,
            case when length(coalesce(c.content, '')) > 300 then substr(c.content, 1, 300) || '...' else coalesce(c.content, '') end as preview, f.score, text_score, text_rank, vector_score, vector_rank
        from fused f join latest c on c.id = f.id join documents d on d.id = c.document_id{where} order by f.score desc, f.id limit 20"""


_Q, _C, _F = _count("quantum"), _count("crystal"), _count("field")
_QC = _bm25([_Q, _C], "f0 > 0 or f1 > 0", 40)
_ALL = "select * from txt"
_TOP = "round(list_cosine_similarity(e.embedding::double[], q.embedding::double[]), 6)"
_VEC = f"""vec as (select q.vec_id as qid, e.vec_id as id, {_TOP} as score, cast(row_number() over (partition by q.vec_id order by {_TOP} desc, e.vec_id) as int) as rank
        from embeddings e, embeddings q where q.vec_id % 20 = 0 and {_TOP} >= 0.25 qualify rank <= 20)"""
_VARIANTS = ", ".join([
    _bm25([_Q, _C], "f0 > 0 or f1 > 0", name="t0"), _bm25([_Q, _C], "f0 > 0 and f1 > 0", name="t1"), _bm25([_F], "f0 > 0", name="t2"),
    "merged as (select id, score, rank from (select *, 0 as q from t0 union all select *, 2 from t1 union all select *, 4 from t2) qualify row_number() over (partition by id order by score desc, q) = 1)",
    _vector(3, 20), "best as (select id, score, rank from near qualify row_number() over (partition by id order by score desc, qid) = 1)",
])

SQL = {
    "fts_or": f"with {_LATEST}, {_bm25([_Q, _C], 'f0 > 0 or f1 > 0')} {_ALL}",
    "fts_and": f"with {_LATEST}, {_bm25([_Q, _C], 'f0 > 0 and f1 > 0')} {_ALL}",
    "fts_not": f"with {_LATEST}, {_bm25([_Q, '0'], 'f0 > 0 and o1 = 0', occurs=[_Q, _C])} {_ALL}",
    "fts_column": f"with {_LATEST}, {_bm25([_count('quantum', ('c0',)), _count('review', ('c2',))], 'f0 > 0 and f1 > 0')} {_ALL}",
    "fts_phrase": f"with {_LATEST}, {_bm25([_phrase('without', 'further', 'notice')], 'f0 > 0')} {_ALL}",
    "fts_prefix": f"with {_LATEST}, {_bm25([' + '.join(f'''len(list_filter({c}, lambda x: starts_with(x, 'quant')))''' for c in ('c0', 'c1', 'c2'))], 'f0 > 0')} {_ALL}",
    "fts_near": f"with {_LATEST}, {_bm25([_near('quantum', 'field', 5), _near('field', 'quantum', 5)], 'f0 > 0', occurs=[_Q, _F])} {_ALL}",
    "fts_grouping": f"with {_LATEST}, {_bm25([_Q, _F, '0', '0'], '(f0 > 0 or f1 > 0) and not (o2 > 0 and o3 > 0)', occurs=[_Q, _F, _C, _count('quantum', ('c0',))])} {_ALL}",
    "search_documents": f"""with {_bm25([_Q, _C], "f0 > 0 and f1 > 0", columns=("name", "title", "raw_markdown"), source="documents")} select t.id, d.name, -score as score, rank from txt t join documents d on d.id = t.id""",
    "vector_topk": f"with {_VEC} select * from vec",
    "merge_variants": f"with {_VEC} select id, score, rank from vec qualify row_number() over (partition by id order by score desc, qid) = 1",
    "chunk_vector_topk": f"""with {_LATEST}, v as (select id, document_id, embedding::double[] as e from latest where {_USABLE}),
        ask as (select v.* from v join (select distinct id from documents where doc_id % 20 = 0) d on d.id = v.document_id)
        select a.id as qid, b.id, {_COSINE} as score, cast(row_number() over (partition by a.id order by {_COSINE} desc, b.id) as int) as rank
        from ask a, v b where {_COSINE} >= 0.25 qualify rank <= 10""",
    "hybrid_chunks": f"with {_LATEST}, {_QC}, {_vector(1, 40)} {_hydrated()}",
    "hybrid_weighted": f"with {_LATEST}, {_QC}, {_vector(1, 40)} {_hydrated(2.0)}",
    "hybrid_semantic_filter": f"""with {_LATEST}, {_QC}, {_vector(1, 40)} {_hydrated(1.0, "'definitions', 'obligations', 'procedures', 'requirements', 'exceptions', 'rights', 'other'")}""",
    "expanded_hybrid": f"with {_LATEST}, {_VARIANTS} {_hydrated(1.0, None, 'merged', 'best')}",
}
