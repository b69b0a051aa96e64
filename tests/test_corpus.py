import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog, chunking, retrieval, structure
from corpusloom.plans import corpus


def _stack(levels):
    """Parents and paths by a stack machine."""
    stack, kids, out = [], {}, []
    for i, n in enumerate(levels):
        while stack and stack[-1][1] >= n:
            stack.pop()
        parent = stack[-1][0] if stack else None
        pos = kids.get(parent, 0)
        kids[parent] = pos + 1
        path = (out[parent][2] + "." if parent is not None else "") + str(pos + 1)
        out.append((parent, pos, path))
        stack.append((i, n))
    return out


def test_tree_equals_stack_machine(spark):
    rng = random.Random(4)
    docs = {f"d{k}": [rng.randint(1, 6) for _ in range(rng.randint(1, 14))] for k in range(60)}
    df = spark.createDataFrame([(d, "\n".join("#" * n + f" t{i}\nbody" for i, n in enumerate(v))) for d, v in docs.items()], "doc string, text string")
    got = {}
    for r in structure.section_tree(structure.headings(df)).collect():
        got[r.doc, r.ordinal] = (r.parent_ordinal, r.position, r.path)
    want = {(d, i): x for d, v in docs.items() for i, x in enumerate(_stack(v))}
    assert got == want


def test_lexer_edges():
    assert [r[0] for r in structure.lex("no heading")] == [-1]
    rows = list(structure.lex("lead\n\n# A\n```\n# code\n```\n#\nB\n####### no\n#x\n"))
    assert [(r[0], r[1], r[2]) for r in rows] == [(-1, 0, "Document Root"), (0, 1, "A"), (1, 1, "B")]
    assert rows[1][4:] == (2, 6)
    assert list(structure.lex(""))[0][3] == ""


def test_packer():
    assert chunking.pack("", 10, 2) == [""]
    assert chunking.pack("aaaa\n\nbbbb", 1, 0) == ["aaaa", "bbbb"]
    assert chunking.pack("a" * 8 + "\n\n" + "b" * 8 + "\n\n" + "c" * 8, 4, 3) == ["a" * 8 + "\n\n" + "b" * 8, "b" * 8 + "\n\n" + "c" * 8]
    assert chunking.pack("x" * 50, 4, 2) == ["x" * 50]


def test_zero_norm_and_fusion(spark):
    v = spark.createDataFrame([("a", [0.0, 0.0]), ("b", [6.0, 8.0]), ("c", [4.0, -3.0])], "id string, v array<double>")
    q = spark.createDataFrame([(0, [3.0, 4.0])], "qid int, q array<double>")
    assert [(r.id, r.score) for r in retrieval.vector_search(v, q, 5, 0.0).orderBy("rank").collect()] == [("b", 1.0), ("a", 0.0), ("c", 0.0)]
    t = spark.createDataFrame([("a", 2.0, 1)], "id string, score double, rank int")
    w = spark.createDataFrame([("b", 0.9, 1)], "id string, score double, rank int")
    got = [(r.id, r.score) for r in retrieval.fuse(t, w, 5).collect()]
    assert [(r.text_rank, r.vector_score) for r in retrieval.fuse(t, w, 5).collect()] == [(1, None), (None, 0.9)]
    assert got == [("a", round(1 / 61 + 1 / 161, 9)), ("b", round(1 / 61 + 1 / 161, 9))]


def test_vector_search_leaves_out_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 0.0]), ("b", [nan, 1.0]), ("c", [inf, 1.0]), ("d", [1.0]), ("e", None), ("f", []), (None, [1.0, 0.0]), ("g", [1.0, 0.1]), ("a2", [2.0, 0.0])]
    v = spark.createDataFrame(rows, "id string, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [nan, 0.0]), (2, None), (3, [0.0, 0.0])], "qid int, q array<double>")
    got = retrieval.vector_search(v, q, 2).collect()
    assert [(r.qid, r.id, r.score, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, "a", 1.0, 1), (0, "a2", 1.0, 2)]
    many = retrieval.vector_search(v, spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "qid int, q array<double>"), 5, -1.0, block=2)
    assert many.count() == 7 * 3
    assert retrieval.vector_search(v.limit(0), q, 2).count() == 0 and retrieval.vector_search(v, q.limit(0), 2).count() == 0


def test_hybrid_filter_comes_after_the_cut(spark):
    rows = [(f"c{i}", "d1" if i else "gone", f"apple {'pear ' * i}", "apple", None, "kind" if i % 2 else None, [1.0, float(i)], "1", None) for i in range(6)]
    chunks = spark.createDataFrame(rows, "id string, document_id string, content string, enriched_content string, section_title string, semantic_type string, embedding array<double>, section_path string, section_summary string")
    docs = spark.createDataFrame([("d1", "Doc")], "id string, name string")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid int, q array<double>")
    every = [r.id for r in retrieval.hybrid_search(chunks, docs, "apple", q, 10).collect()]
    assert "c0" not in every and set(every) == {f"c{i}" for i in range(1, 6)}
    some = retrieval.hybrid_search(chunks, docs, "apple", q, 10, semantic_types=["kind"]).collect()
    assert {r.id for r in some} == {"c1", "c3", "c5"} and some[0].document_name == "Doc"
    assert retrieval.hybrid_search(chunks, docs, "apple", q, 1, semantic_types=["kind"]).count() <= 1
    wide = retrieval.expanded_search(chunks, docs, ["apple", "apple AND", "pear"], q, 10)
    assert {r.id for r in wide.collect()} == set(every)


def test_pdf_routes(spark):
    rows = spark.createDataFrame([("text_based", 0.97, False), ("text_based", 0.65, False), ("text_based", 0.98, True), ("scanned", 0.99, True), (None, None, None), ("text_based", None, False), ("text_based", float("nan"), False)], "pdf_type string, confidence double, ocr_recommended boolean")
    assert [r.route + "/" + r.reason for r in catalog.pdf_route(rows).collect()] == [
        "local_extraction/text_based with confidence 0.97 >= 0.90", "vlm/confidence 0.65 < 0.90", "vlm/ocr_recommended=true", "vlm/pdf_type=scanned", "vlm/pdf_type=unknown", "vlm/confidence unknown < 0.90", "vlm/confidence unknown < 0.90",
    ]


def test_latest_upsert_delete(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z"), (None, 1, "n")], "id string, at int, v string")
    assert {(r.id, r.v) for r in catalog.latest(rows, "id", "at").collect()} == {("a", "y"), ("b", "z"), (None, "n")}
    base = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "id string, v int")
    change = spark.createDataFrame([("b", 9), ("c", 4)], "id string, v int")
    assert {tuple(r) for r in catalog.upsert(base, change, "id").collect()} == {("a", 1), ("b", 9), ("c", 4), (None, 3)}
    with pytest.raises(Exception, match="changed twice"):
        catalog.upsert(base, change.unionByName(change), "id").collect()
    docs, parts = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",), ("b",), (None,)], "document_id string")
    left = catalog.delete_cascade(docs, parts, parts, docs.where("id = 'a'"))
    assert [x.count() for x in left] == [1, 2, 2]


def test_outline_leaves_nested(spark):
    text = "lead\n# A\nbody of\na\n## B\n# C\n"
    docs = spark.createDataFrame([("d", text), ("e", "no heading"), ("f", None)], "doc string, text string")
    heads = structure.headings(docs)
    tree = structure.section_tree(heads)
    assert {r.doc: r.outline for r in structure.outline(tree).collect()} == {"d": "1. A\n  1.1. B\n2. C"}
    assert structure.outline(tree, True).first().outline == "1. A\n   [body of a...]\n  1.1. B\n2. C"
    assert {(r.doc, r.ordinal, r.path) for r in structure.leaves(tree, heads).collect()} == {("d", 1, "1.1"), ("d", 2, "2"), ("e", -1, "")}
    assert {(r.ordinal, r.sibling) for r in structure.siblings(tree).collect()} == {(0, 2), (2, 0)}
    assert structure.at_path(tree, "1.1").first().title == "B"
    nested = {r.doc: json.loads(r.tree) for r in structure.nested(docs).collect()}
    assert nested["d"]["content"] == "lead" and [c["path"] for c in nested["d"]["children"]] == ["1", "2"] and nested["d"]["children"][0]["children"][0]["id"] == "d_1"
    assert nested["e"]["content"] == "no heading" and nested["e"]["children"] == []


def test_chunks_of_sections(spark):
    long = "\n\n".join(["w" * 3000] * 5)
    docs = spark.createDataFrame([("d", f"intro\n# A\n{long}\n# B\n \n# C\nend")], "doc string, text string")
    heads = structure.headings(docs).withColumn("node", F.when(F.col("ordinal") < 0, "root").otherwise(F.col("ordinal").cast("string")))
    got = chunking.section_chunks(heads).orderBy("chunk_index").collect()
    assert [(r.chunk_id, r.node, r.chunk_index) for r in got] == [("d_root_0", None, 0), ("d_0_0", "0", 1), ("d_0_1", "0", 2), ("d_0_2", "0", 3), ("d_2_0", "2", 4)]
    assert [(r.char_offset_start, r.char_offset_end) for r in got][1:3] == [(0, 6002), (6002, 12004)]
    tree = structure.section_tree(structure.headings(docs)).select("doc", F.col("ordinal").cast("string").alias("node"), "path", "title", F.array(F.lit("why?")).alias("hypothetical_questions"))
    rich = {r.chunk_id: r for r in chunking.with_metadata(chunking.section_chunks(heads), tree).collect()}
    assert rich["d_root_0"].enriched_content == "intro" and rich["d_2_0"].enriched_content == "Section: 3 - C\nQuestions this section answers:\nQ: why?\n\nContent:\nend"
    loose = chunking.unstructured_chunks(spark.createDataFrame([("d", "a\n\n" + long), ("n", None)], "doc string, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_id for r in loose] == ["d_chunk_0", "d_chunk_1", "d_chunk_2"] and loose[0].char_offset_start == 0


def test_context_lookup_takes_every_dotted_section(spark, tmp_path):
    rows = [("a0", "a", "1", "Top", "sum", "x", 1), ("a1", "a", "1.1", "Old", "", None, 1), ("a1", "a", "1.1", "One", "", None, 2), ("a2", "a", "1.2", "Two", None, "x", 1)]
    rows += [("a3", "a", "1.1.1", "Niece", None, None, 1), ("a4", "a", "10.1", "Far", None, None, 1), ("b1", "b", "1.1", "Other", None, None, 1), ("b0", "b", "1", "Flat", "", None, 1)]
    spark.createDataFrame(rows, "id string, document_id string, path string, title string, summary string, semantic_type string, loaded_at int").write.parquet(f"{tmp_path}/sections.parquet")
    got = {r.id: (r.path, r.parent_summary, r.sibling_titles) for r in corpus.context_lookup(spark, str(tmp_path)).collect()}
    assert got == {"a1": ("1.1", "sum", "Niece; Two"), "a2": ("1.2", "sum", "Niece; One"), "a3": ("1.1.1", None, None), "a4": ("10.1", None, None), "b1": ("1.1", None, None)}
