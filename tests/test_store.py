import json

import pytest

from corpusloom.functions import config
from corpusloom.sources import providers, store


def test_store_versions(spark, tmp_path):
    path = str(tmp_path / "corpus")
    with pytest.raises(FileNotFoundError):
        store.Corpus(spark, path)
    c = store.Corpus.create(spark, path, "intake")
    with pytest.raises(FileExistsError):
        store.Corpus.create(spark, path)
    docs = spark.createDataFrame([("a", "A", "file"), ("b", "B", "url")], "id string, name string, source_type string")
    c.add("documents", docs)
    c.add("sections", spark.createDataFrame([("a_1", "a", "2", "two"), ("a_0", "a", "10", "ten"), ("b_0", "b", "1", "one")], "id string, document_id string, path string, title string"))
    for bad in (docs, docs.where("id = 'x'").unionByName(spark.createDataFrame([("z", "Z", "f")] * 2, docs.schema)), spark.createDataFrame([(None, "Z", "f")], docs.schema)):
        with pytest.raises(ValueError):
            c.add("documents", bad)
    chunks = spark.createDataFrame([("c1", "a", 1, [1.0, 0.0]), ("c0", "a", 0, [])], "id string, document_id string, chunk_index int, embedding array<double>")
    with pytest.raises(ValueError):
        c.add("chunks", chunks)
    assert c.check_model("m1") == "m1" and c.check_model("m1") == "m1"
    with pytest.raises(ValueError):
        c.check_model("m2")
    c.add("chunks", chunks)
    assert [(r.id, r.embedding) for r in c.chunks_of("a").collect()] == [("c0", None), ("c1", [1.0, 0.0])]
    assert [r.path for r in c.sections_of("a").collect()] == ["10", "2"]
    c.update("documents", spark.createDataFrame([("a", "A2"), ("none", "N")], "id string, name string"))
    c.update_enrichment(spark.createDataFrame([("a_1", "short", "X")], "id string, summary string, title string"))
    c.update_embeddings(spark.createDataFrame([("c0", [0.5, 0.5])], "id string, embedding array<double>"))
    assert {(r.id, r.name) for r in c.read("documents").collect()} == {("a", "A2"), ("b", "B")}
    assert c.get("sections", "a_1").first().summary == "short" and c.get("sections", "a_1").first().title == "two"
    assert c.get("chunks", "c0").first().embedding == [0.5, 0.5]
    with pytest.raises(ValueError):
        c.update("documents", spark.createDataFrame([("a", "x"), ("a", "y")], "id string, name string"))
    c.compact("documents")
    c.delete_documents(spark.createDataFrame([("a",)], "id string"))
    again = store.Corpus(spark, path)
    info = again.info()
    assert (info["name"], info["document_count"], info["section_count"], info["chunk_count"], info["embedding_model"]) == ("intake", 1, 1, 0, "m1") and info["size_bytes"] > 0
    c.add("documents", docs.where("id = 'a'"))  # a deleted id is free again
    assert c.read("documents").count() == 2


def test_settings_and_cache(spark, tmp_path):
    c = store.Corpus.create(spark, str(tmp_path / "c"))
    c.set_meta("k", "1")
    c.set_meta("k", "2")
    assert c.get_meta("k") == "2" and c.get_meta("none", "d") == "d" and c.info()["name"] == "c"
    calls = []

    def expand(q):
        calls.append(q)
        return {"lex": ["a b"], "vec": ["c"], "hyde": ""}

    one, two = store.cached_expansion(c, "  What IS\t", expand), store.cached_expansion(c, "what is", expand)
    assert one == two and len(calls) == 1
    assert store.variants("q", one) == (["q", "q", "a b"], ["q", "q", "c"])
    c.set_cache("other", "x", "y")
    assert c.clear_cache("expansion") == 1 and c.get_cache("other", "x") == "y" and c.clear_cache() == 1 and c.clear_cache() == 0


def test_providers(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Ä", encoding="utf-8")
    (tmp_path / "b.PDF").write_bytes(b"%pdf")
    (tmp_path / "c.gif").write_bytes(b"gif")
    (tmp_path / "d.docx").write_bytes(b"zip")
    found = providers.files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: (r.markdown, r.error) for r in providers.convert(found, {".pdf": lambda p, b: b.decode().upper()}).collect()}
    assert got == {"a.md": ("# Ä", None), "b.PDF": ("%PDF", None), "d.docx": (None, "ValueError: Unsupported file type: .docx")}
    pages = spark.createDataFrame([(["one"],), (["one", "two"],)], "pages array<string>")
    assert [r[0] for r in pages.select(providers.merge_pages("pages")).collect()] == ["one", "## Page 1\n\none\n\n---PAGE BREAK---\n\n## Page 2\n\ntwo"]
    sections = spark.createDataFrame([("s1", 1, "1", "T", "x" * 60), ("s2", 1, "2", "bad", "y" * 16_000), ("s3", 1, "3", "small", "  z  "), ("s0", 0, "", "root", "w" * 90), ("s4", 1, "4", "null", None)], "id string, level int, path string, title string, content string")

    def enricher(s):
        if s["title"] == "bad":
            return {"importance_score": 2}
        return {"summary": s["title"], "key_terms": ["k"], "entities": [{"name": "n"}], "importance_score": 0.9}

    rows = {r.id: r for r in providers.enrich(sections, enricher).collect()}
    assert set(rows) == {"s1", "s2"} and rows["s1"].summary == "T" and rows["s1"].entities == [{"name": "n"}] and rows["s1"].error is None
    assert (rows["s2"].summary, rows["s2"].semantic_type, rows["s2"].importance_score) == ("", "other", 0.5) and rows["s2"].error
    texts = spark.createDataFrame([(1, "a"), (2, None), (3, "ccc")], "id long, text string")
    made = providers.embed(texts, lambda t: [[len(x), 1.0] for x in t], "m", "m", 0)
    assert {(r.id, tuple(r.embedding) if r.embedding else None) for r in made.collect()} == {(1, (1.0, 1.0)), (2, None), (3, (3.0, 1.0))}
    assert providers.dimension(made) == 2 and providers.dimension(made.limit(0)) is None
    with pytest.raises(ValueError):
        providers.embed(texts, len, "m", "other")


def test_detector_payloads():
    good = {"pdf_type": "text_based", "confidence": 1, "ocr_recommended": False, "page_count": 2, "pages_needing_ocr": [1], "more": 1}
    assert providers.parse_detection(json.dumps(good)) == {"pdf_type": "text_based", "confidence": 1.0, "ocr_recommended": False, "page_count": 2, "pages_needing_ocr": [1]}
    for change in ({"pdf_type": None}, {"confidence": "1"}, {"ocr_recommended": 1}, {"page_count": 1.5}, {"pages_needing_ocr": ["1"]}, {"error": "x"}):
        with pytest.raises(ValueError):
            providers.parse_detection(json.dumps(good | change))
    for bad in ("no json", "[]"):
        with pytest.raises(ValueError):
            providers.parse_detection(bad)
    assert providers.parse_markdown('{"markdown": "# A"}') == "# A"
    with pytest.raises(ValueError):
        providers.parse_markdown('{"markdown": "  "}')


def test_settings():
    assert config.smart_routing(None) and config.smart_routing("anything") and not config.smart_routing(" OFF ")
    assert config.least_confidence(None) == 0.9 and config.least_confidence("0") == 0
    for bad in ("x", "1.01", "-1", "nan"):
        with pytest.raises(ValueError):
            config.least_confidence(bad)
    assert config.batch_size("3", 9) == 3 and config.batch_size(None, 9) == 9 and config.batch_size("0") == 1
    assert config.cache_key(" A\t") == config.cache_key("a")
