from corpusloom.functions.config import cache_key, parse_model
from corpusloom.streaming.ingest import ingest


def test_stream_of_files(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# A\nx\n## B\ny")
    (src / "b.bin").write_text("# no")
    for _ in range(2):  # nothing is read twice
        ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [(r.title, r.path) for r in rows] == [("A", "1"), ("B", "1.1")]


def test_model_strings():
    assert parse_model("openai:m@a=true@b=12@c@d=x") == ("openai:m", {"a": True, "b": 12, "d": "x"})
    assert cache_key(" What ") == cache_key("what")
