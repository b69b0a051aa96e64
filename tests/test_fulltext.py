import random
import sqlite3

import pytest

from corpusloom.operators import fulltext

COLUMNS = ["content", "extra", "title"]
QUERIES = [
    "payment", "payments contract", "payment OR notice", "payment AND notice NOT delay", "payment NOT (notice OR delay)", "payment NOT (notice AND zebra)", "(payment AND zebra) OR delay", '"contract notice"', "contract + notice", "pay*", "paym*",
    "title : contract", "{title extra} : notice", "- content : delay", "^contract", "title : ^ notice", "NEAR(contract delay, 2)", 'NEAR("contract notice" delay, 3)', "NEAR(payment notice)",
    "(payment OR notice) AND delay", "payment notice OR delay zebra", "café", "cafe", "CAFE OR resumé", '"what\'s due?"', "content : (payment OR delay)", "relational", '""', "notice \"\"", "zzz", "notice OR zzz", "NEAR(contract notice delay, 1)",
]
BAD = ["", "   ", "NOT payment", "payment AND", "payment'", "what?", "net-30", "a.b", "(payment", "nocolumn : payment", "payment OR", "NEAR(a b, x)", "+ payment", "{title : x"]


def _rows():
    rng = random.Random(11)
    words = "payment payments paid contract contracts notice noticed delay delays café cafe résumé relation relational relate due what s zebra section".split()
    rows = [(f"r{i:03d}", *(" ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(0, 14))) for _ in COLUMNS)) for i in range(120)]
    return [*rows, ("r900", None, None, None), ("r901", "", "payment", None)]


def _sqlite(rows):
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(id unindexed, content, extra, title, tokenize='porter')")
    db.executemany("insert into f values (?,?,?,?)", rows)
    return db


def test_ranking_equals_sqlite(spark, tmp_path):
    rows = _rows()
    db = _sqlite(rows)
    df = spark.createDataFrame(rows, "id string, content string, extra string, title string")
    got = {}
    for r in fulltext.search(df, "id", COLUMNS, QUERIES, 1000).collect():
        got.setdefault(r.qid, {})[r.id] = r.score
    for i, q in enumerate(QUERIES):
        want = {a: -b for a, b in db.execute("select id, bm25(f) from f where f match ?", (q,))}
        assert got.get(i, {}).keys() == want.keys(), q
        assert all(abs(got[i][k] - v) < 1e-6 for k, v in want.items()), q
    index = fulltext.Index(spark, str(tmp_path / "index"), COLUMNS)
    index.add(df.where("id < 'r060'"), "id", 1)
    index.add(df.where("id >= 'r060'"), "id", 2)
    stored = {}
    for r in index.search(QUERIES, 1000).collect():
        stored.setdefault(r.qid, {})[r.id] = r.score
    assert stored == got
    index.remove(df.where("id < 'r010'").select("id"), 3)
    index.add(df.where("id < 'r005'"), "id", 3)
    left = fulltext.search(df.where("id < 'r005' or id >= 'r010'"), "id", COLUMNS, ["notice"], 1000).collect()
    assert {(r.id, r.score) for r in index.search(["notice"], 1000).collect()} == {(r.id, r.score) for r in left}


def test_bad_syntax(spark):
    db = _sqlite(_rows())
    for q in BAD:
        with pytest.raises(fulltext.QuerySyntaxError):
            fulltext.parse(q, COLUMNS)
        with pytest.raises(sqlite3.OperationalError):
            db.execute("select id from f where f match ?", (q,)).fetchall() or (_ for _ in ()).throw(sqlite3.OperationalError if not q.strip() else AssertionError(q))
    assert fulltext.phrases(fulltext.parse("net-30 payments?", COLUMNS, safe=True)) == [fulltext.Phrase(("net",)), fulltext.Phrase(("30",)), fulltext.Phrase(("payment",))]
    df = spark.createDataFrame([(1, "net payment", 5), (2, None, 5), (None, "net", 5)], "id long, content string, len int")
    found = fulltext.search(df, "id", ["content"], ["net AND", "payment"], skip_bad=True).collect()
    assert [(r.qid, r.id) for r in found] == [(1, 1)]
    assert fulltext.search(df.limit(0), "id", ["content"], ["net"]).count() == 0


def test_stemmer():
    words = "caresses ponies cats agreed plastered motoring conflated troubled hopping falling filing happy sky relational conditional digitizer electriciti hopeful goodness allowance adoption homologous rate controll roll ies a".split()
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(w, tokenize='porter')")
    db.execute("create virtual table v using fts5vocab(f, 'instance')")
    db.executemany("insert into f(rowid, w) values (?, ?)", list(enumerate(words, 1)))
    assert [fulltext.porter(w) for w in words] == [t for (t,) in db.execute("select term from v order by doc")]
