from datetime import datetime

import pytest

from corpusloom.functions.keys import join_verdicts
from corpusloom.operators.references import corpus_references, orphan_references

T = [datetime(2024, 1, d) for d in range(1, 9)]


def test_reasons_and_normalised_ids(spark):
    docs = spark.createDataFrame([("d1", T[0], 1), ("d2", T[0], 1), ("d3", T[5], 1)], "id string, ingested_at timestamp, reason int")
    secs = spark.createDataFrame([("s1", " D1 ", T[1]), ("s2", "d2", T[1]), ("s3", "d3", T[1]), ("s4", "zz", T[1]), ("s5", None, T[1]), ("s6", " ", T[1]), ("s4", "zz", T[2])], "id string, document_id string, loaded_at timestamp")
    chunks = spark.createDataFrame([("c1", "d1", "s1", T[2]), ("c2", "d3", "S9", T[6])], "id string, document_id string, section_id string, loaded_at timestamp")
    log = spark.createDataFrame([(1, "documents", "D2", "delete", T[3]), (2, "documents", "d1", "delete", T[2]), (3, "documents", "d1", "restore", T[3])], "log_id long, table_name string, record_id string, op string, op_at timestamp")
    got = {(r.ref_field, r.row_id, r.reason) for r in corpus_references(docs, secs, chunks, log).collect()}
    assert got == {("sections.document_id", "s2", "deleted"), ("sections.document_id", "s3", "late"), ("sections.document_id", "s4", "missing"), ("chunks.section_id", "c2", "missing")}


@pytest.mark.parametrize("match, want", [("simple", {"b"}), ("partial", {"b", "d"}), ("full", {"b", "c", "d"})])
def test_match_semantics_by_null_mask(spark, match, want):
    parent = spark.createDataFrame([("x", "1", "extra")], "p string, q string, id string")
    child = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "x", None), ("d", None, "7"), ("e", None, None)], "id string, k string, l string")
    assert {r.id for r in orphan_references(child, parent, {"k": "p", "l": "q"}, match).collect()} == want


def test_empty_parent_and_child(spark):
    parent = spark.createDataFrame([], "p string")
    child = spark.createDataFrame([("a", "x")], "id string, k string")
    assert orphan_references(child, parent, {"k": "p"}).count() == 1
    assert orphan_references(child.limit(0), parent, {"k": "p"}).count() == 0


def test_hot_keys_are_split_and_nothing_is_lost(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}", {"m": i}) for i in range(300)], "id long, k string, extra map<string,long>")
    verdicts = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> 'k1'")
    want = {(r.id, r.k) for r in rows.where("k <> 'k1'").collect()}
    for split in (7, 1000):
        got = join_verdicts(rows, verdicts, ["k"], "n", split).collect()
        assert len(got) == len(want) and {(r.id, r.k) for r in got} == want
    assert join_verdicts(rows, verdicts.limit(0), ["k"], "n", 7).count() == 0


def test_partly_late_and_delivered_twice(spark):
    docs = spark.createDataFrame([("d1", T[3])], "id string, ingested_at timestamp")
    secs = spark.createDataFrame([("s1", "d1", T[1]), ("s1", "d1", T[5]), ("s2", "d1", T[5]), (None, "zz", T[1]), (None, "zz", T[1])], "id string, document_id string, loaded_at timestamp")
    chunks = spark.createDataFrame([], "id string, document_id string, section_id string, loaded_at timestamp")
    log = spark.createDataFrame([], "log_id long, table_name string, record_id string, op string, op_at timestamp")
    got = {(r.ref_field, r.row_id, r.reason) for r in corpus_references(docs, secs, chunks, log).collect()}
    assert got == {("sections.document_id", "s1", "late"), ("sections.document_id", None, "missing")}
