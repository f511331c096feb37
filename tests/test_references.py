from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.operators.references import dangling_references, dangling_report, reference_rows, target_rows

T = [datetime(2024, 1, d) for d in range(1, 10)]


def _run(spark, children, parents):
    c = spark.createDataFrame(children, "id string, ref string, received_at timestamp_ntz, deleted_at timestamp_ntz, status string, key string")
    p = spark.createDataFrame(parents, "id string, received_at timestamp_ntz, deleted_at timestamp_ntz, live boolean")
    refs = reference_rows(c, table_name="c", row_key="id", keys=F.array("ref"), target="p")
    return dangling_references(refs, target_rows(p, target="p", key="id"))


def test_missing_deleted_late(spark):
    children = [
        ("a", "p1", T[3], None, "x", "k"), ("b", " p1\t", T[3], None, None, None), ("c", "nowhere", T[3], None, None, None), ("d", "p2", T[3], None, None, None),
        ("e", "p3", T[3], None, None, None), ("f", None, T[3], None, None, None), ("g", "  ", T[3], None, None, None), ("h", "nowhere", T[3], T[4], None, None),
        ("i", "nowhere", T[3], None, None, None), ("i", "nowhere", T[5], None, None, None), (None, "nowhere", T[3], None, None, None), ("j", "P1", T[3], None, None, None),
        ("k", "p4", None, None, None, None), ("l", "p5", T[3], None, None, None), ("m", "p3", T[6], None, None, None), ("m", "p3", T[3], None, None, None),
    ]
    parents = [("p1", T[1], None, True), ("p2", T[1], T[2], True), ("p3", T[5], None, True), ("p4", T[5], None, True), ("p5", T[1], T[2], True), ("p5", T[4], None, True), (None, T[1], None, True)]
    got = {(r.row_key, r.ref_key, r.status) for r in _run(spark, children, parents).collect()}
    assert got == {("c", "nowhere", "missing"), ("d", "p2", "deleted"), ("e", "p3", "late"), ("i", "nowhere", "missing"), (None, "nowhere", "missing"), ("j", "P1", "missing"), ("m", "p3", "late")}


def test_empty_tables_and_report(spark):
    one = [("a", "p", T[1], None, None, None)]
    assert _run(spark, one, []).collect()[0].status == "missing"
    assert _run(spark, [], [("p", T[1], None, True)]).count() == 0
    report = dangling_report(_run(spark, one + [("b", "q", None, None, None, None)], [])).collect()
    assert {(r.month, r.n_references) for r in report} == {("2024-01", 1), (None, 1)}


def test_hot_key_equals_brute_force(spark):
    children = [(str(i), "hot" if i % 3 == 0 else f"p{i % 40}", T[i % 9], None, None, None) for i in range(900)]
    parents = [(f"p{i}", T[(i * 7) % 9], T[1] if i % 5 == 0 else None, True) for i in range(30)]
    known = {p[0]: (p[1], p[2]) for p in parents}
    want = set()
    for c in children:
        s = "missing" if c[1] not in known else "deleted" if known[c[1]][1] else "late" if known[c[1]][0] > c[2] else None
        if s:
            want.add((c[0], c[1], s))
    assert {(r.row_key, r.ref_key, r.status) for r in _run(spark, children, parents).collect()} == want
