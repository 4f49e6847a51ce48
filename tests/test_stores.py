"""Stores of JSON documents on folders with broken, empty and missing files."""

from __future__ import annotations

import json

from tessera.sources import stores as S


def test_json_folder(spark, tmp_path):
    for name, text in {"a.json": '{"x": 1}', "b.json": "[1, 2]", "c.json": "{broken", "d.txt": "{}", "e.json": "", "f.json": "3"}.items():
        (tmp_path / name).write_text(text)
    got = {r["source"]: json.loads(r["doc"]) for r in S.json_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.json": {"x": 1}, "b.json": {"_data": [1, 2]}, "f.json": {"_data": 3}}
    assert [r["source"] for r in S.json_folder(spark, str(tmp_path), prefix="b").collect()] == ["b.json"]


def test_json_document(spark, tmp_path):
    for name, text, want in (("a", '{"x": 1}', [{"x": 1}]), ("b", ' [{"x": 1},\n 2, null]', [{"x": 1}, 2, None]), ("c", "[broken", []), ("d", "7", []), ("e", "[]", [])):
        (tmp_path / name).write_text(text)
        assert [json.loads(r["doc"]) for r in S.json_document(spark, str(tmp_path / name)).collect()] == want


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\nbroken\n\n {"x": 2} \n')
    (tmp_path / "b.log").write_text('{"x": 3}\n')
    assert sorted(json.loads(r["doc"])["x"] for r in S.json_lines(spark, str(tmp_path)).collect()) == [1, 2]


def test_remote_stores(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"x": 1}\n')
    got = S.remote_stores(spark, [str(tmp_path / "none"), str(tmp_path / "a")], S.json_lines).collect()
    assert [(r["source_url"], r["doc"]) for r in got] == [(str(tmp_path / "a"), '{"x": 1}')]


def test_federation(spark):
    one = lambda x: spark.createDataFrame([(x,)], "doc string")
    stores = {"a": one("1"), "b": one("2")}
    assert [tuple(r) for r in S.federation(stores, "b").collect()] == [("b", "2")]
    assert sorted(tuple(r) for r in S.federation(stores, "z").collect()) == [("a", "1"), ("b", "2")]


def test_new_lines(spark, tmp_path):
    log, mark, sink = (str(tmp_path / x) for x in ("log", "mark", "sink"))
    (tmp_path / "log").mkdir()
    read = lambda: sorted(r["doc"] for r in spark.read.schema("doc string").parquet(sink).collect())
    (tmp_path / "log" / "a.jsonl").write_text('{"x":1}\nbroken\n')
    S.new_lines(spark, log, mark, sink)
    assert read() == ['{"x":1}']
    (tmp_path / "log" / "b.jsonl").write_text('{"x":2}\n')
    S.new_lines(spark, log, mark, sink)
    S.new_lines(spark, log, mark, sink)
    assert read() == ['{"x":1}', '{"x":2}']


def test_added_lines(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@\n a\n-b\n+c\n+d\n e\n@@ -9 +10 @@ f\n-g\n+h\ndiff --git a/y b/y\nBinary files differ\n"
    rows = spark.createDataFrame([(1, diff), (2, None), (3, ""), (4, "no diff")], "diff_id long, diff string")
    assert sorted(tuple(r) for r in S.added_lines(rows).collect()) == [(1, "x", 2, "c"), (1, "x", 3, "d"), (1, "x", 10, "h")]
