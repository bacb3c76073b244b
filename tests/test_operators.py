import pytest

from tracelake.functions import text as T
from tracelake.functions.canonical import blob_oid, same_json
from tracelake.operators import diff, metrics, pack, verify
from tracelake.streaming import versions


def test_lines_terms_and_fences(spark):
    from pyspark.sql import functions as F

    cases = {"": [], "a\r\nb\rc\nd": ["a\r\n", "b\r", "c\n", "d"], "a b\x0bc\n": ["a b\x0bc\n"], "\n\n": ["\n", "\n"]}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.ls for r in df.select("t", T.source_lines(F.col("t")).alias("ls")).collect()} == cases
    one = spark.createDataFrame([("HTTPRequest cache_entry parseJSON x",)], "t string").select(T.terms(F.col("t")).alias("w"), T.fence_width(F.lit("a ```` b")).alias("f")).first()
    assert one.w == ["httprequest", "http", "request", "cache_entry", "cache", "entry", "parsejson", "parse", "json", "x"] and one.f == 5


def test_metrics_are_null_where_undefined(spark):
    row = metrics.confusion(spark.createDataFrame([], "truth boolean, pred boolean")).first()
    assert (row.tp, row.precision, row.recall, row.accuracy) == (0, None, None, None)
    assert metrics.cluster_bootstrap({}) is None
    low, high = metrics.cluster_bootstrap({"a": [1, 0], "b": [1, 1]}, draws=200)
    assert 0 <= low <= high <= 1


def test_status_precedence(spark):
    saved = spark.createDataFrame([(i, p, 1, 2, "x\ny\n", "") for i, p in enumerate(["a", "b", "c", "d", "../e", "f"])], "entry_id int, path string, start_line int, end_line int, text string, file_sha256 string")
    files = spark.createDataFrame([("a", "x\ny\n"), ("b", "q\n")], "path string, text string")
    assert [r.status for r in verify.verify(saved, files).orderBy("entry_id").collect()] == ["valid", "relocated", "relocated", "relocated", "invalid", "relocated"]
    two = files.union(spark.createDataFrame([("z", "0\nx\ny\n1")], "path string, text string"))
    assert [r.status for r in verify.verify(saved, two).orderBy("entry_id").collect()] == ["valid", "ambiguous", "ambiguous", "ambiguous", "invalid", "ambiguous"]
    none = spark.createDataFrame([("b", "q\n")], "path string, text string")
    outside = spark.createDataFrame([("f",)], "path string")
    assert [r.status for r in verify.verify(saved, none, outside).orderBy("entry_id").collect()] == ["deleted", "modified", "deleted", "deleted", "invalid", "invalid"]


def test_delta_round_trip_and_violations(spark):
    old = spark.createDataFrame([(1, "a", 2), (2, "b", None), (3, "c", 4)], "k int, s string, n int")
    new = spark.createDataFrame([(1, "a", None), (2, "x", 5), (4, "d", 6)], "k int, s string, n int")
    ops = diff.delta(old, new, "k")
    assert diff.identical(diff.apply(old, ops, "k"), new) and not diff.violations(old, ops, "k").count()
    bad = spark.createDataFrame([(1, "add", "s", "q"), (9, "remove", None, None)], "k int, op string, field string, value string")
    assert {r.k: r.reason for r in diff.violations(old, bad, "k").collect()} == {1: "added key exists", 9: "key is absent"}


def test_packing_skips_and_is_exact():
    head = {"schema_version": 1, "snapshot_id": "s", "query": "q", "method": "bm25", "tokenizer": "bytes"}
    hits = [pack.entry({"id": str(i), "path": "p", "start_line": 1, "end_line": 1, "text": t, "symbol": "<text>", "kind": "text", "file_sha256": "", "score": 1.0}) for i, t in enumerate(["a\n", "b" * 5000, "é```é", "c"])]
    b = pack.pack(head, hits, 2500)
    assert [e["id"] for e in b["entries"]] == ["0", "2", "3"] and b["omitted_count"] == 1
    assert b["consumed"] == len(pack.render(b).encode()) <= 2500 and pack.bundle_error(b) is None
    assert pack.bundle_error({**b, "query": "other"}) == "broken seal"
    with pytest.raises(ValueError):
        pack.pack(head, hits, 10)


def test_blob_names_and_typed_equality():
    assert blob_oid(b"") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"
    assert same_json({"a": 1, "b": 2}, {"b": 2, "a": 1}) and not same_json(True, 1)


def test_stream_passes_only_changes(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 1, "x")], "path string, seq long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("path string, seq long, text string").parquet(str(src))
    q = versions.changes(stream).writeStream.format("memory").queryName("versions").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.path, r.seq, r.before is None) for r in spark.table("versions").collect()} == {("a", 1, True), ("a", 3, False), ("b", 1, True)}


def test_spans_of_one_id_and_different_texts_are_found_apart(spark):
    saved = spark.createDataFrame([("e", "a", 1, 1, "x\n", ""), ("e", "a", 1, 1, "y", ""), ("f", "b", 1, 2, "x\ry", "")], "entry_id string, path string, start_line int, end_line int, text string, file_sha256 string")
    files = spark.createDataFrame([("p", "0\nx\n"), ("q", "y"), ("r", "x\r\ny"), ("s", "z\rx\ry")], "path string, text string")
    assert sorted(map(tuple, verify.occurrences(saved, files).collect())) == [("e", "p", 2), ("e", "q", 1), ("e", "r", 2), ("e", "s", 3), ("f", "s", 2)]


def test_texts_are_not_joined_to_verify(spark):
    saved = spark.createDataFrame([("e", "a", 1, 2, "x\ny\n", "")], "entry_id string, path string, start_line int, end_line int, text string, file_sha256 string")
    files = spark.createDataFrame([("a", "0\nx\ny\n")], "path string, text string")
    results = verify.verify(saved, files)
    assert results.collect()[0].new_line == 2
    assert "text#" not in results._jdf.queryExecution().optimizedPlan().toString()
