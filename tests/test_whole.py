"""Bundles are packed from all ranked chunks, however many of the first do not fit."""

from tracelake.operators import pack, session
from tracelake.plans import catalog


def test_small_chunk_after_many_large_ones_is_packed(spark, tmp_path):
    docs = [(i, "needle " * 1000, "en", "web") for i in range(70)] + [(99, "needle in the hay", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "needle"), (2, "hay")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.query_id: (r.entries, r.omitted, r.consumed <= 4000) for r in catalog.bundle_render(spark, tmp_path).collect()}
    assert got == {1: (1, 70, True), 2: (1, 0, True)}
    files = spark.createDataFrame([(f"{i}.txt", t) for i, t, *_ in docs], "path string, text string")
    b = session.make_bundle(files, "needle", method="bm25")
    assert [e["path"] for e in b["entries"]] == ["99.txt"] and b["omitted_count"] == 70
    assert b["consumed"] == len(pack.render(b).encode()) and pack.bundle_error(b) is None


def test_greedy_keeps_every_group_whole(spark):
    rows = [(g, r, f"{g}-{r}", 9 if r < 300 else 3) for g in (1, 2, None) for r in range(303)]
    got = pack.greedy(spark.createDataFrame(rows, "q int, r int, i string, c int").repartition(5), "q", "r", "i", "c", 8).collect()
    assert sorted(((r.q, r.kept, r.used) for r in got), key=str) == sorted(((g, [f"{g}-300", f"{g}-301"], 6) for g in (1, 2, None)), key=str)
