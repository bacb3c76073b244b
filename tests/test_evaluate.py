import pytest
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import evaluate, metrics, pack, session, verify

SF = "/root/testdata/sf0.001"


def test_line_offsets_agree_with_the_engines_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\nd", "\n\n\r\r\n", "é x\x0b\ny", "\r"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.source_lines(F.col("t")).alias("ls")).collect()
    for r in got:
        raw = r.t.encode()
        at = evaluate.line_offsets(raw)
        assert [raw[a:b].decode() for a, b in zip(at, at[1:])] == r.ls
        assert evaluate.bytes_at(raw, 1, len(r.ls)) == (raw or None) and evaluate.bytes_at(raw, 1, len(r.ls) + 1) is None


def test_statuses_equal_a_second_account_from_bytes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text is not null and doc_id < 60")
    from tracelake.operators import corpus

    files = corpus.documents_as_files(docs)
    saved, after = verify.entries(files), verify.drifted(files)
    tree = {r.path: r.text.encode() for r in after.collect()}
    got = {r.entry_id: (r.status, r.matches) for r in verify.verify(saved, after).collect()}
    for e in saved.collect():
        status, found = evaluate.annotate(e.asDict(), tree)
        assert got[e.entry_id][0] == status
        assert status == "valid" or got[e.entry_id][1] == len(found)
    assert {s for s, _ in got.values()} >= {"valid", "relocated", "modified", "deleted"}
    with pytest.raises(ValueError):
        evaluate.byte_matches(tree, b"")


def test_flags_findings_and_publication(spark):
    rows = [("valid", "changed", "unchanged", ["missing"]), ("valid", "unresolved", "changed", []), ("modified", "changed", "changed", ["changed"]), ("relocated", "unchanged", "unchanged", None)]
    flagged = evaluate.drift_flags(spark.createDataFrame(rows, "source_status string, dependency_status string, anchor_status string, references array<string>"))
    assert evaluate.drift_summary(flagged).first().asDict() == {"samples": 4, "text_recoverable": 3, "additionally_flagged": 1, "direct_reference_flag": 1, "anchor_flag": 1, "needs_review": 1}
    files = spark.createDataFrame([("a", "x\n/home/me/x\nC:\\Users\\me\\y\n"), ("b", "-----BEGIN PRIVATE KEY-----\nPlan Zeta\nghp_" + "a" * 30), ("c", "clean\n")], "path string, text string")
    found = sorted(tuple(r) for r in evaluate.findings(files, private=("zeta",)).collect())
    assert found == [("a", 2, "personal folder"), ("a", 3, "personal folder of Windows"), ("b", 1, "private key"), ("b", 2, "private term"), ("b", 3, "access token")]
    safe = {r.path: r for r in evaluate.publication(files).collect()}
    assert [safe[p].redacted for p in "abc"] == [True, True, False] and evaluate.findings(spark.createDataFrame([(p, r.text) for p, r in safe.items()], "path string, text string")).count() == 0
    paths = spark.createDataFrame([("src/a.py",), ("src/tests/a.py",), ("src/test_a.py",), ("lib/a.py",), ("src/a_test.go",), ("srcx/a.py",)], "path string")
    assert [r[0] for r in paths.where(evaluate.production(F.col("path"), ("src",))).collect()] == ["src/a.py"]


def test_empty_tables_have_results(spark):
    empty = spark.createDataFrame([], "condition string, drift string, passed boolean, error_type string")
    assert evaluate.failure_types(empty).count() == evaluate.passes_by_drift(empty).count() == 0
    cases = spark.createDataFrame([], "expected string, observed string, fresh boolean, text_usable boolean, capture_ms double, verify_ms double, sidecar_bytes long, bundle_bytes long")
    assert evaluate.suite_summary(cases).first().cases == 0
    attempts = spark.createDataFrame([("t", "c", True, True, False, True, 3, 1.5)], "task_id string, condition string, correct boolean, valid boolean, changed boolean, matches_old boolean, evidence_bytes long, seconds double")
    row = metrics.attempt_summary(attempts, "condition").first()
    assert (row.attempts, row.correct, row.control_correct, row.sum_bytes) == (1, 1, 1, 3)
    tasks, conditions = spark.createDataFrame([("t",), ("u",)], "task_id string"), spark.createDataFrame([("c",)], "condition string")
    assert [tuple(r) for r in metrics.incomplete_cells(attempts, tasks, conditions).collect()] == [("u", "c", 0)]


TREE = [("a.py", "def total(x):\n    return x + rate()\n\ndef rate():\n    return 2\n"), ("b.py", "def other():\n    return 'total total'\n"), ("notes.txt", "total " * 50)]


def test_anchors_come_from_python_alone_with_its_own_statistics(spark):
    files = spark.createDataFrame(TREE + [(f"n{i}.txt", "total rate other " * 20) for i in range(30)], "path string, text string")
    one = session.anchors_of(files, "total")
    python = session.anchors_of(files.where("path like '%.py'"), "total")
    assert one == python and one[0]["path"] in ("a.py", "b.py")
    assert len({(a["path"], a["symbol"]) for a in session.anchors_of(files, "total rate other", 3)}) == 3
    with pytest.raises(ValueError):
        session.anchors_of(files, "nowhere")


def test_policies_and_the_four_predicates(spark):
    df = lambda rows: spark.createDataFrame(rows, "path string, text string")
    before = df(TREE)
    saved = session.make_bundle(before, "total", method="bm25")
    moved = df([("a.py", "# new\n" + TREE[0][1]), *TREE[1:]])
    edited = df([("a.py", TREE[0][1].replace("x + rate", "x - rate")), *TREE[1:]])
    assert session.context_for("reuse", edited, saved, "total") == (saved, "reuse")
    assert session.context_for("verify", before, saved, "total") == (saved, "reuse")
    mended, how = session.context_for("verify", moved, saved, "total")
    assert how == "repair" and session.verify_bundle(moved, mended)["valid"]
    fresh, how = session.context_for("verify", edited, saved, "total")
    assert how == "fresh" and session.verify_bundle(edited, fresh)["valid"]
    told = session.diagnose(saved, before, moved)
    by = {e["path"]: told[e["id"]] for e in saved["entries"]}
    assert by["b.py"]["file_hash"] and by["b.py"]["status"] == "valid" and not by["a.py"]["file_unchanged"] and by["a.py"]["recoverable"] and by["a.py"]["one_hop"] == "unchanged"
    assert session.diagnose({**saved, "entries": []}, before, moved) == {}


def test_budgets_in_tokens(monkeypatch):
    import sys
    import types

    fake = types.SimpleNamespace(get_encoding=lambda name: types.SimpleNamespace(encode_ordinary=str.split))
    monkeypatch.setitem(sys.modules, "tiktoken", fake)
    head = {"schema_version": 1, "snapshot_id": "s", "query": "q", "method": "bm25", "tokenizer": "cl100k_base"}
    hit = pack.entry({"id": "0", "path": "p", "start_line": 1, "end_line": 1, "text": "one two three", "symbol": "<text>", "kind": "text", "file_sha256": "", "score": 1.0})
    b = pack.pack(head, [hit], 40, pack.counter("cl100k_base"))
    assert b["budget_unit"] == "tokens" and b["consumed"] == len(pack.render(b).split())
    assert pack.counter("bytes")("é") == 2
    with pytest.raises(ValueError):
        pack.counter("words")
