"""Sessions: capture evidence with its witnesses, check it later, refresh what no longer holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.canonical import canonical, escaped, seal_holds, sealed
from tracelake.operators import corpus, facts, graph, pack, rank, resolve, verify

ANCHOR = tuple("end_line file_sha256 id kind path start_line symbol text text_sha256".split())
TRUSTED = {"unchanged", "unresolved"}


def tree_chunks(files: DataFrame) -> DataFrame:
    """Chunks by declaration for Python files, by window for others."""
    rows = facts.extract(files).select("path", F.inline("chunks")).join(files.select("path", F.sha2("text", 256).alias("file_sha256")), "path")
    return corpus.with_chunk_id(rows)


def _ranked(files: DataFrame, query: str, method: str, limit: int | None) -> DataFrame:
    spark, chunks = files.sparkSession, tree_chunks(files)
    qs = spark.createDataFrame([(0, query)], "query_id int, query string")
    scored = rank.bm25(chunks, qs)
    if method == "graph":
        scored = rank.graph_bonus(scored, chunks, facts.file_edges(facts.extract(files)), qs)
    elif method != "bm25":
        raise ValueError("method is bm25 or graph")
    best = rank.reasons(rank.top(scored, limit)).select("id", "score", "rank", "reasons")
    return best.join(chunks, "id")


def search(files: DataFrame, query: str, method: str = "graph", limit: int = 20) -> list[dict]:
    """Ranked chunks; the limit bounds what reaches the driver."""
    return [r.asDict() for r in _ranked(files, query, method, limit).orderBy("rank").collect()]


def snapshot(files: DataFrame) -> str:
    return corpus.snapshot_id(files).first()[0]


def make_bundle(files: DataFrame, query: str, budget: int = 4000, method: str = "graph", limit: int | None = None, tokenizer: str = "bytes") -> dict:
    """All ranked chunks are candidates unless a limit is given; those of more bytes than the budget stay with the executors.

    A token has 128 bytes at most in the named tokenizers, so a chunk beyond that cannot fit a budget in tokens.
    """
    head = {"schema_version": 1, "snapshot_id": snapshot(files), "query": query, "method": method, "tokenizer": tokenizer}
    count = pack.counter(tokenizer)
    ranked = _ranked(files, query, method, limit)
    fitting = ranked.where(F.octet_length("text") <= budget * (1 if tokenizer == "bytes" else 128)).orderBy("rank").toLocalIterator()
    return pack.pack(head, (pack.entry(r.asDict()) for r in fitting), budget, count, total=ranked.count())


def verify_bundle(files: DataFrame, bundle: dict) -> dict:
    """Report of every entry; a bundle that is not whole has only invalid ones. No entries are never valid."""
    error = pack.bundle_error(bundle)
    entries = bundle.get("entries", []) if isinstance(bundle, dict) else []
    if error:
        return {"error": error, "results": [{"entry_id": e.get("id"), "status": "invalid"} for e in entries if isinstance(e, dict)], "valid": False}
    if not entries:
        return {"error": None, "results": [], "valid": False}
    spark: SparkSession = files.sparkSession
    saved = spark.createDataFrame([(e["id"], e["path"], e["start_line"], e["end_line"], e["text"], e["file_sha256"]) for e in entries], "entry_id string, path string, start_line int, end_line int, text string, file_sha256 string")
    results = sorted((r.asDict() for r in verify.verify(saved, files).collect()), key=lambda r: r["entry_id"])
    return {"error": None, "results": results, "valid": all(r["status"] == "valid" for r in results)}


def _python(files: DataFrame) -> dict[str, str]:
    """The Python files of one source tree; the resolver works on one tree at a time."""
    return {r.path: r.text for r in files.where(F.col("path").rlike(r"(?i)\.pyi?$")).select("path", "text").collect()}


def capture(files: DataFrame, query: str, budget: int = 4000, method: str = "bm25") -> dict:
    bundle = make_bundle(files, query, budget, method)
    anchors = [{k: e[k] for k in ANCHOR} for e in bundle["entries"]]
    return sealed({"schema_version": 1, "bundle": bundle, "dependencies": sealed({"snapshot_id": bundle["snapshot_id"], "entries": resolve.capture(_python(files), anchors)})})


def context_error(context: dict) -> str | None:
    """Seals, and one witness for each entry that agrees with it in every field."""
    if not seal_holds(context) or not seal_holds(context["dependencies"]):
        return "broken seal"
    if (error := pack.bundle_error(context["bundle"])) is not None:
        return error
    if context["bundle"]["snapshot_id"] != context["dependencies"]["snapshot_id"]:
        return "bundle and witnesses are of different snapshots"
    entries, witnesses = context["bundle"]["entries"], context["dependencies"]["entries"]
    if sorted(e["id"] for e in entries) != sorted(w["id"] for w in witnesses):
        return "entries and witnesses differ"
    by = {w["id"]: w["anchor"] for w in witnesses}
    if any(by[e["id"]][k] != e[k] for e in entries for k in ANCHOR):
        return "a witness is of another span"
    return None


def check(files: DataFrame, context: dict) -> dict:
    """Reuse, repair, review or retrieve."""
    if error := context_error(context):
        return {"recommendation": "retrieve", "error": error}
    source = verify_bundle(files, context["bundle"])
    deps = resolve.check(_python(files), context["dependencies"]["entries"])
    statuses = {d["status"] for d in deps}
    places = {r["status"] for r in source["results"]}
    fresh = bool(deps) and statuses == {"unchanged"}
    if source["valid"] and fresh:
        step = "reuse"
    elif places and places <= {"valid", "relocated"} and fresh:
        step = "repair"
    elif source["valid"] and statuses <= TRUSTED:
        step = "review"
    else:
        step = "retrieve"
    return {"recommendation": step, "error": None, "source": source, "dependencies": deps, "fresh": fresh}


def refresh(files: DataFrame, context: dict) -> dict:
    """A new context: repaired where that is allowed and leaves entries, else retrieved anew."""
    report, bundle = check(files, context), context["bundle"]
    if report["recommendation"] == "reuse":
        return {**context, "receipt": {"action": "reuse"}}
    if report["recommendation"] == "repair":
        texts = {r.path: r.text for r in files.join(files.sparkSession.createDataFrame([(r["new_path"] or e["path"],) for r, e in zip(report["source"]["results"], sorted(bundle["entries"], key=lambda e: e["id"]))], "path string").distinct(), "path").select("path", "text").collect()}
        mended = pack.repair(bundle, {r["entry_id"]: r for r in report["source"]["results"]}, texts, snapshot(files))
        if mended["entries"]:
            anchors = [{k: e[k] for k in ANCHOR} for e in mended["entries"]]
            deps = sealed({"snapshot_id": mended["snapshot_id"], "entries": resolve.capture(_python(files), anchors)})
            return sealed({"schema_version": 1, "bundle": mended, "dependencies": deps, "receipt": {"action": "repair", "from": context["id"]}})
    fresh = capture(files, bundle["query"], bundle["budget"], bundle["method"])
    return sealed({**fresh, "receipt": {"action": "retrieve", "from": context["id"]}})


def anchors_of(files: DataFrame, query: str, limit: int = 1) -> list[dict]:
    """The best ``limit`` different declarations; statistics and ranks are those of Python chunks alone."""
    python = files.where(F.col("path").rlike(r"(?i)\.pyi?$"))
    ranked = _ranked(python, query, "bm25", None)
    # One row a declaration, the best ranked, so that only ``limit`` rows reach the driver.
    best = ranked.groupBy("path", "symbol", "kind").agg(F.min("rank").alias("rank")).orderBy("rank").limit(limit)
    hits = [r.asDict() for r in ranked.join(best.select("rank"), "rank").orderBy("rank").collect()]
    if not hits:
        raise ValueError("no Python source answers this query")
    return graph.select_anchors(hits, limit)


def context_for(policy: str, files: DataFrame, saved: dict, query: str, budget: int = 4000) -> tuple[dict, str]:
    """A bundle by policy and what was done: ``reuse`` as it is, ``fresh`` anew, ``verify`` repaired where nothing is lost."""
    if policy == "reuse":
        return saved, "reuse"
    if policy == "verify":
        report = verify_bundle(files, saved)
        if report["valid"]:
            return saved, "reuse"
        if report["error"] is None and {r["status"] for r in report["results"]} <= {"valid", "relocated"}:
            by = {r["entry_id"]: r for r in report["results"]}
            paths = {by[e["id"]]["new_path"] or e["path"] for e in saved["entries"]}
            texts = {r.path: r.text for r in files.where(F.col("path").isin(*paths)).select("path", "text").collect()}
            mended = pack.repair(saved, by, texts, snapshot(files))
            if len(mended["entries"]) == len(saved["entries"]):
                return mended, "repair"
    elif policy != "fresh":
        raise ValueError("policy is reuse, fresh or verify")
    return make_bundle(files, query, budget, "bm25"), "fresh"


def diagnose(bundle: dict, before: DataFrame, after: DataFrame) -> dict[str, dict]:
    """By entry, what four predicates say of one bundle: its file unchanged, its file's hash, its text, its witness."""
    if not bundle["entries"]:
        return {}
    paths = [e["path"] for e in bundle["entries"]]
    digest = lambda df: {r.path: r.sha for r in df.where(F.col("path").isin(*paths)).select("path", F.sha2("text", 256).alias("sha")).collect()}
    old, new = digest(before), digest(after)
    text = {r["entry_id"]: r["status"] for r in verify_bundle(after, bundle)["results"]}
    witnesses = resolve.capture(_python(before), [{k: e[k] for k in ANCHOR} for e in bundle["entries"]])
    one_hop = {w["id"]: d["status"] for w, d in zip(witnesses, resolve.check(_python(after), witnesses))}
    return {
        e["id"]: {"file_unchanged": old.get(e["path"]) == new.get(e["path"]), "file_hash": new.get(e["path"]) == e["file_sha256"], "status": text[e["id"]], "recoverable": text[e["id"]] in ("valid", "relocated"), "one_hop": one_hop[e["id"]]}
        for e in bundle["entries"]
    }


class GraphSession:
    """Graphs by handle: capture, then refresh against what a holder already has."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder, self.parsed, self.held = spark, folder, {}, {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.held.clear()

    def _save(self, g: dict) -> str:
        self.held[g["id"]] = g
        if self.folder:
            self.spark.createDataFrame([(g["id"], canonical(g))], "graph_id string, graph string").write.mode("append").parquet(self.folder)
        return g["id"]

    def load(self, handle: str) -> dict:
        import json

        if handle not in self.held and self.folder:
            row = self.spark.read.parquet(self.folder).where(F.col("graph_id") == handle).first()
            if row:
                self.held[handle] = json.loads(row.graph)
        g = self.held[handle]
        if not seal_holds(g):
            raise ValueError("the stored graph is broken")
        return g

    def capture(self, files: DataFrame, query: str, limit: int = 1, budget: int = 16000, **bounds) -> dict:
        anchors = anchors_of(files, query, limit)
        g = graph.build(_python(files), anchors, parsed=self.parsed, **bounds)
        return {"handle": self._save(g), "view": graph.full_view(g, budget), "anchors": g["anchors"]}

    def refresh(self, files: DataFrame, handle: str, budget: int = 16000) -> dict:
        old = self.load(handle)
        anchors = [{"id": a["entry_id"], "path": a["path"], "symbol": a["symbol"], "kind": a["kind"]} for a in old["anchors"]]
        g = graph.build(_python(files), anchors, old["policy"]["max_depth"], old["policy"]["max_nodes"], self.parsed)
        results = graph.compare(old, g)
        return {"handle": self._save(g), "results": results, "fresh": bool(results) and all(r["status"] == "unchanged" for r in results), "view": graph.update_view(old, g, budget), "delta": graph.make_delta(old, g)}


def report_html(bundle: dict, report: dict) -> str:
    """A page without scripts or outside parts; every text is escaped."""
    status = {r["entry_id"]: r["status"] for r in report["results"]}
    rows = "".join(f"<section><h2>{escaped(e['path'])}:{e['start_line']}-{e['end_line']} <b>{escaped(status.get(e['id'], 'invalid'))}</b></h2><pre>{escaped(e['text'])}</pre></section>" for e in bundle["entries"])
    policy = "default-src 'none'; style-src 'unsafe-inline'"
    return f'<!doctype html><html><head><meta charset="utf-8"><meta http-equiv="Content-Security-Policy" content="{policy}"><title>Evidence</title><style>pre{{white-space:pre-wrap}}</style></head><body><h1>{escaped(bundle["query"])}</h1><p>{"valid" if report["valid"] else "not valid"}</p>{rows}</body></html>\n'
