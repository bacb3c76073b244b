"""Command line: exit 0 if all is well, 1 if evidence no longer holds, 2 on an error."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from tracelake.operators import graph, pack, session
from tracelake.sources import files as io

BUDGET = {"bundle": 4000, "capture": 4000, "graph-capture": 16000, "graph-refresh": 16000}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tracelake")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=int if isinstance(v, int) else str)
        c.add_argument("--output")
        c.add_argument("--ref")

    add("index", "root")
    add("search", "root", "query", method="graph", limit=10)
    add("bundle", "root", "query", method="graph", budget=4000)
    add("capture", "root", "query", method="bm25", budget=4000)
    for name in ("verify", "repair", "check", "refresh", "report"):
        add(name, "root", "artifact")
    add("render", "artifact")
    add("graph-capture", "root", "query", "store", budget=16000, depth=4, nodes=256, limit=1)
    add("graph-refresh", "root", "store", "handle", budget=16000)
    add("graph-apply", "artifact", "delta")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return _run(args, spark or SparkSession.builder.appName("tracelake").getOrCreate())
    except (ValueError, OSError, KeyError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


def _run(args, spark) -> int:
    files = io.read_revision(spark, args.root, args.ref) if hasattr(args, "root") else None
    artifact = io.read_artifact(args.artifact) if hasattr(args, "artifact") else None
    out, code = None, 0
    match args.command:
        case "index":
            out = {"snapshot_id": session.snapshot(files), "files": files.count(), "chunks": session.tree_chunks(files).count()}
        case "search":
            out = session.search(files, args.query, args.method, args.limit)
        case "bundle":
            out = session.make_bundle(files, args.query, args.budget, args.method)
        case "capture":
            out = session.capture(files, args.query, args.budget, args.method)
        case "verify":
            out = session.verify_bundle(files, artifact)
            code = int(not out["valid"])
        case "repair":
            report = session.verify_bundle(files, artifact)
            texts = {r.path: r.text for r in files.select("path", "text").collect()}
            out = pack.repair(artifact, {r["entry_id"]: r for r in report["results"]}, texts, session.snapshot(files))
            code = int(not out["entries"])
        case "check":
            out = session.check(files, artifact)
            code = int(out["recommendation"] != "reuse")
        case "refresh":
            out = session.refresh(files, artifact)
        case "report":
            report = session.verify_bundle(files, artifact)
            out, code = session.report_html(artifact, report), int(not report["valid"])
        case "render":
            out = pack.render(artifact)
        case "graph-capture":
            out = session.GraphSession(spark, args.store).capture(files, args.query, args.limit, args.budget, max_depth=args.depth, max_nodes=args.nodes)
            code = int(not out["view"]["complete"])
        case "graph-refresh":
            out = session.GraphSession(spark, args.store).refresh(files, args.handle, args.budget)
            code = int(not out["fresh"])
        case "graph-apply":
            out = graph.apply_delta(artifact, io.read_artifact(args.delta))
    text = out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2, sort_keys=True) + "\n"
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(text)
    else:
        sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
