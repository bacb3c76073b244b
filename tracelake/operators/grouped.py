"""Many source trees side by side: witnesses, graphs and bundles as grouped plans."""

from __future__ import annotations

from itertools import chain, groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracelake.functions import text as T
from tracelake.functions.canonical import canonical, text_digest
from tracelake.operators import facts, graph, pack, resolve


#: Characters of the files whose syntax trees a worker keeps for later trees.
PARSED = 1 << 19


def _anchor(corpus: resolve.Corpus, key: tuple) -> dict:
    name, path, symbol, kind = key
    f = corpus.file(path) if path in corpus.texts else facts.parse(path, "")
    found = f.definitions.get((symbol, kind), [])
    a, b = facts.span(found[0]) if found else (1, 1)
    return {"id": name, "path": path, "symbol": symbol, "kind": kind, "start_line": a, "end_line": b, "text": "".join(f.lines[a - 1 : b])}


def compared(old: dict[str, str], new: dict[str, str], anchors: list[tuple], max_depth: int, max_nodes: int, parsed: dict | None = None) -> list[tuple]:
    """``id, one_hop, transitive, nodes, delta_ok, complete`` of each anchor (id, path, symbol, kind). A file is parsed once, and kept in ``parsed``."""
    parsed = {} if parsed is None else parsed
    was = resolve.Corpus(old, parsed)
    now = was if old == new else resolve.Corpus(new, parsed)
    own = [_anchor(was, a) for a in anchors]
    witnesses = {r["id"]: r["status"] for r in resolve.check(new, resolve.capture(old, own, was), now)}
    a = graph.build(old, own, max_depth, max_nodes, corpus=was)
    b = a if now is was else graph.build(new, own, max_depth, max_nodes, corpus=now)
    compares = graph.compare(a, b)
    results = {r["entry_id"]: r["status"] for r in compares}
    same = canonical(graph.apply_delta(a, graph.make_delta(a, b))) == canonical(b)
    complete = graph.update_view(a, b, results=compares)["complete"]
    return [(x["id"], witnesses[x["id"]], results[x["id"]], len(a["nodes"]), same, complete) for x in own]


def compare_revisions(before: DataFrame, after: DataFrame, anchors: DataFrame, max_depth: int = 4, max_nodes: int = 256) -> DataFrame:
    """``rev, id, one_hop, transitive, nodes, delta_ok, complete`` of every anchor.

    ``before`` and ``after``: rev, path, text. ``anchors``: rev, id, path, symbol,
    kind. A ``rev`` is one tree; trees are independent, so they spread by key and
    come to a worker one after the other.
    """
    name = F.lit(None).cast("string")
    rows = before.select("rev", F.lit("before").alias("side"), "path", "text", name.alias("id"), name.alias("symbol"), name.alias("kind"))
    rows = rows.unionByName(after.select("rev", F.lit("after").alias("side"), "path", "text", name.alias("id"), name.alias("symbol"), name.alias("kind")))
    rows = rows.unionByName(anchors.select("rev", F.lit("anchor").alias("side"), "path", name.alias("text"), "id", "symbol", "kind"))
    names = "rev id one_hop transitive nodes delta_ok complete".split()

    def run(batches):
        parsed, seen, held = {}, 0, 0
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("rev", "side", "path", "text", "id", "symbol", "kind"))))
        done = []
        for rev, own in groupby(rows, lambda r: r[0]):
            side = {"before": {}, "after": {}, "anchor": []}
            for _, s, path, text, name, symbol, kind in own:
                if s == "anchor":
                    side[s].append((name, path, symbol, kind))
                else:
                    side[s][path] = text
            done += [(rev, *x) for x in compared(side["before"], side["after"], side["anchor"], max_depth, max_nodes, parsed)]
            held += sum(len(text) for _, text in islice(parsed, seen, None))
            seen = len(parsed)
            if held > PARSED:
                parsed, seen, held = {}, 0, 0
            if len(done) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], names)
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(types)], names)

    kind = before.schema["rev"].dataType
    types = [to_arrow_type(kind), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.bool_()]
    out = f"rev {kind.simpleString()}, id string, one_hop string, transitive string, nodes long, delta_ok boolean, complete boolean"
    # Trees are few bytes and much work, so their parts are not put together by size.
    parts = int(before.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "rev").sortWithinPartitions("rev").mapInArrow(run, out)


def entry_bytes() -> Column:
    """Bytes of a chunk's rendered entry (:func:`tracelake.operators.pack.render_entry`) but for the digits of its score."""
    head = F.to_json(F.struct("id", "path", "symbol", "kind", "start_line", "end_line", "file_sha256", F.lit("0" * 64).alias("text_sha256"), F.array().cast("array<string>").alias("reasons")))
    text = F.octet_length("text") + F.when(F.col("text").endswith("\n"), 0).otherwise(1)
    return F.octet_length(head) + len(',"score":') + text + 2 * T.fence_width(F.col("text")) + 4


def bundles(ranked: DataFrame, budget: int = 4000) -> DataFrame:
    """``query_id, entries, omitted, consumed, rendered_sha256`` of every query's packed bundle.

    ``ranked`` holds the chunk columns, ``query_id``, ``query``, ``rank`` and
    ``score`` of all candidates, or of those that could be packed with ``total``, the number of all.
    One ordered pass a query; texts that exceed the budget by themselves are counted but not moved.
    """
    counted = ranked if "total" in ranked.columns else ranked.withColumn("total", F.count("*").over(Window.partitionBy("query_id")))
    fields = "query_id query rank score total id path symbol kind start_line end_line file_sha256 text".split()
    rows = counted.where((F.octet_length("text") <= budget) | (F.col("rank") == 1)).select(*fields)
    names = ["query_id", "entries", "omitted", "consumed", "rendered_sha256"]

    def one(q, hits):
        first = next(hits)
        head = {"schema_version": 1, "snapshot_id": "", "query": first["query"], "method": "bm25", "tokenizer": "bytes"}
        try:
            b = pack.pack(head, map(pack.entry, chain([first], hits)), budget, total=first["total"])
        except ValueError:
            return (q, 0, first["total"], None, None)
        return (q, len(b["entries"]), b["omitted_count"], b["consumed"], text_digest(pack.render(b)))

    def run(frames):
        hits = (r for pdf in frames for r in pdf.astype(object).to_dict("records"))
        for q, own in groupby(hits, lambda r: r["query_id"]):
            row = one(q, ({**r, "start_line": int(r["start_line"]), "end_line": int(r["end_line"]), "score": float(r["score"]), "total": int(r["total"])} for r in own))
            yield pd.DataFrame([row], columns=names)

    kind = ranked.schema["query_id"].dataType.simpleString()
    return rows.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInPandas(run, f"query_id {kind}, entries long, omitted long, consumed long, rendered_sha256 string")
