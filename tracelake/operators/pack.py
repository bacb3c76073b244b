"""Evidence bundles: rendering, greedy packing under an exact byte budget, repair."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.canonical import canonical, sealed, text_digest

HEADER = tuple("budget budget_unit id method omitted_count provenance query schema_version snapshot_id tokenizer".split())


def greedy(rows: DataFrame, group: str, rank: str, item: str, cost: str, budget: int) -> DataFrame:
    """``group, kept, used``: items in rank order that still fit; one that does not is skipped.

    One ordered pass over a group of any size, which holds only the bytes used and the items kept.
    """
    kinds = [rows.schema[c].dataType.simpleString() for c in (group, item)]
    ordered = rows.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(cost).cast("long").alias("c"), F.col(rank).alias("r"))

    def run(batches):
        state = None
        for batch in batches:
            done = []
            for g, i, c in zip(*(batch.column(k).to_pylist() for k in "gic")):
                if state is None or state[0] != g:
                    done += [state] if state else []
                    state = [g, [], 0]
                if c is not None and state[2] + c <= budget:
                    state[1].append(i)
                    state[2] += c
            yield out(done, batch.schema)
        if state:
            yield out([state], batch.schema)

    def out(done, schema):
        g, i = schema.field("g").type, pa.list_(schema.field("i").type)
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], kind) for k, kind in ((0, g), (1, i), (2, pa.int64()))], ["g", "kept", "used"])

    folded = ordered.repartition("g").sortWithinPartitions("g", "r", "i", "c").mapInArrow(run, f"g {kinds[0]}, kept array<{kinds[1]}>, used long")
    return folded.select(F.col("g").alias(group), "kept", "used")


def render_entry(entry: dict) -> str:
    """Blank line, citation, fenced text."""
    runs = [len(r) for r in "".join(c if c == "`" else " " for c in entry["text"]).split()]
    fence = "`" * max(3, 1 + max(runs, default=0))
    body = entry["text"] if entry["text"].endswith("\n") else entry["text"] + "\n"
    return f"\n{canonical({k: v for k, v in entry.items() if k != 'text'})}\n{fence}\n{body}{fence}\n"


def render(bundle: dict) -> str:
    """The payload whose size the budget counts."""
    head = {k: bundle[k] for k in HEADER if k in bundle}
    return "# Evidence bundle\n" + canonical(head) + "\n" + "".join(map(render_entry, bundle["entries"]))


def byte_count(text: str) -> int:
    return len(text.encode())


TOKENIZERS = ("bytes", "cl100k_base", "o200k_base")


def counter(tokenizer: str) -> Callable[[str], int]:
    """What a budget counts: bytes, or ordinary tokens of a named encoding, whose data must be at hand."""
    if tokenizer not in TOKENIZERS:
        raise ValueError(f"tokenizer is one of {', '.join(TOKENIZERS)}")
    if tokenizer == "bytes":
        return byte_count
    import tiktoken

    encoding = tiktoken.get_encoding(tokenizer)
    return lambda text: len(encoding.encode_ordinary(text))


def pack(header: dict, candidates: Iterable[dict], budget: int, count: Callable[[str], int] = byte_count, total: int | None = None) -> dict:
    """A sealed bundle of the candidates that fit, in order; oversize ones are skipped.

    Only the digits of ``omitted_count`` make costs not additive, so each step
    adds an entry's own cost and the change of those digits. With ``total``, the
    candidates may be a stream, and may lack some that surely do not fit.
    """
    if total is None:
        candidates = list(candidates)
        total = len(candidates)
    base = {**header, "budget": budget, "budget_unit": "bytes" if count is byte_count else "tokens"}

    def whole(kept):
        return sealed({**base, "omitted_count": total - len(kept), "entries": kept})

    if count(render(whole([]))) > budget:
        raise ValueError("the budget does not hold an empty bundle")
    kept: list[dict] = []
    size = count(render(whole([])))
    for c in candidates:
        if count is byte_count:
            before, after = (len(str(total - len(kept) - k)) for k in (0, 1))
            new = size + byte_count(render_entry(c)) + after - before
        else:
            new = count(render(whole([*kept, c])))
        if new <= budget:
            kept.append(c)
            size = new
    bundle = whole(kept)
    return {**bundle, "consumed": count(render(bundle))}


def entry(hit: dict) -> dict:
    """A chunk with its digest and rounded score."""
    fields = "id path symbol kind start_line end_line file_sha256 text".split()
    return {**{k: hit[k] for k in fields}, "text_sha256": text_digest(hit["text"]), "score": round(hit["score"], 8), "reasons": list(hit.get("reasons", []))}


def bundle_error(bundle) -> str | None:
    """The first reason not to trust a bundle."""
    if not isinstance(bundle, dict) or bundle.get("schema_version") != 1:
        return "unsupported schema"
    entries = bundle.get("entries")
    if not isinstance(entries, list):
        return "entries are no list"
    core = {k: v for k, v in bundle.items() if k != "consumed"}
    try:
        if sealed(core)["id"] != bundle.get("id"):
            return "broken seal"
    except (TypeError, ValueError):
        return "not canonical"
    seen = set()
    for e in entries:
        if not isinstance(e, dict) or not isinstance(e.get("text"), str) or text_digest(e["text"]) != e.get("text_sha256"):
            return "entry digest"
        a, b = e.get("start_line"), e.get("end_line")
        if type(a) is not int or type(b) is not int or not 1 <= a <= b:
            return "entry lines"
        if e.get("id") in seen:
            return "repeated entry"
        seen.add(e.get("id"))
    return None


def repair(bundle: dict, results: dict[str, dict], files: dict[str, str], snapshot: str) -> dict:
    """Keeps valid and relocated entries, bound to where they are now, and packs them again."""
    kept = []
    for e in bundle["entries"]:
        r = results[e["id"]]
        if r["status"] == "relocated":
            width = e["end_line"] - e["start_line"]
            path, line = r["new_path"], r["new_line"]
            e = {**e, "path": path, "start_line": line, "end_line": line + width, "file_sha256": text_digest(files[path])}
        elif r["status"] != "valid":
            continue
        else:
            e = {**e, "file_sha256": text_digest(files[e["path"]])}
        place = [e["path"], e["start_line"], e["end_line"], [e["symbol"], e["kind"]], e["file_sha256"]]
        kept.append({**e, "id": text_digest(json.dumps(place, separators=(",", ":")))})
    head = {k: bundle[k] for k in ("schema_version", "query", "method", "tokenizer")}
    return pack({**head, "snapshot_id": snapshot, "provenance": {"repaired_from": bundle["id"]}}, kept, bundle["budget"])
