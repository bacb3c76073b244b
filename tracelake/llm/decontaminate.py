"""Benchmark decontamination with DataFrame operations only.

The test items become a hash set of windows of eight normalised words. Each
window is filed under its longest word (its anchor), and that small table is
broadcast while its size is under a checked bound; beyond it the same rows meet
through a shuffled join on the anchor. Documents stream past as words; only a
word that is some window's anchor is looked at further, and the window around
it is compared in full, so every hit is verified.

Defined results: a null or wordless text has no words and no hits; a null
``item`` text or one without words has no window; repeated document rows give
repeated result rows; rows with one id and different texts are kept apart by a
hash of the text; null ids match null ids; other columns are ignored by
:func:`hits` and kept unchanged by :func:`clean`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
#: Broadcast the windows up to this many characters of window text.
BROADCAST_CHARS = 16_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``anchor, lead, len, gram, items``."""
    words = F.filter(F.split(ascii_lower(F.col("text")), SEPARATORS), lambda w: w != "")
    each = (
        items.select(F.col("item_id").cast("string").alias("item"), words.alias("w"))
        .where(F.size("w") > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0))), lambda i: F.slice("w", i + 1, width))).alias("g"))
    )
    longest = F.array_max(F.transform("g", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
    return (
        each.groupBy("g")
        .agg(F.collect_set("item").alias("items"))
        .withColumn("lead", -longest["i"])
        .select(F.lower(F.element_at("g", F.col("lead") + 1)).alias("anchor"), "lead", F.size("g").alias("len"), F.array_join("g", " ").alias("gram"), "items")
    )


def occurrences(docs: DataFrame, grams: DataFrame, broadcast: bool) -> DataFrame:
    """``doc_id, text_key, start, len, items`` for each window found in each document."""
    words = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", SEPARATORS).alias("w"))
    # The outer form keeps the optimiser from splitting every text once more for a filter.
    at = words.select("*", F.posexplode_outer("w").alias("pos", "word"))
    if broadcast:
        found = at.join(F.broadcast(grams), F.lower("word") == F.col("anchor"))
        around = F.slice("w", F.col("pos") - F.col("lead") + 1, F.col("len"))
    else:
        first = F.greatest(F.col("pos") - WINDOW + 1, F.lit(0))
        near = at.select("doc_id", "text_key", "pos", F.lower("word").alias("word"), first.alias("first"), F.slice("w", first + 1, 2 * WINDOW - 1).alias("w"))
        found = near.join(grams, F.col("word") == F.col("anchor"))
        around = F.slice("w", F.col("pos") - F.col("lead") - F.col("first") + 1, F.col("len"))
    # A separator before the first word leaves an empty string at index 0, which no window holds.
    inside = found.where(F.col("pos") >= F.col("lead"))
    return inside.where(ascii_lower(F.array_join(around, " ")) == F.col("gram")).select("doc_id", "text_key", (F.col("pos") - F.col("lead")).alias("start"), "len", "items")


def _covered(spans: str) -> Column:
    """Words inside the union of sorted ``(start, len)`` spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, s):
        end = s["start"] + s["len"]
        return F.struct((acc["n"] + F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end"))

    return F.aggregate(spans, zero, step)["n"]


def document_hits(docs: DataFrame, benchmark: DataFrame, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """One row per distinct contaminated text: ``doc_id, text_key, spans, items, n_hit``."""
    size = benchmark.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    grams = windows(benchmark)
    found = occurrences(docs, grams, size * WINDOW <= broadcast_chars)
    per = found.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return per.withColumn("n_hit", _covered("spans"))


def _with_hits(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Left join on the id and the text's hash; each prefixed ``_hit`` so that no column clashes."""
    right = found.select(*[F.col(c).alias(f"_hit_{c}") for c in found.columns])
    key = docs["doc_id"].eqNullSafe(right["_hit_doc_id"]) & (F.xxhash64(docs["text"]) == right["_hit_text_key"])
    return docs.join(right, key, "left")


def hits(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Per document ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    found = document_hits(docs, benchmark, broadcast_chars)
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    right = found.select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key"), "items", "n_hit")
    both = slim.join(right, slim["doc_id"].eqNullSafe(right["hit_id"]) & (slim["text_key"] == right["hit_key"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.size(items) >= least_items).alias("contaminated"),
    )


def _without(spans: Column) -> Column:
    """The text without the words of the spans and the separators before each; its cost is words plus spans.

    Words and separators take turns as tokens. Lambda variables hold what is used
    more than once, so that no optimiser copies a regular expression into a loop.
    """

    def rest(tokens):
        # Where a separator comes first, the split that counts words has an empty entry before it.
        lead = F.when(F.substring(F.get(tokens, F.lit(0)), 1, 1).rlike(SEPARATORS), 2).otherwise(1)
        none = F.array().cast("array<struct<at:int,n:int>>")

        def step(acc, s):
            start = F.greatest(2 * s["start"] - acc["lead"], F.lit(0))
            gap = F.array(F.struct(acc["end"].alias("at"), (start - acc["end"]).alias("n")))
            end = F.greatest(acc["end"], 2 * (s["start"] + s["len"]) - acc["lead"])
            return F.struct(F.when(start > acc["end"], F.concat(acc["gaps"], gap)).otherwise(acc["gaps"]).alias("gaps"), end.alias("end"), acc["lead"].alias("lead"))

        folded = F.aggregate(spans, F.struct(none.alias("gaps"), F.lit(0).alias("end"), lead.alias("lead")), step)
        gaps = F.transform(F.array(folded), lambda f: F.concat(f["gaps"], F.array(F.struct(f["end"].alias("at"), (F.size(tokens) - f["end"]).alias("n")))))[0]
        return F.array_join(F.flatten(F.transform(gaps, lambda g: F.slice(tokens, g["at"] + 1, g["n"]))), "")

    return F.transform(F.array(F.regexp_extract_all("text", F.lit(f"({SEPARATORS}|{WORD})"), 1)), rest)[0]


def clean(docs: DataFrame, benchmark: DataFrame, least_items: int = 2, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Documents without those that hold ``least_items`` items; spans of fewer items are cut out.

    A cut removes the words of a hit and the separators before each; the rest of
    the text stays as it is.
    """
    both = _with_hits(docs, document_hits(docs, benchmark, broadcast_chars))
    text = F.when(F.col("_hit_spans").isNull(), docs["text"]).otherwise(_without(F.col("_hit_spans")))
    return both.where(F.coalesce(F.size("_hit_items") < least_items, F.lit(True))).select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
