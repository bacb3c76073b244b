"""Saved spans against a later revision: six statuses, and the baselines they are judged with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.functions.tables import kept
from tracelake.operators import corpus

STATUSES = ("valid", "relocated", "ambiguous", "modified", "deleted", "invalid")


def drifted(files: DataFrame) -> DataFrame:
    """A later revision made from ``doc_id % 10``.

    3 gains a header line, 4 moves, 5 has its first line edited, 6 goes, 7 is
    displaced and copied, 8 and 9 gain a line at the end, the rest stay.
    """
    k = F.pmod("doc_id", F.lit(10))
    text = F.when(k == 3, F.concat(F.lit("inserted header\n"), "text")).when(k == 5, F.concat(F.lit("edited "), "text")).when(k == 7, F.concat(F.lit("displaced\n"), "text")).when(k >= 8, F.concat("text", F.lit("\nappended line"))).otherwise(F.col("text"))
    path = F.when(k == 4, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    kept = files.where(k != 6)
    # A copy lies beside the displaced file: one pass, no union.
    paths = F.when(k == 7, F.array(path, F.concat(F.lit("copy/"), "path"))).otherwise(F.array(path))
    return kept.select("doc_id", F.explode(paths).alias("path"), text.alias("text"))


def entries(files: DataFrame) -> DataFrame:
    """The saved spans of a corpus: every chunk of every file with its digests."""
    return corpus.chunks(files).select(F.concat_ws(":", "path", F.col("start_line").cast("string")).alias("entry_id"), "path", F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), "text", "file_sha256")


def digests(text: Column) -> Column:
    """Of each line 128 bits of its SHA-256, in hex. Equal ones are equal lines, so joins carry these in place of texts."""
    return F.transform(T.source_lines(text), lambda x: F.left(F.sha2(x, 256), F.lit(32)))


def _held(files: DataFrame) -> DataFrame:
    return kept(files.select("path", digests(F.col("text")).alias("ls"), F.sha2("text", 256).alias("sha")), "held")


def _places(spans: DataFrame, held: DataFrame) -> DataFrame:
    """``entry_id, path, line`` of every place of the spans (``entry_id, own``: digests of lines) in ``held``.

    The spans meet the corpus on the hash of one line, the rarest of a span by
    its count in the corpus, so a line that many files repeat is no hot key
    unless a span has no other; then the whole slice is compared.
    """
    whole = lambda ls: F.sha2(F.array_join(ls, ""), 256)
    # Spans of one id may have different texts.
    spans = spans.withColumn("v", F.xxhash64("own"))
    each = spans.select("entry_id", "v", F.posexplode("own").alias("at", "line")).select("entry_id", "v", "at", F.xxhash64("line").alias("h"))
    hashed = held.select("path", F.posexplode("ls").alias("pos", "line")).select("path", "pos", F.xxhash64("line").alias("h"))
    counts = hashed.groupBy("h").agg(F.count("*").alias("n"))
    rarest = each.join(counts, "h", "left").groupBy("entry_id", "v").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "h")).alias("k")).select("entry_id", "v", "k.at", "k.h")
    keyed = rarest.join(spans.select("entry_id", "v", F.size("own").alias("width"), whole(F.col("own")).alias("want")), ["entry_id", "v"])
    # Places meet first; the digests of the files' lines come in for these alone.
    met = hashed.join(keyed, "h").where(F.col("pos") >= F.col("at"))
    same = whole(F.slice("ls", F.col("pos") - F.col("at") + 1, F.col("width"))) == F.col("want")
    return met.join(held.select("path", "ls"), "path").where(same).select("entry_id", "path", (F.col("pos") - F.col("at") + 1).cast("long").alias("line"))


def occurrences(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """``entry_id, path, line``: every whole-line occurrence of each span."""
    return _places(kept(wanted.select("entry_id", digests(F.col("text")).alias("own")), "spans"), _held(files))


def _spans(saved: DataFrame) -> DataFrame:
    return saved.withColumn("own", digests(F.col("text"))).drop("text")


def _placed(saved: DataFrame, held: DataFrame) -> DataFrame:
    """Saved spans with what is at their path now."""
    now = held.withColumnRenamed("path", "now_path")
    spans = saved if "own" in saved.columns else _spans(saved)
    there = spans.join(now, spans["path"] == now["now_path"], "left")
    enough = F.coalesce(F.size("ls") >= F.col("end_line"), F.lit(False)) & F.col("now_path").isNotNull()
    at = F.slice("ls", F.col("start_line"), F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)))
    return there.select(
        "entry_id", "path", "own", F.col("now_path").isNotNull().alias("exists"),
        enough.alias("by_range"), (enough & F.coalesce(at == F.col("own"), F.lit(False))).alias("by_line"), F.coalesce(F.col("sha") == F.col("file_sha256"), F.lit(False)).alias("by_hash"),
    )


def verify(saved: DataFrame, files: DataFrame, outside: DataFrame | None = None) -> DataFrame:
    """``entry_id, status, matches, new_path, new_line`` of each saved span.

    In this order: an unsafe path is invalid; the text at its recorded lines is
    valid; one match elsewhere is relocated, several are ambiguous; else a file
    of that path is modified, one outside of the corpus (``outside``: paths)
    invalid, none deleted.
    """
    return judged(saved, files, outside)[0]


def judged(saved: DataFrame, files: DataFrame, outside: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of :func:`verify`, those of :func:`acceptors`, and the spans without text; each text is read once."""
    held, spans = _held(files), kept(_spans(saved), "spans")
    placed = kept(_placed(spans, held).withColumn("own", F.when(~F.col("by_line"), F.col("own"))), "placed")
    found = _places(placed.where(~F.col("by_line")).select("entry_id", "own"), held).groupBy("entry_id").agg(F.count("*").alias("n"), F.min(F.struct("path", "line")).alias("m"))
    joined = placed.drop("own").join(found, "entry_id", "left")
    if outside is not None:
        joined = joined.join(outside.select(F.col("path").alias("out")).distinct(), joined["path"] == F.col("out"), "left")
        beyond = F.col("out").isNotNull()
    else:
        beyond = F.lit(False)
    n = F.coalesce("n", F.lit(0))
    status = F.when(T.unsafe_path(F.col("path")), "invalid").when(F.col("by_line"), "valid").when(n == 1, "relocated").when(n > 1, "ambiguous").when(F.col("exists"), "modified").when(beyond, "invalid").otherwise("deleted")
    one = status == "relocated"
    results = joined.select("entry_id", status.alias("status"), n.alias("matches"), F.when(one, F.col("m.path")).alias("new_path"), F.when(one, F.col("m.line")).alias("new_line"))
    return results, placed.select("entry_id", "by_range", "by_line", "by_hash"), spans.drop("own")


def acceptors(saved: DataFrame, files: DataFrame) -> DataFrame:
    """Baselines: ``by_range`` (path and enough lines), ``by_line`` (exact text there), ``by_hash`` (file unchanged)."""
    held = files.select("path", digests(F.col("text")).alias("ls"), F.sha2("text", 256).alias("sha"))
    return _placed(saved, held).select("entry_id", "by_range", "by_line", "by_hash")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def all_valid(results: DataFrame) -> DataFrame:
    """Nothing is not valid evidence."""
    return results.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(F.col("status") == "valid"), F.lit(False)).alias("every")).select((F.col("some") & F.col("every")).alias("valid"))


PRECEDENCE = tuple("invalid missing changed unresolved unchanged".split())


def worst(status: Column) -> Column:
    """Aggregate: the worst status of a group, ``unchanged`` for an empty one."""
    order = F.array(*[F.lit(s) for s in PRECEDENCE])
    return F.coalesce(F.element_at(order, F.min(F.array_position(order, status)).cast("int")), F.lit("unchanged"))
