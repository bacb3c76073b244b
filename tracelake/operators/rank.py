"""Lexical ranking: BM25 over all chunks, and a one-hop bonus from linked files."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions import text as T
from tracelake.operators import corpus

K1, B, BONUS = 1.2, 0.75, 0.15


def all_terms() -> Column:
    """Text terms once, symbol terms twice, path terms once."""
    return F.concat(T.terms(F.col("text")), T.terms(F.col("symbol")), T.terms(F.col("symbol")), T.terms(F.col("path")))


def term_frequencies(chunks: DataFrame) -> DataFrame:
    """``id, term, tf`` of chunks of different ids, each of which counts as its ``copies``.

    Terms are counted where their chunk is, in Arrow batches; nothing is shuffled.
    """
    times = F.col("copies") if "copies" in chunks.columns else F.lit(1).cast("long")
    return chunks.select("id", times.alias("copies"), all_terms().alias("ts")).mapInArrow(_counted, "id string, term string, tf long")


def _counted(batches):
    for whole in batches:
        ends = np.cumsum(pc.list_value_length(whole.column("ts")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < whole.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 100_000)))
            b = whole.slice(start, stop - start)
            sizes = np.diff(ends[start:stop], prepend=ends[start - 1] if start else 0)
            words = b.column("ts").flatten().dictionary_encode()
            n = max(1, len(words.dictionary))
            pair, k = np.unique(np.repeat(np.arange(b.num_rows), sizes) * n + words.indices.to_numpy(), return_counts=True)
            row = pair // n
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), words.dictionary.take(pa.array(pair % n)), pa.array(k * b.column("copies").to_numpy()[row])], ["id", "term", "tf"])
            start = stop


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """``term, df``: how many of the chunks, of different ids, have a term."""
    return chunks.select(F.explode(F.array_distinct(all_terms())).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, id, path, start_line, score, matched`` of chunks that score above zero.

    Lengths and counts come from all chunks. Only postings of query terms are
    shuffled on: lengths are folded into a chunk's row before its terms are exploded.
    """
    base = chunks.select("id", "path", "start_line", all_terms().alias("ts")).withColumn("len", F.size("ts"))
    stats = base.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).withColumn("avg_len", F.when(F.col("avg_len") > 0, F.col("avg_len")).otherwise(1.0))
    wanted = queries.select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term"))
    vocabulary = wanted.select("term").distinct()
    hits = base.select("id", "path", "start_line", "len", F.explode("ts").alias("term")).join(vocabulary, "term", "left_semi").groupBy("id", "path", "start_line", "len", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    # ``stats`` is one row; the join is a broadcast of two numbers.
    scored = hits.join(df, "term").join(F.broadcast(stats)).join(wanted, "term")
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("query_id", "id", "path", "start_line").agg(F.sum(part).alias("score"), F.array_sort(F.collect_set("term")).alias("matched"))


def top(scores: DataFrame, limit: int | None) -> DataFrame:
    """The best ``limit`` of every query, or all: by falling score, then path, line and id."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 8)), "path", "start_line", "id")
    ranked = scores.where("score > 0").withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def rare_term_edges(files: DataFrame) -> DataFrame:
    """``src, dst``: files (``path, text``) that share a term which no third file has.

    A file's terms are told apart in its own row. Files are known by a hash of their
    path with a salt under which no two have the same, so that the least and the greatest
    of a term's files are numbers and its rows are added up before the shuffle.
    """
    single, several = corpus.apart(files.select("path", "text").where(~T.is_blank(F.col("text"))))
    paths = files.select("path").distinct()
    for salt in count():
        known = paths.select(F.xxhash64("path", F.lit(salt)).alias("h"), "path")
        if not known.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").head(1):
            break
    own = F.array_distinct(F.concat(T.terms(F.col("text")), F.array(F.lit("text")), T.terms(F.col("path"))))
    held = lambda df: df.select(F.xxhash64("path", F.lit(salt)).alias("h"), F.explode(own).alias("term"))
    both = held(single).unionByName(held(several).distinct())
    pairs = both.groupBy("term").agg(F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")).where("n = 2").select("a", "b").distinct()
    named = pairs.join(known.select(F.col("h").alias("a"), F.col("path").alias("x")), "a").join(known.select(F.col("h").alias("b"), F.col("path").alias("y")), "b")
    return named.select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst"))


def graph_bonus(scores: DataFrame, chunks: DataFrame, edges: DataFrame, query_ids: DataFrame) -> DataFrame:
    """Adds to each chunk of a file the bonus of its best positive neighbour file."""
    best = scores.where("score > 0").groupBy("query_id", "path").agg(F.max("score").alias("file_score"))
    both = edges.union(edges.select("dst", "src")).toDF("seed", "path").distinct()
    seeds = both.join(best.withColumnRenamed("path", "seed"), "seed")
    # The strongest neighbour; of equals the smallest path.
    bonus = seeds.groupBy("query_id", "path").agg(F.max("file_score").alias("top"), F.min_by("seed", F.struct(-F.col("file_score"), F.col("seed"))).alias("seed"))
    extra = bonus.join(chunks.select("id", "path", "start_line"), "path")
    own = scores.select("query_id", "id", "path", "start_line", "score", "matched")
    joined = own.join(extra.select("query_id", "id", "path", "start_line", "top", "seed"), ["query_id", "id", "path", "start_line"], "full_outer")
    return joined.select("query_id", "id", "path", "start_line", (F.coalesce("score", F.lit(0.0)) + BONUS * F.coalesce("top", F.lit(0.0))).alias("score"), "matched", "seed")


def reasons(scored: DataFrame) -> DataFrame:
    """Adds ``reasons``: matched terms, and the neighbour that gave a bonus."""
    lexical = F.when(F.size("matched") > 0, F.concat(F.lit("lexical overlap: "), F.array_join("matched", ", ")))
    hop = F.when(F.col("seed").isNotNull(), F.concat(F.lit("one-hop static dependency hint from "), "seed")) if "seed" in scored.columns else F.lit(None).cast("string")
    return scored.withColumn("reasons", F.array_compact(F.array(lexical, hop)))
