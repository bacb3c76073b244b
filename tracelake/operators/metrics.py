"""Evaluation analytics: confusion, retrieval, samples, bootstrap and paired outcomes."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    """Undefined is null, never zero."""
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Counts and rates of ``truth`` against ``pred``, of each group."""
    t, p = F.col("truth"), F.col("pred")
    counts = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "accuracy": _ratio(tp + tn, tp + fp + tn + fn), "false_acceptance": _ratio(fp, fp + tn)})


def status_matrix(rows: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Every cell of truth by prediction, zeros included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(a, b) for a in statuses for b in statuses], "truth string, pred string")
    counts = rows.groupBy("truth", "pred").agg(F.count("*").alias("k"))
    return grid.join(F.broadcast(counts), ["truth", "pred"], "left").select("truth", "pred", F.coalesce("k", F.lit(0)).alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.col("truth") == F.col("pred")).cast("int")).alias("agreement"))


def retrieval(returned: DataFrame, relevant: DataFrame) -> DataFrame:
    """``query_id, recall, hit, first_rank, reciprocal_rank``; labels count once each.

    ``returned``: query_id, path, rank. ``relevant``: query_id, path.
    """
    labels = relevant.distinct()
    best = returned.groupBy("query_id", "path").agg(F.min("rank").alias("rank"))
    joined = labels.join(best, ["query_id", "path"], "left")
    per = joined.groupBy("query_id").agg(F.count("*").alias("labels"), F.count("rank").alias("found"), F.min("rank").alias("first_rank"))
    return per.select("query_id", _ratio(F.col("found"), F.col("labels")).alias("recall"), (F.col("found") > 0).alias("hit"), "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_summary(per: DataFrame, *by: str) -> DataFrame:
    return per.groupBy(*by).agg(F.count("*").alias("queries"), F.avg(F.col("hit").cast("int")).alias("hit_rate"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"))


def hash_rank_sample(rows: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """The first ``n`` of each group by the digest of seed and key."""
    rank = F.sha2(F.concat_ws("\x00", F.lit(seed), group, F.col(key).cast("string")), 256)
    w = Window.partitionBy(group).orderBy(rank, key)
    return rows.withColumn("sample_rank", F.row_number().over(w)).where(F.col("sample_rank") <= n)


def index_percentile(rows: DataFrame, value: str, p: float, *by: str) -> DataFrame:
    """The value at ``int(p * (n - 1))`` in order, without interpolation."""
    w = Window.partitionBy(*by).orderBy(value)
    ranked = rows.withColumn("at", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy(*by)))
    return ranked.where(F.col("at") == F.floor(F.lit(p) * (F.col("n") - 1))).select(*by, F.col(value).alias("value"))


def cluster_bootstrap(values: dict[str, list[float]], draws: int = 5000, seed: int = 20260921, low: float = 0.025, high: float = 0.975) -> tuple[float, float] | None:
    """Percentile interval of the mean under resampling of whole clusters; null without clusters.

    The clusters are few (repositories), so the draws run on the driver.
    """
    names = sorted(values)
    if not names:
        return None
    r = random.Random(seed)
    means = []
    for _ in range(draws):
        picked = [x for _ in names for x in values[names[r.randrange(len(names))]]]
        if picked:
            means.append(sum(picked) / len(picked))
    means.sort()
    return (means[int(low * (len(means) - 1))], means[int(high * (len(means) - 1))]) if means else None


def hashed_bootstrap(rows: DataFrame, cluster: str, value: str, draws: int, seed: int) -> DataFrame:
    """The same interval with draws from hashes, as a plan: ``low, high``.

    ``weights`` counts how often each draw picks a cluster; clusters are few, so
    draws times clusters is a small table.
    """
    sums = rows.groupBy(cluster).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    numbered = sums.withColumn("i", F.row_number().over(Window.orderBy(cluster)) - 1)
    size = numbered.agg(F.count("*").alias("size"))
    picks = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").join(F.broadcast(size)).select("draw", "size", F.explode(F.sequence(F.lit(1), F.col("size"))).alias("turn"))
    hashed = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("draw").cast("string"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long")
    chosen = picks.select("draw", F.pmod(hashed, "size").alias("i")).join(F.broadcast(numbered), "i")
    means = chosen.groupBy("draw").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return index_percentile(means, "mean", 0.025).select(F.col("value").alias("low")).join(index_percentile(means, "mean", 0.975).select(F.col("value").alias("high")))


def macro_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of group means, each of equal weight, beside the plain mean."""
    per = rows.groupBy(group).agg(F.avg(value).alias("m"), F.sum(value).alias("s"), F.count(value).alias("c"))
    return per.agg(F.avg("m").alias("macro_mean"), _ratio(F.sum("s"), F.sum("c")).alias("mean"), F.count("*").alias("groups"))


def paired_outcomes(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """2 x 2 counts of ``correct`` in two conditions of the same tasks."""
    pair = a.select(key, F.col("correct").alias("x")).join(b.select(key, F.col("correct").alias("y")), key)
    x, y = F.col("x"), F.col("y")
    return pair.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("first_only"), F.count_if(~x & y).alias("second_only"), F.count_if(~x & ~y).alias("neither"))


def attempt_summary(attempts: DataFrame, *by: str) -> DataFrame:
    """Model attempts: correct, accuracy, invalid, splits by changed behaviour, bytes and time."""
    c, ch = F.col("correct"), F.col("changed")
    return attempts.groupBy(*by).agg(
        F.count("*").alias("attempts"), F.count_if(c).alias("correct"), F.avg(c.cast("int")).alias("accuracy"), F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if(c & ch).alias("changed_correct"), F.count_if(c & ~ch).alias("control_correct"), F.count_if(~c & F.col("matches_old")).alias("wrong_matches_old"),
        F.sum("evidence_bytes").alias("sum_bytes"), F.avg("evidence_bytes").alias("mean_bytes"), F.max("evidence_bytes").alias("max_bytes"), F.median("seconds").alias("median_seconds"),
    )


def incomplete_cells(attempts: DataFrame, tasks: DataFrame, conditions: DataFrame) -> DataFrame:
    """Cells of task by condition (both short lists) without exactly one attempt."""
    counts = attempts.groupBy("task_id", "condition").agg(F.count("*").alias("k"))
    cells = tasks.select("task_id").distinct().join(F.broadcast(conditions.select("condition").distinct()))
    return cells.join(counts, ["task_id", "condition"], "left").select("task_id", "condition", F.coalesce("k", F.lit(0)).alias("n")).where("n <> 1")


def repeated_bytes(nodes: DataFrame, key: list[str], text: str) -> DataFrame:
    """Bytes in all, and of distinct nodes only."""
    total = nodes.agg(F.sum(F.octet_length(text)).alias("bytes"), F.count("*").alias("n"))
    unique = nodes.groupBy(*key).agg(F.first(F.octet_length(text)).alias("b")).agg(F.sum("b").alias("unique_bytes"))
    return total.join(unique).withColumn("repeated_bytes", F.col("bytes") - F.col("unique_bytes"))


def with_total(rows: DataFrame, group: str, **aggregates: Column) -> DataFrame:
    """Aggregates by group and over all (group ``all``) in one pass."""
    cols = [v.alias(k) for k, v in aggregates.items()]
    return rows.rollup(group).agg(F.grouping(group).alias("_g"), *cols).withColumn(group, F.when(F.col("_g") == 1, "all").otherwise(F.col(group))).drop("_g")
