"""Differences of two keyed tables: changed files, field deltas, their application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``path, change``: added, removed or edited; unchanged files are left out."""
    a = before.select("path", F.sha2("text", 256).alias("a"))
    b = after.select("path", F.sha2("text", 256).alias("b"))
    both = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("edited").alias("change"))


def delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, op, field, value``: rows added (every field), removed, and fields set or unset.

    Values are text; a field that did not change is not in the delta.
    """
    fields = [c for c in old.columns if c != key]
    a = old.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in fields], F.lit(1).alias("in_a"))
    b = new.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in fields], F.lit(1).alias("in_b"))
    both = a.join(b, key, "full_outer")
    none = F.lit(None).cast("string")
    change = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.struct(F.when(F.col(f"b_{c}").isNull(), "unset").otherwise("set").alias("op"), F.lit(c).alias("field"), F.col(f"b_{c}").alias("value"))) for c in fields]
    whole = [F.struct(F.lit("add").alias("op"), F.lit(c).alias("field"), F.col(f"b_{c}").alias("value")) for c in fields]
    gone = F.array(F.struct(F.lit("remove").alias("op"), none.alias("field"), none.alias("value")))
    ops = F.when(F.col("in_b").isNull(), gone).when(F.col("in_a").isNull(), F.array(*whole)).otherwise(F.array_compact(F.array(*change)))
    return both.select(key, F.explode(ops).alias("o")).select(key, "o.op", "o.field", "o.value")


def violations(old: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Preconditions that a delta breaks: ``key, reason``. Empty if it applies."""
    kinds = ops.groupBy(key).agg(F.collect_set("op").alias("ops"), F.count("*").alias("n"), F.count_distinct("op", F.coalesce("field", F.lit(""))).alias("d"))
    there = old.select(key, F.lit(True).alias("there"))
    both = kinds.join(there, key, "left")
    has = lambda op: F.array_contains("ops", op)
    exists = F.coalesce("there", F.lit(False))
    reason = F.when(has("add") & exists, "added key exists").when((has("remove") | has("set") | has("unset")) & ~exists, "key is absent").when(has("remove") & (F.size("ops") > 1), "removed and patched").when(F.col("n") != F.col("d"), "repeated operation")
    return both.select(key, reason.alias("reason")).where(F.col("reason").isNotNull())


def apply(old: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """The new table, each column cast to its old type."""
    fields = [c for c in old.columns if c != key]
    patch = ops.groupBy(key).agg(F.max(F.when(F.col("op") == "remove", 1)).alias("gone"), F.max(F.when(F.col("op") == "add", 1)).alias("new"), *[F.max(F.when(F.col("field") == c, F.struct(F.lit(1).alias("is"), "value"))).alias(f"p_{c}") for c in fields])
    both = old.join(patch, key, "full_outer").where(F.col("gone").isNull())
    kinds = dict(old.dtypes)
    return both.select(key, *[F.when(F.col(f"p_{c}").isNotNull(), F.col(f"p_{c}")["value"].cast(kinds[c])).otherwise(F.col(c)).alias(c) for c in fields])


def identical(a: DataFrame, b: DataFrame) -> bool:
    return not a.exceptAll(b).take(1) and not b.exceptAll(a).take(1)


def repeated(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def closure(edges: DataFrame, roots: DataFrame, depth: int, most_nodes: int | None = None) -> DataFrame:
    """``root, node, depth``: what each root reaches in ``depth`` steps at most, with the fewest steps.

    Level by level with an anti join on what is reached; ``most_nodes`` bounds
    the distinct nodes of a root, taken in order of discovery. Levels are few,
    so each is cut from its lineage by a reliable checkpoint.
    """
    seen = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth")).distinct()
    frontier, reached = seen, [seen]
    for level in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = step.join(reduce(DataFrame.unionByName, reached).select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(level))
        if edges.sparkSession.sparkContext.getCheckpointDir():
            frontier = frontier.checkpoint()
        reached.append(frontier)
    out = reduce(DataFrame.unionByName, reached)
    if most_nodes is not None:
        from pyspark.sql import Window

        w = Window.partitionBy("root").orderBy("depth", "node")
        out = out.withColumn("order", F.row_number().over(w)).where(F.col("order") <= most_nodes).drop("order")
    return out
