"""Connected components of an edge table by alternating stars, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import written

#: Members of a group whose pairs are listed, and of a part of a group that is compared with its centre.
SMALL_GROUP, PART = 64, 1024


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b"), F.col("a"))).toDF("a", "b")


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = _both(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them. Needs ``a > b``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the smallest node that each node with an edge reaches.

    ``edges`` has ``a`` and ``b``; their order and repetitions do not matter.
    Minima are found with partial aggregates, so a hub is no hot group; every
    round is written to the shared folder. The rounds end when a round changes
    nothing, which happens after about the squared logarithm of the nodes.
    """
    now = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return stars.union(now.select(F.col("b"), F.col("b"))).distinct()
        before = state
        now = written(_small_star(_large_star(now)), "stars")
    raise RuntimeError("the components did not settle")


def grouped_components(members: DataFrame, confirm, may_link, exhaust, small_group: int = SMALL_GROUP) -> DataFrame:
    """``node, root`` of the links between members of one group.

    ``members`` (``meet, v, mark``, a written table) says which nodes meet in which groups,
    and gives each a small mark; ``may_link`` is a cheap predicate on two marks, ``confirm``
    takes pairs ``a, b, near`` and returns those ``a, b`` that are links. Pairs of equal ``near``
    come from one group and have few nodes, so that what is to be compared can be sent there once
    a node instead of once a pair. First every member is compared with the group's centre,
    which is the member that meets most others. Where a group still holds several
    components, small groups compare members across components, pair by pair, and larger ones
    go to ``exhaust``, which takes ``meet, v, root, mark`` and returns links ``a, b`` that join
    all those components of a group between which it has a link; no pairs of theirs are listed.
    So the components are those of all links.
    """
    sizes = members.groupBy("meet").agg(F.count("*").alias("size"))
    sized = written(members.join(sizes, "meet"), "sized")
    weights = sized.groupBy("v").agg(F.sum("size").alias("weight"))
    spark = members.sparkSession
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def listed(pairs):
        """A pair that meets in several groups is compared in the largest, where most others are."""
        return pairs.toDF("a", "b", "size", "near").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct("size", "near"))["near"].alias("near"))

    order = Window.partitionBy("meet").orderBy(F.desc("weight"), "v")
    heads = sized.join(weights, "v").withColumn("place", F.row_number().over(order)).where(F.col("place") == 1)
    heads = written(heads.select("meet", F.col("v").alias("centre"), F.col("mark").alias("m")), "centres")
    part = F.xxhash64("meet", F.pmod(F.xxhash64("v"), F.ceil(F.col("size") / PART)))
    first = sized.join(heads, "meet").where((F.col("v") != F.col("centre")) & may_link(F.col("mark"), F.col("m")))
    compared = written(listed(first.select("centre", "v", "size", part.alias("near"))), "pairs")
    linked = written(confirm(compared), "linked")
    roots = written(components(linked), "roots")

    # In a group of two nothing is left to compare.
    now = sized.where(F.col("size") > 2).join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    mixed = now.groupBy("meet").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(F.col("low") < F.col("high"))
    active = written(now.join(mixed.select("meet"), "meet", "left_semi"), "active")
    if not active.take(1):
        return roots
    # A stated number of tasks: few bytes make many comparisons, and the adaptive planner goes by bytes.
    small = active.where(F.col("size") <= small_group).repartition(tasks, "meet")
    other = small.select("meet", F.col("v").alias("w"), F.col("root").alias("root_w"), F.col("mark").alias("m"))
    pairs = small.join(other, "meet").where((F.col("v") < F.col("w")) & (F.col("root") != F.col("root_w")) & may_link(F.col("mark"), F.col("m")))
    pairs = written(listed(pairs.select("v", "w", "size", "meet")).join(compared.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    further = written(confirm(pairs), "linked")
    large = active.where(F.col("size") > small_group)
    joined = written(exhaust(large.select("meet", "v", "root", "mark")), "linked") if large.take(1) else further
    return written(components(linked.union(further).union(joined)), "roots")
