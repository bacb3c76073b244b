"""Exact top-k inner products over a bit-sliced index.

Vectors become integers ``floor(256 * x)``. A block of candidates is stored as
bit slices: for every bit of the two's complement there is one word per vector
(per 64 dimensions) whose bits are that bit of each component. A block of
queries is stored likewise, and the product of a query with one candidate slice
is a sum of population counts of ANDed words. Candidate slices are added from
the most significant one downward. After each, the slices still to come bound
every score from both sides; once the bounds leave few rows for a query, only
these boundary rows are resolved, by exact integer products. Nothing is
estimated, so recall is 1.

The index is a written table of blocks: ids, slices and the integers that
boundary rows are resolved by. Every ``QUERY_BLOCKS`` query blocks meet every row
block under one key, so that a row block is sent once for all of them; each
meeting returns ``k`` rows a query at most.

A vector with a component of ``LARGEST`` or beyond goes to blocks of its own.
Where a product of such blocks need not fit 62 bits, floating-point products
with their error bound take the place of the slices, and boundary rows are
resolved in integers of any size; a score beyond a long is ranked as it is and
returned as the nearest long.

Defined results: a vector that is null, empty or holds a null or non-finite
component takes no part; vectors of different lengths are never paired;
null ids take no part; repeated ids are separate candidates of one id, a
query's own id is never its candidate; fewer than ``k`` candidates give all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import written

LARGEST = 2**26
QUERY_BLOCK, ROW_BLOCK, TILE, QUERY_BLOCKS = 1024, 8192, 128, 16
MOST_TASKS = 20_000
_VALUES = ("wide", "ids", "vectors", "bits", "slices")
_BLOCK = "dim int, part long, wide boolean, ids binary, vectors binary, bits int, slices binary"


def _usable(df: DataFrame) -> DataFrame:
    whole = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    # NaN compares above every number in Spark, so it fails the bound just as an infinity does.
    return whole.where(~F.exists("v", lambda x: x.isNull() | (F.abs(x) >= F.lit(float("inf")))))


def _integers(v: np.ndarray) -> list[list[int]]:
    """``floor(256 * x)`` of each component as integers of any size."""
    return [[int(x) * 256 if abs(x) >= 2**53 else int(np.floor(x * 256)) for x in row] for row in v.tolist()]


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """Consecutive rows of one partition, dimension and width as one row of the index."""

    def pack(batches):
        from pyspark import TaskContext

        held: dict[tuple[int, bool], tuple[list, list]] = {}
        number = TaskContext.get().partitionId() << 20

        def block(key):
            nonlocal number
            (dim, wide), (ids, vectors) = key, held.pop(key)
            number += 1
            v = np.array(vectors, np.float64)
            bits, slices = 0, b""
            if not wide:
                v = np.floor(v * 256).astype("<i4")
                bits = _bits(v)
                slices = bit_slices(v, bits).tobytes()
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "part": pa.array([number - 1], pa.int64()), "wide": pa.array([wide]), "ids": [np.array(ids, "<i8").tobytes()], "vectors": [v.tobytes()], "bits": pa.array([bits], pa.int32()), "slices": [slices]})

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            column = batch.column("v")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
            for i, vec_id in enumerate(ids):
                v = flat[ends[i - 1] if i else 0 : ends[i]]
                key = (len(v), bool(np.abs(v).max() >= LARGEST / 256))
                own = held.setdefault(key, ([], []))
                own[0].append(vec_id)
                own[1].append(v)
                if len(own[0]) == rows:
                    yield block(key)
        for key in list(held):
            yield block(key)

    return df.mapInArrow(pack, _BLOCK)


def bit_slices(v: np.ndarray, bits: int) -> np.ndarray:
    """``(bits, rows, words)`` uint64: bit ``b`` of each component, 64 components a word."""
    n, dim = v.shape
    words = -(-dim // 64)
    out = np.empty((bits, n, words), np.uint64)
    wide = np.zeros((n, words * 64), np.uint8)
    for b in range(bits):
        wide[:, :dim] = (v >> b) & 1
        out[b] = np.packbits(wide, axis=1, bitorder="little").view("<u8")
    return out


def _bits(v: np.ndarray) -> int:
    """Bits of the two's complement that hold every component."""
    return int(max(v.max(initial=0), -(v.min(initial=0) + 1))).bit_length() + 1


def _ranked(q: np.ndarray, r: np.ndarray, score: np.ndarray, row_ids: np.ndarray, k: int):
    """The best ``k`` rows of each query, best first, ties by id."""
    order = np.lexsort((row_ids[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], r[keep], score[keep]


def best_wide(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """:func:`best` for components of any size, given as doubles to be scaled."""
    out = []
    with np.errstate(over="ignore", invalid="ignore"):
        q_f, r_f = np.floor(queries * 256), np.floor(rows * 256)
        error = (queries.shape[1] + 2) * 2.0**-51
        for start in range(0, len(queries), TILE):
            part = slice(start, min(start + TILE, len(queries)))
            about, size = q_f[part] @ r_f.T, np.abs(q_f[part]) @ np.abs(r_f).T * error
            own = query_ids[part, None] == row_ids[None, :]
            low = np.where(own, -np.inf, about - size)
            at = max(len(rows) - k, 0)
            # What is not a number is not ruled out.
            low = np.where(np.isnan(low), -np.inf, low)
            kth = np.partition(low, at, axis=1)[:, at]
            alive = ~own & ~(about + size < kth[:, None])
            q, r = np.nonzero(alive)
            exact_q, exact_r = _integers(queries[part]), {i: v for i, v in zip(np.unique(r).tolist(), _integers(rows[np.unique(r)]))}
            score = np.array([sum(a * b for a, b in zip(exact_q[i], exact_r[j])) for i, j in zip(q.tolist(), r.tolist())], object)
            order = sorted(range(len(q)), key=lambda i: (q[i], -score[i], row_ids[r[i]]))
            q, r, score = q[order], r[order], score[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            out.append((q[keep] + start, r[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.array([], int),) * 3


def best(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, sliced=None):
    """``(query index, row index, score)`` arrays of each query's best ``k`` rows of this block.

    ``sliced`` are the bits and slices of queries and of rows, where they are at hand.
    """
    queries, rows = queries.astype(np.int64), rows.astype(np.int64)
    if sliced is None:
        q_bits, r_bits = _bits(queries), _bits(rows)
        sliced = (q_bits, bit_slices(queries, q_bits)), (r_bits, bit_slices(rows, r_bits))
    (q_bits, q_slices), (r_bits, r_slices) = sliced
    weight = np.array([1 << b for b in range(q_bits - 1)] + [-(1 << (q_bits - 1))], np.int64)
    positive, negative = np.maximum(queries, 0).sum(1), np.minimum(queries, 0).sum(1)
    out = []
    for start in range(0, len(queries), TILE):
        stop = min(start + TILE, len(queries))
        partial = np.zeros((stop - start, len(rows)), np.int64)
        own = query_ids[start:stop, None] == row_ids[None, :]
        alive = None
        for b in range(r_bits - 1, -1, -1):
            add = np.zeros_like(partial)
            for a in range(q_bits):
                common = np.bitwise_count(q_slices[a, start:stop, None, 0] & r_slices[b, None, :, 0]).astype(np.int64)
                for w in range(1, q_slices.shape[2]):
                    common += np.bitwise_count(q_slices[a, start:stop, None, w] & r_slices[b, None, :, w])
                common *= weight[a]
                add += common
            partial += add * ((1 << b) if b < r_bits - 1 else -(1 << b))
            # The slices below b add between left*negative and left*positive.
            left = (1 << b) - 1
            floor = np.where(own, np.iinfo(np.int64).min // 2, partial + left * negative[start:stop, None])
            kth = np.partition(floor, max(len(rows) - k, 0), axis=1)[:, max(len(rows) - k, 0)]
            alive = ~own & (partial + left * positive[start:stop, None] >= kth[:, None])
            if alive.sum() <= 4 * k * (stop - start) or not b:
                break
        q, r = np.nonzero(alive)
        q += start
        score = np.empty(len(q), np.int64)
        for i in range(0, len(q), 65536):
            score[i : i + 65536] = (queries[q[i : i + 65536]] * rows[r[i : i + 65536]]).sum(1)
        out.append(_ranked(q, r, score, row_ids, k))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.array([], int),) * 3


def top_k(embeddings: DataFrame, is_query, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` highest integer inner products.

    ``is_query`` is a boolean column over ``vec_id``; candidates are all rows but
    those of the query's own id. Ties go to the smaller ``vec_id``.
    """
    usable = _usable(embeddings)
    # Written once: blocks are numbered by task, and every later reader must see the same numbers.
    queries = written(_blocks(usable.where(is_query).repartition("vec_id"), query_block), "query-blocks")
    rows = written(_blocks(usable, row_block), "row-blocks")
    # Numbers only: the blocks' vectors stay on the executors. Each key is one row block and a few query blocks, so none is hot.
    order = Window.partitionBy("dim").orderBy("part")
    named = queries.select("dim", "part").withColumn("team", F.floor((F.row_number().over(order) - 1) / QUERY_BLOCKS))
    named = written(named, "query-teams")
    teams = named.groupBy("dim").agg(F.collect_set("team").alias("teams"))
    row_parts = rows.groupBy("dim").agg(F.collect_set("part").alias("row_parts"))
    pairs = teams.join(row_parts, "dim").agg(F.sum(F.size("teams").cast("long") * F.size("row_parts"))).first()[0] or 1
    key, tasks = ["dim", "team", "row_part"], min(pairs, MOST_TASKS)
    left = rows.withColumnRenamed("part", "row_part").join(teams, "dim").withColumn("team", F.explode("teams")).drop("teams")
    right = queries.join(named, ["dim", "part"]).select("dim", "team", "part", *[F.col(c).alias(f"q_{c}") for c in _VALUES]).join(row_parts, "dim").withColumn("row_part", F.explode("row_parts")).drop("row_parts")
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key).select("dim", "part", "row_part", *_VALUES, *[f"q_{c}" for c in _VALUES])

    def scored(batches):
        for batch in batches:
            for row in batch.to_pylist():
                dim, wide, q_wide = row["dim"], row["wide"], row["q_wide"]
                q_ids, r_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                q_v, r_v = (np.frombuffer(row[c], "<f8" if w else "<i4").reshape(-1, dim) for c, w in (("q_vectors", q_wide), ("vectors", wide)))
                if wide or q_wide or dim << (row["bits"] + row["q_bits"] - 1) >= 1 << 62:
                    # Integers of narrow blocks are exact as doubles.
                    q_v, r_v = (v if w else v / 256 for v, w in ((q_v, q_wide), (r_v, wide)))
                    q, r, score = best_wide(q_v, q_ids, r_v, r_ids, k)
                else:
                    shaped = [(row[b], np.frombuffer(row[s], "<u8").reshape(row[b], -1, -(-dim // 64))) for b, s in (("q_bits", "q_slices"), ("bits", "slices"))]
                    q, r, score = best(q_v, q_ids, r_v, r_ids, k, shaped)
                exact = [str(x) for x in score.tolist()]
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[q], "vec_id": r_ids[r], "exact": pa.array(exact, pa.string()), "dim": np.full(len(q), dim, np.int32), "query_row": row["part"] * query_block + q})

    partial = met.mapInArrow(scored, "query_id long, vec_id long, exact string, dim int, query_row long")
    # As text, a score of any size sorts by sign, digits and value.
    below = F.col("exact").startswith("-")
    size, digits = F.length("exact"), F.col("exact")
    w = Window.partitionBy("dim", "query_row", "query_id").orderBy(below, F.when(below, size), F.when(below, digits), F.desc(F.when(~below, size)), F.desc(F.when(~below, digits)), "vec_id")
    fits = F.expr("try_cast(exact as long)")
    score = F.coalesce(fits, F.when(below, F.lit(-(1 << 63))).otherwise(F.lit((1 << 63) - 1)))
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
