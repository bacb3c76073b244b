import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelake.llm import topk


def _brute(rows, k, every):
    usable = {}
    for vec_id, v in rows:
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.setdefault(vec_id, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    out = []
    for q, vectors in usable.items():
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[0], c)), o) for o, cs in usable.items() if o != q for c in cs if len(c) == len(vectors[0]))
            out += [(q, i + 1, o, -s) for i, (s, o) in enumerate(scored[:k])]
    return sorted(out)


def _run(spark, rows, k=5, every=5, **blocks):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    return sorted(map(tuple, topk.top_k(df, F.col("vec_id") % every == 0, k, **blocks).collect()))


def test_against_brute_force_with_ties_nulls_and_small_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 1, 70).astype("float32").tolist(), "x") for i in range(120)]
    rows += [(200 + i, rows[3][1], "x") for i in range(4)]
    rows += [(300, None, None), (305, [None] * 70, "x"), (310, [float("nan")] + [0.0] * 69, "x"), (315, [], "x"), (320, [1.0, 2.0], "x"), (325, [3.0, -1.5], "x"), (330, [float("inf")] * 70, "x")]
    assert _run(spark, rows, query_block=7, row_block=16) == _brute([r[:2] for r in rows], 5, 5)


def test_fewer_candidates_than_k_and_empty_table(spark):
    rows = [(0, [1.0, 0.5], None), (1, [0.25, -8.0], None)]
    assert _run(spark, rows) == [(0, 1, 1, int(256 * 64 + 128 * -2048))]
    assert _run(spark, [(0, [1.0], None)]) == []
    assert _run(spark, []) == []


def test_bounds_leave_no_row_behind():
    rng = np.random.default_rng(7)
    for scale in (3, 40, 500):
        q, r = rng.integers(-scale, scale, (40, 64)), rng.integers(-scale, scale, (300, 64))
        ids = np.arange(300) + 1000
        got = topk.best(q, np.arange(40), r, ids, 5)
        exact = q @ r.T
        for i in range(40):
            want = sorted(range(300), key=lambda j: (-exact[i, j], ids[j]))[:5]
            assert got[1][got[0] == i].tolist() == want


@pytest.mark.parametrize("dim", [1, 3, 70])
def test_components_of_any_size_take_part(spark, dim):
    r = np.random.default_rng(dim)
    rows = [(i, (r.normal(size=dim) * 10.0 ** r.integers(-2, 30)).tolist()) for i in range(60)] + [(i, r.normal(size=dim).tolist()) for i in range(60, 120)]
    rows += [(200, [3e5] * dim), (201, [3e5] * dim), (202, [float("inf")] * dim), (203, [2.0**60] * dim), (204, [-(2.0**70)] * dim), (205, [1e300] * dim), (206, [-1e300] * dim), (205, [1e300] * dim)]
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(x * 256) for x in v] for i, v in rows if i != 202}
    kept = [(i, whole[i]) for i, _ in rows if i != 202]
    want = []
    for q, v in kept:
        if q % 2 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, o)), i) for i, o in kept if i != q)
            want += [(q, n + 1, i, max(-(1 << 63), min((1 << 63) - 1, -x))) for n, (x, i) in enumerate(scores[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, 5, query_block=8, row_block=16)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_a_large_component_is_no_reason_to_be_left_out(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [300000.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 1).collect()] == [(0, 1, 1, 256 * 256 * 300002)]
