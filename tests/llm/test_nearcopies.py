import re

import numpy as np
import pytest

from tracelake.llm import components, nearcopies, queries
from tracelake.llm.common import written

SF = "/root/testdata/sf0.01"


def _set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _brute(rows, width, percent):
    """``(doc_id, n, component)`` by comparing every pair that shares a shingle."""
    sets = [_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    seen = set()
    for own in holders.values():
        for i in own:
            for j in own:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * len(sets[i] | sets[j]):
                        parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d is None, d, len(s), least.get(root(i), d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _run(spark, rows, width=3, percent=85, **k):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, print string, n int").repartition(3)
    return sorted(((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in nearcopies.find(docs, width, percent, **k).collect()), key=str)


def test_query_against_brute_force_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op6_near_copies(spark, SF).collect()
    assert sorted(((False, r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _brute(rows, 3, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("small_group", [2, 32])
def test_chains_and_groups_without_an_original(spark, small_group):
    r = np.random.default_rng(4)
    word = lambda: "".join(r.choice(list("abcdefghij"), 4))
    base = [word() for _ in range(120)]
    rows, text = [], list(base)
    for i in range(9):  # a chain: each link holds, far ends do not
        rows.append((1000 - i, " ".join(text)))
        text[(3 * i) % 120] = word()
    for i in range(8):  # edits of one text that is not there
        own = list(base[::-1])
        for j in r.choice(120, 2, replace=False):
            own[j] = word()
        rows.append((2000 + i, " ".join(own)))
    rows += [(3000 + i, rows[i % 5][1]) for i in range(10)]
    assert _run(spark, rows, small_group=small_group) == _brute(rows, 3, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "A"), (6, "a b"), (7, "a\tb"), (8, "a b c"), (8, "a b c"), (None, "a b c"), (9, "É x é"), (10, "é x é"), (11, "w x y z"), (12, "word " * 90000), (13, "word " * 90001), (None, "lone text here")]
    assert _run(spark, rows) == _brute(rows, 3, 85)
    assert _run(spark, []) == []
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, component_id string")
    kept = nearcopies.keep_one(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == [1, 2, 3, 4, 6, 8, 8, 9, 10, 11, 12]


def test_keep_one_goes_by_id_and_text(spark):
    a, b, c = "one text of some words here", "quite another matter that stands alone", "the third one, by null"
    rows = [(3, a), (7, a), (7, b), (7, b), (8, b), (None, c), (9, c), (None, c), (10, None), (10, ""), (11, a + " and more that makes it differ by far too much")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(((r.doc_id, r.text) for r in nearcopies.keep_one(docs).collect()), key=str)
    assert kept == sorted([(3, a), (7, b), (7, b), (None, c), (None, c), (9, c), (10, None), (10, ""), rows[-1]], key=str)


def test_keep_one_leaves_one_text_of_an_id_in_a_component(spark):
    words = [f"w{i}" for i in range(200)]
    a, b = " ".join(words), " ".join([*words[:-1], "x"])
    docs = spark.createDataFrame([(5, a), (5, b), (6, b)], "doc_id long, text string")
    assert nearcopies.keep_one(docs).count() == 1


def test_sets_too_large_for_one_task_are_compared_alike(spark, monkeypatch):
    links = nearcopies._links
    monkeypatch.setattr(nearcopies, "_links", lambda *a: links(*a, most_bytes=1000))
    test_chains_and_groups_without_an_original(spark, 32)


def _family(copies):
    """Copies of one text of 300 words with 16 edits each: they meet in groups, but no two are linked; and two that are."""
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefghij"), 5))
    base = [word() for _ in range(300)]
    rows = []
    for i in range(copies):
        own = list(base)
        for j in r.choice(300, 16, replace=False):
            own[j] = word()
        rows.append((i, " ".join(own)))
    near = rows[-1][1].split(" ")
    near[7] = word()
    return [*rows, (copies, " ".join(near))]


def test_no_pairs_of_a_large_group_are_listed(spark, monkeypatch):
    rows, plausible, listed = _family(130), nearcopies._plausible, []

    def counted(pairs, *a):
        listed.append(pairs.count())
        return plausible(pairs, *a)

    monkeypatch.setattr(nearcopies, "_plausible", counted)
    got = _run(spark, rows, small_group=16)
    assert got == _brute(rows, 3, 85)
    assert len({x[3] for x in got}) < len(rows)
    # Pairs with centres, and those of small groups; all pairs are 8,515.
    assert sum(listed) < 3000


@pytest.mark.parametrize("most", [1 << 24, 20_000])
def test_large_groups_are_compared_whole_or_by_parts(spark, monkeypatch, most):
    exhausted = nearcopies._exhausted
    monkeypatch.setattr(nearcopies, "_exhausted", lambda *a: exhausted(*a, most_bytes=most))
    rows = _family(40)
    assert _run(spark, rows, small_group=4) == _brute(rows, 3, 85)
    test_chains_and_groups_without_an_original(spark, 2)


def test_what_many_tasks_compare_is_written_in_few_files(spark):
    nodes = spark.range(400).selectExpr("id as v", "1L as n", "cast('x' as binary) as value")
    pairs = spark.range(0, 400, 2).selectExpr("id as a", "id + 1 as b", "id as near")
    ends = pairs.select("near", pairs["a"].alias("v")).union(pairs.select("near", pairs["b"].alias("v"))).join(nodes, "v")
    kept = written(nearcopies._compared(pairs, ends, lambda x, y: np.ones(len(x), bool)), "kept")
    assert kept.count() == 200
    assert len(kept.inputFiles()) <= 4


def test_estimates_are_near_the_truth():
    r = np.random.default_rng(9)
    for n, j in ((2000, 0.85), (500, 0.5), (4000, 0.95)):
        both = int(n * j)
        errors = []
        for _ in range(60):
            pool = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[: both + (n - both) // 2]), np.sort(np.concatenate([pool[:both], pool[both + (n - both) // 2 :]]))
            pool = r.permutation(pool)
            a, b = np.sort(pool[: both + (n - both) // 2]), np.sort(np.concatenate([pool[:both], pool[both + (n - both) // 2 :]]))
            e, _ = nearcopies.estimate(nearcopies.sketch(a)[None], nearcopies.sketch(b)[None], np.array([len(a)]), np.array([len(b)]))
            errors.append(e[0] - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.02


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(1, i) for i in range(2, 60)] + [(300, 301), (301, 300), (302, 300), (7, 7), (400, 400)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 181)}, **{i: 1 for i in range(1, 60)}, 300: 300, 301: 300, 302: 300}
