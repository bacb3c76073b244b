import numpy as np
import pytest

from tracelake.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_against_labels_that_training_never_sees(spark):
    got = {r.doc_id: r for r in queries.op9_quality(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    bad = [d for d, q in labels.items() if q == 0]
    good = [d for d, q in labels.items() if q == 1]
    assert np.mean([not got[d].keep for d in bad]) > 0.95
    assert np.mean([got[d].keep for d in good]) > 0.98


def test_labeller_accuracies_are_recovered():
    r = np.random.default_rng(1)
    truth = r.random(6000) < 0.85
    counts = {}
    truths = {}
    for t in truth:
        # Faults are of different kinds, and each labeller sees its own.
        kind = r.integers(0, 3)
        p = "".join("0" if (not t and kind == j // 2 and r.random() < 0.95) or (t and r.random() < 0.004) else "-" if r.random() < 0.1 else "1" for j in range(6))
        counts[p] = counts.get(p, 0) + 1
        truths.setdefault(p, []).append(t)
    posterior = quality.expectation_maximisation(counts)
    right = sum(sum((posterior[p] >= 0.5) == t for t in ts) for p, ts in truths.items())
    assert right / 6000 > 0.97
    assert quality.expectation_maximisation({}) == {}
    assert quality.expectation_maximisation({"---": 5}) == {"---": 0.0}


def test_scores_do_not_depend_on_the_other_texts():
    scorer = quality.Scorer(np.random.default_rng(0).normal(size=quality.BUCKETS).astype("float32"), 1.0, 0.0)
    texts = ["", "a", "ab", "some more text", "é" * 1000, None]
    assert scorer.means(texts) == pytest.approx(np.concatenate([scorer.means([t]) for t in texts]), abs=1e-4)


def test_null_blank_long_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "the cat and the dog are in the house. " * 9), (4, "the cat and the dog are in the house. " * 9), (None, "word of the day. " * 60000), (6, "AAA!! BBB!! CCC!! " * 30)]
    docs = spark.createDataFrame([(*r, "z", 1.5) for r in rows], "doc_id long, text string, votes string, score double").repartition(2)
    got = quality.classify(docs).collect()
    assert len(got) == 7
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.votes, r.posterior, r.score, r.keep))
    assert all(len(v) == 1 for v in by.values())
    assert all(next(iter(by[i]))[2:] == (0.0, False) for i in (1, 2, 3))
    assert quality.classify(docs.limit(0)).count() == 0


def test_function_words_are_counted_over_all_words():
    # The period of the text is the stride by which words used to be picked.
    assert quality.features("the stone fell down " * 500)["function"] == pytest.approx(0.25)
    assert quality.features("stone the fell down " * 500)["function"] == pytest.approx(0.25)


def test_a_long_passage_that_recurs_is_repetition():
    r = np.random.default_rng(3)
    words = [f"w{i}" for i in r.integers(0, 6000, 30000)]
    at = quality.LABELLERS.index(quality._repetition)
    assert quality.votes(" ".join(words))[at] == "1"
    assert quality.votes(" ".join(words[:5000] * 6))[at] == "0"
