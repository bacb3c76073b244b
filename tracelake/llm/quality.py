"""Document quality from weak labels: labellers, expectation-maximisation, a hashed scorer.

Each labeller is a cheap heuristic that votes good, bad or nothing on a whole
text. Their votes overlap and contradict each other; expectation-maximisation
over the counts of all vote patterns of the corpus (a bounded table, as there
are ``3 ** len(LABELLERS)`` patterns at most) estimates how each labeller votes
on good and on bad documents, and so a posterior for every pattern. Posterior
labels then train a logistic scorer on hashed byte trigrams, on a sample of
``SAMPLE`` documents of either class at most; the scorer sees what the
heuristics do not, and its probability decides.

Defined results: a null, empty or blank text has no votes, posterior and score 0
and is not kept; with no two classes in the sample the score is the posterior;
repeated rows get equal results; null ids are scored like others; other columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import mix64, slices

BUCKETS, SAMPLE, SEED, EPOCHS = 1 << 18, 1500, 4711, 4
FALSE_ALARM, PRIOR = 0.005, 0.5
BLOCK, WINDOW = 4000, 8
_FUNCTION_WORDS = frozenset("the of and to in a is that for it was with as on by this be at or from an are not but he she they der die das und ist nicht ein eine zu den mit von im auf sich dem des le la les de et un une du des est que qui dans en pour sur pas par avec el los las del una y es con por no se su lo para".split())
#: Upper case, lower case, digit, space, line end, terminal mark, other ASCII mark, beyond ASCII.
_CLASS = np.full(256, 7, np.uint8)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".!?" else 6
_COMMON_MARKS = np.zeros(256, bool)
_COMMON_MARKS[list(b",;:'\"()-")] = True


def _vote(value: float, good, bad) -> str:
    return "1" if good(value) else "0" if bad(value) else "-"


def _case(f):
    return _vote(f["upper"], lambda v: v < 0.2, lambda v: v > 0.5)


def _symbols(f):
    return _vote(f["odd"], lambda v: v < 0.01, lambda v: v > 0.04)


def _stress(f):
    return _vote(f["stress"], lambda v: v < 0.05, lambda v: v > 0.25)


def _word_length(f):
    return _vote(f["word_length"], lambda v: 3 <= v <= 9, lambda v: v < 2 or v > 14)


def _repetition(f):
    return "-" if f["words"] < 40 else _vote(f["variety"], lambda v: v > 1.2, lambda v: v < 0.9)


def _echo(f):
    return "-" if f["words"] < 4 else _vote(f["echo"], lambda v: v < 0.05, lambda v: v > 0.3)


def _function_words(f):
    return "-" if f["words"] < 10 else _vote(f["function"], lambda v: v > 0.12, lambda v: v < 0.03)


def _sentences(f):
    return "-" if f["words"] < 15 else _vote(f["sentence"], lambda v: 3 <= v <= 40, lambda v: v > 120 or v < 1.5)


def _digits(f):
    return _vote(f["digits"], lambda v: v < 0.05, lambda v: v > 0.3)


LABELLERS = (_case, _symbols, _stress, _word_length, _repetition, _echo, _function_words, _sentences, _digits)
#: Features that also enter the scorer, each hashed by its name.
NAMED = ("upper", "odd", "stress", "echo", "function", "digits")


def _variety(words: list[str], distinct: int) -> float:
    """Distinct words by the number that a text of that length has.

    A text of over ``BLOCK`` words is measured on all of its consecutive blocks, and
    the mean is lowered by the share of its windows of ``WINDOW`` words that have come before.
    """
    if len(words) <= BLOCK:
        return distinct / max(len(words), 1) ** 0.8
    place: dict[str, int] = {}
    codes = mix64(np.fromiter((place.setdefault(w, len(place)) + 1 for w in words), np.uint64, len(words)))
    blocks = np.array_split(codes, -(-len(words) // BLOCK))
    mean = sum(len(np.unique(b)) / len(b) ** 0.8 for b in blocks) / len(blocks)
    n = len(words) - WINDOW + 1
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows = mix64(windows + codes[k : k + n])
    return mean * len(np.unique(windows)) / n


def features(text: str) -> dict[str, float]:
    """What the labellers look at, from all bytes and all words."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=8)
    words = text.split()
    distinct = Counter(words)
    letters = n[0] + n[1] + n[7] / 2
    marks = np.bincount(raw, minlength=128)
    common = int(marks[:256][_COMMON_MARKS[: len(marks)]].sum())
    counted = max(len(words), 1)
    return {
        "words": len(words),
        "variety": _variety(words, len(distinct)),
        "echo": sum(map(eq, words, words[1:])) / counted,
        "upper": n[0] / max(letters, 1),
        "odd": max(n[6] - common, 0) / max(len(raw), 1),
        "stress": (marks[33] + marks[63]) / counted,
        "word_length": (len(text) - n[3] - n[4]) / counted,
        "function": sum(k for w, k in distinct.items() if w.lower().strip(".,") in _FUNCTION_WORDS) / counted,
        "sentence": counted / max(int(marks[46] + marks[33] + marks[63]), 1),
        "digits": n[2] / max(len(raw) - n[3] - n[4], 1),
    }


def votes(text: str | None) -> str:
    """One character by labeller: ``1`` good, ``0`` bad, ``-`` no vote."""
    if not text or not text.strip():
        return "-" * len(LABELLERS)
    f = features(text)
    return "".join(labeller(f) for labeller in LABELLERS)


def expectation_maximisation(counts: dict[str, int], rounds: int = 200, tolerance: float = 1e-9) -> dict[str, float]:
    """Posterior of being good for every vote pattern.

    The labellers each look for one kind of fault, so on bad documents most of them
    vote good: what they share is that they seldom vote bad on a good one. Hence
    the start (a second bad vote makes a document likely bad) and the prior, which
    holds ``FALSE_ALARM`` of a good document's votes to be bad and weighs as much as
    ``PRIOR`` of the corpus. Estimates are smoothed by one imagined document.
    """
    patterns = sorted(counts)
    if not patterns:
        return {}
    n = np.array([counts[p] for p in patterns], float)
    v = np.array([["10-".index(c) for c in p] for p in patterns])
    bad = (v == 1).sum(1)
    posterior = np.choose(np.minimum(bad, 2), [0.95, 0.6, 0.05])
    for _ in range(rounds):
        log = []
        for weight, prior in ((n * posterior, PRIOR * n.sum() * np.array([1 - FALSE_ALARM, FALSE_ALARM])), (n * (1 - posterior), np.zeros(2))):
            total = weight.sum()
            rates = np.array([[weight[v[:, j] == k].sum() + 1 for k in range(2)] for j in range(v.shape[1])]) + prior
            # A labeller that abstains says nothing either way.
            rates /= rates.sum(1, keepdims=True)
            said = np.where(v < 2, np.log(rates[np.arange(v.shape[1]), np.minimum(v, 1)]), 0)
            log.append(np.log(total + 1) + said.sum(1))
        after = 1 / (1 + np.exp(np.clip(log[1] - log[0], -500, 500)))
        done = np.abs(after - posterior).max() < tolerance
        posterior = after
        if done:
            break
    # A document on which nobody votes is not shown to be good.
    return {p: 0.0 if set(p) == {"-"} else float(x) for p, x in zip(patterns, posterior)}


def _trigrams(raw: np.ndarray) -> np.ndarray:
    a = raw.astype(np.uint32)
    h = a[:-2] * np.uint32(0x9E3779B1) ^ a[1:-1] * np.uint32(0x85EBCA77) ^ a[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(7)) & np.uint32(BUCKETS - 1)


_NAMED_AT = np.array([zlib.crc32(name.encode()) % BUCKETS for name in NAMED])


def _named(text: str) -> np.ndarray:
    f = features(text)
    if f["words"] < 10:
        f["function"] = 0.2  # too few words to tell
    return np.array([f[name] for name in NAMED], np.float32)


class Scorer:
    """Mean weight of a text's byte trigrams and weighted named features, scaled to a probability."""

    def __init__(self, weights: np.ndarray, scale: float, shift: float):
        self.weights, self.scale, self.shift = weights, scale, shift

    def means(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        for start, stop in slices([len(r) for r in raws], 1 << 22):
            raw = np.frombuffer(b"".join(b"\n\n" + r + b"\n\n" for r in raws[start:stop]), np.uint8)
            weight = self.weights[_trigrams(raw)]
            ends = np.cumsum([len(r) + 4 for r in raws[start:stop]])
            begins = ends - [len(r) + 4 for r in raws[start:stop]]
            # Windows that reach into the next text are left out.
            sums = np.add.reduceat(np.append(weight, [0, 0]).astype(np.float64), begins)
            for k in (1, 2):
                inner = ends - k < len(weight)
                sums[inner] -= weight[(ends - k)[inner]]
            out[start:stop] = sums / (ends - begins - 2)
        return out + np.array([_named(t or "") for t in texts], np.float32).reshape(-1, len(NAMED)) @ self.weights[_NAMED_AT]

    def scores(self, texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.means(texts) + self.shift, -50, 50)))


def train(rows: list[tuple[str, float]], epochs: int = EPOCHS, rate: float = 3.0) -> Scorer | None:
    """Fit on ``(text, posterior)``; None unless both classes are there. The rows' order does not matter."""
    rows = sorted(set(rows))
    y = np.array([p for _, p in rows])
    if not len(y) or y.max() < 0.5 or y.min() >= 0.5:
        return None
    r = np.random.default_rng(SEED)
    bags = []
    for text, _ in rows:
        ids, n = np.unique(_trigrams(np.frombuffer(b"\n\n" + text.encode("utf-8", "surrogatepass") + b"\n\n", np.uint8)), return_counts=True)
        bags.append((np.append(ids, _NAMED_AT), np.append((n / n.sum()).astype(np.float32), _named(text))))
    weights, bias = np.zeros(BUCKETS, np.float32), 0.0
    # Each class has half of the weight however many documents it has.
    balance = np.where(y >= 0.5, len(y) / (2 * (y >= 0.5).sum()), len(y) / (2 * (y < 0.5).sum()))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in r.permutation(len(rows)):
            ids, share = bags[i]
            p = 1 / (1 + np.exp(-np.clip(weights[ids] @ share + bias, -50, 50)))
            g = (p - y[i]) * balance[i]
            weights[ids] -= 0.1 * step * g * share / max(float(share @ share), 1e-3)
            bias -= 0.01 * step * g
    scorer = Scorer(weights, 1.0, bias)
    z = scorer.means([t for t, _ in rows])
    # Platt scaling by Newton steps on the same sample, towards its posteriors.
    a, b = 1.0, bias
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        w = balance * np.maximum(p * (1 - p), 1e-6)
        g = np.array([(balance * (p - y) * z).sum() + 1e-3 * (a - 1), (balance * (p - y)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(h, g)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Scorer(weights, float(a), float(b))


def pattern_counts(docs: DataFrame) -> dict[str, int]:
    """How many documents have each vote pattern, over all documents."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"votes": [votes(t) for t in batch.column("text").to_pylist()]})

    counted = docs.select("text").mapInArrow(run, "votes string").groupBy("votes").count()
    return {r["votes"]: r["count"] for r in counted.collect()}


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], Scorer | None]:
    """Posteriors by pattern, and the scorer trained on a hashed sample of both classes."""
    counts = pattern_counts(docs)
    posterior = expectation_maximisation(counts)
    of_class = {True: 0, False: 0}
    for pattern, n in counts.items():
        of_class[posterior[pattern] >= 0.5] += n
    scale = 1 << 30
    rate = {k: min(scale, int(scale * sample / n)) if n else 0 for k, n in of_class.items()}

    def run(batches):
        for batch in batches:
            texts, draws = batch.column("text").to_pylist(), batch.column("draw").to_pylist()
            own = [posterior[votes(t)] for t in texts]
            kept = [i for i, (p, d) in enumerate(zip(own, draws)) if texts[i] and d < rate[p >= 0.5]]
            yield pa.RecordBatch.from_arrays([pa.array([texts[i] for i in kept], pa.string()), pa.array([own[i] for i in kept], pa.float64())], ["text", "posterior"])

    drawn = docs.select("text", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(scale)).alias("draw")).where(F.col("draw") < max(rate.values()))
    rows = drawn.mapInArrow(run, "text string, posterior double").limit(4 * sample).collect()
    return posterior, train([(r["text"], r["posterior"]) for r in rows])


def classify(docs: DataFrame, sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``doc_id, votes, posterior, score, keep`` of every document."""
    posterior, scorer = fit(docs, sample)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cast = [votes(t) for t in texts]
            own = np.array([posterior[v] for v in cast])
            score = np.where([bool(t and t.strip()) for t in texts], scorer.scores(texts) if scorer else own, 0.0) if texts else own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cast, pa.string()), pa.array(own, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= threshold, pa.bool_())], ["doc_id", "votes", "posterior", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, votes string, posterior double, score double, keep boolean")
