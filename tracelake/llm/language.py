"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text's features are its character 2-, 3- and 4-grams over letters (lower
case; every other run of characters is one space), hashed to ``BUCKETS``
embeddings that are averaged over the whole text; a linear softmax on the
average gives the language. Both layers are trained here by stochastic gradient
descent in numpy on a bounded sample, balanced by language: at most
``sample_per_language`` labelled documents each. As the classifier is linear
behind the average, prediction folds both layers into one table of logits by
bucket and needs one gather a gram.

A fifth of the sample is kept back to calibrate: a temperature is fitted on it,
and documents whose calibrated probability is under a threshold are rejected.
The threshold keeps ``keep`` of the calibration documents and is never above
``HIGHEST_THRESHOLD``. Grams never seen in training have no embedding and pull
the average to the prior, so unknown languages end with a low score.

Defined results: a null text and one without a letter are ``und`` with score 0
and rejected; rows with null id or null label are never learned from; without
any labelled row every text is ``und``; ties go to the first language in
alphabetical order; repeated rows get equal results; of the other columns none
is an input of a prediction.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import lean, slices

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
SAMPLE_PER_LANGUAGE, EPOCHS, RATE, SEED = 600, 6, 0.5, 20240
HIGHEST_THRESHOLD = 0.5
#: A label set beyond this is refused: it is not one of languages.
MOST_LANGUAGES = 1000
_CHUNK = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    """Per code point: itself if a letter, else a space."""
    points = np.arange(0x110000, dtype=np.uint32)
    is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(is_letter, points, np.uint32(32))


class Model:
    """Logits by bucket, their bias, the languages, the temperature and the threshold."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.languages, self.table, self.bias, self.temperature, self.threshold = languages, table, bias, temperature, threshold

    def logits(self, texts: list[str]) -> np.ndarray:
        """Mean logits of each text, over all of it."""
        out = np.zeros((len(texts), len(self.languages)))
        for start, stop in slices([len(t) for t in texts], _CHUNK):
            part = texts[start:stop]
            total, count = self._sums(part)
            out[start:stop] = total / np.maximum(count, 1)[:, None]
        return out + self.bias

    def _sums(self, texts):
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        lower = [t.lower() for t in texts]
        points = _letters()[np.frombuffer(f" {'  '.join(lower)} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
        lengths = np.fromiter(map(len, lower), np.int64, len(texts)) + 2
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32) | (owner[1:] != owner[:-1])
        points, owner = points[keep], owner[keep]
        # Very long texts are hashed in ranges of gram starts, each gram in one of them.
        for n in ORDERS:
            for lo in range(0, len(points) - n + 1, 2 * _CHUNK):
                h = _hashes(points[lo : lo + 2 * _CHUNK + n - 1], n)
                own, last = owner[lo : lo + len(h)], owner[lo + n - 1 : lo + n - 1 + len(h)]
                inside = own == last
                h, own = h[inside], own[inside]
                starts = np.searchsorted(own, np.arange(len(texts)))
                sizes = np.diff(np.append(starts, len(h)))
                has = sizes > 0
                if has.any():
                    for k in range(len(self.languages)):
                        total[has, k] += np.add.reduceat(self.table[k].take(h), starts[has], dtype=np.float64)
                count += sizes
        return total, count

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """Language, calibrated probability and whether it is accepted."""
        has = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        z = self.logits([t if ok else "" for t, ok in zip(texts, has)]) / self.temperature if self.languages else np.zeros((len(texts), 0))
        out = []
        for row, ok in zip(z, has):
            if not ok or not self.languages:
                out.append(("und", 0.0, False))
                continue
            e = np.exp(row - row.max())
            best = int(row.argmax())
            score = float(e[best] / e.sum())
            out.append((self.languages[best], score, score >= self.threshold))
        return out


def _hashes(points: np.ndarray, n: int) -> np.ndarray | None:
    if len(points) < n:
        return None
    h = np.full(len(points) - n + 1, n, np.uint32)
    for i in range(n):
        h ^= points[i : len(points) - n + 1 + i] * _MULTIPLIERS[i]
        h = (h << np.uint32(13)) | (h >> np.uint32(19))
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(16)
    return h & np.uint32(BUCKETS - 1)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one text and their shares."""
    points = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    found = [h for n in ORDERS if (h := _hashes(points[keep], n)) is not None]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int64), (n / n.sum()).astype(np.float32)


def train(rows: Iterable[tuple[str, str]], keep: float = 0.999, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit on ``(text, language)`` rows; their order does not matter."""
    rows = sorted({(t, lang) for t, lang in rows if t and lang and any(map(str.isalpha, t))})
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return Model([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    bags = [_bag(rows[i][0]) for i in order]
    y = np.array([languages.index(rows[i][1]) for i in order])
    aside = max(1, len(rows) // 5) if len(rows) >= 20 else 0
    k = len(languages)
    seen = np.zeros(BUCKETS, bool)
    for ids, _ in bags[aside:]:
        seen[ids] = True
    embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32) * seen[:, None]
    weight, bias = rng.normal(0, 0.3, (DIM, k)).astype(np.float32), np.zeros(k, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in aside + rng.permutation(len(rows) - aside):
            ids, share = bags[i]
            hidden = share @ embed[ids]
            z = hidden @ weight + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            back = weight @ g
            weight -= step * np.outer(hidden, g)
            bias -= 0.1 * step * g
            # A gram's own share is small; the embeddings' step is scaled by the number of grams.
            embed[ids] -= (step * len(ids)) * 0.2 * share[:, None] * back[None, :]
    table = np.ascontiguousarray((embed @ weight).T.astype(np.float32))
    model = Model(languages, table, bias.astype(float))
    held = range(aside) if aside else range(len(rows))
    z = np.array([table[:, bags[i][0]] @ bags[i][1] + bias for i in held], float).reshape(-1, k)
    own = y[list(held)]
    model.temperature = min(np.geomspace(0.05, 20, 60), key=lambda t: _loss(z / t, own))
    p = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
    top = np.sort((p / p.sum(1, keepdims=True)).max(1))
    model.threshold = float(min(HIGHEST_THRESHOLD, top[int((1 - keep) * len(top))]))
    return model


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    z = z - z.max(1, keepdims=True)
    return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(y)), y]).mean())


def held_out():
    """Whether crc32 of the id as text leaves no remainder by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample_per_language: int = SAMPLE_PER_LANGUAGE, **params) -> Model:
    """Train on a hashed sample of labelled rows, ``sample_per_language`` each at most.

    The number of rows by language is counted over all documents; each language
    is then thinned by a hash of its rows to that number in expectation, and a
    limit holds where repeated rows would pass it.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} different labels are no languages")
    if not counts:
        return train([])
    scale = 1 << 30
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(scale, int(scale * sample_per_language / n)))])
    picked = usable.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(scale)) < F.element_at(rate, F.col("lang")))
    rows = picked.select("text", "lang").limit(2 * sample_per_language * len(counts)).collect()
    return train([(r["text"], r["lang"]) for r in rows], **params)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, accepted`` of every document."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            lang, score, accepted = zip(*model.predict(texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names)

    names = ["doc_id", "held_out", "lang_pred", "score", "accepted"]
    slim = docs.select("doc_id", held_out().alias("held_out"), "text")
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is accepted, with their columns as they are."""

    def run(batches):
        for batch in batches:
            accepted = [ok for _, _, ok in model.predict(batch.column("text").to_pylist())]
            yield batch.filter(pa.array(accepted, pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
