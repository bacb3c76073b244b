"""Secret scanning: three exact rules and a character convolutional network.

The rules find assignments, access keys and long hexadecimal runs; the network
scores every other candidate (16 or more token characters in a row that belong to
no rule's span) in windows of its characters and the 16 before and after. A long
candidate is scored window by window, all of it, and its highest score counts.

The network (embedded characters, one convolution, maximum and mean over the
window, a logistic output) is trained here in numpy on labelled findings that
:func:`labelled` generates from a seed: credentials of common shapes in
contexts where they leak, and benign runs such as host names, paths, numbers,
identifiers, digits and words. A part is kept back; on it a temperature calibrates the
scores and the threshold is the highest one whose recall is at least ``RECALL``.
:func:`planted` puts findings into given texts, as a second set to measure on.

Rows are scanned as Latin-1 bytes with one byte for each code point, so byte
positions are code point positions; what lies beyond Latin-1 is no token
character either way.

Defined results: null and empty texts have no spans; repeated rows get equal
results; overlapping spans of different rules all stay; base64 of anything is what a
secret looks like and is reported; what lies beside a rule's
span in the same run is a candidate of its own; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "model")
LEAST, BODY, AROUND, RECALL = 16, 32, 16, 0.98
WIDTH = BODY + 2 * AROUND
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True


def long_runs(text: bytes) -> list[tuple[int, int]]:
    """Runs of ``LEAST`` token characters or more."""
    codes = np.frombuffer(text, np.uint8)
    edge = np.flatnonzero(np.diff(_TOKEN[codes], prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    far = ends - starts >= LEAST
    return list(zip(starts[far].tolist(), ends[far].tolist()))


def rule_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the three rules, sorted. Access keys and hexadecimal runs lie in long runs."""
    found = []
    if b":" in text or b"=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for start, end in runs:
        if end - start >= 20:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end)]
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end)]
    return sorted(found)


def candidates(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of runs outside of the rules' spans that have ``LEAST`` characters."""
    out, i, reach = [], 0, 0
    for start, end in runs:
        at = max(start, min(reach, end))
        while i < len(spans) and spans[i][0] < end:
            if spans[i][0] - at >= LEAST:
                out.append((at, spans[i][0]))
            reach = max(reach, spans[i][2])
            at = max(at, min(reach, end))
            i += 1
        if end - at >= LEAST:
            out.append((at, end))
    return out


def windows(text: bytes, start: int, end: int) -> np.ndarray:
    """Windows of ``WIDTH`` codes that cover a candidate; 128 is added inside of it."""
    out = []
    for at in range(start, end, BODY):
        w = np.zeros(WIDTH, np.uint8)
        lo, hi = max(0, at - AROUND), min(len(text), at + BODY + AROUND)
        codes = np.frombuffer(text[lo:hi], np.uint8) & 127
        inside = np.arange(lo, hi)
        w[lo - (at - AROUND) : hi - (at - AROUND)] = codes | np.where((inside >= start) & (inside < end), 128, 0).astype(np.uint8)
        out.append(w)
    return np.array(out)


class Network:
    """Embedding, convolution over five characters, maximum and mean, logistic output."""

    EMBED, SPAN, FILTERS = 8, 5, 24

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = np.float32
        self.p = {"e": r.normal(0, 0.5, (256, self.EMBED)).astype(f), "w": r.normal(0, 0.2, (self.SPAN * self.EMBED, self.FILTERS)).astype(f), "b": np.zeros(self.FILTERS, f), "o": r.normal(0, 0.2, 2 * self.FILTERS).astype(f), "c": np.zeros(1, f)}
        self.temperature, self.threshold = 1.0, 0.5

    def _forward(self, x):
        h = self.p["e"][x]
        n, width, _ = h.shape
        cols = np.lib.stride_tricks.sliding_window_view(h, self.SPAN, axis=1).transpose(0, 1, 3, 2).reshape(n, width - self.SPAN + 1, -1)
        z = np.maximum(cols @ self.p["w"] + self.p["b"], 0)
        pooled = np.concatenate([z.max(1), z.mean(1)], axis=1)
        return cols, z, pooled, pooled @ self.p["o"] + self.p["c"][0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each window."""
        out = [self._forward(x[i : i + 2048])[3] for i in range(0, len(x), 2048)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(out) / self.temperature, -50, 50))) if out else np.zeros(0)

    def train(self, x, y, epochs=5, rate=0.004, seed=5):
        r = np.random.default_rng(seed)
        m, v, t = {k: np.zeros_like(a) for k, a in self.p.items()}, {k: np.zeros_like(a) for k, a in self.p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), 64):
                b = order[i : i + 64]
                cols, z, pooled, out = self._forward(x[b])
                d = (1 / (1 + np.exp(-out)) - y[b]).astype(np.float32) / len(b)
                g = {"o": pooled.T @ d, "c": np.array([d.sum()], np.float32)}
                back = d[:, None] * self.p["o"][None, :]
                dz = np.repeat(back[:, None, self.FILTERS :] / z.shape[1], z.shape[1], axis=1)
                np.put_along_axis(dz, z.argmax(1)[:, None, :], np.take_along_axis(dz, z.argmax(1)[:, None, :], 1) + back[:, None, : self.FILTERS], 1)
                dz *= z > 0
                g["w"] = np.tensordot(cols, dz, axes=((0, 1), (0, 1)))
                g["b"] = dz.sum((0, 1))
                dcols = (dz @ self.p["w"].T).reshape(len(b), z.shape[1], self.SPAN, self.EMBED)
                dh = np.zeros((len(b), x.shape[1], self.EMBED), np.float32)
                for s in range(self.SPAN):
                    dh[:, s : s + z.shape[1]] += dcols[:, :, s]
                g["e"] = np.zeros_like(self.p["e"])
                np.add.at(g["e"], x[b].ravel(), dh.reshape(-1, self.EMBED))
                t += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)


def labelled(n: int = 4000, seed: int = 3) -> list[tuple[bytes, int, int, int]]:
    """``(text, start, end, label)`` findings: half are credentials, half are not."""
    r = np.random.default_rng(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def of(alphabet, lo, hi):
        return "".join(r.choice(list(alphabet), r.integers(lo, hi)))

    def word(lo=2, hi=9):
        return "".join(r.choice(["an", "er", "th", "on", "re", "in", "ti", "es", "or", "en", "st", "ou", "ción", "ung", "é", "que", "sch", "tz", "be", "keit", "lich", "pf", "ge", "men", "dor", "ee", "str", "mp", "gl", "wh", "bot", "ssa", "ck", "ry", "vi", "x"], r.integers(1, 4)))[:hi].encode("ascii", "ignore").decode() or "a"

    def words(k):
        return " ".join(word() for _ in range(k))

    def good():
        kind = r.integers(0, 9)
        if kind == 0:
            return f"{r.choice(['ghp', 'gho', 'glpat', 'npm', 'xoxb', 'sk', 'pk_live', 'rk_live'])}{r.choice(['_', '-'])}{of(lower + upper + digits, 20, 44)}"
        if kind == 1:
            return of(lower + upper + digits + "+/", 24, 64) + r.choice(["", "=", "=="])
        if kind == 2:
            return ".".join(of(lower + upper + digits + "_-", 18, 40) for _ in range(3))
        if kind == 3:
            return of("0123456789abcdef", 20, 24) + of("ABCDEF0123456789", 8, 20)
        if kind == 4:
            return f"AIza{of(lower + upper + digits + '_-', 30, 40)}"
        if kind == 5:
            return of(upper + digits, 20, 40)
        if kind == 6:
            return of("ABCDEF0123456789", 32, 65)
        if kind == 7:
            return of(lower + upper, 28, 48)
        return of(lower + upper + digits, 20, 48)

    def bad():
        kind = r.integers(0, 15)
        if kind == 0:
            return f"{word()}{r.integers(0, 99)}.{word()}{word()}.example.{r.choice(['com', 'org', 'net'])}"
        if kind == 1:
            return f"{r.integers(1990, 2030)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}T{r.integers(0, 24):02d}"  + f".{r.integers(100000, 999999)}"
        if kind == 2:
            return "/".join(word() for _ in range(r.integers(3, 7))) + f"/{r.integers(0, 99999)}.html"
        if kind == 3:
            return f"{word()}_{word()}_{word()}{r.integers(0, 99)}_{word()}_{word()}"
        if kind == 4:
            return word() * int(r.integers(6, 12)) + str(r.integers(0, 9))
        if kind == 5:
            return f"v{r.integers(0, 20)}.{r.integers(0, 20)}.{r.integers(0, 99)}-{r.choice(['alpha', 'beta', 'rc', 'release'])}.{r.integers(0, 9)}"
        if kind == 6:
            return "-".join(word() for _ in range(r.integers(4, 8))) + f"-{r.integers(1, 3000)}"
        if kind == 7:
            return f"{'=' * int(r.integers(10, 30))}{r.integers(0, 9)}{word()}"
        if kind == 8:
            return f"//{word()}.example.com/static/{r.choice(['js', 'css', 'img'])}/{word()}.{of('0123456789abcdef', 8, 21)}.{r.choice(['chunk.js', 'min.js', 'css', 'png'])}"
        if kind == 9:
            return of(digits, LEAST, 25) + r.choice(["", "."])
        if kind in (10, 11):
            body = "".join(word() for _ in range(r.integers(3, 8)))
            return r.choice([body, body, body.title(), body.upper()]) + r.choice(["", ".", "..."])
        if kind == 12:
            return word() + "".join(word().title() for _ in range(r.integers(3, 7)))
        if kind == 13:
            return "_".join(word().upper() for _ in range(r.integers(3, 7)))
        return "".join(word().title() for _ in range(r.integers(4, 8))) + str(r.integers(0, 99))

    rows = []
    while len(rows) < n:
        label = len(rows) % 2
        body = good() if label else bad()
        while len(body) < LEAST:
            body += of(lower + digits, 8, 17) if label else word()
        left = r.choice([" ", "=", '"', ": ", " '", "key ", "Bearer ", "\n", "-H ", "https:", "("])
        if not label and ".example." in body and r.integers(0, 2):
            left = f" {word()}.{r.integers(0, 99)}@"
        text = words(r.integers(0, 5)) + left + body + r.choice([" ", '"', "'", "\n", ",", ")", ";"]) + words(r.integers(0, 5))
        raw, at = text.encode("latin-1"), text.index(body)
        # A finding is the whole run, as in a scan.
        start, end = next(x for x in long_runs(raw) if x[0] <= at < x[1])
        rows.append((raw, start, end, label))
    return rows


def planted(texts: list[str], n: int, seed: int = 99) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, label)``: findings of another seed, each between the words of one of the texts."""
    r = np.random.default_rng(seed)
    out = []
    for raw, start, end, label in labelled(n, seed):
        text = texts[r.integers(len(texts))]
        blanks = [m.start() for m in re.finditer(" ", text)] or [0]
        at = blanks[r.integers(len(blanks))]
        out.append((f"{text[:at]} {raw[start:end].decode('latin-1')}{text[at:]}", at + 1, at + 1 + end - start, label))
    return out


@functools.cache
def network(n: int = 4000, recall: float = RECALL) -> Network:
    """The trained network with its temperature and recall-constrained threshold."""
    data = labelled(n)
    aside = len(data) // 5
    w = [windows(t, s, e) for t, s, e, _ in data]
    fit_x = np.concatenate(w[aside:])
    fit_y = np.concatenate([np.full(len(a), d[3], np.float32) for a, d in zip(w[aside:], data[aside:])])
    net = Network()
    net.train(fit_x, fit_y)
    top = np.array([net._forward(a)[3].max() for a in w[:aside]], float)
    y = np.array([d[3] for d in data[:aside]])

    def loss(t):
        p = np.clip(1 / (1 + np.exp(-top / t)), 1e-9, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    net.temperature = float(min(np.geomspace(0.05, 20, 80), key=loss))
    positive = np.sort(1 / (1 + np.exp(-top[y == 1] / net.temperature)))
    net.threshold = float(positive[int((1 - recall) * len(positive))])
    return net


def scan_text(text: str | None, net: Network) -> list[tuple[int, int, int]]:
    """Every span of one text as ``(start, kind, end)``, sorted."""
    return scan_texts([text], net)[0]


def scan_texts(texts: list[str | None], net: Network) -> list[list[tuple[int, int, int]]]:
    out, found, stacked = [], [], []
    for row, text in enumerate(texts):
        raw = (text or "").encode("latin-1", "replace")
        runs = long_runs(raw)
        spans = rule_spans(raw, runs)
        out.append(spans)
        for start, end in candidates(runs, spans):
            w = windows(raw, start, end)
            found.append((row, start, end, len(w)))
            stacked.append(w)
    if found:
        score = net.scores(np.concatenate(stacked))
        at = 0
        for row, start, end, n in found:
            if score[at : at + n].max() >= net.threshold:
                out[row].append((start, 3, end))
            at += n
    return [sorted(x) for x in out]


def _join(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model`` of every document."""
    net = network()

    def run(batches):
        for batch in batches:
            found = scan_texts(batch.column("text").to_pylist(), net)
            base = [[x for x in spans if x[1] < 3] for spans in found]
            count = lambda k: pa.array([sum(x[1] == k for x in spans) for spans in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), count(0), count(1), count(2), pa.array([hashlib.sha256(_join(b).encode()).hexdigest() for b in base]), pa.array(map(_join, found), pa.string()), count(3)], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by ``[SECRET]``; overlapping spans become one."""
    net = network()
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            clean = []
            for text, spans in zip(texts, scan_texts(texts, net)):
                pieces, end = [], 0
                for s, _, e in spans:
                    if s >= end:
                        pieces += [text[end:s], "[SECRET]"]
                    end = max(end, e)
                clean.append(None if text is None else "".join([*pieces, text[end:]]))
            yield batch.set_column(at, "text", pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)
