"""Near-duplicate documents by HyperMinHash, with every link confirmed on full sets.

A document's set of word shingles is hashed to 64 bits a shingle. Its sketch
splits the hashes into ``REGISTERS`` buckets and keeps of each bucket's smallest
hash the count of leading zeros and ``MANTISSA`` bits after the leading one. An
empty bucket borrows from the first bucket that is not, in an order of its own,
so that short texts have as many registers as long ones, each still equal with
the sets' similarity as its probability. Documents of equal sets form one class at once. Class representatives meet where
a band of ``ROWS`` registers agrees; a pair goes on if its collision-corrected
Jaccard estimate lies within ``SIGMAS`` standard errors of the threshold or
above; then the full sets decide.

Representatives in one band's group are not paired with each other. Each is
compared with the group's centre, the member that shares most groups with
others (of edited copies, the original). Links join components; where a group
still holds several components, small groups compare members across components
pair by pair. Of larger ones the full sets go to a task (parts of them to a task
for each two parts, if they are many bytes), which counts what all members have
in common with each other as a product of matrices and gives links that join its
components. So no path between documents is lost, a group that hangs together
costs one comparison a member, and no pairs of a large group are listed.

Registers and sets go to where a group's pairs are compared, once for each of its
members instead of once for each pair.

Defined results: a null, empty or blank text has an empty set, is linked with
nothing and is a component of its own; fewer words than a shingle make one
shingle; repeated rows are linked and each gets the same result; rows of one id
with different texts are members of their own, and of those only the texts of
one set stay in a component; equal rows of one id stay or go together; rows of a null
id take part and have ``kept`` false, but a component is named by its smallest
non-null id and :func:`keep_one` removes none of them; other columns are ignored
or kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import FILTER_BITS, id_filter, lean, mix64, slices, written
from tracelake.llm.components import SMALL_GROUP, grouped_components

REGISTERS, ROWS, MANTISSA, SIGMAS = 128, 4, 10, 6
EMPTY = 0xFFFF
#: Bytes of sets that a task holds for one group's comparisons, and of a group whose members are compared all at once.
NEAR_BYTES, GROUP_BYTES = 1 << 26, 1 << 24
_CHUNK = 1 << 20

_r = np.random.default_rng(123456789)
_BYTE = _r.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_BYTE[_WHITE] = 0
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_ORDER = np.array([np.random.default_rng([7, i]).permutation(REGISTERS) for i in range(REGISTERS)])
_BITS = np.random.default_rng(8).integers(1, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE, _KEYS = np.uint64(0x9E3779B97F4A7C15), _r.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def _word_hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the text it belongs to."""
    codes = _FOLD[np.frombuffer(b" ".join(raws) + b" ", np.uint8)]
    white = _WHITE[codes]
    inside = ~white
    start = np.flatnonzero(inside & np.concatenate([[True], white[:-1]]))
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    end = np.flatnonzero(white & np.concatenate([[False], inside[:-1]]))
    length = end - start
    at = np.flatnonzero(inside)
    place = at - np.repeat(start, length)
    terms = _BYTE[codes[at]] * _powers(int(length.max()))[place]
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    words = mix64(np.add.reduceat(terms, first) + length.astype(np.uint64) * _KEYS[0])
    begins = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
    return words, np.searchsorted(begins, start, side="right") - 1


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    for lo, hi in slices([len(r) for r in raws], _CHUNK):
        words, owner = _word_hashes(raws[lo:hi])
        n = np.bincount(owner, minlength=hi - lo)
        ends = np.cumsum(n)
        if len(words) >= width:
            shingle = np.zeros(len(words) - width + 1, np.uint64)
            for i in range(width):
                shingle = (shingle ^ words[i : len(words) - width + 1 + i]) * _KEYS[1]
                shingle ^= shingle >> np.uint64(29)
            shingle = mix64(shingle)
        for i in range(hi - lo):
            stop, start = ends[i], ends[i] - n[i]
            if n[i] >= width:
                out.append(np.unique(shingle[start : stop - width + 1]))
            elif n[i]:
                h = np.uint64(n[i])
                for w in words[start:stop]:
                    h = mix64(np.array([h ^ w]) * _KEYS[2])[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: leading zeros and mantissa of each bucket's smallest hash."""
    out = np.full(REGISTERS, EMPTY, np.uint16)
    bits = REGISTERS.bit_length() - 1
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (hashes[first] << np.uint64(bits)) >> np.uint64(11)  # 53 bits: exact as a float
    exponent = np.frexp(rest.astype(np.float64))[1]
    zeros = np.minimum(53 - exponent, 53)
    # The mantissa's bits follow the leading one.
    mantissa = (rest << (zeros + 12).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    held = bucket[first]
    out[held] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | np.where(rest == 0, 0, mantissa).astype(np.uint16)
    if 0 < len(held) < REGISTERS:
        full = np.zeros(REGISTERS, bool)
        full[held] = True
        lacking = np.flatnonzero(~full)
        out[lacking] = out[_ORDER[lacking, full[_ORDER[lacking]].argmax(1)]]
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard of sketch rows, and its standard error at the 0.8 to 0.85 range."""
    same = (a == b).mean(1)
    ratio = n_a / n_b
    chance = 0.169919487159739 * 4 * ratio / (1 + ratio) ** 2 / (1 << MANTISSA)
    return same - chance, np.full(len(a), np.sqrt(0.16 / REGISTERS))


def band_keys(registers: np.ndarray) -> np.ndarray:
    """One key for each band of ``ROWS`` registers."""
    bands = registers.reshape(-1, ROWS)
    packed = np.zeros(len(bands), np.uint64)
    for i in range(ROWS):
        packed |= bands[:, i].astype(np.uint64) << np.uint64(16 * i)
    place = np.arange(len(bands), dtype=np.uint64) % np.uint64(REGISTERS // ROWS)
    return mix64(packed * _KEYS[3] + place * _KEYS[4]).view(np.int64)


def fingerprint(hashes: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return np.array([mix64(hashes ^ _KEYS[5]).sum(dtype=np.uint64), mix64(hashes ^ _KEYS[6]).sum(dtype=np.uint64) ^ np.uint64(len(hashes))], np.uint64).tobytes()


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, text_key, n, print, registers, b0, b1`` of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            registers = [sketch(s) for s in sets]
            bits = np.array([marks(r) for r in registers], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()), pa.array([r.tobytes() if len(s) else None for r, s in zip(registers, sets)], pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])], ["doc_id", "text_key", "n", "print", "registers", "b0", "b1"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(lean(run), f"doc_id {kind}, text_key long, n long, print binary, registers binary, b0 long, b1 long")


def _bands(classes: DataFrame) -> DataFrame:
    """``meet, v`` rows: a class under the key of each of its bands."""
    each = REGISTERS // ROWS

    def run(batches):
        for batch in batches:
            keys = band_keys(np.frombuffer(b"".join(batch.column("registers").to_pylist()), np.uint16))
            yield pa.RecordBatch.from_pydict({"meet": keys, "v": np.repeat(batch.column("v").to_numpy(), each)})

    return classes.select("v", "registers").mapInArrow(run, "meet long, v long")


def marks(registers: np.ndarray) -> np.ndarray:
    """One bit of a hash of each register and its place, as two 64-bit words."""
    return np.packbits(((registers * _BITS) >> np.uint32(31)).astype(np.uint8)).view(np.int64)


def _may_link(percent: int):
    """Whether sizes and marks allow a link.

    The smaller set must hold the threshold's share of the larger. Registers of
    linked sets differ with at most one minus the threshold's probability, and
    the bits of those that do with one half of that; ``SIGMAS`` errors are added.
    """
    p = (1 - percent / 100) / 2
    most = int(REGISTERS * p + SIGMAS * np.sqrt(REGISTERS * p * (1 - p))) + 1

    def test(a, b):
        differ = F.bit_count(a["b0"].bitwiseXOR(b["b0"])) + F.bit_count(a["b1"].bitwiseXOR(b["b1"]))
        return (100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])) & (differ <= most)

    return test


def _ends(pairs: DataFrame) -> DataFrame:
    """``near, v``: the nodes of each group's pairs."""
    return pairs.select("near", F.col("a").alias("v")).union(pairs.select("near", F.col("b").alias("v"))).distinct()


def _compared(pairs: DataFrame, ends: DataFrame, decide) -> DataFrame:
    """Pairs that ``decide`` keeps, by the ``value`` and size ``n`` of both ends (``ends``: ``near, v, n, value``)."""
    tasks = 4 * int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = ends.select("near", "v", F.lit(None).cast("long").alias("b"), "n", "value").union(pairs.select("near", "a", "b", F.lit(None).cast("long"), F.lit(None).cast("binary")))
    met = rows.repartition(tasks, "near").sortWithinPartitions("near", F.col("b").isNotNull(), "v")

    def run(batches):
        now, held = None, {}
        for batch in batches:
            near, v, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("near", "v", "b"))
            pair = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((near[1:] != near[:-1]) | (pair[1:] != pair[:-1])) + 1).tolist(), len(near)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if near[lo] != now:
                    now, held = near[lo], {}
                if not pair[lo]:
                    n, values = batch.column("n"), batch.column("value")
                    held.update((int(v[i]), (n[i].as_py(), values[i].as_py())) for i in range(lo, hi))
                    continue
                x, y = v[lo:hi].astype(np.int64), b[lo:hi].astype(np.int64)
                keep = np.flatnonzero(decide([held[i] for i in x.tolist()], [held[i] for i in y.tolist()]))
                if len(keep):
                    yield pa.RecordBatch.from_pydict({"a": x[keep], "b": y[keep], "near": np.full(len(keep), now, np.int64)})

    # Many tasks, but few files: each file that is written costs some processes.
    return met.mapInArrow(run, "a long, b long, near long").hint("rebalance")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose estimate does not rule out the threshold."""

    def decide(left, right):
        keep = []
        for i in range(0, len(left), 1 << 14):
            x, y = left[i : i + (1 << 14)], right[i : i + (1 << 14)]
            a, b = (np.frombuffer(b"".join(r for _, r in side), np.uint16).reshape(len(side), -1) for side in (x, y))
            j, error = estimate(a, b, np.array([n for n, _ in x]), np.array([n for n, _ in y]))
            keep.append(j >= percent / 100 - SIGMAS * error)
        return np.concatenate(keep)

    return _compared(pairs, _ends(pairs).join(classes.select("v", "n", F.col("registers").alias("value")), "v"), decide)


def _sets(docs: DataFrame, needed: DataFrame, width: int) -> DataFrame:
    """``needed`` (``doc_id, print`` and more) with ``value``, its set of shingles, from the texts."""
    bits = id_filter(needed, F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1 == 1))
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["own_id", "own_print", "value"])

    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("bit"))
    found = hashed.mapInArrow(lean(run), f"own_id {kind}, own_print binary, value binary")
    return needed.join(found, (F.col("print") == F.col("own_print")) & F.col("doc_id").eqNullSafe(F.col("own_id"))).drop("own_id", "own_print")


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets meet the threshold."""
    if len(x) < len(y):
        x, y = y, x
    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int((x[place] == y).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, most_bytes: int = NEAR_BYTES) -> DataFrame:
    """Pairs whose full sets meet the threshold.

    Where a group's sets are larger than a task should hold, its pairs are joined one by one.
    """
    needed = written(_ends(pairs).join(classes.select("v", "n", "print", "doc_id"), "v"), "needed")
    large = written(needed.groupBy("near").agg(F.sum("n").alias("n")).where(F.col("n") * 8 > most_bytes).select("near"), "large")

    def decide(left, right):
        return np.array([_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for (_, x), (_, y) in zip(left, right)])

    if not large.take(1):
        return _compared(pairs, _sets(docs, needed, width), decide).select("a", "b")
    light = needed.join(large, "near", "left_anti")
    found = _compared(pairs.join(large, "near", "left_anti").select("a", "b", "near"), _sets(docs, light, width), decide).select("a", "b")
    heavy = needed.join(large, "near", "left_semi").select("v", "print", "doc_id").distinct()
    sets = written(_sets(docs, heavy, width).dropDuplicates(["v"]), "sets")
    met = pairs.join(large, "near", "left_semi").join(sets.select(F.col("v").alias("b"), F.col("value").alias("s_b")), "b").join(sets.select(F.col("v").alias("a"), F.col("value").alias("s_a")), "a")

    def run(batches):
        for batch in batches:
            keep = [_alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column("s_a"), batch.column("s_b"))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return found.union(met.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long"))


def _joining(sets: list[np.ndarray], roots: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Places of sets that meet the threshold, enough to join all components between which any do."""
    size, m = np.array([len(x) for x in sets], np.int64), len(sets)
    # The members outside of the largest component are compared with all.
    roots = np.unique(roots, return_inverse=True)[1]
    rows = np.flatnonzero(roots != np.bincount(roots).argmax())
    if not len(rows):
        return []
    values = np.concatenate(sets)
    order = np.argsort(values)
    owner, values = np.repeat(np.arange(m, dtype=np.int32), size)[order], values[order]
    # What one member alone has is in common with none.
    new = np.append(True, values[1:] != values[:-1])
    shared = ~(new & np.append(new[1:], True))
    owner, column = owner[shared], np.cumsum(new[shared]) - 1
    kind = np.float32 if size.max() < 1 << 24 else np.float64
    width, height, out = max(1, (1 << 22) // m), max(1, (1 << 21) // m), []
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for i in range(0, len(rows), height):
        some = rows[i : i + height]
        common = np.zeros((len(some), m), kind)
        for k, (lo, hi) in enumerate(zip(edges, edges[1:])):
            held = np.zeros((m, min(width, int(column[hi - 1]) + 1 - k * width)), kind)
            held[owner[lo:hi], column[lo:hi] - k * width] = 1
            common += held[some] @ held.T
        linked = (100.0 + percent) * common >= percent * (size[some, None] + size[None, :]).astype(np.float64)
        x, y = np.nonzero(linked & (roots[some][:, None] != roots[None, :]))
        x = some[x]
        # One link for each two components, as long as they are not joined.
        first = np.unique(np.minimum(roots[x], roots[y]) * (m + 1) + np.maximum(roots[x], roots[y]), return_index=True)[1]
        parent = np.arange(m)
        for a, b in zip(x[first].tolist(), y[first].tolist()):
            p, q = roots[a], roots[b]
            while parent[p] != p:
                parent[p] = p = parent[parent[p]]
            while parent[q] != q:
                parent[q] = q = parent[parent[q]]
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((a, b))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        roots = parent[roots]
    return out


def _exhausted(groups: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, most_bytes: int = GROUP_BYTES) -> DataFrame:
    """Links ``a, b`` that join all components of a group (``meet, v, root, mark``) between which it has any."""
    tasks = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Groups of many bytes: each two parts meet in a task, and with them the members of either.
    total = groups.groupBy("meet").agg(F.sum("mark.n").alias("total"))
    parts = F.when(8 * F.col("total") <= most_bytes, 1).otherwise(F.ceil(16 * F.col("total") / most_bytes)).cast("int")
    placed = groups.join(total, "meet").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("v"), "parts").cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where((F.col("own") != F.col("other")) | (F.col("parts") == 1))
    near = F.xxhash64("meet", F.least("own", "other"), F.greatest("own", "other")).alias("near")
    needed = written(met.select(near, "v", "root").join(classes.select("v", "print", "doc_id"), "v"), "needed")
    rows = _sets(docs, needed, width).select("near", "v", "root", "value").repartition(tasks, "near").sortWithinPartitions("near")

    def run(batches):
        now, v, roots, sets = None, [], [], []

        def links():
            found = _joining(sets, np.array(roots), percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([v[x[i]] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            near, values = batch.column("near").to_numpy(), batch.column("value")
            edges = [0, *(np.flatnonzero(near[1:] != near[:-1]) + 1).tolist(), len(near)]
            for lo, hi in zip(edges, edges[1:]):
                if hi == lo:
                    continue
                if near[lo] != now:
                    yield links()
                    now, v, roots, sets = near[lo], [], [], []
                v += batch.column("v")[lo:hi].to_pylist()
                roots += batch.column("root")[lo:hi].to_pylist()
                sets += [np.frombuffer(values[i].as_py(), np.uint64) for i in range(lo, hi)]
        yield links()

    return rows.mapInArrow(lean(run), "a long, b long").hint("rebalance")


def find(docs: DataFrame, width: int = 5, percent: int = 80, small_group: int = SMALL_GROUP) -> DataFrame:
    """``doc_id, text_key, n_shingles, print, component_id, first`` of every document.

    ``print`` names its set; ``first`` says whether id and set are those that name the component.
    """
    signed = written(signatures(docs, width), "signatures")
    classes = written(
        signed.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("registers").alias("registers"), F.first("b0").alias("b0"), F.first("b1").alias("b1")).withColumn("v", F.monotonically_increasing_id()),
        "classes",
    )

    def confirm(pairs):
        return _links(written(_plausible(pairs, classes, percent), "plausible"), docs, classes, width, percent)

    def exhaust(groups):
        return _exhausted(groups, docs, classes, width, percent)

    # One sort by key serves both neighbours: a class stays where another one has the same key.
    by_key = Window.partitionBy("meet").orderBy("v")
    bands = _bands(classes).withColumn("before", F.lag("v").over(by_key)).withColumn("after", F.lead("v").over(by_key))
    met = bands.where(F.col("before").isNotNull() | F.col("after").isNotNull()).select("meet", "v")
    members = met.join(classes.select("v", F.struct("n", "b0", "b1").alias("mark")), "v").select("meet", "v", "mark")
    roots = grouped_components(written(members, "members"), confirm, _may_link(percent), exhaust, small_group)
    vertex = classes.select("print", "doc_id", "v")
    rooted = vertex.join(roots.withColumnRenamed("node", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    rooted = written(rooted.select("print", "doc_id", "root"), "rooted")
    names = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", F.col("print").alias("own"))).alias("least"))
    named = rooted.join(names, "root").select("print", F.col("least.doc_id").alias("component_id"), F.col("least.own").alias("own"))
    out = signed.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "print").join(named, "print", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    first = F.col("print").isNull() | F.coalesce((F.col("doc_id") == F.col("component_id")) & (F.col("print") == F.col("own")), F.lit(False))
    return out.select("doc_id", "text_key", "n_shingles", "print", "component_id", first.alias("first"))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    return find(docs, width, percent).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that name their component, with their columns as they are; rows of a null id stay."""
    gone = find(docs, width, percent).where(~F.col("first") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    return docs.join(gone, (docs["doc_id"] == gone["_gone_id"]) & (F.xxhash64(docs["text"]) == gone["_gone_key"]), "left_anti").select(*[docs[c] for c in docs.columns])
