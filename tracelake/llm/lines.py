"""Line deduplication by an edit join over shared anchors, in cells of lines of like lengths.

Two lines are linked if their edit distance is within :func:`allowed` of the
shorter one: one edit for every whole 20 characters, however long the line is
(lines under 20 characters must be equal). So a line goes to the cell of its
length and visits those of all greater lengths it may be linked to; a cell and
its visitors are compared in one task, which has their texts, so no candidate is
ever written. ``t`` edits leave a stretch of ``(n - t) / (t + 1)`` characters
whole, so in a cell all lines file the least grams, by hash, of all windows that
just fill the shortest such stretch (winnowing): linked lines file one gram in
common, at places at most ``t`` apart. Lines that meet under a gram, agree in
length and place and are not joined yet are compared first by counts of
characters, then by edit distance, many pairs at once (see ``_within``). Where
grams let more pairs meet than there are, all lines near in length are looked at.
Links join lines into classes (see ``components``).

Of the occurrences of a class the first one, by document id and line number,
stays; the others are removed. Blank lines are not lines: they stay and are not
counted.

Defined results: null and empty texts have no lines; very long lines are
compared whole; equal document ids are one document to the order, so repeated
rows of a document are treated alike (each keeps what the other keeps); rows of
a null id lose lines but never hold a first occurrence unless no other row has
the line; a document that had lines and loses all of them is dropped by
:func:`clean`; other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import lean, mix64, slices, written
from tracelake.llm.components import components

#: Shortest and longest length of a pair's shorter line, and the grams such pairs meet on.
FAMILIES = ((20, 39, 10), (40, 1 << 40, 12))
BAG = 32
#: Edits that are looked for diagonal by diagonal.
FEW = 4
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 17
#: Characters of distinct lines that are sent together, and of the lines of a cell; lines of a cell that a line may meet under one key before those of narrower keys are joined.
CHUNK, BUCKET, CROWD = 1 << 23, 20_000_000, 1024
#: Lines that visit a cell at once; diagonals and characters of pairs that are compared at once; words of a line that are compared at once.
VISITORS, PLACES, PAIRED, RUN = 1 << 16, 1 << 16, 1 << 21, 64
_K1, _K3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_MIXED, _powers = mix64(np.arange(1 << 14, dtype=np.uint64) + _K3), np.ones(1, np.uint64)


def allowed(length):
    """Edits allowed for a shorter line of this length."""
    return np.asarray(length) // 20


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is greater, of one pair; queries take ``_within``, which tests hold against this.

    A common start and end are cut off. Up to ``FEW`` edits are found by the furthest place
    that each number of edits reaches on each diagonal; the rest is the bit-parallel recurrence
    (Myers, Hyyrö) with a column of the table in one integer of any size, first on a start of
    the shorter line: if that is too far from every start of the other, so are the lines.
    """
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    i, n = 0, len(a)
    step = 64
    while i < n and a[i : i + step] == b[i : i + step] and i + step <= n:
        i += step
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, n = 0, len(a)
    while j + step <= n and a[n - j - step : n - j] == b[len(b) - j - step : len(b) - j]:
        j += step
    while j < n and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[: n - j], b[: len(b) - j]
    if not a:
        return min(len(b), most + 1)
    few = _few_edits(a, b, min(most, FEW))
    if few <= most and few <= FEW or most <= FEW:
        return min(few, most + 1)
    head = 4 * most
    if len(a) > 2 * head and _least_of_start(a[:head], b[: head + most], most) > most:
        return most + 1
    return _bit_parallel(a, b, most)


def _common(a: str, i: int, b: str, j: int) -> int:
    """Characters that ``a`` from ``i`` and ``b`` from ``j`` have in common."""
    start, step, most = i, 16, min(len(a) - i, len(b) - j)
    end = i + most
    while i + step <= end and a[i : i + step] == b[j : j + step]:
        i, j, step = i + step, j + step, 2 * step
    while step > 1:
        step //= 2
        if i + step <= end and a[i : i + step] == b[j : j + step]:
            i, j = i + step, j + step
    while i < end and a[i] == b[j]:
        i, j = i + 1, j + 1
    return i - start


def _few_edits(a: str, b: str, most: int) -> int:
    """The distance, or ``most + 1``: the furthest place in ``a`` by diagonal, one edit after the other."""
    goal, n = len(b) - len(a), len(a)
    reach = {0: _common(a, 0, b, 0)}
    for edits in range(most + 1):
        if reach.get(goal, -1) >= n:
            return edits
        further = {}
        for k in range(-edits - 1, edits + 2):
            i = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            if i < 0:
                continue
            i = min(i, n, len(b) - k)
            if i >= 0 and i + k >= 0:
                further[k] = i + _common(a, i, b, i + k)
        reach = further
    return most + 1


def _columns(a: str):
    """A step from column to column of the table of ``a``: the change of its last row for the next character."""
    places: dict[str, int] = {}
    for at, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << at
    # Bit i of up (down): the table rises (falls) by one from row i to row i + 1 of the current column.
    mask, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, get = mask, 0, places.get

    def step(c: str, first: int) -> int:
        nonlocal up, down
        same = get(c, 0)
        flat = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (mask & ~(across | up)), up & across
        change = bool(more & last) - bool(less & last)
        more, less = more << 1 | first, less << 1
        up, down = mask & (less | ~(flat | more)), mask & more & flat
        return change

    return step


def _bit_parallel(a: str, b: str, most: int) -> int:
    step, score, left = _columns(a), len(a), len(b)
    for c in b:
        score += step(c, 1)
        left -= 1
        if score - left > most:
            return most + 1
    return min(score, most + 1)


def _least_of_start(a: str, b: str, most: int) -> int:
    """The least distance of ``a`` and any start of ``b``, or more than ``most``."""
    step, score = _columns(a), len(a)
    least = score
    for c in b:
        score += step(c, 1)
        if score <= most:
            return score
        least = min(least, score)
    return least


class Hashes:
    """Hashes of any substrings of joined lines in constant time each."""

    def __init__(self, lines: list[str]):
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.fromiter(map(len, lines), np.int64, len(lines))
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]) if len(lines) else self.length
        powers = np.ones(len(points) + 1, np.uint64)
        powers[1:] = np.uint64(_BASE)
        np.multiply.accumulate(powers, out=powers)
        self.inverse = np.ones(len(points) + 1, np.uint64)
        self.inverse[1:] = np.uint64(_INVERSE)
        np.multiply.accumulate(self.inverse, out=self.inverse)
        self.prefix = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix64(points.astype(np.uint64) + _K3) * powers[:-1], out=self.prefix[1:])

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix64((self.prefix[start + size] - self.prefix[start]) * self.inverse[start] + size.astype(np.uint64) * _K1)


def line_ids(lines: list[str]) -> tuple[np.ndarray, "Hashes | None"]:
    h = Hashes(lines)
    return h.of(h.start, h.length), h


def _ids(lines: list[str]) -> np.ndarray:
    """64-bit hashes that name lines."""
    global _powers
    if not lines:
        return np.zeros(0, np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    start = np.cumsum(length) - length
    if length.max() > len(_powers):
        _powers = np.full(int(length.max()), _BASE, np.uint64)
        _powers[0] = 1
        np.multiply.accumulate(_powers, out=_powers)
    if points.max() < len(_MIXED):
        terms = _MIXED[points]
    else:
        terms = mix64(points.astype(np.uint64) + _K3)
    terms *= _powers[np.arange(len(points)) - np.repeat(start, length)]
    return mix64(np.add.reduceat(terms, start) + length.astype(np.uint64) * _K1).view(np.int64)


def _whole(length: np.ndarray) -> np.ndarray:
    """Characters that the allowed edits leave whole in a row, at least."""
    t = allowed(length)
    return -(-(length - t) // (t + 1))


def _windows(length: np.ndarray, low: int, high: int, gram: int) -> np.ndarray:
    """Grams in the window of a line: the narrowest of all shorter lines it may be linked to."""
    # The shortest n of those has n + n // 20 >= length.
    least = np.maximum(20 * (length // 21) + length % 21, low)
    # Whole stretches grow between multiples of 20 and from one multiple to the next.
    step = -(-least // 20) * 20
    return np.where(step <= np.minimum(length, high), np.minimum(_whole(least), _whole(step)), _whole(least)) - gram + 1


# From here to ``_keys``, and from ``_planes`` to ``_unpack``: packed grams of a join by key, which no query uses
# since lines meet in cells; their tests still hold them.


def _anchors(h: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(key, index of the line, first place, last place)`` of every gram that a line files."""
    out = []
    for low, high, gram in FAMILIES:
        fits = np.flatnonzero((h.length >= low) & (h.length <= high + allowed(high)))
        if not len(fits):
            continue
        # The grams of all these lines, one line after the other.
        n = h.length[fits] - gram + 1
        begin = np.cumsum(n) - n
        places = np.arange(n.sum()) - np.repeat(begin, n)
        leasts = grams = h.of(np.repeat(h.start[fits], n) + places, np.full(len(places), gram))
        windows = _windows(h.length[fits], low, high, gram)
        chosen, width = [], 1
        at = np.arange(len(grams))
        for window in np.unique(windows).tolist():
            # The first least of as many grams from each one on, from those of narrower windows.
            while width < window:
                step = min(width, window - width)
                less = leasts[step:] < leasts[:-step]
                at, leasts = np.where(less, at[step:], at[:-step]), np.where(less, leasts[step:], leasts[:-step])
                width += step
            which = np.flatnonzero(windows == window)
            m = n[which] - window + 1
            owner = np.repeat(which, m)
            picked = at[begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)]
            new = np.append(True, (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1]))
            chosen.append((picked[new], owner[new]))
        picked, owner = map(np.concatenate, zip(*chosen))
        both = mix64(grams[picked] ^ mix64(owner.astype(np.uint64) + _K3))
        order = np.argsort(both)
        head = np.flatnonzero(np.append(True, both[order[1:]] != both[order[:-1]]))
        place = places[picked[order]]
        first = order[head]
        out.append((grams[picked[first]].view(np.int64), fits[owner[first]], np.minimum.reduceat(place, head), np.maximum.reduceat(place, head)))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(map(np.concatenate, zip(*out)))


def _keys(h: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """``(key, index of the line)`` of every gram that a line files."""
    return _anchors(h)[:2]


def _bag(line: str) -> bytes:
    """Counts of a line's characters, folded to ``BAG`` bytes; an edit changes their sum of differences by two at most."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.minimum(np.bincount(points % BAG, minlength=BAG), 255).astype(np.uint8).tobytes()


def _texts(batch) -> tuple[list[str], list[int], list[int]]:
    """Lines that are not blank, the row of each and its number in the text."""
    lines, rows, numbers = [], [], []
    for row, text in enumerate(batch.column("text").to_pylist()):
        for number, line in enumerate((text or "").split("\n")):
            if line and not line.isspace():
                lines.append(line)
                rows.append(row)
                numbers.append(number)
    return lines, rows, numbers


def _planes(x: np.ndarray, width: int = 4) -> bytes:
    """The lowest bytes of all numbers, then the next ones: those that vary little lie together."""
    return x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T[:width].tobytes()


def _unplaned(data: memoryview, at: int, size: int, width: int = 4) -> tuple[np.ndarray, int]:
    out = np.zeros((size, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, size * width, at).reshape(width, size).T
    return out.reshape(-1).view(np.uint32), at + size * width


def _steps(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Differences to the number before, but at ``head``; modulo 2^32."""
    x = x.astype(np.uint32)
    out = x.copy()
    out[1:] -= x[:-1]
    out[head] = x[head]
    return out


def _summed(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    total = np.cumsum(x, dtype=np.uint32)
    lengths = np.diff(np.append(head, len(x)))
    return total - np.repeat(total[head] - x[head], lengths)


def _pack(lengths: np.ndarray, key: np.ndarray, owner: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int):
    """``bucket, lines, grams, bytes`` of the grams of lines in order of their lengths.

    Of a key, the bucket and 24 bits are kept: what meets by chance is told apart by length, place and text.
    """
    key = key.view(np.uint64)
    bucket = ((key >> np.uint64(24)) & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
    # Places beyond 2^24 only lose their order, which no one relies on.
    order = np.argsort(bucket << np.uint64(46) | owner.astype(np.uint64) << np.uint64(24) | np.minimum(first, (1 << 24) - 1).astype(np.uint64))
    key, owner, first, last, bucket = key[order], owner[order], first[order], last[order], bucket[order]
    ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
    start = 0
    for end in ends.tolist():
        own, lo, hi = owner[start:end], first[start:end], last[start:end]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        which, count, none = own[head], np.diff(np.append(head, len(own))), np.zeros(0, np.int64)
        data = b"".join((_planes(_steps(which, none)), _planes(_steps(lengths[which], none)), _planes(count), _planes(key[start:end] & np.uint64(0xFFFFFF), 3), _planes(_steps(lo, head)), _planes(hi - lo)))
        yield int(bucket[start]), len(which), len(own), pa.Codec("zstd").compress(data, asbytes=True)
        start = end


def _unpack(data: bytes, lines: int, grams: int):
    """``line, length`` of a packed part's lines and ``key, index of its line, first, last`` of its grams."""
    raw = pa.Codec("zstd").decompress(data, 12 * lines + 11 * grams, asbytes=True)
    which, at = _unplaned(raw, 0, lines)
    length, at = _unplaned(raw, at, lines)
    count, at = _unplaned(raw, at, lines)
    key, at = _unplaned(raw, at, grams, 3)
    lo, at = _unplaned(raw, at, grams)
    span, at = _unplaned(raw, at, grams)
    lo = _summed(lo, np.cumsum(count, dtype=np.int64) - count)
    return np.cumsum(which, dtype=np.uint32), np.cumsum(length, dtype=np.uint32), key, np.repeat(np.arange(lines, dtype=np.int32), count), lo, lo + span


def _whole_at_least(low: int, high: int) -> int:
    """Characters that stay whole in a row in any two linked lines, if the longer has ``low`` to ``high``."""
    # The shortest n with n + n // 20 >= low; whole stretches of longer lines than the next multiples of 20 are no shorter.
    least = max(20 * (low // 21) + low % 21, FAMILIES[0][0])
    return int(_whole(np.arange(least, min(high, least + 60) + 1)).min())


def _gram_hashes(points: np.ndarray, gram: int) -> np.ndarray:
    """A 32-bit hash of ``gram`` characters from each one on, by doubling."""
    x = points * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    size = 1
    while size < gram:
        step = min(size, gram - size)
        x = x[:-step] * np.uint32(0xC2B2AE3D) + x[step:] * np.uint32(0x27D4EB2F)
        x ^= x >> np.uint32(13)
        size += step
    for factor, shift in ((0x85EBCA6B, 13), (0xC2B2AE35, 16)):
        x *= np.uint32(factor)
        x ^= x >> np.uint32(shift)
    return x


def _picks(lines: list[str], whole: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``key, index of the line, place`` of the least grams of all windows of ``whole`` characters, and the lines' bags."""
    window = (whole + 1) // 4
    gram = whole - window + 1
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    owner = np.repeat(np.arange(len(lines)), length)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    bags = np.minimum(np.bincount(owner * BAG + points % BAG, minlength=BAG * len(lines)), 255).astype(np.uint8).reshape(-1, BAG)
    grams = _gram_hashes(points, gram)
    least, width = grams, 1
    while width < window:
        step = min(width, window - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    # Windows that reach into the next line do not count.
    inside = np.ones(len(least), bool)
    end = np.cumsum(length)
    across = (end[:, None] - np.arange(1, whole)).ravel()
    inside[across[across < len(least)]] = False
    picked = np.zeros(len(grams), bool)
    for i in range(window):
        picked[i : i + len(least)] |= (least == grams[i : i + len(least)]) & inside
    at = np.flatnonzero(picked)
    return grams[at], owner[at], at - (end - length)[owner[at]], bags


class _Filed:
    """The grams of lines in order of their lengths, in order of key and line: ``both`` has key and line, ``lo`` and ``hi`` the places."""

    def __init__(self, lines: list[str], whole: int, bits: int, shift: int):
        self.lines, self.length = lines, np.fromiter(map(len, lines), np.int64, len(lines))
        self.bits, found, bags = np.uint64(bits), [], []
        for i, j in slices(self.length.tolist(), _CHUNK):
            key, owner, place, own = _picks(lines[i:j], whole)
            # 15 bits of place, and as many of the key as are left beside the line.
            found.append(key.astype(np.uint64) >> np.uint64(max(0, bits - 17)) << np.uint64(bits + 15) | (owner + i).astype(np.uint64) << np.uint64(15) | (place >> shift).astype(np.uint64))
            bags.append(own)
        grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        found.clear()
        grams.sort()
        self.bags = np.concatenate(bags) if bags else np.zeros((0, BAG), np.uint8)
        # Of a key that a line has more than once, one row stays; arrays are let go as soon as they can be.
        head = np.ones(len(grams) + 1, bool)
        head[1:-1] = (grams[1:] ^ grams[:-1]) > np.uint64(0x7FFF)
        place = (grams & np.uint64(0x7FFF)).astype(np.int16)
        self.lo, self.hi = place[head[:-1]], place[head[1:]]
        grams >>= np.uint64(15)
        self.both = grams if head.all() else grams[head[:-1]]

    def key(self) -> np.ndarray:
        return self.both >> self.bits

    def line(self, at: np.ndarray) -> np.ndarray:
        return (self.both[at] & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)


def _ranges(start: np.ndarray, width: np.ndarray):
    """``index, place`` of all places of ranges, some at a time."""
    for a, b in slices(width.tolist(), 1 << 19):
        i = np.repeat(np.arange(a, b), width[a:b])
        yield i, start[i] + np.arange(len(i)) - np.repeat(np.cumsum(width[a:b]) - width[a:b], width[a:b])


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _within(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Whether the lines of each pair, the shorter first, have no more than the allowed edits."""
    n, m = (np.array([len(x[i]) for x in pairs], np.int64) for i in (0, 1))
    most, out = allowed(n), np.zeros(len(pairs), bool)
    order = np.argsort(most, kind="stable")
    order = order[m[order] - n[order] <= most[order]]
    for lo, hi in _batches(most[order].tolist(), (n[order] + m[order]).tolist()):
        some = order[lo:hi]
        out[some] = _reached([pairs[i] for i in some.tolist()], n[some], m[some], most[some])
    return out


def _batches(most: list[int], chars: list[int]):
    """Ranges of pairs, in order of the edits allowed, that have ``PLACES`` diagonals and ``PAIRED`` characters at most, or one pair."""
    start, held = 0, 0
    for i, (t, n) in enumerate(zip(most, chars)):
        # All pairs of a batch take as many diagonals as its last one.
        if i > start and ((t + 1) * (i - start + 1) > PLACES or held + n > PAIRED):
            yield start, i
            start, held = i, 0
        held += n
    if start < len(most):
        yield start, len(most)


def _codes(pairs: list[tuple[str, str]]) -> list[np.ndarray]:
    """The characters of the pairs' first lines, one line after the other, and of their second ones, in a byte each if that can be."""
    texts = ["".join(x[i] for x in pairs) for i in (0, 1)]
    try:
        both = [np.frombuffer(x.encode("latin-1"), np.uint8) for x in texts]
    except UnicodeEncodeError:
        both = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in texts]
        seen = np.zeros(0x110000, bool)
        for x in both:
            seen[x] = True
        if seen.sum() <= 256:
            codes = (np.cumsum(seen) - 1).astype(np.uint8)
            both = [codes[x] for x in both]
    # What lies behind the end is read, but not counted.
    return [np.append(x, np.zeros(8 * RUN + 8, x.dtype)) for x in both]


def _reached(pairs, n, m, most) -> np.ndarray:
    """``_within`` for some pairs at once.

    For each number of edits, the furthest place in the shorter line is known on each diagonal (the characters that the
    longer line is ahead); only those diagonals count from which the edits left lead to both lines' ends. From there
    it is carried on over what follows alike in both lines.
    """
    a, b = _codes(pairs)
    per = 8 // a.itemsize
    words = [np.ndarray(len(x) - 8, np.uint64, x, strides=x.strides) for x in (a, b)]
    shift = np.uint8(7 - per.bit_length())
    begin, goal = np.cumsum(n) - n, m - n
    out, own = np.zeros(len(pairs), bool), np.arange(len(pairs))
    # Row r holds diagonal r - under. Places count from the start of the first of all lines.
    under = int(((most - goal) // 2).max()) + 1
    rows = under + int(((most + goal) // 2).max()) + 2
    ahead = np.arange(rows)[:, None] - under
    other = np.cumsum(m) - m - begin + ahead
    end = begin + np.minimum(n, m - ahead)
    last = begin + n
    reach = np.full((rows, len(pairs)), -(1 << 40))
    for edits in range(int(most.max()) + 1):
        left = most - edits
        lo = max(1, under + max(-edits, int((goal - left).min())))
        hi = min(rows - 1, under + min(edits, int((goal + left).max())) + 1)
        at = slice(lo, hi)
        if edits:
            place = np.maximum(reach[at], reach[lo + 1 : hi + 1])
            place += 1
            np.maximum(place, reach[lo - 1 : hi - 1], out=place)
            np.minimum(place, end[at], out=place)
        else:
            place = begin[None].copy()
        place, beside, stop = place.ravel(), (place + other[at]).ravel(), end[at].ravel()
        which, size = np.flatnonzero(a.take(place) == b.take(beside)), 1
        while len(which):
            i, j = place[which], beside[which]
            if size == 1:
                x = words[0][i] ^ words[1][j]
                far = i
            else:
                steps = per * np.arange(size)
                x = words[0][i[:, None] + steps] ^ words[1][j[:, None] + steps]
                unlike = x != 0
                k = np.where(unlike.any(1), unlike.argmax(1), size - 1)
                x, far = x[np.arange(len(k)), k], i + per * k
            # The lowest set bit is in the first character that differs.
            far = np.minimum(far + (np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> shift), stop[which])
            place[which] = far
            beside[which] = j + (far - i)
            which, size = which[(x == 0) & (far < stop[which])], min(4 * size, RUN)
        reach[at] = place.reshape(hi - lo, -1)
        done = (reach[under + goal, np.arange(len(own))] >= last) & (most >= edits)
        out[own[done]] = True
        alive = ~done & (most > edits)
        count = np.count_nonzero(alive)
        if not count:
            break
        if count < 0.8 * len(own):
            most, goal, own, last = (x[alive] for x in (most, goal, own, last))
            reach, other, end = (np.ascontiguousarray(x[:, alive]) for x in (reach, other, end))
    return out


class _Cell:
    """Links between lines of a cell and of those that visit it."""

    def __init__(self, lines: set[str], whole: int):
        self.longest = max(map(len, lines), default=0)
        self.bits, self.shift, self.whole = max(len(lines), VISITORS).bit_length(), max(0, self.longest.bit_length() - 15), whole
        self.home = _Filed(sorted(lines, key=len), whole, self.bits, self.shift)
        self.parent = np.arange(len(lines))
        # Bits by the highest bits of keys, so that grams in order read them in order.
        self.fold = np.uint64(max(22, self.bits))
        self.table = np.zeros(1 << (46 - int(self.fold)), np.uint8)
        for i in range(0, len(self.home.both), _CHUNK):
            byte, bit = self._places(self.home.both[i : i + _CHUNK])
            head = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            self.table[byte[head]] |= np.bitwise_or.reduceat(bit, head)

    def _places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (grams >> self.fold).astype(np.int64)
        return key >> 3, np.left_shift(np.uint8(1), (key & 7).astype(np.uint8))

    def inner(self):
        both = self.home.both
        same = (both[1:] ^ both[:-1]) < np.uint64(1) << self.home.bits
        yield from self._links(self.home, np.flatnonzero(np.append(same, False)), True)

    def visit(self, lines: list[str]):
        """``lines`` are in order of length and no longer than the home's longest."""
        guests = _Filed(lines, self.whole, self.bits, self.shift)
        byte, bit = self._places(guests.both)
        yield from self._links(guests, np.flatnonzero(self.table[byte] & bit), False)

    def _links(self, guests: _Filed, at: np.ndarray, own: bool):
        """Pairs of a guest and a longer (or equally long) line of the home that are linked, until all roots are joined."""
        home, base = self.home, 0 if own else len(self.home.lines)
        if not len(home.lines) or not len(at):
            return
        parent = self.parent if own else np.concatenate([self.parent, base + np.arange(len(guests.lines))])
        most = allowed(guests.length)
        first = np.arange(1, len(guests.lines) + 1) if own else np.searchsorted(home.length, guests.length)
        after = np.searchsorted(home.length, guests.length + most, "right")
        tried = np.zeros(0, np.int64)
        line, key = guests.line(at), guests.both[at] >> self.bits << self.bits
        start = np.searchsorted(home.both, key | first[line].astype(np.uint64))
        width = np.searchsorted(home.both, key | after[line].astype(np.uint64)) - start
        start, width, at, line = (x[width > 0] for x in (start, width, at, line))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def settled():
            while True:
                up = parent[parent]
                if (up == parent).all():
                    return up
                parent[:] = up

        def looked(x, y):
            """Links of guests ``x`` and lines ``y`` whose roots differ, some of each guest at a time."""
            nonlocal tried
            pairs = _distinct(x << 32 | y)
            if len(tried):
                pairs = pairs[tried[np.minimum(np.searchsorted(tried, pairs), len(tried) - 1)] != pairs]
            x, y = pairs >> 32, pairs & 0xFFFFFFFF
            keep = np.zeros(len(x), bool)
            for i in range(0, len(x), 1 << 16):
                part = slice(i, i + (1 << 16))
                keep[part] = np.abs(guests.bags[x[part]].astype(np.int16) - home.bags[y[part]]).sum(1) <= 2 * most[x[part]]
            x, y, some = x[keep], y[keep], 1
            while len(x):
                head = np.append(True, x[1:] != x[:-1])
                take = np.arange(len(x)) - np.flatnonzero(head)[np.cumsum(head) - 1] < some
                linked = _within([(guests.lines[i], home.lines[j]) for i, j in zip(x[take].tolist(), y[take].tolist())])
                for i, j in zip(x[take][linked].tolist(), y[take][linked].tolist()):
                    p, q = root(base + i), root(j)
                    # Homes' roots are homes, so that they outlast a visit.
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        yield i, j
                tried = _distinct(np.append(tried, (x[take] << 32 | y[take])[~linked]))
                roots = settled()
                rest = ~take & (roots[base + x] != roots[y])
                x, y, some = x[rest], y[rest], 2 * some

        wide = width > CROWD
        crowded = _distinct(line[wide])
        # Where keys let more pairs meet than there are, all lines near in length are looked at instead.
        by_line = int((after - first)[crowded].sum()) < int(width[wide].sum())
        for which in (~wide, wide if not by_line else np.zeros(len(wide), bool)):
            begin, own_at, own_line = start[which], at[which], line[which]
            for i, j in _ranges(begin, width[which]):
                roots = settled()
                x, y, g = own_line[i], home.line(j), own_at[i]
                t = (most[x] >> self.shift) + (self.shift > 0)
                near = (roots[base + x] != roots[y]) & (guests.lo[g] <= home.hi[j] + t) & (home.lo[j] <= guests.hi[g] + t)
                yield from looked(x[near], y[near])
        if by_line:
            for i, j in _ranges(first[crowded], np.maximum(after - first, 0)[crowded]):
                roots = settled()
                x = crowded[i]
                near = roots[base + x] != roots[j]
                yield from looked(x[near], j[near])
        self.parent = parent[: len(home.lines)]


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes, each to the least it reaches: chains would take more rounds to settle."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for p, q in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while parent[p] != p:
            parent[p] = p = parent[parent[p]]
        while parent[q] != q:
            parent[q] = q = parent[parent[q]]
        parent[max(p, q)] = min(p, q)
    # Parents are less than their children, so one pass settles all.
    for i, p in enumerate(parent):
        parent[i] = parent[p]
    root = np.array(parent, np.int64)
    apart = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[apart], nodes[root[apart]]


def _cells(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least length of each class of lengths, and in how many parts its lines lie: cells of some ``BUCKET`` characters.

    Lengths are counted to half a per cent, so that few counts come to the driver, and in one text of eight, by hash.
    Only the cells' sizes depend on that, not what is linked.
    """
    size = F.length("line")
    found = docs.where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).select(F.explode(F.split("text", "\n")).alias("line")).where(size >= FAMILIES[0][0]).groupBy(F.floor(F.log(size.cast("double")) * 200).alias("step")).agg(F.sum(8 * size.cast("long")).alias("chars")).toPandas().sort_values("step")
    goal = max(1, min(BUCKET, int(found["chars"].sum()) // (2 * docs.sparkSession.sparkContext.defaultParallelism)))
    starts, held = [FAMILIES[0][0]], [0]
    # Classes end where whole stretches get longer.
    stops = [40, 60, 100, 200, 400]
    for step, chars in zip(found["step"].tolist(), found["chars"].tolist()):
        least = int(np.ceil(np.exp(step / 200)))
        passed = [x for x in stops if x <= least]
        if least > starts[-1] and (passed or held[-1] and held[-1] + chars > goal):
            starts.append(max([least, *passed]))
            held.append(0)
            stops = stops[len(passed) :]
        held[-1] += chars
    return np.array(starts), np.array([max(1, -(-x // (2 * BUCKET))) for x in held])


def _spread(docs: DataFrame, starts: np.ndarray, parts: np.ndarray) -> DataFrame:
    """``cell, visitor, bytes, data``: lines, packed, for the cell of their length and those of lengths that they may be linked to."""
    base = np.cumsum(parts) - parts

    def flush(lines: list[str]):
        lines.sort(key=len)
        length = np.fromiter(map(len, lines), np.int64, len(lines))
        own, last = (np.searchsorted(starts, x, "right") - 1 for x in (length, length + allowed(length)))
        part = np.zeros(len(lines), np.int64)
        many = np.flatnonzero(parts[own] > 1)
        for i, j in slices(length[many].tolist(), _CHUNK):
            part[many[i:j]] = _ids([lines[k] for k in many[i:j].tolist()]) % parts[own[many[i:j]]]
        order = np.lexsort((length, part, last, own))
        groups = np.stack([own, last, part])[:, order]
        edges = [0, *(np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(0)) + 1).tolist(), len(order)]
        for i, j in zip(edges, edges[1:]):
            raw = "\n".join([lines[k] for k in order[i:j].tolist()]).encode("utf-8", "surrogatepass")
            data = pa.Codec("zstd", 1).compress(raw, asbytes=True)
            first, to, at = groups[:, i].tolist()
            cells = [int(base[first] + at)] + [c for c in range(int(base[first]), int(base[to] + parts[to])) if c != base[first] + at]
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array([c != cells[0] for c in cells]), pa.array([len(raw)] * len(cells), pa.int32()), pa.array([data] * len(cells), pa.binary())], ["cell", "visitor", "bytes", "data"])

    def run(batches):
        pending, held = {}, 0
        for batch in batches:
            for line in _texts(batch)[0]:
                if len(line) >= FAMILIES[0][0] and line not in pending:
                    pending[line] = None
                    held += len(line)
                    if held >= CHUNK:
                        yield from flush(list(pending))
                        pending, held = {}, 0
        if pending:
            yield from flush(list(pending))

    return docs.select("text").mapInArrow(lean(run), "cell int, visitor boolean, bytes int, data binary")


def _links(docs: DataFrame) -> DataFrame:
    """``node, root`` of the lines that are linked with others, by their ids."""
    starts, parts = _cells(docs)
    highest = np.append(starts[1:] - 1, 1 << 40)
    whole = np.repeat([_whole_at_least(a, b) for a, b in zip(starts.tolist(), highest.tolist())], parts)

    def run(batches):
        home, guests, held, cell, state = set(), set(), 0, 0, None

        def rows(found, lines):
            pairs, parts = list(found), []
            for i in range(0, len(pairs), 1 << 12):
                own, other = ([x[k] for x in pairs[i : i + (1 << 12)]] for k in (0, 1))
                parts.append([np.concatenate([_ids(x[lo:hi]) for lo, hi in slices([len(y) for y in x], _CHUNK)]) for x in ([lines[k] for k in own], [state.home.lines[k] for k in other])])
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(*map(np.concatenate, zip(*parts)))], ["a", "b"])

        def opened():
            nonlocal state, home
            state, home = _Cell(home, int(whole[cell])), None
            yield from rows(state.inner(), state.home.lines)

        def visited():
            lines = sorted(guests, key=len)
            guests.clear()
            yield from rows(state.visit(lines), lines)

        for batch in batches:
            for row in range(batch.num_rows):
                cell, visitor, size, data = (batch.column(c)[row] for c in ("cell", "visitor", "bytes", "data"))
                cell = cell.as_py()
                lines = pa.Codec("zstd").decompress(data.as_buffer(), size.as_py(), asbytes=True).decode("utf-8", "surrogatepass").split("\n")
                if not visitor.as_py():
                    home.update(lines)
                    continue
                if state is None:
                    yield from opened()
                for line in lines:
                    if line not in guests and len(line) <= state.longest:
                        guests.add(line)
                        held += len(line)
                        if held >= CHUNK // 2 or len(guests) >= VISITORS:
                            yield from visited()
                            held = 0
        if home:
            yield from opened()
        if guests:
            yield from visited()

    met = _spread(docs, starts, parts).repartitionById(int(parts.sum()), F.col("cell")).sortWithinPartitions("visitor")
    links = written(met.mapInArrow(lean(run), "a long, b long"), "links")
    # What has been written needs its shuffle no more; it is deleted when the driver's objects are.
    docs.sparkSession.sparkContext._jvm.System.gc()
    return components(links)


def _occurrences(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line, v, w`` of every line: two independent 64-bit hashes name a text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lines, rows, numbers = _texts(batch)
            ids = [_ids(lines[lo:hi]) for lo, hi in slices([len(x) for x in lines], _CHUNK)]
            v = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            owner = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(owner), batch.column("text_key").take(owner), pa.array(numbers, pa.int32()), pa.array(v), pa.array(lines, pa.string())], ["doc_id", "text_key", "line", "v", "content"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(lean(run), f"doc_id {kind}, text_key long, line int, v long, content string").withColumn("w", F.xxhash64("content")).drop("content")


def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_key, line, root, first_id, first_line``: every line and its class's first occurrence."""
    roots = _links(docs)
    found = written(_occurrences(docs), "occurrences")
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "line")
    distinct = found.groupBy("v", "w").agg(F.min(place).alias("first")).join(roots.select(F.col("node").alias("v"), "root"), "v", "left")
    # Unlinked lines are classes by both hashes; linked ones by their root.
    distinct = written(distinct.withColumn("kind", F.when(F.col("root").isNull(), F.col("w")).otherwise(0)).withColumn("root", F.coalesce("root", "v")), "distinct")
    firsts = distinct.groupBy("root", "kind").agg(F.min("first").alias("own"))
    named = distinct.select("v", "w", "root", "kind").join(firsts, ["root", "kind"]).select("v", "w", "root", F.col("own.doc_id").alias("first_id"), F.col("own.line").alias("first_line"))
    return found.join(named, ["v", "w"]).select("doc_id", "text_key", "line", "root", "first_id", "first_line")


def _removed():
    return ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("line") == F.col("first_line")))


def summary(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_kept, first_ids`` of every document.

    ``first_ids`` lists the other documents that hold the first occurrences of its removed lines.
    """
    other = F.when(_removed() & ~F.col("first_id").eqNullSafe(F.col("doc_id")), F.col("first_id"))
    # Repeated rows of one text have the same lines; each line counts once.
    per = classes(docs).dropDuplicates(["doc_id", "text_key", "line"]).groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.count_if(~_removed()).alias("k"), F.array_sort(F.collect_set(other)).alias("ids"))
    right = per.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), "n", "k", "ids")
    left = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    both = left.join(right, left["doc_id"].eqNullSafe(right["d"]) & (left["text_key"] == right["t"]), "left")
    return both.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_lines"), F.coalesce("k", F.lit(0)).alias("n_kept"), F.coalesce("ids", F.array().cast(per.schema["ids"].dataType)).alias("first_ids"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines; those left without any line are dropped."""
    gone = classes(docs).where(_removed()).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("_gone"))
    right = gone.select(F.col("doc_id").alias("_d"), F.col("text_key").alias("_t"), "_gone")
    both = docs.join(right, docs["doc_id"].eqNullSafe(right["_d"]) & (F.xxhash64(docs["text"]) == right["_t"]), "left").select(*docs.columns, "_gone")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts, keep = [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("_gone").to_pylist()):
                if lines:
                    drop = set(lines)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
                texts.append(text)
                keep.append(not lines or bool(text.strip()))
            yield batch.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["_gone"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(lean(run), docs.schema)
