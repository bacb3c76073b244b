import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import lines

SF = "/root/testdata/sf0.001"


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=1500, deadline=None)
@given(st.text("ab", max_size=12), st.text("ab", max_size=12), st.integers(0, 3))
def test_banded_distance_equals_the_full_table(a, b, most):
    assert lines.edit_distance(a, b, most) == min(_levenshtein(a, b), most + 1)


@settings(max_examples=400, deadline=None)
@given(st.text("abcd", min_size=18, max_size=60), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 70), st.sampled_from("abcd")), max_size=2))
def test_linked_lines_share_a_key(a, edits):
    b = list(a)
    for kind, at, c in edits:
        at %= len(b) + 1
        if kind == 0:
            b.insert(at, c)
        elif at < len(b):
            b[at : at + 1] = [c] if kind == 1 else []
    b = "".join(b)
    most = int(lines.allowed(min(len(a), len(b))))
    if a != b and _levenshtein(a, b) <= most:
        keys, owners = lines._keys(lines.line_ids([a, b])[1])
        assert set(keys[owners == 0]) & set(keys[owners == 1])


def _brute(rows):
    found = [(d is None, d, i, n, x) for i, (d, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    distinct = sorted({x for *_, x in found})
    parent = {x: x for x in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(distinct):
        for y in distinct[i + 1 :]:
            most = int(lines.allowed(min(len(x), len(y))))
            if most and abs(len(x) - len(y)) <= most and lines.edit_distance(x, y, most) <= most:
                parent[root(x)] = root(y)
    first = {}
    for no_id, d, i, n, x in found:
        place = (no_id, d or 0, n)
        first[root(x)] = min(first.get(root(x), place), place)
    out = []
    for i, (d, t) in enumerate(rows):
        own = [(n, x) for no_id, _, j, n, x in found if j == i]
        kept = [n for n, x in own if first[root(x)] == (d is None, d or 0, n)]
        ids = sorted({first[root(x)][1] for n, x in own if n not in kept and first[root(x)][:2] != (d is None, d or 0)})
        out.append((d, len(own), len(kept), ids))
    return sorted(out, key=str)


def _run(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "r") for d, t in rows], "doc_id long, text string, line int, root string").repartition(3)
    return sorted(((r.doc_id, r.n_lines, r.n_kept, list(r.first_ids)) for r in lines.summary(docs).collect()), key=str)


def test_summary_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = "a sentence that is somewhat long, with 14 words or so, to be edited by hand"
    rows += [(9000, base), (9001, base.replace("14", "15")), (9002, "x" + base[:-1]), (9003, base.replace("14", "1556")), (9004, base[::-1] + "\n" + base)]
    assert _run(spark, rows) == _brute(rows)


def test_edges_and_clean(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "short\nshort\nshorx"), (5, "short"), (5, "short"), (None, "short\nonly here and nowhere else"), (6, "long " * 40000), (7, "long " * 39999 + "lonk "), (8, "é" * 30 + "\r\nkeep"), (9, "é" * 29 + "è\r\nother")]
    assert _run(spark, rows) == _brute(rows)
    assert _run(spark, []) == []
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, _x string")
    kept = lines.clean(docs)
    assert kept.columns == docs.columns
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert got == {(1, None), (2, ""), (3, "\n \n"), (4, "short\nshorx"), (None, "only here and nowhere else"), (6, "long " * 40000), (8, "é" * 30 + "\r\nkeep"), (9, "other")}


def _edited(r, line, edits):
    """``line`` with evenly spread edits, which leave the shortest stretches whole."""
    out = list(line)
    for at in sorted({int((i + 1) * len(line) / (edits + 1)) for i in range(edits)}, reverse=True):
        kind = r.randrange(3)
        out[at : at + (kind > 0)] = [] if kind == 1 else ["#"]
    return "".join(out)


def test_edited_lines_of_every_length_meet():
    """Recall of the anchors against brute force is whole, with as many edits as are allowed."""
    r = random.Random(5)
    linked = 0
    for n in [*range(20, 260), *range(260, 3000, 97)]:
        for _ in range(4):
            a = "".join(r.choice("abcdefgh ") for _ in range(n))
            b = _edited(r, a, n // 20)
            most = int(lines.allowed(min(len(a), len(b))))
            if a == b or _levenshtein(a, b) > most if n < 260 else lines.edit_distance(a, b, most) > most:
                continue
            linked += 1
            key, owner, lo, hi = lines._anchors(lines.line_ids([a, b])[1])
            own = [{k: (x, y) for k, o, x, y in zip(key.tolist(), owner.tolist(), lo.tolist(), hi.tolist()) if o == i} for i in (0, 1)]
            assert any(own[0][k][0] - most <= own[1][k][1] and own[1][k][0] - most <= own[0][k][1] for k in own[0].keys() & own[1].keys()), (n, a, b)
            bags = [np.frombuffer(lines._bag(x), np.uint8).astype(int) for x in (a, b)]
            assert abs(bags[0] - bags[1]).sum() <= 2 * most
    assert linked > 700


def test_replaced_words_link_paragraphs(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(60):
        line = [r.choice(words) for _ in range(r.randrange(12, 150))]
        rows.append((2 * i, " ".join(line)))
        line[r.randrange(len(line))] = r.choice(words)
        rows.append((2 * i + 1, " ".join(line)))
    # By the test's full table, which the code under test has no part in.
    far = sum(2 < _levenshtein(a, b) <= min(len(a), len(b)) // 20 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    got = _run(spark, rows)
    assert far > 30 and got == _brute(rows)
    assert sum(kept == 0 for _, _, kept, _ in got) >= far


def test_packed_grams_are_few_bytes_and_come_back_whole():
    """Every gram comes back, to 24 bits of its key; unpacked rows took 24 bytes a gram in the shuffle."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghijklm") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    texts = sorted({" ".join(r.choice(words) for _ in range(r.randrange(5, 120))) for _ in range(2000)} | {"ab" * 40000, "-" * 70}, key=len)
    _, h = lines.line_ids(texts)
    key, owner, first, last = lines._anchors(h)
    packed = list(lines._pack(h.length, key, owner, first, last, 6))
    got = []
    for bucket, size, grams, data in packed:
        which, length, k, line, lo, hi = lines._unpack(data, size, grams)
        assert (length == h.length[which]).all()
        got += zip([bucket] * grams, which[line].tolist(), k.tolist(), lo.tolist(), hi.tolist())
    u = key.view(np.uint64)
    buckets = (u >> np.uint64(24)) % np.uint64(1 << 32) % np.uint64(6)
    assert sorted(got) == sorted(zip(buckets.tolist(), owner.tolist(), (u % np.uint64(1 << 24)).tolist(), first.tolist(), last.tolist()))
    assert sum(len(x[-1]) for x in packed) < 6 * len(key)


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    """Keys under which more lines meet than are listed in pairs go to rounds of centres; links stay whole."""
    monkeypatch.setattr(lines, "CROWD", 3)
    monkeypatch.setattr(lines, "CHUNK", 3000)
    monkeypatch.setattr(lines, "BUCKET", 2000)
    r = random.Random(9)
    common = "this passage is found in very many of the lines, whatever else they say: "
    rows = []
    for i in range(40):
        own = "".join(r.choice("abcdefgh ") for _ in range(30))
        rows.append((2 * i, common + own + "\n" + common))
        rows.append((2 * i + 1, common + own[:-2] + "xy"))
    got = _run(spark, rows)
    assert got == _brute(rows)
    assert sum(kept == 0 for _, _, kept, _ in got) >= 40


def test_distances_of_long_lines_equal_the_whole_table():
    r = random.Random(10)
    for n in (30, 90, 400, 900):
        for edits in (0, 1, 3, 6, n // 20, n // 8):
            a = "".join(r.choice("abcd") for _ in range(n))
            b = _edited(r, a, edits) if edits else a[::-1]
            d = _levenshtein(a, b)
            for most in (n // 40, n // 20, d - 1, d):
                if most >= 0:
                    assert lines.edit_distance(a, b, most) == min(d, most + 1)


def test_many_distances_at_once_equal_one_by_one():
    r = random.Random(11)
    for letters in ("ab", "abcdefgh ", "aé€\U0001d11ebc"):
        pairs = []
        for n in [*range(20, 200, 3), *range(200, 5600, 450)]:
            a = "".join(r.choice(letters) for _ in range(n))
            for edits in (0, 1, n // 40, n // 20, n // 20 + 1, n // 12):
                pairs.append(sorted((a, _edited(r, a, edits)), key=len))
            pairs.append((a, "".join(r.choice(letters) for _ in range(n))))
        assert lines._within(pairs).tolist() == [lines.edit_distance(a, b, len(a) // 20) <= len(a) // 20 for a, b in pairs]


def test_a_cell_finds_every_link_of_its_lines_and_visitors(monkeypatch):
    """With as many edits as are allowed, evenly spread, and with keys that many lines share."""
    r = random.Random(12)
    for crowd in (1024, 1):
        monkeypatch.setattr(lines, "CROWD", crowd)
        for low, high in ((20, 39), (40, 59), (100, 199), (400, 800)):
            whole = lines._whole_at_least(low, high)
            for n in range(low, high, 1 + (high - low) // 12):
                a = "".join(r.choice("abcdefgh ") for _ in range(n))
                b, end = _edited(r, a, n // 20), a[:-1] + "#"
                x, y = sorted((a, b), key=len)
                if a == b or len(y) < low or len(y) > high or not lines._within([(x, y)])[0]:
                    continue
                assert len(list(lines._Cell({x, y}, whole).inner())) == 1
                assert len(list(lines._Cell({y}, whole).visit([x]))) == 1
                assert len(list(lines._Cell({a, b, end}, whole).inner())) == 2


def test_lines_are_sent_as_texts_and_few_times(spark):
    """What is shuffled is under the texts' own size, where packed grams and listed pairs were more (F1)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    chars = docs.selectExpr("sum(length(text))").first()[0]
    sent = lines._spread(docs, *lines._cells(docs)).selectExpr("sum(length(data))").first()[0]
    assert sent < 1.2 * chars


def test_cells_in_parts_lose_no_link(spark, monkeypatch):
    """Lines of one length that are more than a cell holds lie in several parts, which visit each other."""
    monkeypatch.setattr(lines, "BUCKET", 300)
    monkeypatch.setattr(lines, "CHUNK", 2000)
    monkeypatch.setattr(lines, "_cells", lambda docs: (np.array([20, 60, 62, 64]), np.array([1, 3, 2, 2])))
    r = random.Random(13)
    rows = []
    for i in range(50):
        line = "".join(r.choice("abcdefgh ") for _ in range(r.randrange(58, 66)))
        rows += [(3 * i, line), (3 * i + 1, _edited(r, line, 2)), (3 * i + 2, _edited(r, line, 3))]
    got = _run(spark, rows)
    assert got == _brute(rows) and sum(kept == 0 for _, _, kept, _ in got) > 60


def test_links_of_a_cell_are_stars():
    chain = np.arange(10, 60)
    a, b = lines._stars(np.append(chain[:-1], [100, 7]), np.append(chain[1:], [101, 7]))
    assert dict(zip(a.tolist(), b.tolist())) == {**{i: 10 for i in range(11, 60)}, 101: 100}


def _scattered(r, line, edits, letters):
    out = list(line)
    for _ in range(edits):
        at, kind = r.randrange(len(out)), r.randrange(3)
        out[at : at + (kind > 0)] = [] if kind == 1 else [r.choice(letters)]
    return "".join(out)


def test_long_lines_take_less_time_at_once_than_one_by_one():
    """Lines of over 250 allowed edits were compared one by one, 13 of the 96 CPU seconds that cells took over 0.51 GB (F1)."""
    r, letters = random.Random(14), "abcdefghijklmnop "
    pairs = []
    for n in (6000, 8000, 12000, 20000):
        for edits in (n // 25, n // 20 - 10, n // 16, n // 12):
            a = "".join(r.choice(letters) for _ in range(n))
            pairs.append(tuple(sorted((a, _scattered(r, a, edits, letters)), key=len)))
    began = time.process_time()
    got = lines._within(pairs).tolist()
    at_once = time.process_time() - began
    began = time.process_time()
    want = [lines.edit_distance(a, b, len(a) // 20) <= len(a) // 20 for a, b in pairs]
    assert got == want and 4 < sum(want) < 14
    assert at_once < 0.6 * (time.process_time() - began)


def test_pairs_compared_at_once_do_not_change_each_other():
    """Of unlike lengths and edits allowed, with characters of one byte, of few kinds and of very many."""
    r = random.Random(15)
    for letters in ("a", "ab", "\x00\xffé ", "aé€\udc80", "".join(map(chr, range(0x4E00, 0x4E00 + 500)))):
        pairs = []
        for n in [*range(1, 130, 4), 300, 901, 2500]:
            a = "".join(r.choice(letters) for _ in range(n))
            for edits in (1, n // 30, n // 20, n // 20 + 1, n // 15):
                pairs.append(tuple(sorted((a, _scattered(r, a, edits, letters)), key=len)))
                pairs.append((a, a[edits:] + "".join(r.choice(letters) for _ in range(edits))))
        r.shuffle(pairs)
        want = [lines.edit_distance(a, b, len(a) // 20) <= len(a) // 20 for a, b in pairs]
        assert lines._within(pairs).tolist() == want == [bool(lines._within([x])[0]) for x in pairs]


def test_one_long_line_does_not_widen_many_short_pairs():
    most = [1] * 50000 + [40] * 300 + [60000]
    ranges = list(lines._batches(most, [40] * 50000 + [1600] * 300 + [2400000]))
    assert [j for _, j in ranges[:-1]] == [i for i, _ in ranges[1:]] and ranges[0][0] == 0 and ranges[-1] == (50300, 50301)
    assert max((j - i) * (most[j - 1] + 1) for i, j in ranges) <= lines.PLACES
