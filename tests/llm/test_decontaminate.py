import hashlib
import random
import re
import time

import pytest

from tracelake.llm import decontaminate

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PIECE = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _windows(items):
    found = {}
    for item, text in items:
        w = _words(text)
        for i in range(max(1, len(w) - 7) if w else 0):
            found.setdefault(tuple(w[i : i + 8]), set()).add(str(item))
    return found


def _hit(text, windows):
    w, at, items = _words(text), set(), set()
    for n in {len(g) for g in windows}:
        for i in range(len(w) - n + 1):
            own = windows.get(tuple(w[i : i + n]))
            if own:
                at |= set(range(i, i + n))
                items |= own
    return len(w), at, items


def _brute_hits(docs, items):
    windows, out = _windows(items), []
    for d, t in docs:
        n, at, own = _hit(t, windows)
        out.append((d, n, len(at), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), len(own) >= 2))
    return sorted(out, key=str)


def _brute_clean(docs, items):
    windows, out = _windows(items), []
    for d, t in docs:
        _, at, own = _hit(t, windows)
        if len(own) < 2:
            if at:
                pieces = PIECE.findall(t)
                t = "".join(p for i, p in enumerate(pieces) if i not in at) + t[sum(map(len, pieces)) :]
            out.append((d, t))
    return sorted(out, key=str)


ITEMS = [(1, "one two three four five six seven eight nine"), (2, "Short item"), (3, None), (4, " .,; "), (5, "ten eleven twelve thirteen fourteen fifteen sixteen seventeen"), (6, "über den fluß und in die wälder hinein"), (6, "short ITEM")]
TEXTS = [
    (1, None), (2, ""), (3, "...  "), (4, "short item"), (5, "  a short... Item, here  "), (5, "other row of one id with a short-item"), (5, "other row of one id with a short-item"), (None, "a short item"), (None, "nothing"),
    (6, "zero one two three four five six seven eight nine ten"), (7, "...one TWO three four, five six seven eight? and one two three four five six seven eight nine!"),
    (8, "short item one two three four five six seven eight"), (9, "über den fluß und in die Wälder hinein; Über"), (10, "one two three four five six seven"), (11, "\nshort\nitem short item"), (12, "x " * 5000 + "short item" + " y" * 5000 + " " * 3000),
]


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_CHARS, 0])
def test_fixtures_against_brute_force(spark, broadcast):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in TEXTS], "doc_id long, text string, _hit_spans int, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.hits(docs, items, broadcast_chars=broadcast)
    assert sorted(map(tuple, got.collect()), key=str) == _brute_hits(TEXTS, ITEMS)


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_CHARS, 0])
def test_clean_against_brute_force(spark, broadcast):
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in TEXTS], "doc_id long, text string, spans int, items string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.clean(docs, items, broadcast_chars=broadcast)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == _brute_clean(TEXTS, ITEMS)


def test_clean_of_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(d, t, 7) for d, t in TEXTS], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    none = items.limit(0)
    assert decontaminate.clean(docs.limit(0), items).count() == decontaminate.hits(docs.limit(0), items).count() == 0
    assert sorted(map(tuple, decontaminate.clean(docs, none).collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    assert decontaminate.hits(docs, none).where("n_hit > 0").count() == 0
    clash = docs.withColumnRenamed("n_hit", "_hit_doc_id")
    assert sorted(((r[0], r[1]) for r in decontaminate.clean(clash, items).collect()), key=str) == _brute_clean(TEXTS, ITEMS)


def test_tables_against_brute_force(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows, own = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    r = random.Random(4)
    for i in range(30):  # passages of one item, in the midst of words
        words = own[i][1].split()
        rows.append((10_000 + i, " ".join(["plain"] * r.randrange(3) + words[: 9 + i] + ["und", "so", "fort"] * r.randrange(3))))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((x.doc_id, x.text) for x in decontaminate.clean(made, items).collect()), key=str) == _brute_clean(rows, own)


def test_clean_is_linear_in_the_length_of_a_text(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight")], "item_id long, text string")

    def seconds(words):
        docs = spark.createDataFrame([(1, "abcdefg " * words + "one two three four five six seven eight" + " tail" * words)], "doc_id long, text string")
        start = time.time()
        assert len(decontaminate.clean(docs, items).first().text) == 13 * words - 1
        return time.time() - start

    seconds(1000)
    short, long = min(seconds(20_000) for _ in range(2)), min(seconds(160_000) for _ in range(2))
    assert long < 8 * short + 2
