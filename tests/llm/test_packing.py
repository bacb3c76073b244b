import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as public
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracelake.llm import packing, queries

SF = "/root/testdata/sf0.01"
FILES = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(FILES[0])


IDS = packing.Ids(*FILES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(list("ab'st  \n\t\r\x00\x1c\x85  　é日1.,!<|>\U0001f600") + ["<|endoftext|>", " the", "'ll"]), max_size=30))
def test_chunked_ids_equal_those_of_the_whole_text(parts):
    text = "".join(parts)
    want = Tokenizer.from_file(FILES[0]) if not hasattr(IDS, "w") else IDS.w
    IDS.w = want
    assert np.frombuffer(IDS.encode(text), "<u4").tolist() == want.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_the_quadratic_form():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 5, 300):
        lengths = r.integers(1, 100, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            if b == len(free):
                free.append(100)
            want[i] = (b, 100 - free[b])
            free[b] -= lengths[i]
        assert [(bins[i], offsets[i]) for i in range(n)] == [want[i] for i in range(n)]


def _check(rows, texts, whole):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*whole.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids)
            at += r.length
            assert zlib.crc32(ids[r.start : at].tobytes()) == r.ids_crc32
        assert at == len(ids)
    total = pad = 0
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total += at
        pad += packing.padding(at)
    return pad / max(total, 1)


def test_query_over_the_whole_table(spark, whole):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert _check(queries.op4_packing(spark, SF).collect(), texts, whole) < 0.02


def test_null_empty_long_and_repeated_rows(spark, whole):
    texts = {1: None, 2: "", 3: "word " * 50000, 4: "a\n b", 5: "x" * 1023}
    docs = spark.createDataFrame([(k, v, "y") for k, v in texts.items()], "doc_id long, text string, offset string").repartition(2)
    _check(packing.pack_public(docs).collect(), texts, whole)
    twice = packing.pack_public(docs.union(docs)).collect()
    assert len(twice) == 2 * len(packing.pack_public(docs).collect())
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack_public(docs.limit(0)).count() == 0
