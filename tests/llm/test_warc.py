import gzip
import io

import pytest


from tracelake.llm import warc


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip_by_declared_length(version):
    bodies = [b"", b"a\nb 1.2.3.4 20200101000000 text/html 7\n", "ü".encode() * 5000]
    raw = warc.arc_version_block(version) + b"".join(warc.arc_record(version, b, url=f"http://e/{i} x", date="20010203040506") for i, b in enumerate(bodies))
    got = list(warc.read_arc(io.BytesIO(raw)))
    assert [b for _, b in got] == bodies
    assert [h["url"] for h, _ in got] == ["http://e/0 x", "http://e/1 x", "http://e/2 x"]


def test_truncated_or_strange_archives_are_errors():
    raw = warc.arc_record(1, b"hello", url="http://e/")
    with pytest.raises(ValueError, match="declared length"):
        list(warc.read_arc(io.BytesIO(raw[:-3])))
    with pytest.raises(ValueError, match="ARC header"):
        list(warc.read_arc(io.BytesIO(b"what is this\n")))
    with pytest.raises(ValueError, match="truncated"):
        list(warc.read_warc(warc.inflated(io.BytesIO(warc.gzip_member(warc.warc_record({"url": "u", "date": "2001", "type": "t", "ip": "-"}, b"x" * 99))[:-9]))))


def test_conversion_makes_ids_dates_types_and_digests(tmp_path, spark):
    a = warc.arc_version_block(2) + b"".join(warc.arc_record(2, b, url="http://e/a", date="2001020304") for b in (b"one", b"two", b"one"))
    (tmp_path / "x.arc").write_bytes(a)
    (tmp_path / "y.arc.gz").write_bytes(gzip.compress(a))
    files = warc.convert_files(spark, [str(tmp_path / "x.arc"), str(tmp_path / "y.arc.gz")], f"file://{tmp_path}/out").collect()
    assert sorted(f.records for f in files) == [3, 3]
    for f in files:
        got = list(warc.read_warc(warc.inflated(warc.open_shared(f.warc, "r"))))
        assert [n["WARC-Type"] for n, _ in got] == ["response", "response", "revisit"]
        assert got[2][0]["WARC-Refers-To"] == got[0][0]["WARC-Record-ID"]
        assert got[0][0]["WARC-Date"] == "2001-02-03T04:00:00Z"
        assert got[1][0]["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"two")
        assert [b for _, b in got] == [b"one", b"two", b"one"]


def test_pages_come_back_with_revisits(spark):
    rows = [(7, "http://e/7", "same", "x"), (3, "http://e/ 3\n", "same", "x"), (5, None, None, "x"), (9, "u", "", "x"), (11, "u", "é" * 90000, "x"), (12, "u", "lone", "x"), (12, "u", "lone", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    got = sorted(map(tuple, warc.read_pages(warc.write_pages(pages)).drop("url").collect()), key=str)
    d = warc.digest
    want = [(3, 4, d(b"same"), "response", None), (7, 4, d(b"same"), "revisit", 3), (5, 0, d(b""), "response", None), (9, 0, d(b""), "revisit", 5), (11, 180000, d("é".encode() * 90000), "response", None), (12, 4, d(b"lone"), "response", None), (12, 4, d(b"lone"), "revisit", 12)]
    assert got == sorted(want, key=str)
    assert warc.read_pages(warc.write_pages(pages.limit(0))).count() == 0
    some = {r.page_id: r.record_type for r in warc.read_pages(warc.write_pages(pages, least_bytes=5)).collect()}
    assert set(some.values()) == {"response"}


def test_one_response_for_each_payload_however_often_its_row_is_there(spark):
    rows = [(5, "same")] * 8 + [(6, "same"), (7, "same"), (7, "other"), (7, "other"), (9, None), (9, ""), (None, "same"), (None, "lone")]
    for parts in (1, 8):
        pages = spark.createDataFrame([(i, f"http://x/{i}", h, True) for i, h in rows], "page_id long, url string, html string, again boolean").repartition(parts)
        got = warc.read_pages(warc.write_pages(pages)).collect()
        assert len(got) == len(rows)
        for payload in {r.payload_digest for r in got}:
            own = [r for r in got if r.payload_digest == payload]
            first = [r for r in own if r.record_type == "response"]
            assert len(first) == 1 and first[0].refers_to is None
            assert all(r.refers_to == first[0].page_id for r in own if r is not first[0])
            assert first[0].page_id == min((r.page_id for r in own if r.page_id is not None), default=None)
