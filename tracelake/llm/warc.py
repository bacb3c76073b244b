"""Legacy ARC archives turned into WARC, and WARC read back.

An ARC file starts with a version block; version 1 record headers hold five
fields (URL, address, date, type, length), version 2 ones ten (with status,
checksum, location, offset and file name). The declared length alone says where
a record ends. For each record the converter makes what WARC asks for and ARC
lacks: a record id (a UUID derived from the record's identity, so a rerun gives
the same), a W3C timestamp from the 14-digit date, a record type and SHA-1
digests. Records of one payload are tied by the digest: the first is a
response, the others revisit it.

Every task writes its own gzip-per-record file under a name no other attempt
uses; the list of files is itself a Parquet table, whose commit decides which
attempt's file counts, so a lost executor or a second attempt leaves no
duplicate.

Defined results: a null payload is empty; a null URL becomes ``urn:page:<id>``;
white space in a URL is percent-encoded; equal payloads of empty texts revisit
each other too if they reach ``least_bytes``; repeated ids are separate records
(of rows equal in id and payload one is the response and the rest revisit it);
null ids take no part in choosing a response and never are one unless every
copy's id is null.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import shared_dir, written

ARC_FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")}
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tracelake:archive")
#: Tasks that read archives; with more files a task reads several.
MOST_READERS = 20_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(version: int, payload: bytes, **fields) -> bytes:
    """One ARC record; absent fields are written as ``-``."""
    values = {"ip": "0.0.0.0", "type": "text/html", "date": "19700101000000", **fields, "length": str(len(payload))}
    return " ".join(str(values.get(k, "-")) for k in ARC_FIELDS[version]).encode() + b"\n" + payload + b"\n"


def arc_version_block(version: int, name: str = "archive.arc", date: str = "19700101000000") -> bytes:
    body = f"{version} 0 tracelake\n{' '.join(_TITLES[version])}\n".encode()
    fields = {"url": f"filedesc://{name}", "date": date, "type": "text/plain", "status": "200", "offset": "0", "file": name}
    return arc_record(version, body, **fields)


_TITLES = {1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"), 2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length")}


def read_arc(stream) -> Iterator[tuple[dict, bytes]]:
    """Header fields and payload of every record of a plain ARC stream but the version block.

    The version comes from the version block; without one, from the number of
    fields. A URL may hold spaces: the other fields are counted from the right.
    A truncated last record raises ``ValueError``.
    """
    version = None
    while line := stream.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "surrogateescape").rstrip("\r\n").split(" ")
        fields = ARC_FIELDS[version or (2 if len(parts) >= 10 else 1)]
        if len(parts) < len(fields) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC header: {line[:80]!r}")
        tail = len(fields) - 1
        head = dict(zip(fields, [" ".join(parts[:-tail]), *parts[-tail:]]))
        body = stream.read(int(head["length"]))
        if len(body) < int(head["length"]):
            raise ValueError("the declared length goes past the end of the archive")
        if version is None and head["url"].startswith("filedesc:"):
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {version}")
            continue
        yield head, body


def timestamp(date: str) -> str:
    """W3C form of an ARC date of up to 14 digits; missing parts are the earliest."""
    d = date if date.isdigit() else ""
    d += "19700101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(*identity) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, chr(0).join(map(str, identity)))}>"


def warc_record(head: dict, payload: bytes, refers_to: str | None = None, extra: dict | None = None, payload_digest: str | None = None, own_id: str | None = None) -> bytes:
    """The WARC record of one ARC record; ``refers_to`` (a record id) makes it a revisit.

    A revisit carries its payload as well, so that each record can be read alone.
    """
    own = payload_digest or digest(payload)
    named = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": own_id or record_id(head["url"], head["date"], own, *(extra or {}).values()),
        "WARC-Date": timestamp(head["date"]),
        "WARC-Target-URI": head["url"],
        "WARC-IP-Address": head["ip"],
        "WARC-Payload-Digest": f"sha1:{own}",
        "WARC-Block-Digest": f"sha1:{own}",
    }
    if refers_to:
        named |= {"WARC-Refers-To": refers_to, "WARC-Profile": REVISIT_PROFILE}
    named |= {**(extra or {}), "Content-Type": head["type"], "Content-Length": str(len(payload))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()).encode("utf-8", "surrogateescape") + b"\r\n" + payload + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def inflated(stream, chunk: int = 1 << 20) -> io.BufferedReader:
    """A reader over the concatenated gzip members of ``stream``, a chunk at a time."""

    class Members(io.RawIOBase):
        def __init__(self):
            self.inflate, self.rest = zlib.decompressobj(31), b""

        def readable(self):
            return True

        def readinto(self, buffer):
            while True:
                raw = self.rest or stream.read(chunk)
                if not raw:
                    if self.inflate.unconsumed_tail == b"" and self.started and not self.inflate.eof:
                        raise ValueError("truncated gzip member")
                    return 0
                self.started = True
                data = self.inflate.decompress(raw, len(buffer))
                self.rest = self.inflate.unconsumed_tail
                if self.inflate.eof:
                    self.rest, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
                    self.started = bool(self.rest)
                if data:
                    buffer[: len(data)] = data
                    return len(data)

        started = False

    return io.BufferedReader(Members(), 1 << 16)


def read_warc(stream) -> Iterator[tuple[dict, bytes]]:
    """Named fields and block of every record of a plain WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        named = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "surrogateescape").rstrip("\r\n").partition(": ")
            named[k] = v
        block = stream.read(int(named["Content-Length"]))
        if len(block) < int(named["Content-Length"]):
            raise ValueError("truncated WARC record")
        yield named, block


def convert(arc_stream, warc_stream) -> int:
    """ARC to WARC, one file: the first record of each payload digest is the response."""
    first: dict[str, str] = {}
    n = 0
    for head, payload in read_arc(arc_stream):
        own = digest(payload)
        warc_stream.write(gzip_member(warc_record(head, payload, first.get(own), {"X-Archive-Offset": str(n)}, own)))
        first.setdefault(own, record_id(head["url"], head["date"], own, str(n)))
        n += 1
    return n


def open_shared(path: str, mode: str):
    """A file of any file system that pyarrow knows, by URI or plain path."""
    from pyarrow import fs

    system, where = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "w":
        system.create_dir(where.rpartition("/")[0], recursive=True)
        return system.open_output_stream(where, compression=None)
    return system.open_input_stream(where, compression=None)


def convert_files(spark, arc_paths: list[str], out_dir: str) -> DataFrame:
    """``arc, warc, records``: every ARC file (plain or gzipped) converted by its own task."""

    def run(batches):
        for batch in batches:
            for path in batch.column("arc").to_pylist():
                target = f"{out_dir}/{re.sub(r'\.arc(\.gz)?$', '', path.rpartition('/')[2])}-{hashlib.sha1(path.encode()).hexdigest()[:8]}-{uuid.uuid4().hex}.warc.gz"
                with open_shared(path, "r") as raw, open_shared(target, "w") as out:
                    n = convert(inflated(raw) if path.endswith(".gz") else io.BufferedReader(_Raw(raw)), out)
                yield pa.RecordBatch.from_pydict({"arc": [path], "warc": [target], "records": [n]})

    paths = spark.createDataFrame([(p,) for p in arc_paths], "arc string").repartition(max(1, len(arc_paths)))
    return written(paths.mapInArrow(run, "arc string, warc string, records long"), "warc-files")


class _Raw(io.RawIOBase):
    """A pyarrow stream with the ``readinto`` that buffering needs."""

    def __init__(self, stream):
        self.stream = stream

    def readable(self):
        return True

    def readinto(self, buffer):
        data = self.stream.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)


def _url(page_id, url: str | None) -> str:
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else f"urn:page:{page_id}"


def write_pages(pages: DataFrame, least_bytes: int = 0, out_dir: str | None = None) -> DataFrame:
    """Pages as WARC files; returns the committed table of files: ``warc, records``.

    Each page first becomes an ARC record (version 1 for even ids, 2 for odd
    ones), which the converter parses by its declared length; so the archives
    are what a conversion of legacy ones would give.
    """
    spark = pages.sparkSession
    out_dir = out_dir or shared_dir(spark, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    keyed = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha1"), F.octet_length("payload").alias("n"))
    # Only payloads of several records need a decision; a payload's smallest id is found with a partial aggregate.
    shared = keyed.where(F.col("n") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    firsts = written(shared.select(F.col("sha1").alias("first_sha1"), "first"), "warc-firsts")
    # Marked rows: ids of copies, without payloads; a hot digest is split by its ids.
    salts = 16
    copies = keyed.where(F.col("n") >= least_bytes).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    spread = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = copies.join(spread, (F.col("sha1") == F.col("first_sha1")) & (copies["salt"] == spread["salt"])).select(F.col("page_id").alias("copy_id"), F.col("sha1").alias("copy_sha1"), "first")
    marked = written(met.groupBy("copy_id", "copy_sha1", "first").agg(F.count("*").alias("rows")), "warc-copies")
    named = rows.withColumn("sha1", F.unhex(F.sha1("payload")))
    same_row = F.col("page_id").eqNullSafe(F.col("copy_id")) & (F.col("sha1") == F.col("copy_sha1"))
    # Rows equal in id and payload to a response are told apart by a number of their own, on a written table.
    repeated = marked.where((F.col("rows") > 1) & (F.col("copy_id") == F.col("first")))
    joined = named.join(marked, same_row, "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    columns = ("page_id", "url", "payload", "first", "again")
    if repeated.take(1):
        many = written(named.join(repeated, same_row).withColumn("number", F.monotonically_increasing_id()).select(*columns[:-1], "sha1", "number"), "warc-repeated")
        least = many.groupBy(F.col("page_id").alias("least_id"), F.col("sha1").alias("least_sha1")).agg(F.min("number").alias("least"))
        told = many.join(least, (F.col("page_id") == F.col("least_id")) & (F.col("sha1") == F.col("least_sha1"))).withColumn("again", F.col("number") != F.col("least"))
        joined = joined.where(~F.coalesce((F.col("rows") > 1) & (F.col("page_id") == F.col("first")), F.lit(False))).select(*columns).union(told.select(*columns))
    joined = joined.select(*columns)

    def run(batches):
        from pyspark import TaskContext

        target = f"{out_dir}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        n, out = 0, None
        for batch in batches:
            out = out or open_shared(target, "w")
            for i in range(batch.num_rows):
                page_id, url, payload, first, again = (batch.column(c)[i].as_py() for c in columns)
                version = 1 if (page_id or 0) % 2 == 0 else 2
                raw = arc_version_block(version) + arc_record(version, payload, url=_url(page_id, url), status="200")
                for head, body in read_arc(io.BytesIO(raw)):
                    own = digest(body)
                    extra = {"X-Page-Id": "" if page_id is None else str(page_id)} | ({"X-Refers-To-Page-Id": str(first)} if again else {})
                    out.write(gzip_member(warc_record(head, body, record_id("page", first, own) if again else None, extra, own, record_id("page", page_id, own, *["again"] * again))))
                    n += 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"warc": [target], "records": [n]})

    return written(joined.mapInArrow(run, "warc string, records long"), "warc-files")


def read_pages(files: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` from the archives.

    Lengths and digests are taken from the payloads read, and checked against
    the headers.
    """

    def run(batches):
        for batch in batches:
            for path in batch.column("warc").to_pylist():
                rows = []
                with open_shared(path, "r") as raw:
                    for named, block in read_warc(inflated(raw)):
                        own = digest(block)
                        if named["WARC-Payload-Digest"] != f"sha1:{own}":
                            raise ValueError(f"a payload in {path} does not have its digest")
                        refers = named.get("X-Refers-To-Page-Id")
                        rows.append((int(named["X-Page-Id"]) if named["X-Page-Id"] else None, named["WARC-Target-URI"], len(block), own, named["WARC-Type"], int(refers) if refers else None))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    # A stated number of partitions, as the adaptive planner would merge a list of paths into one task.
    return files.select("warc").repartition(max(1, min(files.count(), MOST_READERS))).mapInArrow(run, _PAGE_SCHEMA)


_PAGE_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _batch(rows):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
