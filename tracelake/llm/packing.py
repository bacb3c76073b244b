"""Packing of tokenised documents into sequences: first-fit decreasing.

A document's ids are cut into pieces: whole sequences first, and one remainder.
The remainders are packed in groups of about ``GROUP`` documents; a document's
group is drawn at random (a hash of its place among the rows of its task, so no
key can be hot). In a group, pieces go by falling length into the first bin
with room, which a tournament tree over the bins' free space finds in
logarithmic time. A group's last bins may be left partly empty.

Tokens come from a public tokenizer file, whose path is a parameter. Most text
is looked up by blank-separated chunk: byte-level BPE of this family never
merges across a lone blank between two other characters, so a chunk's ids are
the same alone and in context. Texts with other white space around blanks, or
with a special token, go whole to the tokenizer.

Defined results: a null or empty text is one end token; repeated rows are
packed once each; very long texts make as many pieces as they need; an empty
table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import TABLES, returned

CAPACITY, GROUP, END, SEED = 1024, 4096, 0, 977
#: Chunks whose ids a task remembers; beyond it they are looked up again.
MOST_CHUNKS = 250_000
LONGEST_CHUNK = 64
SPECIAL = "<|endoftext|>"


class Ids:
    """Ids of texts as little-endian unsigned 32-bit words."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk with the blank before it; None if its neighbours might matter."""
        body = chunk[1:] if chunk[:1] == " " else chunk
        if not body or body[0].isspace() or body[-1].isspace():
            return None
        ids = self.fast(chunk) if self.fast else self.whole.encode(chunk, add_special_tokens=False).ids
        found = np.array(ids, "<u4").tobytes()
        if len(chunk) <= LONGEST_CHUNK:
            if len(self.chunks) >= MOST_CHUNKS:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if SPECIAL in text or "\x00" in text:
            return self._whole(text)
        parts = text.replace(" ", "\x00 ").split("\x00")
        try:
            return b"".join(map(self.chunks.__getitem__, parts))
        except KeyError:
            pass
        get, out = self.chunks.get, []
        for part in parts:
            ids = get(part) or self._chunk(part)
            if ids is None:
                return self._whole(text)
            out.append(ids)
        return b"".join(out)


@functools.cache
def shared_ids(path: str, ranks_path: str | None, pattern: str | None) -> Ids:
    """One table of chunks for all tasks of a Python worker."""
    return Ids(path, ranks_path, pattern)


TABLES.append(shared_ids.cache_clear)


class Tournament:
    """Free space of bins in a complete binary tree; each node holds the most free below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        """The first bin with ``need`` free, which is then taken."""
        most, node = self.most, 1
        while node < self.leaves:
            node *= 2
            if most[node] < need:
                node += 1
        most[node] -= need
        found = node - self.leaves
        while node > 1:
            node //= 2
            left, right = most[2 * node], most[2 * node + 1]
            most[node] = left if left >= right else right
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ties of length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    tree = Tournament(len(lengths), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        need = int(lengths[i])
        bins[i] = b = tree.first_fit(need)
        offsets[i] = capacity - tree.most[tree.leaves + b] - need
    return bins, offsets


def padding(used: int, capacity: int = CAPACITY) -> int:
    """Padding of a sequence of ``used`` tokens: none at a power of two."""
    return 0 if used & (used - 1) == 0 else capacity - used


_PIECES = "start long, length long, ids_crc32 long, doc_tokens long, pick long"


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, pick`` of every piece of every document.

    ``pick`` is the document's random draw.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        ids_of = shared_ids(tokenizer, ranks, pattern).encode
        end = np.array([END], "<u4").tobytes()
        # The draws of a task: a repeated task sees the same rows in the same order.
        draw = np.random.default_rng([SEED, TaskContext.get().partitionId()])
        for batch in batches:
            rows, column = [], batch.column("text")
            picks = draw.integers(0, 1 << 62, batch.num_rows).tolist()
            for i in range(batch.num_rows):
                ids = ids_of(column[i].as_py()) + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    stop = min(start + capacity, n)
                    rows.append((i, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop]), n, picks[i]))
            owner, *columns = zip(*rows) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names)
        returned()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pick"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_PIECES}")


def pack(pieces: DataFrame, documents: int, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces, of ``documents`` documents in all."""
    groups = max(1, -(-documents // group))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "pick")

    def one(key, table):
        length = table.column("length").to_numpy()
        full = length == capacity
        bins, offsets = np.empty(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[~full], offsets[~full] = first_fit_decreasing(length[~full], capacity)
        bins[full] = np.arange(full.sum()) + (bins[~full].max(initial=-1) + 1)
        table = table.drop_columns(["pick", "bucket"])
        return table.append_column("sequence_id", pa.array(bins * groups + key[0].as_py())).append_column("offset", pa.array(offsets))

    bucketed = pieces.withColumn("bucket", F.pmod(F.col("pick"), F.lit(groups)))
    return bucketed.groupBy("bucket").applyInArrow(one, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece."""
    return pack(pieces(docs, tokenizer, ranks, pattern, capacity), docs.count(), capacity)


def pack_public(docs: DataFrame) -> DataFrame:
    """:func:`pack_documents` with the public 50k byte-level vocabulary."""
    import public_tokenizers as public

    return pack_documents(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
