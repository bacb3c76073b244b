"""Canonical JSON, seals and identities, on the driver and as pandas UDFs.

Spark's own JSON writer spells doubles and orders keys in another way, so sealed
documents are written here alone.
"""

from __future__ import annotations

import gzip
import hashlib
import html
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


_ENCODERS = {a: json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=a, allow_nan=False) for a in (False, True)}


def canonical(value, ascii_only: bool = False) -> str:
    """Sorted keys, no blanks; non-finite numbers are refused."""
    return _ENCODERS[bool(ascii_only)].encode(value)


def digest(value, ascii_only: bool = False) -> str:
    return hashlib.sha256(canonical(value, ascii_only).encode()).hexdigest()


def text_digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sealed(value: dict) -> dict:
    """The object with its seal ``id``, a digest of all else."""
    bare = {k: v for k, v in value.items() if k != "id"}
    return {**bare, "id": digest(bare)}


def seal_holds(value: dict) -> bool:
    return isinstance(value, dict) and sealed(value)["id"] == value.get("id")


def node_id(path, symbol, kind) -> str:
    return digest([path, symbol, kind])


def fingerprint(path, symbol, kind, text_sha256) -> str:
    return digest([path, symbol, kind, text_sha256])


def edge_id(source, expression, operation) -> str:
    return digest([source, expression, operation])


def blob_oid(raw: bytes, length: int = 40) -> str:
    """Git's name of a blob: SHA-1 or SHA-256 by the length of the expected name."""
    data = b"blob %d\0" % len(raw) + raw
    return (hashlib.sha1(data) if length == 40 else hashlib.sha256(data)).hexdigest()


def parse_answer(text: str):
    """Strict JSON: no repeated keys, no NaN or infinities. Raises ``ValueError``."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(keys) != len(set(keys)):
            raise ValueError("repeated key")
        return dict(items)

    def refuse(word):
        raise ValueError(f"{word} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=refuse)


def same_json(a, b) -> bool:
    """Equality that tells booleans from numbers and ignores the order of keys."""
    return canonical(a) == canonical(b)


def escaped(text: str) -> str:
    return html.escape(text, quote=True)


def unique_prefix(ids: list[str], least: int = 12) -> int:
    """Shortest length, ``least`` or more, at which all ids differ."""
    ids = sorted(set(ids))
    width = least
    for a, b in zip(ids, ids[1:]):
        shared = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        width = max(width, shared + 1)
    return width


@F.pandas_udf(LongType())
def gzip_bytes(text: pd.Series) -> pd.Series:
    """Size of a text compressed at level 9 without a time stamp."""
    return text.map(lambda t: None if t is None else len(gzip.compress(t.encode(), 9, mtime=0))).astype("Int64")


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """A JSON text in canonical form; null where it is not strict JSON."""

    def one(t):
        try:
            return None if t is None else canonical(parse_answer(t))
        except ValueError:
            return None

    return text.map(one)
