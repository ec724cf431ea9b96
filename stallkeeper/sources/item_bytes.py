"""Item bytes: base64 of gzip of a tagged binary tree, to JSON text that from_json reads with a schema."""

from __future__ import annotations

import gzip
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Number of the tag and its struct format.
NUMBERS = {1: ">b", 2: ">h", 3: ">i", 5: ">f", 6: ">d"}
ARRAYS = {7: ">b", 11: ">i", 12: ">q"}
DEPTH = 64


def parse(data: bytes) -> object:
    """The value of a tree's root; raises on broken data."""
    at = 0

    def take(fmt: str):
        nonlocal at
        (x,) = struct.unpack_from(fmt, data, at)
        at += struct.calcsize(fmt)
        return x

    def text() -> str:
        nonlocal at
        n = take(">H")
        at += n
        return data[at - n : at].decode("utf-8", "replace")

    def value(tag: int, depth: int):
        if depth > DEPTH:
            raise ValueError("too deep")
        if tag == 4:  # as its two halves: a reader takes it for a number only where that is asked for
            return [take(">i"), take(">i")]
        if tag in NUMBERS:
            return take(NUMBERS[tag])
        if tag in ARRAYS:
            return [take(ARRAYS[tag]) for _ in range(take(">i"))]
        if tag == 8:
            return text()
        if tag == 9:
            kind, n = take(">b"), take(">i")
            return [value(kind, depth + 1) for _ in range(n)]
        if tag == 10:
            out = {}
            while (kind := take(">b")) != 0:
                name = text()
                out[name] = value(kind, depth + 1)
            return out
        raise ValueError(f"tag {tag}")

    tag = take(">b")
    text()
    return value(tag, 0)


@F.pandas_udf(StringType())
def decode(packed: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """JSON of the tree in binary (after unbase64), null for what can't be read."""

    def one(x: bytes | None) -> str | None:
        try:
            return json.dumps(parse(gzip.decompress(x) if x[:2] == b"\x1f\x8b" else x))
        except (ValueError, TypeError, struct.error, OSError, EOFError, RecursionError):
            return None

    for batch in packed:
        yield batch.map(one)
