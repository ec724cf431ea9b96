"""Best-fit packing planned on the histogram of piece lengths.

Texts become token ids once; what goes on is a row per piece with its length. The plan is made from the counts per
length alone (at most as many numbers as a sequence has tokens): lengths descend, and each goes to the open sequences
with the least room that still fits, in bulk. Pieces then take the planned slots by their rank within their length.
Ranks are numbered within buckets and shifted by the buckets' counts, so no length meets in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.common import small_batches, written

LENGTH = 1024
END = 2
BUCKET_ROWS = 50_000  # pieces that are ranked in one window


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers JSON file. Its ids are what that library gives; tiktoken runs the same merges
    about four times as fast. Files of another kind are refused, since the two would differ."""
    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    before = spec["pre_tokenizer"] or {}
    if spec["model"]["type"] != "BPE" or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False:
        raise ValueError(f"{path}: no plain byte-level BPE")
    #: The printable stand-ins that byte-level vocabularies use for bytes.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    #: Fixed value: the pattern that byte-level BPE splits text with.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_ids(text: str | None, path: str, end: int | None = END) -> np.ndarray:
    """The ids of tokenizers.Tokenizer.encode(text, add_special_tokens=False), then end. What tiktoken gives up on (it
    can't split about a million white space characters in a row) goes to that library itself."""
    try:
        ids = np.asarray(encoder(path).encode_to_numpy(text or "", allowed_special="all"), np.uint32)
    except ValueError:
        if not text:
            raise
        ids = np.asarray(library(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return ids if end is None else np.append(ids, np.uint32(end))


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter."""
    first = n % length or length
    return [(0, min(first, n)), *((s, length) for s in range(first, n, length))] if n else []


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), with_ids also the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = token_ids(text, tokenizer, end).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), length)):
                    own = ids[start : start + n]
                    rows.append((doc, k, start, n, zlib.crc32(own.tobytes()), own.astype(np.int64) if with_ids else None))
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    kind = docs.schema[id_col].dataType.simpleString()
    out = small_batches(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return out.withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Rows (piece length, first rank, end rank, first sequence, pieces a sequence,
    offset): the piece of rank r is number r - first; it goes to sequence first + number // pieces, at offset + length *
    (number % pieces)."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, count)
    free: list[int] = []
    out, sequences = [], 0

    def leave(space: int, run: tuple[int, int]) -> None:
        if space and run[1]:
            if space not in room:
                room[space] = []
                bisect.insort(free, space)
            room[space].append(run)

    for size in sorted(histogram, reverse=True):
        rank, n = 0, histogram[size]
        while n:
            k = bisect.bisect_left(free, size)
            if k < len(free):
                space = free[k]
                first, count = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(k)
            else:
                space, first, count = length, sequences, -(-n // (length // size))
                sequences += count
            each = space // size
            full = min(count, n // each)
            if full:
                out.append((size, rank, rank + full * each, first, each, length - space))
                leave(space - each * size, (first, full))
                rank, n = rank + full * each, n - full * each
            rest = n if full < count else 0
            if rest:  # fewer than each: one more sequence takes them
                out.append((size, rank, rank + rest, first + full, rest, length - space))
                leave(space - rest * size, (first + full, 1))
                rank, n, full = rank + rest, 0, full + 1
            leave(space, (first + full, count - full))
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int | None = END, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id_col, piece (from 0), start, length, ids_crc32, sequence_id, offset, with_ids also ids.

    A null text is an empty one, so a document always has the end token. Documents of more tokens than length are cut.
    Repeated rows are packed each; rows without an id too. Other columns are ignored; an empty table gives no rows."""
    spark = docs.sparkSession
    own = written(pieces(docs, tokenizer, length, end, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in own.groupBy("length").count().collect()}  # at most `length` rows
    planned = spark.createDataFrame(plan(counts, length), "p_length long, first long, past long, sequence long, each long, at long")
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    own = own.withColumn("bucket", F.pmod(F.xxhash64(id_col, "piece", "ids_crc32"), F.lit(buckets)))
    before = own.groupBy("length", "bucket").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(id_col, "piece", "ids_crc32"))
    ranked = own.withColumn("within", within).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    number = F.col("rank") - F.col("first")
    slots = ranked.join(F.broadcast(planned), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past")))  # the plan has at most length squared rows, whatever the input
    return slots.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"), (F.col("at") + F.col("length") * F.pmod(number, F.col("each"))).alias("offset"), *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of the sequences of pack(with_ids=True); a sequence is of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
