"""Benchmark decontamination with an Aho-Corasick automaton over normalised benchmark windows.

Texts are normalised to lower-case words (A-Z only; a word is a run of 0-9, a-z and characters from U+0080) joined by
single spaces. The automaton's patterns are the items' windows of WINDOW words, or the whole item if it has fewer; each
text is scanned once per block of patterns, and hits are mapped back to word numbers and to characters of the original.
A block has at most BLOCK_BYTES of patterns (a benchmark of usual size is one block), and that is all that is sent to
the executors at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.common import small_batches

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Bytes of UTF-8 to words: A-Z to a-z; 0-9, a-z and 0x80 up stay; the rest separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

RESULT = "hits array<struct<start:int,stop:int>>, items array<{kind}>, n_words long"


def words_of(text: str | bytes | None) -> list[bytes]:
    data = text.encode() if isinstance(text, str) else text or b""
    return data.translate(NORMAL).split()


def windows(text: str | None, width: int) -> list[bytes]:
    """Distinct windows, each with a space on either side; of an item with fewer words, the whole of it."""
    found = words_of(text)
    n = min(width, len(found))
    return list({b" " + b" ".join(found[i : i + n]) + b" " for i in range(len(found) - n + 1)} if n else ())


def automaton(patterns: dict[bytes, tuple[int, list[int]]]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for pattern, (words, items) in patterns.items():
        found.add_word(pattern.decode("latin-1"), (len(pattern), words, items))
    found.make_automaton()
    return found


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[dict[bytes, tuple[int, list[int]]]]:
    """Items come to the driver one partition at a time and leave in blocks of bounded size."""
    block: dict[bytes, tuple[int, list[int]]] = {}
    size = 0
    for item, text in benchmark.toLocalIterator():
        for pattern in windows(text, width):
            if pattern not in block:
                size += len(pattern)
            block.setdefault(pattern, (pattern.count(b" ") - 1, []))[1].append(item)
        if size > block_bytes:
            yield block
            block, size = {}, 0
    yield block


def _scan(patterns: dict[bytes, tuple[int, list]], names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(patterns) if patterns else None
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            before = zip(batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True) if "hits" in names else ((None, None) for _ in texts)
            hits, items, counts = [], [], []
            for text, (old_hits, old_items) in zip(texts, before, strict=True):
                found = words_of(text)
                marked, met = np.zeros(len(found) + 1, np.int64), set(old_items or ())
                for x in old_hits or ():
                    marked[x["start"]] += 1
                    marked[x["stop"]] -= 1
                if machine and found:
                    line = b" " + b" ".join(found) + b" "
                    spaces = None
                    for end, (length, words, of) in machine.iter(line.decode("latin-1")):
                        if spaces is None:
                            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
                        start = int(np.searchsorted(spaces, end - length + 1))
                        marked[start] += 1
                        marked[start + words] -= 1
                        met.update(of)
                edges = np.diff(np.concatenate([[0], np.cumsum(marked) > 0, [0]]).astype(np.int8))
                hits.append([{"start": int(a), "stop": int(b)} for a, b in zip(np.flatnonzero(edges > 0), np.flatnonzero(edges < 0), strict=True)])
                items.append(sorted(met))
                counts.append(len(found))
            kept = [c for c in names if c not in ("hits", "items", "n_words")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(items, pa.list_(kind)), pa.array(counts, pa.int64())], [*kept, "hits", "items", "n_words"]
            )

    return run


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word numbers to characters of the original text; only texts with hits are matched again."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        out = []
        for text, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
            at = [m.span() for m in WORD.finditer(text)] if hits else []
            out.append([{"start": at[h["start"]][0], "stop": at[h["stop"] - 1][1]} for h in hits])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind), *(batch.column(c) for c in ("hits", "items", "n_words"))], ["id", "spans", "hits", "items", "n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_words, hits (word ranges that windows cover, merged; stop is exclusive), spans
    (the same in characters of the original text), items (sorted ids of items with windows that occur).

    Null and empty texts have no words and no hits. Benchmark rows without text, words or id are left out; items that
    share a window all count; items have text or whole numbers as ids. Repeated rows are judged each by itself. Other columns are ignored."""
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    benchmark = benchmark.select(F.col(item_col).cast("string" if benchmark.schema[item_col].dataType.simpleString() == "string" else "long").alias(item_col), text_col)
    item = benchmark.schema[item_col].dataType.simpleString()
    result = RESULT.format(kind=item)
    for patterns in _blocks(benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col), width, block_bytes):
        rows = rows.mapInArrow(_scan(patterns, rows.columns, pa.string() if item == "string" else pa.int64()), f"id {kind}, text string, {result}")
    return rows.mapInArrow(_spans, f"id {kind}, spans array<struct<start:int,stop:int>>, {result}").select(F.col("id").alias(id_col), "n_words", "hits", "spans", "items")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and a digest of the items instead of lists."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h["stop"] - h["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without documents in which any benchmark window occurs. Rows without an id stay
    only if their text has no hit."""
    rows = small_batches(docs)
    for patterns in _blocks(benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(item_col, text_col), width, BLOCK_BYTES):
        rows = rows.where(_clean(patterns)(F.col(text_col))) if patterns else rows
    return rows


def _clean(patterns: dict[bytes, tuple[int, list[int]]]):
    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = automaton(patterns)
        for texts in batches:
            lines = (b" ".join([b"", *words_of(x), b""]).decode("latin-1") for x in texts)
            yield pd.Series([next(machine.iter(x), None) is None for x in lines], dtype=bool)

    return clean
