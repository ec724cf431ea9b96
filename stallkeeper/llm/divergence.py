"""Source divergence audit: how far each source's words are from those of the other sources of its language.

Tasks count terms per (language, source) and hand on one row per term they met, so texts and hot sources never meet in
one task. A language's kept terms are dealt to blocks by hash. A block is a dense matrix of whole numbers, groups by
terms; one broadcast per group compares it with all other groups over the block's terms. Pairs' partial sums are added
over blocks, and each block's best terms of a group, taken from a heap, are merged to the group's best.

All arithmetic is exact: shares are whole numbers of SCALE, by long division where a product would not fit 64 bits.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.common import small_batches, written

SCALE = 1_000_000_000
SMOOTHING = 1
MIN_DOCS = 3
TOP = 200
CELLS = 1 << 17  # a block's groups times terms, or PER_PAIR for each pair of groups if that is more
PER_PAIR = 4
CHUNK = 1 << 20  # bytes of a text that are split at once
HELD = 200_000  # counted terms that a task holds before it hands them on
#: Bytes of terms: ASCII letters, lower-cased, and all bytes of characters beyond ASCII. Others become blanks.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            end = cut + 1 if cut >= 0 else (text.find(b" ", end) + 1 or len(text))
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, groups: tuple[str, str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """lang, source, term, occurrences, docs (rows of docs with the term); a row with a null term and no occurrences for
    each group, so that groups without terms are there too. Null texts, languages and sources are read as ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        found: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (times, rows) in found.items():
                terms = [*times]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array([t.decode() for t in terms], pa.string()), pa.array([times[t] for t in terms], pa.int64()), pa.array([rows[t] for t in terms], pa.int64())], NAMES)
            found.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group = (lang, source)
                if group not in seen:
                    seen.add(group)
                    yield pa.RecordBatch.from_arrays([pa.array([lang], pa.string()), pa.array([source], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], NAMES)
                times, rows = found[group]
                own: set[bytes] = set()
                for part in _parts(text.translate(TERM_BYTES)):
                    times.update(part)
                    own.update(part)
                rows.update(own)
            if sum(len(times) for times, _ in found.values()) > HELD:
                yield from out()
        yield from out()

    lang, source, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*groups, text_col))
    texts = docs.select(lang, source, text.cast("binary"))
    counted = small_batches(texts).mapInArrow(run, "lang string, source string, term string, occurrences long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("docs").alias("docs"))


NAMES = ["lang", "source", "term", "occurrences", "docs"]


def share(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms))."""
    of = total + SMOOTHING * terms
    left = counts + SMOOTHING
    if int(left.max(initial=0)) < 2**63 // SCALE:
        return 1 + SCALE * left // of
    out, step = np.zeros_like(left), 1000
    for k in range(4):  # long division: the whole part, then three times three digits
        if k:
            left = left * step  # what is left is less than `of`, which is less than 2 ** 53
        out, left = out * step + left // of, left % of
    return 1 + out


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q) ** 2 / q). Shares are 1 + SCALE at most, so squares fit 64 bits."""
    d = p - q
    return d * d // q


def _compare(key: tuple, cells: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """One block: partial sums of all pairs of its groups, and each group's best terms."""
    names = sources["source"].tolist()
    at = {s: i for i, s in enumerate(names)}
    kept, whole, terms = [int(v) for v in sources["kept"]], int(sources["whole"].iloc[0]), int(sources["terms"].iloc[0])
    words, columns = [], {}
    for w in cells["term"]:
        if w not in columns:
            columns[w] = len(words)
            words.append(w)
    counts = np.zeros((len(names), len(words)), np.int64)
    places = np.array([at[s] for s in cells["source"]], np.intp), np.array([columns[w] for w in cells["term"]], np.intp)
    counts[places] = cells["occurrences"].to_numpy(np.int64)  # a term is there once per group
    shares = np.stack([share(row, n, terms) for row, n in zip(counts, kept)])
    language = share(counts.sum(axis=0), whole, terms)
    order = [w.encode() for w in words]
    out: list[tuple] = []
    for i, name in enumerate(names):
        pairs = excess(shares[i], shares).sum(axis=1)  # the group's row against all rows of the block
        out += [("pair", name, names[j], int(v)) for j, v in enumerate(pairs) if j != i]
        values = excess(shares[i], language)
        own = np.flatnonzero((counts[i] > 0) & (shares[i] > language))
        if len(own) > TOP:
            own = own[values[own] >= np.partition(values[own], len(own) - TOP)[len(own) - TOP]]
        out += [("term", name, words[j], int(values[j])) for j in heapq.nsmallest(TOP, own, key=lambda j: (-values[j], order[j]))]
    return pd.DataFrame([(key[0], s, part, item, v) for part, s, item, v in out], columns=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, groups: tuple[str, str] = ("lang", "source"), text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part 'pair' has the distance of each source from each other source of its
    language, part 'term' the TOP terms that it has more of than its language as a whole.

    Null texts, languages and sources are empty strings; groups without terms have pairs too (of value 0 if their language
    keeps no term). Equal values are ranked by item, in the order of UTF-8. Repeated rows count each; other columns are
    ignored; an empty table gives no rows. A language's sources are compared with each other, which is what is asked, so
    work grows with their square: sources are meant to be few beside documents (a task holds their shares of a block)."""
    counted = written(term_counts(docs, groups, text_col), "terms")
    term = Window.partitionBy("lang", "term")  # a row per source
    in_docs, first = F.sum("docs").over(term), F.row_number().over(term.orderBy("source")) == 1
    cells = counted.where("term is not null").select("*", in_docs.alias("in_docs"), first.cast("long").alias("first")).where(F.col("in_docs") >= MIN_DOCS)
    cells = written(cells.select("lang", "source", "term", "occurrences", "first"), "cells")
    per_group = cells.groupBy("lang", "source").agg(F.sum("occurrences").alias("kept"), F.sum("first").alias("first"))
    known = counted.where("term is null").select("lang", "source").join(per_group, ["lang", "source"], "left").na.fill(0, ["kept", "first"])
    per_lang = known.groupBy("lang").agg(F.sum("kept").alias("whole"), F.count(F.lit(1)).alias("sources"), F.sum("first").alias("terms"))
    size = F.greatest(F.lit(CELLS), PER_PAIR * F.col("sources") * F.col("sources"))
    per_lang = written(per_lang.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") * F.col("sources") / size)).cast("int")), "languages")
    dealt = cells.join(per_lang.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "occurrences")
    copies = known.select("lang", "source", "kept").join(per_lang, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "kept", "whole", "terms")
    parts = dealt.groupBy("lang", "block").cogroup(copies.groupBy("lang", "block")).applyInPandas(_compare, "lang string, source string, part string, item string, value long")
    parts = written(parts, "divergence")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
