"""Exact top-k BM25 search over sharded inverted indexes with block-max WAND dynamic pruning.

Each shard's index is a row of a written table: sorted 64-bit term hashes and postings (document, term frequency) per
term. Document frequencies, number and mean length of documents are counted over all shards, so scores are global and
the shards' best merge exactly.

A query is the set of distinct words of its text. Queries are a table of term hashes and weights, which is dealt to the
shards like the shards' own rows and streams past them. Shards are searched in rounds, each GROWTH times as many as all
before: a round starts from the score that a query's k-th best document had so far, its floor. In a shard, terms' bounds
sort a query's terms; those whose bounds together stay below the floor admit no document. A shard that all terms
together can't lift to the floor isn't read. Only documents that the other terms and the block bounds of the rest lift to the floor are looked
up in the rest's postings; blocks below it are not touched there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stallkeeper.llm.common import join_groups, small_batches, written
from stallkeeper.llm.decontam import words_of

K1, B = 1.2, 0.75
SHARD_DOCS = 16_384
SHARD_BYTES = 40 << 20
BLOCK = 6  # bits: documents of a block
GROWTH = 3
LOOKUPS = 1500  # postings that are found by bisection rather than by reading the lists
SLACK = 1e-6  # of scores, so that equal ones are never pruned
INDEX = "shard int, docs array<long>, lengths array<int>, terms array<long>, frequencies array<int>, postings array<int>, counts array<int>"
PARTS = ["docs", "lengths", "terms", "frequencies", "postings", "counts"]


def term_hashes(text: str | bytes | None) -> np.ndarray:
    found = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard of a partition's documents. Each text is counted at once, so no more than its different words are kept."""
    ids: list[int] = []
    lengths: list[int] = []
    words: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    for batch in batches:
        ids += batch.column(0).to_pylist()
        for text in batch.column(1).cast(pa.binary()):
            found = term_hashes(text.as_py())
            own, n = np.unique(found, return_counts=True)
            lengths.append(len(found))
            words.append(own)
            counts.append(n.astype(np.int32))
    if not ids:
        return
    postings = np.repeat(np.arange(len(ids), dtype=np.int32), [len(w) for w in words])
    every = np.concatenate(words)
    words.clear()
    order = np.argsort(every, kind="stable")  # a term's documents stay in their order
    every, postings = every[order], postings[order]
    times = np.concatenate(counts)[order]
    counts.clear()
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.empty(0, np.int64)
    frequencies = np.diff(np.append(starts, len(every)))
    row = [(np.array(ids), pa.int64()), (np.array(lengths), pa.int32()), (every[starts], pa.int64()), (frequencies, pa.int32()), (postings, pa.int32()), (times, pa.int32())]
    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, k)) for v, k in row]
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *lists], ["shard", *PARTS])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A written table with a row per shard of about shard_docs documents or shard_bytes of text.

    All rows with an id are indexed; null texts are documents without words; rows that repeat an id are documents each.
    Rows are dealt out one by one, so hot sources and long texts spread. Other columns are ignored."""
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    shards = max(1, -(-n // shard_docs), -(-(size or 0) // shard_bytes))
    return written(rows.repartition(shards).mapInArrow(_build, INDEX), "index")


class Shard:
    def __init__(self, row: dict[str, np.ndarray], mean: float):
        self.docs, self.terms, self.postings = row["docs"], row["terms"], row["postings"].astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(row["frequencies"], dtype=np.int64)])
        tf = row["counts"].astype(np.float64)
        norm = K1 * (1 - B + B * row["lengths"] / mean) if mean else np.full(len(self.docs), K1)
        self.impact = tf * (K1 + 1) / (tf + norm[self.postings])
        self.best = np.maximum.reduceat(self.impact, self.starts[:-1]) if len(self.terms) else np.empty(0)
        # block bounds of the terms that many blocks have; a rarer one's own bound holds for all blocks
        self.blocks = (len(self.docs) - 1 >> BLOCK) + 1
        often = np.flatnonzero(row["frequencies"] >= self.blocks)
        self.row = np.full(len(self.terms), -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.bounds = np.zeros((len(often), self.blocks), np.float32)
        for j, t in enumerate(often):
            a, b = self.starts[t], self.starts[t + 1]
            block = self.postings[a:b] >> BLOCK
            first = np.flatnonzero(np.diff(block, prepend=-1))
            self.bounds[j, block[first]] = np.nextafter(np.maximum.reduceat(self.impact[a:b], first).astype(np.float32), np.float32(np.inf))

    def _scores(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of all documents, by the lists of terms."""
        spans = [slice(a, b) for a, b in zip(self.starts[terms], self.starts[terms + 1], strict=True)]
        if not spans:
            return np.zeros(len(self.docs))
        values = np.concatenate([self.impact[s] for s in spans])
        values *= np.repeat(weights, self.starts[terms + 1] - self.starts[terms])
        return np.bincount(np.concatenate([self.postings[s] for s in spans]), values, len(self.docs))

    def _lookup(self, live: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of the documents live, by bisection in the lists of terms."""
        out = np.zeros(len(live))
        for t, w in zip(terms, weights, strict=True):
            a, b = self.starts[t], self.starts[t + 1]
            own = self.postings[a:b]
            at = np.minimum(np.searchsorted(own, live), len(own) - 1)
            out += np.where(own[at] == live, w * self.impact[a + at], 0)
        return out

    def _ceilings(self, terms: np.ndarray, weights: np.ndarray, tops: np.ndarray) -> np.ndarray:
        """What terms can add to a document, at most, of each block."""
        row = self.row[terms]
        return weights[row >= 0] @ self.bounds[row[row >= 0]] + tops[row < 0].sum()

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best k, given k found elsewhere with scores of floor or more, and their scores."""
        none = np.empty(0, np.int64), np.empty(0)
        if not len(self.terms):
            return none
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        at, w = at[known], weights[known]
        tops = w * self.best[at]
        order = np.argsort(-tops)
        at, w, tops = at[order], w[order], tops[order]
        rest = np.concatenate([np.cumsum(tops[::-1])[::-1], [0.0]])  # what terms from here on can add
        if rest[0] < floor - SLACK or not len(at):
            return none
        done = int(np.searchsorted(-rest, -(floor - SLACK), "right")) if floor > 0 else len(at)  # from here on they admit no document
        done = min(done, len(at))
        got = self._scores(at[:done], w[:done])
        step = max(8, done // 4)
        while True:
            if len(got) >= k:
                floor = max(floor, float(np.partition(got, -k)[-k]))  # parts of scores are lower bounds
            bound = got if done == len(at) else got + np.repeat(self._ceilings(at[done:], w[done:], tops[done:]), 1 << BLOCK)[: len(got)]
            live = np.flatnonzero((got > 0) & (bound >= floor - SLACK))
            if len(live) * (len(at) - done) <= LOOKUPS:
                return live, got[live] + self._lookup(live, at[done:], w[done:])
            got += self._scores(at[done : done + step], w[done : done + step])
            done, step = min(done + step, len(at)), step * 2


def _query_terms(queries: DataFrame) -> DataFrame:
    """query and term, of the distinct words of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(term_hashes(x)) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.empty(0, np.int64), *found]))], ["query", "term"])

    return small_batches(queries).mapInArrow(run, "query long, term long")


def _weighted(index: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """query, terms and weights (arrays in the same order) of the words that any document has."""
    asked = written(_query_terms(queries).distinct(), "asked")
    wanted = asked.groupBy("term").agg(F.count("*").alias("n"))
    seen = index.select(F.inline(F.arrays_zip("terms", "frequencies"))).groupBy(F.col("terms").alias("term")).agg(F.sum("frequencies").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = written(wanted.join(seen, "term").select("term", "n", idf.alias("weight")), "frequencies")
    rows = join_groups(asked, known, ["term"], how="inner")
    own = rows.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("t"))  # a text's words
    return own.select("query", F.col("t.term").alias("q_terms"), F.col("t.weight").alias("q_weights"))


def _searched(index: DataFrame, queries: DataFrame, first: int, past: int, mean: float, k: int) -> DataFrame:
    """The best k documents of each of shards first to past, less those below the queries' floors."""
    shards = index.where((F.col("shard") >= first) & (F.col("shard") < past)).select("shard", *PARTS, F.lit(None).cast("long").alias("query"), *(F.lit(None).cast(t).alias(c) for c, t in (("q_terms", "array<bigint>"), ("q_weights", "array<double>"), ("floor", "double"))))
    asked = queries.select(F.explode(F.sequence(F.lit(first), F.lit(past - 1))).alias("shard"), *(F.lit(None).cast(index.schema[c].dataType).alias(c) for c in PARTS), "query", "q_terms", "q_weights", "floor")
    rows = shards.unionByName(asked).repartitionById(past - first, F.col("shard") - first).sortWithinPartitions("shard", F.col("query").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            found = []
            query, floors = batch.column("query"), batch.column("floor").to_pylist()
            for j in range(batch.num_rows):
                if not query[j].is_valid:
                    shard = Shard({c: batch.column(c)[j].values.to_numpy() for c in PARTS}, mean)
                elif shard is not None:
                    live, got = shard.search(*(batch.column(c)[j].values.to_numpy() for c in ("q_terms", "q_weights")), k, floors[j] or 0.0)
                    ids, got = shard.docs[live], np.round(got, 6)
                    best = np.lexsort((ids, -got))[:k]
                    found.append((np.full(len(best), query[j].as_py()), ids[best], got[best]))
            columns = [np.concatenate([[], *x]) for x in zip(*found, strict=True)] if found else [np.empty(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.float64), strict=True)], ["query", "doc", "score"])

    return rows.mapInArrow(run, "query long, doc long, score double")


def search(index: DataFrame, queries: DataFrame, k: int = 10, query_col: str = "doc_id", text_col: str = "text", growth: int = GROWTH) -> DataFrame:
    """query_id, rank (from 1), doc_id, score of the k best documents of each query by BM25 over its distinct words; equal
    scores (to 6 places) go by doc_id.

    Documents without any of its words aren't found, so null texts and queries without words find nothing. Rows that
    repeat a query's id count as one query with the words of all; rows without an id are left out. Documents that repeat a
    text or an id are hits each. Other columns are ignored; an empty index or query table gives no rows."""
    n, words, shards = index.select(F.size("docs").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("words"), "shard").agg(F.sum("n"), F.sum("words"), F.max("shard")).first()
    if not n:
        return index.sparkSession.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    rows = queries.where(F.col(query_col).isNotNull()).select(F.col(query_col).cast("long").alias("query"), F.col(text_col).alias("text"))
    asked = written(_weighted(index, rows, n), "queries")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    best, first, past = None, 0, 1
    while first <= shards:
        floors = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor")) if best is not None else None
        ready = asked.join(floors, "query", "left") if best is not None else asked.withColumn("floor", F.lit(None).cast("double"))
        found = _searched(index, ready, first, min(past, shards + 1), words / n, k)
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = written(found.withColumn("rank", rank).where(F.col("rank") <= k), "best")  # k rows a query and shard are ranked
        first, past = past, past * (growth + 1)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("doc_id"), "score")
