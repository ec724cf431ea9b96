"""A toxicity classifier that neutral mentions of groups don't sway.

Logistic regression on the presence of words. For each labelled text that has identity terms, swapped copies (each term
replaced by others of its group) are made, and squared differences of their scores from the text's are penalised, so
identity terms can't carry weight. Words are chosen by how far their share of toxic texts stands from the overall one.

The fit uses about TRAIN_DOCS labelled texts, chosen by hash of their id among the labels, before any text is read; the
chosen rows are written once. Words' counts are aggregated in Spark. What comes to the driver is bounded by that sample
and by FEATURES: per text the numbers of its chosen words, and a pair of numbers for each swap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm.common import small_batches, written

TRAIN_DOCS = 20_000
FEATURES = 2000
MIN_DF = 3
MIN_Z = 4.0
PENALTY = 10.0  # of squared score differences between a text and its swapped copies
RIDGE = 1e-3
THRESHOLD = 0.3
#: Neutral names of groups; each is swapped for the others of its row.
GROUPS = (
    ("women", "men", "girls", "boys", "transgender"),
    ("woman", "man", "girl", "boy"),
    ("gay", "lesbian", "straight", "bisexual", "homosexual", "heterosexual", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("muslime", "christen", "juden"), ("musulmans", "chrétiens", "juifs"), ("musulmanes", "cristianos", "judíos"),
)
SWAPS = {t.encode(): [o.encode() for o in row if o != t] for row in GROUPS for t in row}
#: Bytes of UTF-8 to words: A-Z to a-z; letters and 0x80 up stay; the rest separates.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[a-z\x80-\xff]+")


def words_of(text: bytes | None) -> set[bytes]:
    return set((text or b"").translate(NORMAL).split())


@dataclass
class ToxicityModel:
    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes | None) -> float:
        found = words_of(text)
        z = self.bias + sum(sorted(self.weights[w] for w in found & self.weights.keys()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _fit(at: np.ndarray, of: np.ndarray, y: np.ndarray, swaps: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, penalty: float, ridge: float, steps: int = 400) -> np.ndarray:
    """Weights and, at n, the bias, by Nesterov's accelerated gradient on log loss + penalty * mean squared difference of
    the swapped copies' scores + ridge. Text at[i] has feature of[i]; a copy is (text, feature that goes, feature that
    comes, or n + 1 if the text has that already)."""
    m, (text, goes, comes) = len(y), swaps
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    rows, cols = np.concatenate([at, np.arange(m)]), np.concatenate([of, np.full(m, n)])
    w = np.zeros(n + 2)
    base = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[n] = np.log(base / (1 - base))
    # coordinates differ much in how often they occur: scale each by its frequency
    often = np.bincount(cols, minlength=n + 2) / m
    width = int(np.bincount(rows).max())
    scale = 1 / (often * min(width, 30) * 0.25 + ridge + 1e-3)
    if len(text):
        copies = np.bincount(text, minlength=m)
        both = 2 * np.bincount(cols, copies[rows], n + 2) - np.bincount(goes, minlength=n + 2) + np.bincount(comes, minlength=n + 2)
        scale = 1 / (1 / scale + penalty * both / len(text) * 0.5)
    scale[n + 1] = 0  # what a text has already adds nothing
    before = w.copy()
    for k in range(steps):
        v = w + (k / (k + 3)) * (w - before)
        z = np.bincount(rows, v[cols], m)
        pull = (sigmoid(z) - y) / m
        grad = np.zeros(n + 2)
        if len(text):
            p, q = sigmoid(z[text]), sigmoid(z[text] - v[goes] + v[comes])
            d = 2 * penalty * (p - q) / len(text)
            pull += np.bincount(text, d * (p * (1 - p) - q * (1 - q)), m)
            grad += np.bincount(goes, d * q * (1 - q), n + 2) - np.bincount(comes, d * q * (1 - q), n + 2)
        grad += np.bincount(cols, pull[rows], n + 2)
        grad[:n] += ridge * v[:n]
        before, w = w, v - scale * grad
    return w[: n + 1]


def sampled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train_docs: int) -> DataFrame:
    """text and y of about train_docs labelled rows of docs. The ids are chosen from the labels alone, then broadcast:
    some train_docs numbers, so texts aren't shuffled. Where ids repeat, rows are thinned to train_docs once more."""
    own = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    total = own.count()
    if total > train_docs:
        own = own.where(F.pmod(F.xxhash64(F.lit("train"), "__id"), F.lit(1_000_000)) < int(1_000_000 * train_docs / total) + 1)
    own = written(own, "train-ids")
    rows = small_batches(docs).select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(own), "__id").select("text", "y")
    rows = written(rows, "train")
    found = rows.count()
    return written(rows.sample(train_docs / found, seed=1), "train") if found > 1.2 * train_docs else rows


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS, features: int = FEATURES, penalty: float = PENALTY, ridge: float = RIDGE) -> ToxicityModel:
    """Fits a model on about train_docs rows of docs that labels (id_col, label_col of 0 or 1) have.

    Null texts are empty ones; null labels are left out, and of several labels of an id the largest counts. Without any
    labelled row nothing is toxic. Other columns of either table are ignored."""
    rows = sampled(docs, labels, id_col, text_col, label_col, train_docs)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(words_of(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.binary()))], ["y", "words"])

    docs_n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not docs_n:
        return ToxicityModel({}, -30.0)
    found = rows.select("text", "y").mapInArrow(words, "y int, words array<binary>").select("y", F.explode_outer("words").alias("word"))
    stats = found.groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("t"))
    base = toxic / docs_n
    z = F.abs(F.col("t") - F.col("n") * base) / F.sqrt(F.col("n") * max(base * (1 - base), 1e-9))
    chosen = stats.where((F.col("n") >= MIN_DF) & F.col("word").isNotNull()).withColumn("z", z).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(features).collect()
    vocabulary = sorted({bytes(r["word"]) for r in chosen} | set(SWAPS))
    number = {w: k for k, w in enumerate(vocabulary)}

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, goes, comes = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                have = words_of(text)
                own.append(sorted(number[w] for w in have & number.keys()))
                swaps = sorted((number[w], number[o] if o not in have else len(number) + 1) for w in have & SWAPS.keys() for o in SWAPS[w])
                goes.append([a for a, _ in swaps])
                comes.append([b for _, b in swaps])
            yield pa.RecordBatch.from_arrays([batch.column("y"), *(pa.array(x, pa.list_(pa.int32())) for x in (own, goes, comes))], ["y", "own", "goes", "comes"])

    kept = rows.select("text", "y").mapInArrow(lists, "y int, own array<int>, goes array<int>, comes array<int>").orderBy("y", "own").toArrow()  # of the sample
    flat = lambda c: np.concatenate([[], *(x.flatten().to_numpy() for x in kept.column(c).chunks)]).astype(np.int64)
    owner = lambda c: np.repeat(np.arange(len(kept)), kept.column(c).combine_chunks().value_lengths().to_numpy())
    w = _fit(owner("own"), flat("own"), kept.column("y").to_numpy().astype(float), (owner("goes"), flat("goes"), flat("comes")), len(vocabulary), penalty, ridge)
    return ToxicityModel({v: float(x) for v, x in zip(vocabulary, w, strict=False) if x}, float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: id_col, score (0 to 1), predicted (1 if score >= threshold, else 0).

    Whole texts are scored; null and empty ones get the score of a text without known words. Repeated rows get the same
    score. Other columns are ignored. A model fitted on no labels gives scores near 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).cast(pa.binary()).to_pylist()], pa.float64())], ["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = small_batches(docs).select(id_col, text_col).mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose text scores below threshold."""
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: model.score(None if t is None else t.encode()))

    return small_batches(docs).where(scored(F.col(text_col)) < threshold)
