"""Language identification of mixed text.

Letters' trigrams (with word ends) give each word a log-probability per language; the word's script leaves only
languages that were seen in that script; Viterbi over the words, with a penalty for each switch, labels spans. All
steps run over arrays of a batch's characters; Viterbi advances all of its texts together, one word at a time.

The model is fitted on about TRAIN_DOCS labelled texts (the bound is on texts, chosen by hash of their id); its size is
bounded by languages times 2 ** BITS numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_DOCS = 8000
BITS = 16
SWITCH = 8.0  # nats
SMOOTH = 0.5
CHUNK = 1 << 21  # characters that are worked on together; one longer text is a chunk of its own
#: First code points of script ranges.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "other"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"), (0x30000, "other"),
)
NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Words:
    """Words of a chunk: text number, first and past-last place within the chunk, letters' trigram hashes."""

    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    grams: np.ndarray  # of all letters, in order
    first: np.ndarray  # of each word in grams
    script: np.ndarray


def parse(texts: list[str]) -> tuple[Words, np.ndarray]:
    """Words of texts, and where each text starts."""
    begins = np.cumsum([0, *(len(x) + 1 for x in texts)])
    chars = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[chars]
    padded = np.zeros(len(chars) + 2, np.uint32)
    low = np.frombuffer("\0".join([*(_lower(x) for x in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    padded[1:-1] = np.where(letter, low, 0)
    edge = np.diff(np.concatenate([[0], letter.view(np.int8), [0]]))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.flatnonzero(letter)
    grams = ((padded[at] * np.uint32(2654435761)) ^ (padded[at + 1] * np.uint32(2246822519)) ^ (padded[at + 2] * np.uint32(3266489917))) >> np.uint32(32 - BITS)
    first = np.concatenate([[0], np.cumsum(stop - start)[:-1]]) if len(start) else np.empty(0, np.int64)
    script = np.array([NAMES.index(n) for _, n in SCRIPTS])[np.searchsorted([c for c, _ in SCRIPTS], chars[start], "right") - 1] if len(start) else np.empty(0, np.int64)
    return Words(np.searchsorted(begins, start, "right") - 1, start, stop, grams, first.astype(np.int64), script), begins


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def chunks(texts: list[str | None]) -> Iterator[list[str]]:
    out: list[str] = []
    size = 0
    for x in texts:
        x = x or ""
        if out and size + len(x) > CHUNK:
            yield out
            out, size = [], 0
        out.append(x)
        size += len(x) + 1
    if out:
        yield out


def viterbi(scores: np.ndarray, doc: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word. Words of a doc stand together; all docs advance together, longest first."""
    if not len(doc):
        return np.empty(0, np.int8)
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    length = np.diff(np.append(begin, len(doc)))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    live = np.searchsorted(-length, -np.arange(length[0]), "left")  # texts with over t words
    best = scores[begin].copy()
    back = np.empty(scores.shape, np.int8)
    own = np.arange(scores.shape[1], dtype=np.int8)
    for t in range(1, length[0]):
        n = live[t]
        now = best[:n]
        top = now.argmax(1).astype(np.int8)
        jump = now.max(1, keepdims=True) - switch
        stay = now >= jump
        at = begin[:n] + t
        back[at] = np.where(stay, own, top[:, None])
        best[:n] = np.where(stay, now, jump) + scores[at]
    label = best.argmax(1).astype(np.int8)
    out = np.empty(len(doc), np.int8)
    for t in range(length[0] - 1, -1, -1):
        n = live[t]
        at = begin[:n] + t
        out[at] = label[:n]
        if t:
            label[:n] = back[at, label[:n]]
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    grams: np.ndarray  # 2 ** BITS x languages, log-probabilities
    scripts: np.ndarray  # scripts x languages: 0, or a large penalty

    def scores(self, words: Words) -> np.ndarray:
        out = np.add.reduceat(self.grams[words.grams], words.first, axis=0) if len(words.doc) else np.empty((0, len(self.languages)), np.float32)
        return out + self.scripts[words.script]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Fits a model on about train_docs rows of docs with a text and a language. Trigrams are counted in Spark."""
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total = rows.count()
    if total > train_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("train"), id_col), F.lit(1_000_000)) < int(1_000_000 * train_docs / total) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for chunk in chunks(texts):
                    words, _ = parse(chunk)
                    own = kept.setdefault(lang, np.zeros((1 << BITS) + len(NAMES), np.int64))
                    own[: 1 << BITS] += np.bincount(words.grams, minlength=1 << BITS)
                    own[1 << BITS :] += np.bincount(words.script, minlength=len(NAMES))
        for lang, own in kept.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "k", "n"])

    found = rows.select(text_col, lang_col).mapInArrow(count, "lang string, k int, n long").groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()  # languages x (2 ** BITS + scripts) at most
    languages = sorted(found.lang.unique())
    grid = np.zeros(((1 << BITS) + len(NAMES), len(languages)))
    grid[found.k, np.searchsorted(languages, found.lang)] = found.n
    grams, scripts = grid[: 1 << BITS], grid[1 << BITS :]
    logs = np.log(grams + SMOOTH) - np.log(grams.sum(0) + SMOOTH * (1 << BITS))
    share = scripts / np.maximum(scripts.sum(0), 1)
    known = (share >= 0.001) | ((share < 0.001).all(1, keepdims=True))  # a script that no language has says nothing
    return LanguageModel(languages, logs.astype(np.float32), np.where(known, 0, -1e4).astype(np.float32))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per row of docs: id_col, lang_pred (of most letters; the first by name of equals), score (that language's
    share of the letters), spans (array of structs start, stop, lang: runs of words of one language, in characters).

    Null texts and texts without letters are und, with score 0 and no spans; so are all if the model knows no language.
    Whole texts are labelled; repeated rows are labelled alike. Other columns are ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2 ** BITS numbers at most
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = pa.array([*m.languages, "und"], pa.string())
        for batch in batches:
            preds, scores, spans = [], [], []
            for texts in chunks(batch.column(1).to_pylist()):
                words, begins = parse(texts)
                if not m.languages:
                    words = parse([""])[0]
                label = viterbi(m.scores(words), words.doc, switch)
                n = len(m.languages)
                letters = np.bincount(words.doc * n + label, words.stop - words.start, len(texts) * n).reshape(len(texts), n) if n else np.zeros((len(texts), 1))
                whole = letters.sum(1)
                preds.append(np.where(whole > 0, letters.argmax(1), n))
                scores.append(letters.max(1) / np.maximum(whole, 1))
                change = np.flatnonzero((np.diff(words.doc, prepend=-1) != 0) | (np.diff(label, prepend=-1) != 0))
                last = np.append(change[1:], len(words.doc))[: len(change)] - 1
                of = words.doc[change]
                fields = [pa.array((words.start[change] - begins[of]).astype(np.int32)), pa.array((words.stop[last] - begins[of]).astype(np.int32)), names.take(pa.array(label[change].astype(np.int32)))]
                spans.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(texts) + 1)).astype(np.int32)), pa.StructArray.from_arrays(fields, fields=list(span))))
            if not preds:
                continue
            yield pa.RecordBatch.from_arrays([batch.column(0), names.take(pa.array(np.concatenate(preds).astype(np.int32))), pa.array(np.concatenate(scores), pa.float64()), pa.concat_arrays(spans)], ["id", "lang_pred", "score", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, lang_pred string, score double, spans array<struct<start:int,stop:int,lang:string>>").withColumnRenamed("id", id_col)
