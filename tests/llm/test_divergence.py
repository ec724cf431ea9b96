import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"


def brute(rows, top=200):
    groups, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= 3), key=str.encode)
        own = {s: {t: c[t] for t in kept} for (x, s), c in groups.items() if x == lang}
        p = lambda counts: {t: 1 + 10**9 * (n + 1) // (sum(counts.values()) + len(kept)) for t, n in counts.items()}
        shares, whole = {s: p(c) for s, c in own.items()}, p({t: sum(c[t] for c in own.values()) for t in kept})
        for s, mine in shares.items():
            pairs = [(-sum((mine[t] - q) ** 2 // q for t, q in other.items()), o.encode(), o) for o, other in shares.items() if o != s]
            terms = [(-((mine[t] - whole[t]) ** 2 // whole[t]), t.encode(), t) for t in kept if own[s][t] and mine[t] > whole[t]]
            out |= {(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(sorted(pairs))} | {(lang, s, "term", t, -v, k + 1) for k, (v, _, t) in enumerate(sorted(terms)[:top])}
    return out


@pytest.mark.parametrize("cells", [1, 1 << 17])
def test_audit_is_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(divergence, "CELLS", cells)  # 1: many blocks
    monkeypatch.setattr(divergence, "PER_PAIR", 1)
    monkeypatch.setattr(divergence, "CHUNK", 16)
    monkeypatch.setattr(divergence, "HELD", 50)
    r = random.Random(7)
    words = [f"{'abcñé'[k % 5]}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)] + ["\U0001f600", "￿", "É", "Straße"]
    rows = [(k, " ".join(r.choice(["", "-", "7", "X"]) + r.choice(words[: 20 + 40 * (k % 10)]) for _ in range(r.randrange(60))), r.choice(["en", "de", None]), f"s{k % 7}") for k in range(150)]
    rows += [(1, rows[1][1], rows[1][2], rows[1][3])] * 4 + [(None, "a" * 300_000 + " b", "en", None), (901, None, "en", "none"), (902, "", "xx", "one"), (903, "1 2", "xx", "two"), (904, "y", "zz", "alone")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("x")).withColumn("occurrences", F.lit(1)).repartition(5)
    found = divergence.audit(docs).collect()
    assert len(found) == len(set(found)) and {tuple(x) for x in found} == brute(rows)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_by_long_division_are_exact():
    counts = np.array([0, 1, 10**12, 7 * 10**14], np.int64)
    total, terms = int(counts.sum()), 4
    assert divergence.share(counts, total, terms).tolist() == [1 + 10**9 * (int(c) + 1) // (total + terms) for c in counts]
