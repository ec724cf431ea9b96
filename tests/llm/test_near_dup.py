import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import near_dup
from stallkeeper.llm.near_dup import drop_near_duplicates, near_duplicates

SCHEMA = "doc_id long, text string"


def brute(rows, words, percent=80):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = sorted((find(a), find(b)))
            comp[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def variants(seed, groups=12, alone=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(groups):
        base = r.choices(vocabulary, k=r.choice([3, 20, 90, 250]))
        for _ in range(r.choice([2, 5, 40])):
            own = list(base)
            for _ in range(r.randrange(0, max(1, len(own) // 12) + 1)):
                own[r.randrange(len(own))] = r.choice(vocabulary)
            if r.random() < 0.3:
                own = own[: -max(1, len(own) // r.choice([5, 9, 20]))]
            rows.append(" ".join(own))
    rows += [" ".join(r.choices(vocabulary, k=r.randrange(0, 120))) for _ in range(alone)]
    shared = " ".join(r.choices(vocabulary, k=60))  # a passage of which short texts mostly consist
    rows += [shared + " " + " ".join(r.choices(vocabulary, k=25)) for _ in range(40)]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "words"), [(1, 2), (2, 5)])
def test_components_are_those_of_brute_force(spark, seed, words):
    rows = variants(seed)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), words).collect()}
    assert found == brute(rows, words)


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(100_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (None, "a b c"), (7, long), (8, long + " end"), (9, "a b c")]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), 2).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 99_999]
    assert [by[k].component_id for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [1, 2, 3, 4, 4, 6, 7, 7, 6]
    assert by[None].component_id is None and by[None].kept


def test_empty_table_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 5, 7, "x"), (2, "a b c d e f", 6, 8, "y")], "doc_id long, text string, id int, comp int, n string")
    assert [tuple(r) for r in drop_near_duplicates(docs).collect()] == [(1, "a b c d e f", 5, 7, "x")]


@pytest.mark.parametrize("seed", [76598])
def test_links_of_unlucky_sketches_are_kept(spark, seed):
    """Of the pair's 64 union values 38 or fewer are in common, though 560 of its 700 shingles are."""
    w = [f"w{k}" for k in np.random.default_rng(seed).integers(0, 100_000, 700)]
    rows = [(1, " ".join(w[:630])), (2, " ".join(w[:560] + w[630:]))]
    assert [near_dup.similar(*(near_dup.shingle_hashes(t.encode(), 1) for _, t in rows), 80)] == [True]
    assert {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 1).collect()} == {1: 1, 2: 1}


@pytest.mark.parametrize(("pairs", "union"), [(500, 100), (500, 220), (60, 3000)])
def test_isolated_pairs_just_over_the_bound_are_linked(spark, pairs, union):
    """Words of pairs differ from all others, so nothing else joins them; similarity 0.80 to 0.82."""
    rows = []
    for k in range(pairs):
        both = -(-union * (80 + k % 3) // 100)
        w = [f"p{k}w{j}" for j in range(union)]
        half = (union - both) // 2
        rows += [(2 * k, " ".join(w[: both + half])), (2 * k + 1, " ".join(w[:both] + w[both + half :]))]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), 1).where("component_id = doc_id").count()
    assert out == pairs


def test_a_hot_pivot_is_verified_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS", 7)
    rows = [(k, " ".join([*(f"w{j}" for j in range(60)), f"own{k}"])) for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("__gone", F.lit(1)).withColumn("n", F.lit(2))
    assert [r.doc_id for r in drop_near_duplicates(docs, 1).collect()] == [0]


def test_percent_below_the_sketches_reach_is_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], SCHEMA), percent=50)
