import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import queries, whitening

VECTORS = "vec_id long, embedding array<float>"


def brute(rows):
    """(n, x, V by exact integers, rows kept) of the vectors of plain Python."""
    kept = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - s for a, s in zip(r, sums)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in d) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    return n, d, cov, kept


@pytest.mark.parametrize(("size", "seed"), [(5, 1), (40, 2)])
def test_whitening_is_brute_force(spark, tmp_path, size, seed):
    r = np.random.default_rng(seed)
    mix = r.normal(size=(size, size))
    rows = [(k, [float(c) for c in np.float32(r.normal(size=size) @ mix + 3)]) for k in range(120)]
    rows += [(0, rows[0][1]), (None, rows[1][1]), (900, None), (901, [None] * size), (902, [float("nan")] * size), (903, [float("inf")] * size), (904, [1.0])]
    table = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit("x")).withColumn("id", F.lit(1)).withColumn("deviation", F.lit(2))
    table.repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = queries.op11_embedding_whitening(spark, str(tmp_path)).collect()
    n, d, cov, kept = brute(rows[:-1])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    assert len(out) == n * len(values) and {r.n for r in out} == {n}
    assert {(r.vec_id, r.deviation) for r in out} == {(k, sum(c * c for c in x)) for (k, _), x in zip(kept, d)}
    for i, e in enumerate(values):
        assert {round(r.explained / (e / np.trace(cov)), 6) for r in out if r.component == i + 1} == {1.0}
        mine = {r.vec_id: r.whitened for r in out if r.component == i + 1}
        theirs = {k: float(np.array(x) / n @ vectors[:, i] / math.sqrt(e)) for (k, _), x in zip(kept, d)}
        sign = 1 if mine[5] * theirs[5] > 0 else -1
        assert max(abs(mine[k] - sign * theirs[k]) for k in theirs) < 1e-6
    assert len({r.identity_error for r in out}) == 1 and out[0].identity_error < 1e-8


def test_degenerate_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.fit(empty) is None and whitening.identity_error(empty, None) is None and whitening.whiten(empty, None).count() == 0
    for rows in ([(1, None)], [(1, [])], [(1, [float("nan")])]):
        assert whitening.fit(spark.createDataFrame(rows, VECTORS)) is None
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], VECTORS)
    model = whitening.fit(same)
    assert (model.n, model.total, len(model.variances)) == (4, 0.0, 0) and [r.whitened for r in whitening.whiten(same, model).collect()] == [[]] * 4
    flat = spark.createDataFrame([(k, [1.0, float(k), 2.0 * k]) for k in range(9)], VECTORS)  # one direction alone
    model = whitening.fit(flat)
    assert len(model.variances) == 1 and abs(model.variances[0] / model.total - 1) < 1e-12 and whitening.identity_error(flat, model) < 1e-9


def test_deviations_beyond_64_bits_are_exact():
    d = np.array([[2**40, -(2**41)], [3, 4]])
    assert [int(v) for v in whitening._deviations(d).to_pylist()] == [2**80 + 2**82, 25]
