"""Queries against their SQL on the smallest tables, and the pipeline's stages against brute force."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stallkeeper.llm import decontam, queries
from tests.llm.test_near_dup import brute

DIR = "/root/testdata/sf0.001"


def table(name):
    return pd.read_parquet(f"{DIR}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    found, expected = queries.queries()[name](spark, DIR).toPandas(), c.execute(queries.oracle_sql()[name]).fetchdf()
    columns = sorted(expected.columns)
    assert sorted(found.columns) == columns
    plain = lambda df: sorted(tuple(None if pd.isna(v) else round(float(v), 6) if isinstance(v, (int, float, np.number)) else str(v) for v in row) for row in df[columns].astype(object).itertuples(index=False))
    assert list(map(str, plain(found))) == list(map(str, plain(expected)))


def test_classifiers_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = pd.read_parquet(f"{d}/documents.parquet"), pd.read_parquet(f"{d}/labels.parquet")
    lang = queries.op5_language_id(spark, d).toPandas().merge(docs, on="doc_id")
    lang = lang[lang.held_out & lang.text.str.len().gt(0)]
    assert (lang.lang == lang.lang_pred).mean() > 0.97
    toxic = queries.op6_toxicity(spark, d).toPandas().merge(labels, on="doc_id")
    toxic = toxic[toxic.held_out]
    assert (toxic.toxic == toxic.predicted).mean() > 0.9


def test_stages(spark):
    columns = set(table("documents").columns)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("extra", F.lit("x"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        seen[name] = (docs.toPandas(), out.toPandas())
        docs = spark.createDataFrame(out.collect(), out.schema)
    for name, (before, after) in list(seen.items())[:-1]:
        assert set(after.columns) == columns | {"extra"}, name
        assert set(after.doc_id) <= set(before.doc_id)
    before, after = seen["near-dedup"]
    assert set(after.doc_id) == {i for i, (_, _, kept) in brute(list(zip(before.doc_id, before.text, strict=True)), 5).items() if kept}
    before, after = seen["decontamination"]
    patterns = {w for t in table("benchmark").text for w in decontam.windows(t, 10)}
    assert set(after.doc_id) == {i for i, t in zip(before.doc_id, before.text, strict=True) if not any(p in b" " + b" ".join(decontam.words_of(t)) + b" " for p in patterns)}
    before, after = seen["line dedup"]
    assert len(before) == len(after) and (after.n_chars == after.text.str.len()).all()
    before, after = seen["packing"]
    assert set(after.doc_id) == set(before.doc_id) and after.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


def test_stages_on_nulls_repeats_long_texts_and_nothing(spark, tmp_path):
    """Rows that no stage may fail on or lose: null ids and texts, repeated rows, long runs, an extra column."""
    own = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("label", F.lit(1)).withColumn("kept", F.lit(True))
    odd = [(None, None), (None, ""), (9001, None), (9001, None), (9002, " " * 1_100_000), (9003, "lone"), (9004, "1" * 300_000)]
    rows = own.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True).unionByName(own.limit(5))
    for docs in (rows, rows.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DIR)
            out.write.parquet(path := str(tmp_path / f"{name}-{docs.count()}"))
            before, after = docs, spark.read.parquet(path)
            if name == "packing":
                assert after.select("doc_id").distinct().count() == before.select("doc_id").distinct().count()
                continue
            assert after.columns == before.columns, name
            known = {(r.doc_id, len(r.text or "")) for r in after.collect()}
            if before.count():
                kept = {(9003, 4)} | ({(9001, 0), (None, 0)} if name != "near-dedup" else {(9001, 0)})
                assert kept <= known, name
            docs = after
