"""The pipeline, stage by stage, against brute force; and the queries against their SQL."""

import pyarrow as pa
import pytest

import corpus_pipeline
from textloom.llm import near_dedup, quality, queries
from textloom.llm.packing import CAPACITY
from tests.test_catalog import compare

from .test_near_dedup import brute
from .test_packing import placed


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, sf).write.parquet(f"{tmp_path}/{i}")
        last, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.dtypes == last.dtypes
            kept.append({r.doc_id: r for r in docs.collect()})
            assert all(last.where(f"doc_id = {k}").first() == v for k, v in list(kept[-1].items())[:3])
    all_ = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    m = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    p = m.score(quality.features(pa.array([r.text for r in all_.values()])))
    assert set(kept[0]) == {k for k, x in zip(all_, p) if x >= quality.THRESHOLD}
    least: dict = {}
    for k in sorted(kept[0]):
        least.setdefault(kept[0][k].text, k)
    assert set(kept[1]) == set(least.values())
    assert set(kept[2]) == {c for _, c, _ in brute(sorted((k, r.text) for k, r in kept[1].items()), near_dedup.N, near_dedup.THRESHOLD)[1]}
    assert set(kept[3]) <= set(kept[2]) and {r.source for r in kept[3].values()} == {r.source for r in kept[2].values()}
    placed(docs.collect(), {k: len(r.text.split()) for k, r in kept[3].items()}, CAPACITY)


def test_run_is_the_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and "pack_id" in out.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    compare(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
