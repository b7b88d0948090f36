"""The pipeline's stages on the documents and on odd rows, and the registered queries."""

import collections

import duckdb
import pytest

import corpus_pipeline
from fathomline.llm import crf_quality, packing, registry
from tests.llm.test_operators import ODD, odd_rows


def test_stages_follow_one_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        if name in ("quality classifier", "simhash near-dedup"):
            assert 0.5 * before < out.count() <= before
        docs, before = out, out.count()
    assert docs.count() == corpus_pipeline.run(spark, sf).count()


def test_rejected_documents_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = crf_quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in crf_quality.classify(docs, model).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, sf).collect()} == good


def test_one_of_many_copies_survives(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").schema
    other = [(i, "\n".join(f"Line {k} of page {i} says {i * 31 + k}." for k in range(8)) + "\nShared footer.", "s") for i in range(60)]
    copies = [(100 + i, "\n".join(f"A copied line {k}, with its own words {k * k}." for k in range(8)) + "\nShared footer.", "s") for i in range(30)]
    copies = [(i, copies[0][1], s) for i, _, s in copies]
    docs = spark.createDataFrame(other + copies, schema)
    rows = corpus_pipeline.drop_site_lines(spark, docs, sf)
    left = corpus_pipeline.one_of_each_group(spark, rows, sf).collect()
    assert sorted(r["doc_id"] for r in left) == [*range(60), 100]
    assert {r["doc_id"]: r["text"] for r in left}[100] == copies[0][1].removesuffix("\nShared footer.")


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, sf, empty):
    docs = spark.createDataFrame(odd_rows(), ODD)
    docs = docs.limit(0) if empty else docs
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        assert not (empty and rows)


def test_packed_rows_hold_the_mixed_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf).cache()
    want = collections.Counter(r["doc_id"] for r in mixed.select("doc_id").collect())
    got = collections.Counter(r["doc_id"] for r in corpus_pipeline.pack_sequences(spark, mixed, sf).filter("piece = 0").collect())
    assert got == want and packing.CAPACITY == 1024


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql_twins(name, spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in found.description]
    df = registry.queries()[name](spark, sf)
    value = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted(columns) == sorted(df.columns)
    assert collections.Counter(tuple(value(r[c]) for c in sorted(columns)) for r in df.collect()) == collections.Counter(tuple(value(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in found.fetchall())


def test_every_operator_has_its_query():
    names = registry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names
