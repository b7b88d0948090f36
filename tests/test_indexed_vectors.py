"""The search of one query by the kept index of vectors gives what a comparison with all rows gives."""

from dataclasses import replace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import vector_index
from fathomline.plans import catalog


def close_groups(n, width, groups, seed):
    """Rows in tight groups, most of them nearer to each other than their codes can tell."""
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, width))[np.arange(n) % groups] + 0.1 * rng.normal(size=(n, width))


def nearest_of_all(ids, x, q, k):
    cos = np.clip((x @ q) / np.sqrt((x * x).sum(axis=1) * (q @ q)), -1, 1).round(9)
    return [(int(ids[i]), float(cos[i])) for i in np.lexsort((ids, -cos))[:k]]


@pytest.mark.parametrize("least", [True, False])
def test_nearest_is_that_of_all_rows(spark, tmp_path, least):
    """r4_indexed_vectors: rows beyond the lists looked into, or beyond the short list of codes, were not found, the query's own row among them."""
    x = close_groups(1200, 18, 6, 4)
    ids = np.arange(1200) * 7 - 100
    rows = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, vector array<double>")
    vector_index.build(rows, str(tmp_path / "i"))
    index = vector_index.read(spark, str(tmp_path / "i"))
    if least:
        index = replace(index, probed=1, short=1)
    for q in (x[3], x[700], -x[5], np.random.default_rng(1).normal(size=18)):
        for k in (1, 12):
            got = [(r["id"], round(r["score"], 9)) for r in vector_index.nearest(spark, index, q.tolist(), k).collect()]
            assert got == nearest_of_all(ids, x, q, k)


def test_more_than_there_are(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i)]) for i in range(40)], "id long, vector array<double>")
    index = replace(vector_index.build(rows, str(tmp_path / "i")), probed=1, short=1)
    got = [r["id"] for r in vector_index.nearest(spark, index, [0.0, 1.0, 0.5], 100).collect()]
    assert sorted(got) == list(range(40))


def test_lists_that_reach_no_row_are_not_read(spark, tmp_path):
    x = close_groups(2000, 12, 24, 9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    index = vector_index.build(rows, str(tmp_path / "i"))
    assert len(index.reaching(vector_index.unit(x[:1])[0], 0.99)) <= len(index.lists) // 4
    assert len(index.reaching(vector_index.unit(x[:1])[0], -np.inf)) == len(index.lists)


def test_the_query_is_its_sql_on_close_rows_and_ties(spark, tmp_path):
    """Rows that only differ in length tie at 1; the smallest id of them is the SQL's."""
    x = np.round(8 * close_groups(1500, 16, 3, 2))
    x[1000], x[1400] = 3 * x[0], 5 * x[0]
    ids = np.arange(1500)
    ids[1000], ids[1400] = -8, -3
    made = spark.createDataFrame([(int(i), v.tolist(), int(i) % 5) for i, v in zip(ids, x, strict=True)], "vec_id long, vector array<double>, label int")
    made.select("vec_id", F.col("vector").cast("array<float>").alias("embedding"), "label").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()["r4_indexed_vectors"]).fetchall()
    assert [tuple(r) for r in catalog.queries()["r4_indexed_vectors"](spark, str(tmp_path)).collect()] == want == [(-8, 1.0)]
