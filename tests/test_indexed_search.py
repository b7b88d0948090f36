"""r3_indexed_search: the written index was a row for each posting, made by two shuffles of all of them."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import retrieval as R
from fathomline.plans import catalog, q_search

CLASSES = ("A", "title"), ("B", "body")


def classes():
    return {c: F.col(name) for c, name in CLASSES}


def test_written_rows_are_far_fewer_than_postings(spark, sf, monkeypatch):
    kept = []
    monkeypatch.setattr(q_search, "remove_folder", lambda _, path: kept.append(path))
    catalog.queries()["r3_indexed_search"](spark, sf)
    written = spark.read.parquet(*kept)
    postings = catalog.queries()["r3_inverted_index"](spark, sf)
    assert written.count() < postings.count() / 5
    # and they are all of them
    key = ["page_id", "class", "term"]
    rows = written.select("class", F.inline(F.arrays_zip("page_id", "term", "tf"))).groupBy(*key).agg(F.sum("tf").alias("tf"))
    assert rows.exceptAll(postings.select(*rows.columns)).count() == 0 and postings.select(*rows.columns).exceptAll(rows).count() == 0


DOCS = [
    (1, "On the", "Out of the and of the AND the"),
    (2, None, "often the theory of them; of--the\nThe end"),
    (3, "of", "the and, of others"),
    (4, "", None),
    (5, "Ünder the", "ärger of ther ŒUVRE of"),
    (None, "the", "of the"),
    (7, "...", "of"),
    (7, None, "the the"),
]


@pytest.mark.parametrize("rows_at_once", ["2", "10000"])
@pytest.mark.parametrize("question", ['the and "of the"', "the", "under or ünder", '"of the" -end', 'the -"of the"', "œuvre the", "nothing", '"on the out"'])
def test_blocks_give_what_a_scan_gives(spark, tmp_path, question, rows_at_once):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
    try:
        docs = spark.createDataFrame(DOCS, "id long, title string, body string").coalesce(1)
        blocks = R.posting_blocks(docs, ["id"], classes())
        assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
        R.write_index(blocks, str(tmp_path / "i"))
        found = R.indexed_scores(R.read_index(blocks, str(tmp_path / "i"), question), question, ["id"])
        # rows of one key are one document
        one = docs.groupBy("id").agg(F.concat_ws(" ", F.collect_list("title")).alias("title"), F.concat_ws(" ", F.collect_list("body")).alias("body"))
        got = R.with_phrases(found.join(one, found["id"].eqNullSafe(one["id"])).select(one["*"], "score"), question, classes())
        scan = R.keyword_scores(one, question, ["id"], classes())
        rows = lambda df: sorted(((r["id"] or 0), round(r["score"], 9)) for r in df.select("id", "score").collect())
        assert rows(got) == rows(scan)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_an_index_of_nothing(spark, sf, tmp_path):
    """No posting, no file: the index could not be read."""
    for name in ("none", "wordless"):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        docs = docs.limit(0) if name == "none" else docs.limit(3).withColumn("text", F.lit(" .. "))
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        assert catalog.queries()["r3_indexed_search"](spark, str(tmp_path / name)).count() == 0


def test_phrases_are_searched_without_cutting_texts(spark, sf):
    plan = R.with_phrases(spark.createDataFrame(DOCS, "id long, title string, body string"), '"of the"', classes())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan
