"""The kept full-text index against scans, and stems against the published examples."""

import datetime as dt
import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fathomline.functions.stemmer import stem
from fathomline.operators import retrieval as R
from fathomline.operators import text_index as TI
from fathomline.plans import search

def classes():
    return {"A": F.col("title"), "B": F.col("body")}


KIND = "id long, title string, body string"
DOCS = [
    (1, "Running boats", "The runner runs far and the boat ran on."),
    (2, "Boat engines", "Engines for boats, and for a boat."),
    (3, "Notes", None),
    (4, "On the", "and of the of and the"),
    (5, None, "relational relations of connected connections"),
]


def test_stems():
    pairs = {
        "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat",
        "conditional": "condit", "valenci": "valenc", "digitizer": "digit", "radicalli": "radic", "vietnamization": "vietnam", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "formaliti": "formal",
        "sensibiliti": "sensibl", "triplicate": "triplic", "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac",
        "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "a": "a", "42nd": "42nd",
    }
    assert {w: stem(w) for w in pairs} == pairs


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, KIND)


def found(df):
    return sorted((r["key"], round(r["score"], 9)) for r in df.collect())


QUERIES = ['boats', '"of the"', "the and -engines", 'boat or notes', '"the of and"', "nothing", "-boats", '"on the and"', "the of"]


@pytest.mark.parametrize("question", QUERIES)
def test_positions_give_what_a_scan_gives(spark, docs, tmp_path, question):
    index = TI.create(docs, str(tmp_path / "i"), "id", classes())
    scan = R.keyword_scores(docs.na.fill(""), question, ["id"], classes()).withColumnRenamed("id", "key")
    assert found(TI.scores(spark, index, question)) == found(scan)


def test_index_reads_no_text_and_few_folders(spark, docs, tmp_path):
    index = TI.create(docs, str(tmp_path / "i"), "id", classes())
    plan = TI.scores(spark, index, '"of the"')._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan and "folder" in plan.split("PartitionFilters:")[1][:200] and "body" not in plan
    files = glob.glob(f"{tmp_path}/i/postings/*/*/*.parquet")
    encodings = {e for f in files for c in range(4) for e in pq.ParquetFile(f).metadata.row_group(0).column(c).encodings}
    assert "DELTA_BINARY_PACKED" in encodings


def test_stemmed_index(spark, docs, tmp_path):
    index = TI.create(docs, str(tmp_path / "i"), "id", classes(), stems=True)
    keys = lambda q: [k for k, _ in found(TI.scores(spark, index, q))]
    assert keys("boat") == keys("boats") == [1, 2] and keys("running") == [1] and keys('"connection connecting"') == [5]


def test_nearness_adds_to_the_score(spark, tmp_path):
    rows = [(1, "", "red boat"), (2, "", "red x x x boat"), (3, "", "boat x red x x x boat")]
    df = spark.createDataFrame(rows, KIND)
    index = TI.create(df, str(tmp_path / "i"), "id", classes())
    plain, near = (dict(found(TI.scores(spark, index, "red boat", near_weight=w))) for w in (0.0, 1.0))
    assert {k: round(near[k] - plain[k], 6) for k in plain} == {1: 1.0, 2: 0.25, 3: 0.5}


def test_updates_equal_a_rebuild(spark, tmp_path):
    base = [(i, f"title {i % 7}", f"word{i % 11} and word{i % 5} of the " + "text " * (i % 3)) for i in range(400)]
    now = {r[0]: r for r in base}
    index = TI.create(spark.createDataFrame(base, KIND), str(tmp_path / "i"), "id", classes())
    size = lambda: sum(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/i/postings/*/*/*.parquet"))
    before = size()
    for step in range(10):
        changed = [(i, "new title", f"word{step} changed of the page") for i in range(step * 4, step * 4 + 4)] + [(1000 + step, "added", "word3 of it")]
        gone = [(399 - step, None, None)]
        now.update({r[0]: r for r in changed})
        now.pop(399 - step)
        TI.update(index, spark.createDataFrame(changed, KIND), "id", classes(), deleted=spark.createDataFrame(gone, KIND))
        if step == 0:
            assert size() - before <= 0.03 * before
        if step in (0, 5, 9):
            for question in ("word3", '"of the"', "title -word2", "added or changed"):
                scan = R.keyword_scores(spark.createDataFrame(list(now.values()), KIND), question, ["id"], classes()).withColumnRenamed("id", "key")
                assert found(TI.scores(spark, index, question)) == found(scan)
    assert len(TI._manifest(spark, index)[1]) <= TI.GENERATIONS
    TI.compact(spark, index)
    assert found(TI.scores(spark, index, "word3")) == found(R.keyword_scores(spark.createDataFrame(list(now.values()), KIND), "word3", ["id"], classes()).withColumnRenamed("id", "key"))


def test_search_by_the_kept_index(spark, tmp_path):
    pages = spark.createDataFrame([(r[0], "main", f"notes/{r[0]}", r[1], r[2], "note", None, dt.datetime(2026, 7, 1), None, None) for r in DOCS], "page_id long, source_id string, slug string, title string, compiled_truth string, type string, effective_date timestamp, updated_at timestamp, created_at timestamp, deleted_at timestamp")
    index = TI.create(pages, str(tmp_path / "i"), "page_id", {"A": F.col("title"), "B": F.col("compiled_truth")}, stems=True)
    plan = search.compile_search("boat engine", dt.datetime(2026, 7, 10))
    assert [r["slug"] for r in search.run_search(plan, search.Corpus(pages, words=index)).collect()] == ["notes/2"]
    assert search.run_search(plan, search.Corpus(pages)).count() == 0
