"""Stages of the pipeline on odd rows: null ids, repeats, clashing columns, empty tables."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row int"
BENCH = "the quick brown fox jumps over the lazy dog while twelve grey cats look on"
ODD = [
    (1, "plain words about the weather in the northern hills and valleys", "en", "s", 5, "x", 1), (1, "plain words about the weather in the northern hills and valleys", "en", "s", 5, "x", 2),
    (2, "plain words about the weather in the northern hills and valleys", "en", "s", 5, "x", 3), (3, None, None, None, None, None, None), (4, "", "en", "s", 0, "x", 4), (None, "some words without a name", "en", "s", 3, "x", 5), (5, BENCH, "en", "s", 9, "x", 6),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{home}/labels.parquet")
    return str(home)


def ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())


def test_stages_keep_and_drop_what_they_say(spark, folder):
    docs = spark.createDataFrame(ODD, SCHEMA)
    near = corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert near.columns == list(corpus_pipeline.COLUMNS)
    two = [(7, "one text of this number about rain and snow in spring", "en", "s", 1, "x", 1), (7, "another text of the number about ships and their long ways", "en", "s", 1, "x", 2), *[(None, "a text without any number about birds and trees", "en", "s", 1, "x", k) for k in (3, 4)]]
    assert ids(corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(two, SCHEMA), folder)) == [(False, 7), (False, 7), (True, 0)]
    assert ids(near) == [(False, 1), (False, 3), (False, 4), (False, 5), (True, 0)]
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert ids(clean) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0)] and clean.columns == near.columns
    # without labels every document has the score 0.5: under the threshold of one stage, at that of the other
    assert corpus_pipeline.drop_toxic(spark, docs, folder).count() == len(ODD) == corpus_pipeline.drop_low_quality(spark, docs, folder).count()
    assert corpus_pipeline.encode(spark, docs, folder).count() == len(ODD)


def test_stages_of_empty_tables_are_empty(spark, folder):
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_a_row_goes_if_one_of_its_doc_id_is_rejected(spark):
    docs = spark.createDataFrame(ODD, SCHEMA)
    rows = corpus_pipeline.named(docs)
    nameless = rows.where(F.col("doc_id") >= corpus_pipeline.NAMELESS).first().doc_id
    judged = spark.createDataFrame([(1, True), (1, False), (2, True), (nameless, True)], "doc_id long, fine boolean")
    assert ids(corpus_pipeline.kept(rows, judged, "fine")) == [(False, 2), (True, 0)]
    assert rows.columns == list(corpus_pipeline.COLUMNS)


def test_rows_without_a_doc_id_are_judged_one_by_one(spark, folder):
    docs = spark.createDataFrame([(None, BENCH, "en", "s", 1, "x", 1), (None, "clean words of no benchmark at all", "en", "s", 1, "x", 2), (None, None, None, None, None, None, 3)], SCHEMA)
    assert sorted(r.text or "" for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect()) == ["", "clean words of no benchmark at all"]
