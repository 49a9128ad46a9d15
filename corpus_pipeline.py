"""A corpus pipeline: each stage keeps, drops or changes documents; run() applies them in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm.bpe_codec import bpe_codec
from jobtrail.llm.common import store, table
from jobtrail.llm.decontaminate import decontaminate
from jobtrail.llm.near_dedup import near_dedup
from jobtrail.llm.quality import quality
from jobtrail.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Percent of shared five-word runs from which the stage takes documents as near copies.
NEAR = 80


#: Rows without a doc_id get one from here on while a stage judges them, by their text.
NAMELESS = 1 << 62


def named(docs: DataFrame) -> DataFrame:
    """The columns of documents; a row without a doc_id has one that rows of its text share, larger than any other."""
    own = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(NAMELESS))
    return docs.select(F.coalesce("doc_id", own).alias("doc_id"), *COLUMNS[1:])


def kept(rows: DataFrame, judged: DataFrame, accepted: str) -> DataFrame:
    """The rows whose doc_id was accepted in all its rows, with their own doc_id again."""
    verdicts = judged.groupBy("doc_id").agg(F.bool_and(F.expr(accepted)).alias("accepted")).where("accepted").select("doc_id")
    return rows.join(verdicts, "doc_id", "left_semi").select(F.when(F.col("doc_id") < NAMELESS, F.col("doc_id")).alias("doc_id"), *COLUMNS[1:])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model of the labels accepts.

    Null and empty texts are not toxic. Of rows with one doc_id all stay or none; rows without one are
    judged by their text; an empty table stays empty; columns beside those of documents are left out.
    """
    rows = named(docs)
    return kept(rows, toxicity(rows, table(spark, sf_dir, "labels")), "predicted = 0")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules of the labels accept.

    Null and empty texts have a score like any other. Rows with one doc_id, empty tables and further
    columns are treated as in the stage before.
    """
    rows = named(docs)
    return kept(rows, quality(rows, table(spark, sf_dir, "labels")), "predicted = 1")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and one row of each text of a doc_id.

    Texts without words, null and empty ones among them, are copies of nothing and stay. Of equal groups
    the least doc_id stays, of rows with one doc_id and text the first; different texts of one doc_id
    are one document, which stays or goes. Rows without a doc_id are the last to stay.
    """
    rows = named(docs)
    rest = [F.col(c) for c in COLUMNS[2:]]
    one = rows.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("row")).select("doc_id", "text", *(F.col(f"row.{c}").alias(c) for c in COLUMNS[2:]))
    return kept(one, near_dedup(rows, NEAR), "kept")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Texts without words have none. Rows with one doc_id, empty tables and further columns are treated
    as in the first stage; with an empty benchmark all documents stay.
    """
    rows = named(docs)
    return kept(rows, decontaminate(rows, table(spark, sf_dir, "benchmark")), "not contaminated")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document that is left, row by row; a null text has none."""
    return bpe_codec(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]
#: The first two stages are trained models; no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = store(docs, f"stage-{name}")
    return docs
