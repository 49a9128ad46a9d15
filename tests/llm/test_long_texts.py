"""Texts of about a megabyte in every operator on documents, and result names as columns of the pipeline's input."""

import random
import zlib

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtrail.llm import bpe_codec, decontaminate, fingerprints, near_dedup, quality, sharding, token_counts, token_output

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(11)
WORD = ["".join(RNG.choices("abcdeñ日", k=RNG.randint(1, 8))) for _ in range(5000)]
LONG = " ".join(RNG.choices(WORD, k=150_000))
EDITED = LONG[:500_000] + " changed here " + LONG[500_000:]
ROWS = [(1, LONG), (2, EDITED), (3, "the long way home\n" * 50_000), (4, "short text"), (5, LONG), (6, "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(4)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_tokens_of_long_texts(docs, tmp_path):
    library = Tokenizer.from_file(BYTES)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in ROWS}
    assert {i: r.n_tokens for i, r in by_id(token_counts.token_counts(docs, BYTES)).items()} == {i: len(x) for i, x in want.items()}
    out = by_id(token_output.token_output(docs, BYTES, f"file://{tmp_path}/tokens"))
    assert {i: r.ids_crc32 for i, r in out.items()} == {i: zlib.crc32(np.array([*x, 2], "<u4").tobytes()) for i, x in want.items()}


def test_codec_of_long_texts(docs):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation()
    library.no_padding()
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in ROWS}
    assert {i: r.n_tokens for i, r in by_id(bpe_codec.bpe_codec(docs, WORDS)).items()} == want


def test_near_copies_shards_and_fingerprints_of_long_texts(docs):
    near = by_id(near_dedup.near_dedup(docs))
    assert {i: r.component_id for i, r in near.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6}
    shards = by_id(sharding.shard(docs))
    assert {i: r.size for i, r in shards.items()} == {i: len(t.encode()) + 1 for i, t in ROWS} and shards[1].shard == shards[5].shard
    prints = by_id(fingerprints.fingerprints(docs))
    assert prints[1].fingerprint == prints[5].fingerprint != prints[2].fingerprint


def test_passage_in_a_long_text(spark, docs):
    words = LONG.split()
    items = [(1, " ".join(words[100_000:100_014])), (2, " ".join(words[-10:])), (3, "way home the long")]
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.decontaminate(ROWS, items)


def test_quality_of_long_texts(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 7)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, labels).collect())


def test_stages_take_columns_named_like_results(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a passage of the benchmark with more words than ten of them")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.createDataFrame([(k, f"some words of document {k} about other things", "en", "s", 9) for k in range(4)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("predicted", "score", "held_out", "accepted", "kept", "component_id", "contaminated", "n_hit", "n_words", "n_tokens", "label", "host", "row"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 4, name
