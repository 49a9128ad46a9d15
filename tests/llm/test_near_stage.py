"""The pipeline's near-duplicates stage and its threshold."""

import random

import corpus_pipeline

from jobtrail.llm import near_dedup

RNG = random.Random(11)


def edited(base, first, last):
    """base with other words from place first to last."""
    return " ".join(f"other{k}" if first <= k < last else w for k, w in enumerate(base))


def test_stage_drops_near_copies_between_80_and_85_percent(spark):
    rows = []
    for k in range(40):
        base = [f"w{RNG.randrange(10**6)}" for _ in range(104)]  # 100 shingles
        rows.append((10 * k, " ".join(base)))
        rows.append((10 * k + 1, edited(base, 50, 50 + 1 + k % 4)))  # 5 to 8 shingles differ: 0.90 to 0.85
        rows.append((10 * k + 2, edited(base, 20, 26)))  # 10 differ: 0.818
        rows.append((10 * k + 3, edited(base, 60, 70)))  # 14 differ: 0.754
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) n_chars")
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert {i % 10 for i in left} == {0, 3} and len(left) == 80
    kept = {r.doc_id % 10 for r in near_dedup.near_dedup(docs, 85).where("kept").collect()}
    assert kept == {0, 2, 3}


def test_bands_follow_the_threshold():
    assert near_dedup.bands_of(85) == (28, 6) and near_dedup.bands_of(80) == (33, 5)
    assert all((1 - (p / 100) ** rows) ** bands <= near_dedup.MISSED for p in (80, 85, 90) for bands, rows in [near_dedup.bands_of(p)])
