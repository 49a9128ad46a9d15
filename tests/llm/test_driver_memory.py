"""What operators 3 and 5 hold on the driver: no broadcasts without hot keys, no copies of the sample."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from jobtrail.llm import groups, near_dedup, toxicity


def test_near_dedup_of_few_rows_has_no_broadcast_of_hot_keys(spark, monkeypatch):
    hinted, stored = [], near_dedup.store

    def store(df, tag):
        hinted.extend([tag] * df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast"))
        return stored(df, tag)

    monkeypatch.setattr(near_dedup, "store", store)
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[:50] + [f"x{k}"] + base[51:])) for k in range(5)] + [(k, f"alone{k} " * k) for k in range(5, 40)] + [(50, None), (51, "")]
    out = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    hinted.extend(["result"] * out._jdf.queryExecution().analyzed().toString().count("strategy=broadcast"))
    got = {r.doc_id: r.component_id for r in out.collect()}
    assert {got[k] for k in range(5)} == {0} and len(got) == len(rows) and got[50] == 50
    assert not hinted


def test_listed_hot_keys_are_those_with_many_rows(spark):
    rows = spark.range(6000).selectExpr("id as doc_id", "case id % 3 when 0 then 7L when 1 then null else id end as key")
    one = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (10_000, "d")], "key long, name string")
    counts = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("k"))
    hot = groups.listed_hot_keys(counts, ["key"], "k", 6000)
    assert [tuple(r) for r in hot.collect()] == [(7, 334)]
    assert groups.listed_hot_keys(counts.where("key <> 7"), ["key"], "k", 900) is None  # each of them has one row
    for keys in (hot, None):
        for how in ("inner", "left"):
            dealt = groups.join_hot(rows, one, ["key"], keys, "doc_id", how).select("doc_id", "key", "name")
            assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.join(one, "key", how).select("doc_id", "key", "name").collect()))
    # rows without a key are spread by a left join, with a list or without
    plan = groups.join_hot(rows, one.hint("merge"), ["key"], None, "doc_id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and ", part" in plan


def test_svm_makes_no_copies_of_its_rows():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(30_000, 64)).astype(np.float32)
    y = np.where(x[:, 0] + draw.normal(size=len(x)) > 0, 1.0, -1.0)
    tracemalloc.start()
    w, bias = toxicity.svm(x, y, np.full(len(x), 0.01))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes and abs(w[0]) > 5 * np.abs(w[1:]).max()
    gap = 1 - y * (x.astype(float) @ w + bias)
    slope = w - 2 * x.astype(float)[gap > 0].T @ (0.01 * y * gap)[gap > 0]
    assert np.abs(slope).max() < 0.05  # it is at its least


def test_strings_are_learned_block_by_block(monkeypatch):
    draw = random.Random(4)
    clean = {" ".join("".join(draw.choices("abcdefghij", k=6)) for _ in range(4)): 1.0 for _ in range(200)}
    toxic = {"".join(draw.choices("klmnopqrst", k=30)): 2.0 for _ in range(20)}
    whole = toxicity.learn_strings(toxic, clean, toxicity.LATIN)
    monkeypatch.setattr(toxicity, "ROWS", 7)
    parts = toxicity.learn_strings(toxic, clean, toxicity.LATIN)
    assert abs(whole.bias - parts.bias) < 1e-3 and np.abs(whole.table() - parts.table()).max() < 1e-2
    assert toxicity.learn_strings({}, clean, toxicity.LATIN) is None is toxicity.learn_strings(toxic, {}, toxicity.LATIN)
