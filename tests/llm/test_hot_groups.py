"""Joins on keys that hold a third of all rows, and operator 5 on a template of thousands of rows."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from jobtrail.llm import groups, near_dedup


def keyed(spark):
    """Rows (key, doc_id): a third of one key, a third without a key, the rest of many keys."""
    return spark.range(6000).selectExpr("id as doc_id", "case id % 3 when 0 then 7L when 1 then null else id end as key")


def test_join_of_hot_keys_is_a_plain_join(spark):
    rows = keyed(spark)
    one = spark.createDataFrame([(7, "a"), (7, "b"), (8, "c"), (10_000, "d")], "key long, name string")
    hot = groups.hot_keys(rows.where("key is not null").groupBy("key").agg(F.count("*").alias("k")), ["key"], "k", rows.count())
    assert [tuple(r) for r in hot.collect()] == [(7, 334)]
    for how in ("inner", "left"):
        dealt = groups.join_hot(rows, one, ["key"], hot, "doc_id", how).select("doc_id", "key", "name")
        plain = rows.join(one, "key", how).select("doc_id", "key", "name")
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))
    plan = groups.join_hot(rows, one.hint("merge"), ["key"], hot, "doc_id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [key" in plan and ", part" in plan  # the shuffle is by key and part


def test_parts_of_all_hot_keys_are_few(spark):
    for rows in (1, 50, 3000):
        counts = spark.range(rows).selectExpr("id % 700 as key").groupBy("key").agg(F.count("*").alias("k"))
        parts = groups.hot_keys(counts, ["key"], "k", rows).agg(F.sum("parts")).first()[0]
        assert parts < 2 * groups.SHARE and (rows > 700 or parts == rows)  # never more parts than rows


def test_pairs_across_components_of_hot_keys(spark):
    rows = [(7 if k % 3 else k, k, k % 5 and k // 40, 0) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, doc_id long, component long, largest long")
    want = sorted((a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] != b[2] and (a[1] + b[1]) % 7 == 0)
    sizes = df.groupBy("key").agg(F.count("*").alias("k"))
    for grid in (False, True):
        dealt = df.join(sizes.withColumn("parts", groups.parts_of("k", len(rows), grid)), "key")
        got = near_dedup.across(dealt, "(p.doc_id + q.doc_id) % 7 = 0", grid).collect()
        assert sorted(map(tuple, got)) == want


def test_components_of_one_centre(spark):
    edges = [(500, k) for k in range(0, 1200, 2) if k != 500] + [(k, k + 1) for k in range(2001, 2040)]
    got = {r.doc_id: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(2, 1200, 2)}, **{k: 2001 for k in range(2002, 2041)}}


def test_template_of_thousands_leaves_no_tables_behind(spark):
    draw = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(3000):
        words = base[:]
        words[draw.randrange(200)] = f"own{k}"
        rows.append((10 * k + 5, " ".join(words)))
    rows += [(k, f"alone{k} " + " ".join(f"x{draw.randrange(10**6)}" for _ in range(30))) for k in range(100_000, 101_000)]
    rows += [(k, "") for k in range(200_000, 202_000)]
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir()) if shared.exists() else set()
    result = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.component_id, r.kept) for r in result.collect()}
    assert got == {i: (5, i == 5) if i < 100_000 else (i, True) for i, _ in rows}
    left = sorted(p.name.split("-")[0] for p in set(shared.iterdir()) - before)
    assert left == ["edges", "sets", "sketch"]  # what the result itself reads
