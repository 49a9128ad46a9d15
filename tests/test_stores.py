"""Incremental aggregates, older figures, row-key pages, the raw store, buckets and follow mode."""

import random
import re

import pytest
from pyspark.sql import functions as F

from jobtrail.functions.scalars import day_bucket, week_bucket
from jobtrail.operators import apps, flows, partials, storage
from jobtrail.sources import edge, raw_store, sinks
from jobtrail.streaming import follow

JOB = "cluster string, user string, app string, run_id long, job_seq long, queue string, total_maps long, mb_millis long, cost long, slot_millis long"
DAY = 86_400_000


def some_jobs(spark, n, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("cd"), draw.choice(["u", None]), draw.choice("ab"), draw.randint(0, 20) * DAY // 2, k, draw.choice(["q1", "q2", None]), *(draw.randint(0, 9) for _ in range(4))) for k in range(n)]
    return spark.createDataFrame(rows, JOB)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(a.columns)).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_any_split_of_jobs_gives_the_same_aggregates(spark, tmp_path, seed):
    jobs, draw, folder = some_jobs(spark, 200, seed), random.Random(seed), f"file://{tmp_path}/agg"
    cuts = sorted(draw.sample(range(200), 3))
    parts = [jobs.where((F.col("job_seq") >= a) & (F.col("job_seq") < b)) for a, b in zip([0, *cuts], [*cuts, 200])]
    order = [(k, p) for k, p in enumerate(parts)]
    draw.shuffle(order)
    for k, p in [*order[:2], order[0], *order[2:]]:  # one batch comes twice
        partials.fold(p.union(parts[0].limit(5)), folder, k)  # and some jobs in every batch
    assert same(partials.merged(spark, folder, day_bucket(F.col("run_id"))), apps.app_agg_daily(jobs))
    partials.compact(spark, folder)
    partials.fold(parts[1], folder, 1)  # a batch that was compacted
    partials.fold(some_jobs(spark, 230, seed).where("job_seq >= 200"), folder, 9)
    assert same(partials.merged(spark, folder, week_bucket(F.col("run_id"))), apps.app_agg_weekly(jobs.union(some_jobs(spark, 230, seed).where("job_seq >= 200"))))


def test_a_fold_or_compaction_that_stopped(spark, tmp_path, monkeypatch):
    jobs, folder = some_jobs(spark, 60, 5), f"file://{tmp_path}/agg"
    partials.fold(jobs.where("job_seq < 20"), folder, 0)
    with monkeypatch.context() as m:
        m.setattr(partials, "partial", lambda _: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            partials.fold(jobs.where("job_seq >= 20"), folder, 1)
    partials.fold(jobs.where("job_seq >= 20"), folder, 1)
    real = partials.renamed
    for stop in (1, 2):
        calls = []

        def once(spark, old, new):
            calls.append(old)
            if len(calls) == stop:
                raise OSError("stopped")
            real(spark, old, new)

        with monkeypatch.context() as m:
            m.setattr(partials, "renamed", once)
            with pytest.raises(OSError):
                partials.compact(spark, folder)
        assert same(partials.merged(spark, folder, day_bucket(F.col("run_id"))), apps.app_agg_daily(jobs))
    partials.compact(spark, folder)
    assert same(partials.merged(spark, folder, day_bucket(F.col("run_id"))), apps.app_agg_daily(jobs))


def test_a_stream_of_jobs_is_aggregated(spark, tmp_path):
    jobs = some_jobs(spark, 90, 7)
    for k in range(3):
        jobs.where(F.col("job_seq") % 3 == k).write.mode("append").parquet(f"{tmp_path}/in")
        partials.aggregated(spark.readStream.schema(jobs.schema).parquet(f"{tmp_path}/in"), f"file://{tmp_path}/agg", f"{tmp_path}/mark").awaitTermination()
    assert same(partials.merged(spark, f"file://{tmp_path}/agg", day_bucket(F.col("run_id"))), apps.app_agg_daily(jobs))


def test_older_figures_of_a_path(spark):
    day, usage = 86_400, "cluster string, path string, hour long, namespace string, space_consumed long, owner string"
    draw = random.Random(1)
    rows = [("c", draw.choice(["/a", "/b"]), draw.randint(0, 170 * 24) * 3600, "n", draw.randint(1, 100), "o") for _ in range(400)]
    frame = spark.createDataFrame(rows, usage)
    rolled = {}
    for c, p, h, _, s, _ in rows:
        rolled[p, h] = rolled.get((p, h), 0) + s
    want = set()
    for (p, h), s in rolled.items():
        for age in storage.AGES:
            earlier = [x for q, x in rolled if q == p and x <= h - age * day]
            if earlier:
                want.add(("c", p, h, s, age, max(earlier), rolled[p, max(earlier)], s - rolled[p, max(earlier)]))
    got = storage.older(frame)
    assert {tuple(r) for r in got.collect()} == want
    plan = storage.older(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cluster") == 2 and plan.count("Window [") == 1  # the roll-up's own, and one for all ages


def test_directories_of_the_nearest_age_that_has_any(spark):
    day, at = 86_400, 200 * 86_400
    rows = [("c", "/d/x", at - 4 * day - 7200, "n", 5, "o"), ("c", "/d/y", at - 4 * day - 3600, "n", 6, "o"), ("c", "/d/z", at - 30 * day, "n", 7, "o"), ("c", "/e/w", at, "n", 8, "o"), ("c", "/f", at - 2 * day, "n", 1, "o")]
    usage = spark.createDataFrame(rows, "cluster string, path string, hour long, namespace string, space_consumed long, owner string")
    assert [(r.path, r.space_consumed) for r in storage.dirs_at(usage, "c", "/d", at + 5).collect()] == [("/d/y", 6)]
    assert [r.path for r in storage.dirs_at(usage, "c", "/e", at).collect()] == ["/e/w"]
    assert storage.dirs_at(usage, "c", "/f", at).count() == 0 and storage.dirs_at(usage, "c", "/none", at).count() == 0


def test_pages_end_to_end_are_the_whole(spark, tmp_path):
    jobs = some_jobs(spark, 300, 3).fillna("nobody", "user")
    all_flows = jobs.groupBy(*flows.FLOW).agg(F.count("*").alias("jobs"))
    sinks.write_flows(all_flows, f"{tmp_path}/flows", 4)
    stored, got, row = spark.read.parquet(f"{tmp_path}/flows"), [], None
    for _ in range(200):
        page = flows.flow_page(stored, 7, row)
        rows = page.collect()
        got += rows[:7]
        row = flows.next_row(page, 7)
        assert row is None or edge.decode_cursor(edge.encode_cursor(*row)) == row
        if row is None:
            break
    want = stored.orderBy("cluster", "user", "app", F.desc("run_id")).collect()
    assert got == want and len(want) > 50
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = flows.flow_page(stored, 7, ("c", "nobody", "b", 5 * DAY))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]
    assert "GreaterThanOrEqual(cluster,c)" in pushed and "LessThanOrEqual(run_id" in pushed
    assert {r.app for r in flows.flow_page(stored, 1000, app=("c", "nobody", "a")).collect()} == {"a"}


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.getClass().getName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(k).metrics().apply("numFiles").value() for k in range(leaves.size()))


def test_raw_rows_are_read_by_ranges_of_ids(spark, tmp_path):
    rows = [(c, f"job_{e}_{k:04d}", f"<conf {e} {k}/>", f"history {e} {k}".encode(), 5, None if k == 3 else 6, "true" if k % 2 else None, "true" if k % 5 == 0 else None) for c in ("c1", "c2") for e in (100, 200) for k in range(0, 5000, 3)]
    schema, folder = "cluster string, job_id string, conf string, history binary, conf_mtime long, history_mtime long, success string, reprocess string", f"file://{tmp_path}/raw"
    raw_store.write_raw(spark.createDataFrame(rows, schema), folder)
    store = raw_store.raw_store(spark, folder)
    in_order = lambda j: raw_store.parsed(j)
    for least, most in ((None, None), ("job_100_4500", "job_200_0500"), ("job_200_12", None), (None, "job_100_0999"), ("job_100_20000", "job_100_30000")):
        want = {r[1] for r in rows if r[0] == "c1" and (not least or in_order(r[1]) >= in_order(least)) and (not most or in_order(r[1]) <= in_order(most))}
        assert {r.job_id for r in raw_store.in_range(store, "c1", least, most).collect()} == want
    assert files_read(raw_store.in_range(store, "c1", "job_100_4500", "job_200_0500")) == 2
    assert files_read(raw_store.of_job(store, "c2", "job_200_0003")) == 1
    assert raw_store.content(store, "c2", "job_200_0003") == "history 200 3" and raw_store.content(store, "c2", "job_200_0003", "conf", False) == b"<conf 200 3/>"
    assert raw_store.content(store, "c2", "job_200_0004") is None
    ready = {r[1] for r in rows if r[0] == "c1" and r[5] and (r[6] != "true" or r[7] == "true")}
    scanned = raw_store.scan(store, "c1")
    assert {r.job_id for r in scanned.collect()} == ready and not {"conf", "history"} & set(scanned.columns)
    assert {r.job_id for r in raw_store.scan(store, "c1", reprocess=True).collect()} == {r[1] for r in rows if r[0] == "c1" and r[5] and r[7]}
    cut = raw_store.ranges(store, "c1", None, None, 100).orderBy("batch").collect()
    assert sum(r.jobs for r in cut) == len(ready) and {r.jobs for r in cut[:-1]} == {100} and in_order(cut[0].max_id) < in_order(cut[1].min_id)


def test_raw_rows_are_replaced_by_job(spark, tmp_path):
    schema, folder = "cluster string, job_id string, conf string", f"file://{tmp_path}/raw"
    raw_store.write_raw(spark.createDataFrame([("c", f"job_1_{k}", "old") for k in (1, 2, 2000)], schema), folder)
    raw_store.write_raw(spark.createDataFrame([("c", "job_1_2", "new"), ("c", "job_1_12345", "new")], schema), folder)
    assert {(r.job_seq, r.conf) for r in raw_store.raw_store(spark, folder).collect()} == {(1, "old"), (2, "new"), (2000, "old"), (12345, "new")}
    with pytest.raises(Exception, match="not a job id"):
        raw_store.write_raw(spark.createDataFrame([("c", "task_x", "new")], schema), folder)


def test_tasks_join_jobs_without_a_shuffle(spark):
    jobs = some_jobs(spark, 200, 9)
    tasks = spark.createDataFrame([(k % 250, k) for k in range(900)], "job_seq long, slot_millis long")
    a, b = sinks.bucketed(jobs, "jobs_in_buckets", "job_seq", 4), sinks.bucketed(tasks, "tasks_in_buckets", "job_seq", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = flows.flow_task_rows(a, b)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert same(joined, flows.flow_task_rows(jobs, tasks))
        assert "Exchange" not in flows.flow_with_tasks(a, b)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("jobs_in_buckets", "tasks_in_buckets"):
            spark.sql(f"drop table {name}")


def test_events_are_followed_once(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/events"

    def put(*sequence):
        sinks.append_events(spark.createDataFrame([(s, f"e{s}") for s in sequence], "sequence long, data string"), path)

    def poll():
        follow.follow(spark, path, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.sequence for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(1, 2, 3, 4)
    assert poll() == [3, 4] and poll() == [3, 4]
    put(5, 6)
    put(6, 7)  # one event was appended twice
    put(1_200_000)
    assert poll() == [3, 4, 5, 6, 7, 1_200_000]
    put(1_200_001)
    assert poll() == [3, 4, 5, 6, 7, 1_200_000, 1_200_001] and poll()[-1] == 1_200_001
