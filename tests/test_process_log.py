"""The log of process records: runs into one folder, restarts, late files, failed batches."""

import pytest
from pyspark.sql import functions as F

from jobtrail.sources import folders, process_log as P

FILES = "id long, mtime long, name string"


def seen(spark, folder, files):
    return sorted((r.id, r.name) for r in P.manifests(spark, folder, files).collect())


def test_two_runs_keep_all_manifests(spark, tmp_path):
    first = spark.createDataFrame([(k, 10 * k, f"f{k}") for k in range(1, 7)], FILES)
    folder = f"file://{tmp_path}/p"
    one = P.preprocess(first, folder, "c", 100, 4)
    both = first.union(spark.createDataFrame([(7, 70, "f7"), (8, 80, "f8")], FILES))
    two = P.preprocess(both, folder, "c", 200, 4)
    assert [i for i, _ in seen(spark, folder, both)] == list(range(1, 9))
    records = {(r.run, r.batch): (r.files, r.state, r.min_mtime, r.max_mtime, r.min_id, r.max_id) for r in P.current(P.entries(spark, folder)).collect()}
    assert records == {(one, 0): (4, 1, 10, 40, 1, 4), (one, 1): (2, 1, 50, 60, 5, 6), (two, 0): (2, 1, 70, 80, 7, 8)}
    P.advance(spark, folder, one, P.LOADED, 2)
    P.advance(spark, folder, one, P.PROCESSED, 3, F.col("batch") == 0)
    now = {(r.run, r.batch): r.state for r in P.current(P.entries(spark, folder)).collect()}
    assert now == {(one, 0): 3, (one, 1): 2, (two, 0): 1}
    assert [(r.run, r.batch) for r in P.todo(P.current(P.entries(spark, folder)), P.LOADED).collect()] == [(two, 0)]
    assert P.entries(spark, folder).count() == 3 * 2 + 2 + 1


@pytest.mark.parametrize("stop", range(4))
def test_a_run_that_stopped_is_run_again(spark, tmp_path, monkeypatch, stop):
    files, folder = spark.createDataFrame([(k, k, f"f{k}") for k in range(10)], FILES), f"file://{tmp_path}/p"
    calls, real = [], {n: getattr(P, n) for n in ("written_once", "append", "overwrite_partitions")}

    def counted(name):
        def step(*args):
            if name == "overwrite_partitions" and "/log" in str(args[1]):
                return real[name](*args)
            if len(calls) == stop:
                calls.append("stopped")
                raise RuntimeError("stopped")
            calls.append(name)
            return real[name](*args)

        return step

    for n in real:
        monkeypatch.setattr(P, n, counted(n))
    run = P.new_run(50)
    with pytest.raises(RuntimeError):
        P.preprocess(files, folder, "c", 50, 4, run)
    more = files.union(spark.createDataFrame([(10, 10, "came between")], FILES)) if stop else files
    P.preprocess(more, folder, "c", 50, 4, run)
    assert [i for i, _ in seen(spark, folder, files)] == list(range(10))
    assert sorted((r.batch, r.files, r.state) for r in P.current(P.entries(spark, folder)).collect()) == [(0, 4, 1), (1, 4, 1), (2, 2, 1)]


@pytest.mark.parametrize("lateness", [None, 1000])
def test_runs_with_late_files_list_what_one_run_does(spark, tmp_path, lateness):
    # arrives: 5 files modified early are seen late, and two have the time of the mark
    rows = [(k, 10 * (k % 50), f"f{k}", 300 if k % 10 == 3 else 10 * (k % 50)) for k in range(120)] + [(500, None, "no time", 300)]
    files, folder = spark.createDataFrame(rows, FILES + ", arrives long"), f"file://{tmp_path}/p"
    for now in (150, 301, 1000):
        P.preprocess(files.where(F.col("arrives") <= now).select("id", "mtime", "name"), folder, "c", now, 7, lateness=lateness)
    P.preprocess(files.select("id", "mtime", "name"), folder, "c", 2000, 7, lateness=lateness)  # nothing new
    assert [i for i, _ in seen(spark, folder, files.select("id", "mtime", "name"))] == sorted(r[0] for r in rows)
    assert P.entries(spark, folder).select("run").distinct().count() == 3


def test_files_of_a_failed_batch_are_listed_again(spark, tmp_path):
    files, folder = spark.createDataFrame([(k, 10 * k, f"f{k}") for k in range(1, 9)], FILES), f"file://{tmp_path}/p"
    run = P.preprocess(files, folder, "c", 100, 4)
    P.append(P.current(P.entries(spark, folder)).where("batch = 0").withColumn("state", F.lit(P.CREATED)), folder, 2)
    assert P.low_water(P.current(P.entries(spark, folder))).first().asDict() == {"cluster": "c", "newest": 80, "low": 9}
    listed = P.unlisted(files, P.entries(spark, folder), P.manifests(spark, folder, files), "c", 200, 0)
    assert sorted(r.id for r in listed.collect()) == [1, 2, 3, 4]
    assert P.unlisted(files, P.entries(spark, folder), P.manifests(spark, folder, files), "other", 200).count() == 8
    with pytest.raises(ValueError, match="later than now"):
        P.unlisted(files, P.entries(spark, folder), P.manifests(spark, folder, files), "c", 20)
    assert run < P.new_run(101)


def test_folders(spark, tmp_path):
    folder = folders.shared(spark, "t")
    assert not folders.exists(spark, folder)
    spark.range(3).write.parquet(folder)
    folders.written_once(spark.range(9), folder)
    assert spark.read.parquet(folder).count() == 3
    folders.delete(spark, folder)
    assert not folders.exists(spark, folder)
