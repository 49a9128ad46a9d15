"""Known values of the domain, over small inputs of the same make."""

import json

import pytest
from pyspark.sql import functions as F

from jobtrail.functions import scalars
from jobtrail.operators import files, flows
from jobtrail.sources import edge, history
from jobtrail.streaming import incremental

# A job's times, what its counters report for its maps, and its megabyte-milliseconds without and with that.
SUBMIT, LAUNCH, FINISH, REPORTED, PLAIN, WITH_REPORTED = 1329348443227, 1329348448308, 1329348468601, 178169856, 10390016, 188559872
# The measures that a job's counters give, alike under both naming schemes.
DETAILS = {
    "map_file_bytes_read": 202401720425, "map_file_bytes_written": 213924145507, "reduce_shuffle_bytes": 106017635120, "hdfs_bytes_read": 374344244609,
    "hdfs_bytes_written": 122203940055, "map_slot_millis": 209069728, "reduce_slot_millis": 110237644,
}


def event(kind, **body):
    return json.dumps({"type": kind, "event": {"org.apache.hadoop.mapreduce.jobhistory.X": body}})


def block(name, **counts):
    return {"name": name, "groups": [{"name": "org.apache.hadoop.mapreduce.JobCounter", "displayName": "Job", "counts": [{"name": k, "displayName": k, "value": v} for k, v in counts.items()]}]}


def history_file():
    """A job of ten maps and one reduce: 49 events of eleven types."""
    lines = [event("JOB_SUBMITTED", jobid="job_1_0001", jobName="Sleep job", userName="user", submitTime=SUBMIT, jobQueueName="default"), event("AM_STARTED", applicationAttemptId="appattempt_1_0001_000001", startTime=SUBMIT, containerId="c_1")]
    lines += [event("JOB_INITED", jobid="job_1_0001", launchTime=LAUNCH, totalMaps=10, totalReduces=1, jobStatus="INITED", uberized=False), event("JOB_INFO_CHANGED", jobid="job_1_0001", submitTime=SUBMIT, launchTime=LAUNCH)]
    for kind, numbers in (("MAP", range(10)), ("REDUCE", range(1))):
        for n in numbers:
            task = f"task_1_0001_{kind[0].lower()}_{n:06d}"
            attempt = task.replace("task", "attempt") + "_0"
            lines.append(event("TASK_STARTED", taskid=task, taskType=kind, startTime=LAUNCH, splitLocations="a,b"))
            lines.append(event(f"{kind}_ATTEMPT_STARTED", taskid=task, taskType=kind, attemptId=attempt, startTime=LAUNCH, trackerName="t", httpPort=1))
            lines.append(event(f"{kind}_ATTEMPT_FINISHED", taskid=task, taskType=kind, attemptId=attempt, taskStatus="SUCCEEDED", finishTime=FINISH, hostname="h", counters=block("COUNTERS", CPU=1)))
            lines.append(event("TASK_FINISHED", taskid=task, taskType=kind, finishTime=FINISH, status="SUCCEEDED", counters=block("COUNTERS", CPU=1)))
    lines.append(event("JOB_FINISHED", jobid="job_1_0001", finishTime=FINISH, finishedMaps=10, finishedReduces=1, failedMaps=0, failedReduces=0, totalCounters=block("TOTAL", MB_MILLIS_MAPS=REPORTED)))
    return "\n".join(["Avro-Json", json.dumps({"type": "record", "name": "Event", "fields": []}), *lines])


def test_a_whole_job(spark):
    parsed = history.events(spark.createDataFrame([("f", history_file())], "job_file string, content string"))
    assert parsed.count() == 49
    rows = {r.row_key: r["values"] for r in history.collapsed(history.fields(parsed)).collect()}
    assert len(rows) - 1 == 23  # eleven tasks, eleven attempts and the application master, beside the job
    job = rows[""]
    assert (job["JOB_STATUS"], job["QUEUE"], job["SUBMIT_TIME"], job["LAUNCH_TIME"], job["FINISH_TIME"], job["TOTAL_MAPS"]) == ("SUCCEEDED", "default", str(SUBMIT), str(LAUNCH), str(FINISH), "10")
    counters = history.counters(parsed)
    assert counters.where("scope = 'task'").count() == 22 and counters.where("scope = 'job'").first().value == REPORTED


def test_a_killed_job_keeps_its_status_and_a_moved_one_its_last_queue(spark):
    lines = ["Avro-Json", "{}", event("JOB_SUBMITTED", jobid="j", jobQueueName="first"), "", event("JOB_QUEUE_CHANGED", jobid="j", jobQueueName="root.someQueueName"), "", event("JOB_KILLED", jobid="j", jobStatus="KILLED")]
    parsed = history.events(spark.createDataFrame([("f", "\n".join(lines))], "job_file string, content string"))
    job = history.collapsed(history.fields(parsed)).first()["values"]
    assert job["JOB_STATUS"] == "KILLED" and job["QUEUE"] == "root.someQueueName"


def test_megabyte_millis_with_and_without_reports(spark):
    rows = spark.createDataFrame([(None, None, False), (REPORTED, None, False), (REPORTED, 7, False), (REPORTED, 7, True)], "m long, r long, uber boolean")
    at = scalars.megabyte_millis(*map(F.lit, (1024, 0, 2048, 0, 512, LAUNCH, FINISH)), F.col("uber"), F.col("m"), F.col("r"))
    assert [r.x for r in rows.select(at.alias("x")).collect()] == [PLAIN, WITH_REPORTED, WITH_REPORTED + 7, PLAIN]


@pytest.mark.parametrize("version", ["ONE", "TWO"])
def test_job_details(spark, version):
    rows = [(1, scope, groups[version == "TWO"], name, DETAILS.get(m, 0)) for m, scope, groups, name in flows.DERIVED]
    got = flows.job_details(spark.createDataFrame([(1, version)], "job_seq long, hadoop_version string"), spark.createDataFrame(rows, "job_seq long, scope string, group string, name string, value long")).first()
    assert {m: got[m] for m in DETAILS} == DETAILS and got.reduce_file_bytes_read == 0


def test_what_is_required_fails(spark):
    with pytest.raises(Exception, match="no configuration of j"):
        history.configurations(spark.createDataFrame([("j", None)], "job_id string, content string")).collect()
    confs = spark.createDataFrame([({"user.name": " "},)], "conf map<string,string>")
    assert confs.select(scalars.user_name(F.col("conf")).alias("u")).first().u is None
    with pytest.raises(Exception, match="no user"):
        confs.select(scalars.user_name(F.col("conf"), required=True).alias("u")).collect()


def test_list_of_files(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name, size in (("job_1_0001_conf.xml", 3), ("b/job_1_0001-9-u-Sleep-1.jhist", 5), ("notes.txt", 1), (".job_1_0001_conf.xml.crc", 1)):
        (tmp_path / "a" / name).write_bytes(b"x" * size)
    found = history.list_files(spark, str(tmp_path))
    assert sorted((r.kind, r.job_id, r["size"]) for r in found.collect() if r.job_id) == [("conf", "job_1_0001", 3), ("history", "job_1_0001", 5)]
    assert history.paired_files(found).count() == 1


def test_key_order(spark):
    rows = [("c", "u", "a", 1, 2222), ("c", "u", "a", 2, 11111), ("b", "u", "a", 1, 5), ("c", "u", "a", 1, 1)]
    ordered = flows.in_key_order(spark.createDataFrame(rows, "cluster string, user string, app string, run_id long, job_seq long")).collect()
    assert [(r.cluster, r.run_id, r.job_seq) for r in ordered] == [("b", 1, 5), ("c", 2, 11111), ("c", 1, 1), ("c", 1, 2222)]


def test_versions_windows_and_tasks(spark):
    jobs = spark.createDataFrame([("c", "u", "a", 1, 1, "v", 10), ("c", "u", "a", 1, 2, None, 20), ("c", "u", "a", 2, 3, "w", 30)], "cluster string, user string, app string, run_id long, job_seq long, version string, submit long")
    assert [r.job_seq for r in flows.of_version(jobs, "v").orderBy("job_seq").collect()] == [1, 2]
    assert [r.job_seq for r in flows.submitted_between(jobs, 10, 30).orderBy("job_seq").collect()] == [1, 2]
    tasks = spark.createDataFrame([(1, "t1"), (1, "t2"), (9, "t3")], "job_seq long, task_id string")
    assert sorted((r.job_seq, r.task_id or "") for r in flows.flow_task_rows(jobs, tasks).collect()) == [(1, "t1"), (1, "t2"), (2, ""), (3, "")]


def test_jobs_to_process_again(spark):
    raw = spark.createDataFrame([(1, 5, 5, "true", None), (2, 5, 5, "true", "true"), (3, 5, 5, "true", None)], "job_seq long, conf_mtime long, history_mtime long, success string, reprocess string")
    chosen = spark.createDataFrame([(1,), (1,), (7,)], "job_seq long")
    marked = files.to_reprocess(raw, chosen)
    assert sorted(r.job_seq for r in files.pending(marked).collect()) == [1, 2] and marked.columns == raw.columns
    assert [r.job_seq for r in files.pending(files.to_reprocess(marked, chosen, again=False)).collect()] == [2]


def test_json_files(spark, tmp_path):
    df = spark.createDataFrame([("c", 1, 2)], "cluster string, submit long, cost long")
    edge.write_json(df, str(tmp_path / "all"))
    edge.write_json(df, str(tmp_path / "some"), "FLOW_SUMMARY_STATS_ONLY", ["submit", "cost"])
    read = lambda name: json.loads(spark.read.text(str(tmp_path / name)).first().value)
    assert read("all") == {"cluster": "c", "submit": 1, "cost": 2} and read("some") == {"cost": 2}


def test_history_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in (1, 2):
        (tmp_path / "in" / f"job_1_000{k}.jhist").write_text(history_file())
        incremental.new_files(spark, str(tmp_path / "in"), "value string", str(tmp_path / "mark"), str(tmp_path / "out"), "text", wholetext="true").awaitTermination()
    texts = spark.read.parquet(str(tmp_path / "out")).select(F.lit("f").alias("job_file"), F.col("value").alias("content"))
    assert texts.count() == 2 and history.events(texts).count() == 98
