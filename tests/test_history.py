import json

import pytest
from pyspark.sql import functions as F

from jobtrail.sources import edge, history
from jobtrail.streaming import incremental


def event(kind, **body):
    return json.dumps({"type": kind, "event": {"org.apache.hadoop.mapreduce.jobhistory.X": body}})


# Names of events and counters of the file format.
COUNTS = {"name": "TOTAL", "groups": [{"name": "G", "displayName": "g", "counts": [{"name": "MB_MILLIS_MAPS", "displayName": "m", "value": 178169856}]}]}
LINES = [
    "Avro-Json",
    json.dumps({"type": "record", "name": "Event"}),
    event("JOB_SUBMITTED", jobid="job_1_0001", submitTime=1329348443227, jobQueueName="root.q", userName="user"),
    "",
    event("TASK_STARTED", taskid="task_1_0001_m_000001", taskType="MAP", startTime=5),
    event("TASK_FINISHED", taskid="task_1_0001_m_000001", taskType="MAP", finishTime=9, status="SUCCEEDED", counters=COUNTS),
    event("SETUP_ATTEMPT_FINISHED", taskid="task_1_0001_m_000002"),
    event("JOB_FINISHED", jobid="job_1_0001", finishTime=1329348468601, totalCounters=COUNTS),
]


def test_events(spark):
    texts = spark.createDataFrame([("f", "\n".join(LINES))], "job_file string, content string")
    parsed = history.events(texts)
    assert parsed.count() == 5
    rows = {r.row_key: r["values"] for r in history.collapsed(history.fields(parsed)).collect()}
    assert rows[""]["QUEUE"] == "root.q" and rows[""]["FINISH_TIME"] == "1329348468601"
    assert rows["0001_m_000001"] == {"TASKID": "task_1_0001_m_000001", "TASK_TYPE": "MAP", "START_TIME": "5", "FINISH_TIME": "9", "TASK_STATUS": "SUCCEEDED"}
    assert {(r.scope, r.name, r.value) for r in history.counters(parsed).collect()} == {("task", "MB_MILLIS_MAPS", 178169856), ("job", "MB_MILLIS_MAPS", 178169856)}
    assert history.submit_times(texts).first().submit_time == 1329348443227


def test_wrong_head_fails(spark):
    with pytest.raises(Exception, match="Avro-Json"):
        history.events(spark.createDataFrame([("f", "Meta VERSION=1 .")], "job_file string, content string")).count()


def test_configuration_and_files(spark):
    xml = "<configuration><property><name>a</name><value>1</value></property><property><name>b</name><value/></property><property><name>a</name><value>2</value></property></configuration>"
    assert history.configurations(spark.createDataFrame([("j", xml)], "job_id string, content string")).first().conf == {"a": "2", "b": ""}
    names = ["/d/job_201306192120_0003_conf.xml", "/d/job_201306192120_0003_1371677567027_u_Sleep+job", "/d/job_1_0002-13-u-Sleep-1.jhist", "/d/other.txt", "/d/.job_1_1_conf.xml.crc"]
    got = {r.path: (r.kind, r.job_id) for r in history.classified(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {names[0]: ("conf", "job_201306192120_0003"), names[1]: ("history", "job_201306192120_0003"), names[2]: ("history", "job_1_0002"), names[3]: ("other", None)}


def test_edge(spark):
    df = spark.range(1).select(F.lit(1).alias("submit"), F.lit("x").alias("queue"), F.create_map(F.lit("a.queue"), F.lit("q"), F.lit("b"), F.lit("c")).alias("conf"))
    assert edge.stats_only(df).columns == ["queue", "conf"] and edge.projected(df, ["queue"]).columns == ["queue"]
    assert df.select(edge.conf_of_queues(F.col("conf"))).first()[0] == {"a.queue": "q"}
    assert df.select(edge.conf_matching(F.col("conf"), ["b", "x.*"])).first()[0] == {"b": "c"}
    assert json.loads(edge.as_json(df.select("queue")).first().json) == {"queue": "x"}


def test_streams(spark, tmp_path):
    jobs = spark.createDataFrame([(1_000_000 + k, "c", "u", "a", k % 3) for k in range(9)], "t bigint, cluster string, user string, app string, run_id bigint").select(F.timestamp_seconds("t").alias("at"), "cluster", "user", "app", "run_id")
    jobs.write.parquet(str(tmp_path / "in/1"))
    run = lambda: incremental.new_files(spark, str(tmp_path / "in"), jobs.schema, str(tmp_path / "c1"), str(tmp_path / "raw")).awaitTermination()
    run()
    jobs.write.parquet(str(tmp_path / "in/2"))
    run()
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 18
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "raw"))
    incremental.daily_counts(incremental.first_of_runs(stream), str(tmp_path / "c2"), str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("runs")).first()[0] == 3
