from pyspark.sql import functions as F

from jobtrail.functions import scalars as S
from jobtrail.sources import edge


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def conf(**pairs):
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in (kv[0].replace("__", "."), kv[1]))) if pairs else F.create_map(F.lit("none"), F.lit(""))


def test_xmx(spark):
    wanted = {"-Xmx500m": 500, "-Xmx2048K": 2, "-Xmx2G": 2048, "-Xmx2G -server -Xmx4G": 2048, "-Xmx2097152": 2, None: 1024, "-server": 1024, "-Xmx5z": None}
    rows = spark.createDataFrame([(k,) for k in wanted], "o string").select("o", S.xmx_mb(F.col("o")).alias("x")).collect()
    assert {r.o: r.x for r in rows} == wanted
    assert one(spark, S.xmx_total_mb(F.lit(500))) == 666 and one(spark, S.xmx_total_mb(F.lit(2048))) == 2730


def test_names(spark):
    assert one(spark, S.pig_app_name(F.col("n")), n="PigLatin:daily_job:daily_2012/06/22-00:00:00") == "oink daily_job:daily"
    assert one(spark, S.cleanse_token(S.mr_app_name(F.col("n"))), n="Crazy Job name! : test 1 2 3!") == "Crazy_Job_name__:_test_1_2_3_"
    assert one(spark, S.scalding_app_name(F.col("n")), n="[AB/CD] com.example.xyz.AbcPqr/(1/4)") == "com.example.xyz.AbcPqr"
    assert one(spark, S.app_id(conf(mapred__job__name="a job"))) == "a_job"
    assert one(spark, S.app_id(conf(batch__desc="b!", mapred__job__name="a job"))) == "b_"
    assert one(spark, S.app_id(conf())) == ""


def test_run_ids(spark):
    at = F.lit(1000).cast("bigint")
    assert one(spark, S.pig_run_id(conf(pig__logfile="pig_1340659035863.log"), at)) == 1340659035863
    assert one(spark, S.pig_run_id(conf(pig__logfile="other.log"), at)) == 0
    assert one(spark, S.pig_run_id(conf(), at)) == 1000
    assert one(spark, S.scalding_run_id(conf(cascading__flow__id="FFFFFFFFFFFFFFFF"), at)) == 1000
    assert one(spark, S.scalding_run_id(conf(cascading__flow__id="10"), at)) == 16
    assert one(spark, S.inverted_run_id(S.inverted_run_id(F.lit(5).cast("bigint")))) == 5


def test_queue_chain(spark):
    user = F.lit("me")
    assert one(spark, S.queue_name(conf(mapreduce__job__queuename="q2", mapred__fairscheduler__pool="p"), user)) == "q2"
    assert one(spark, S.queue_name(conf(mapred__fairscheduler__pool="p", mapred__job__queue__name="c"), user)) == "p"
    assert one(spark, S.queue_name(conf(mapred__job__queue__name="c"), user)) == "c"
    assert one(spark, S.queue_name(conf(), user)) == "DEFAULT_QUEUE"
    assert one(spark, S.queue_name(conf(mapreduce__job__queuename="default"), user)) == "me"


def test_buckets_and_cost(spark):
    assert one(spark, S.day_bucket(F.lit(1402698420000))) == 1402617600000
    assert one(spark, S.week_bucket(F.lit(1402698420000))) == 1402185600000
    assert one(spark, S.job_cost(F.lit(100), F.lit(0.0), F.lit(0))) == 0
    assert abs(one(spark, S.job_cost(F.lit(100), F.lit(20.0), F.lit(512))) - 4.521e-8) < 1e-10
    assert one(spark, S.approximate_submit_time(F.lit(1396550668000))) == 1396547068000
    assert one(spark, S.megabyte_millis(*map(F.lit, (1, 0, 1, 0, 512, 1329348448308, 1329348468601)), F.lit(False))) == 10390016


def test_job_ids(spark):
    assert one(spark, S.format_job_id(F.lit(12), F.lit(7))) == "job_12_0007"
    assert one(spark, S.format_job_id(F.lit(12), F.lit(123456))) == "job_12_123456"
    assert one(spark, S.job_seq(F.col("j")), j="job_12_0007") == 7
    assert edge.decode_cursor(edge.encode_cursor("c", "u", "a", 33)) == ("c", "u", "a", 33)


def test_runs_hosts_tasks_and_manifests(spark):
    conf = F.create_map(F.lit("yarn.resourcemanager.address"), F.lit(" "), F.lit("mapred.job.tracker"), F.lit("jt.example:8021"), F.lit("mapred.app.submitted.timestamp"), F.lit("x"))
    r = spark.range(1).select(
        S.cluster_host(conf).alias("a"), S.mr_run_id(conf, F.lit(9)).alias("b"), S.task_key(F.lit("attempt_201206201718_0003_m_000000_0")).alias("c"), S.hour_bucket(F.lit(7201)).alias("d"),
        S.safe_long(F.lit("12x")).alias("e"), S.safe_long(F.lit("12")).alias("f"), S.manifest_name(F.lit("dc 1@x"), F.lit(0), F.lit(3)).alias("g"), S.approximate_submit_time(F.lit(3_600_001)).alias("h"),
    ).first()
    assert r.a == "jt.example" and r.b == 9 and r.d == 7200 and (r.e, r.f) == (0, 12) and r.g == "dc1x-19700101000000-3" and r.c.startswith(("m_", "0003_m_"))
    assert r.h <= 3_600_001
