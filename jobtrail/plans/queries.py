"""The query catalogue over the test tables, and for each query the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions import scalars
from jobtrail.operators import apps, files, flows, partials, progress, storage
from jobtrail.plans import adapters as A
from jobtrail.sources import edge, process_log, raw_store, side, sinks
from jobtrail.sources.folders import shared
from jobtrail.streaming.follow import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Parameters of the catalogue.
FROM, TO = 788918400000, 852076800000  # 1995-01-01 and 1997-01-01
ONE_JOB = 7
DAY = 86400000

JOBS = """
spans as (select l_orderkey job_seq, min(epoch_ms(l_shipdate)) launch, max(epoch_ms(l_shipdate)) finish, count(*) total_maps, sum(cast(trunc(l_quantity) as bigint))::bigint slot_millis from lineitem group by 1),
jobs as (select r_name cluster, c_mktsegment "user", o_orderpriority app, epoch_ms(date_trunc('month', o_orderdate)::timestamp) run_id, o_orderkey job_seq, o_orderstatus status, n_name queue,
  cast(year(o_orderdate) as varchar) "version", epoch_ms(o_orderdate) submit, cast(round(o_totalprice * 100) as bigint) mb_millis, launch, finish, coalesce(total_maps, 0)::bigint total_maps, coalesce(slot_millis, 0)::bigint slot_millis
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join spans on o_orderkey = job_seq)
"""
TASKS = "tasks as (select l_orderkey job_seq, cast(trunc(l_quantity) as bigint) slot_millis, epoch_ms(l_shipdate) finish, l_linestatus task_status from lineitem)"
COUNTERS = 'counters as (select l_orderkey job_seq, l_returnflag "group", l_linestatus "name", cast(trunc(l_quantity) as bigint) "value" from lineitem)'
EV = """
ev as (select event_type cluster, cast(user_id % 10 as varchar) "user", cast(user_id % 3 as varchar) app, epoch_ms(date_trunc('hour', ts)::timestamp) run_id, event_id job_seq,
  cast(json_extract_string(props, '$.k') as bigint) % 4 || '' queue, cast(round(value * 100) as bigint) mb_millis, 1 total_maps, cast(json_extract_string(props, '$.k') as bigint) slot_millis from events)
"""
FLOW = 'cluster, "user", app, run_id'
APP = 'cluster, "user", app'
ROLLUP = """count(*)::bigint job_count, sum(total_maps)::bigint total_maps, sum(slot_millis)::bigint slot_millis, sum(mb_millis)::bigint mb_millis,
  arg_min(queue, {'a': submit, 'b': job_seq}) queue, arg_max("version", job_seq) "version" """
AGG = """count(*)::bigint total_jobs, count(distinct run_id)::bigint number_runs, sum(total_maps)::bigint total_maps, sum(slot_millis)::bigint slot_millis, sum(mb_millis)::bigint mb_millis, string_agg(distinct queue, '!' order by queue) queues"""
JOB_COLUMNS = 'cluster, "user", app, run_id, job_seq, status, queue, "version", submit, mb_millis, launch, finish, total_maps, slot_millis'
WIDE = JOBS + """, wide as (select *, total_maps % 3 total_reduces, total_maps * 100 map_file_bytes_read, total_maps * 50 map_file_bytes_written, (total_maps % 3) * 70 reduce_file_bytes_read, slot_millis * 1024 hdfs_bytes_read,
  slot_millis * 512 + job_seq % 7 hdfs_bytes_written, slot_millis map_slot_millis, slot_millis * 3 reduce_slot_millis, mb_millis % 1000 "cost", (total_maps % 3) * 30 reduce_shuffle_bytes, case job_seq % 3 when 0 then 'ONE' when 1 then 'TWO' end hadoop_version from jobs)
"""
SUMS = ", ".join(f'sum("{m}")::bigint "{m}"' for m in flows.MEASURES)
DERIVED = "derived as (select * from (values " + ", ".join(f"({k}, '{m}', '{scope}', '{g}', '{name}')" for k, (m, scope, g, name) in enumerate((m, s, g, n) for m, s, gs, n in flows.DERIVED for g in gs)) + ") v(k, measure, scope, grp, nam))"
SCOPED = DERIVED + f', scoped as (select l_orderkey job_seq, scope, grp, nam, cast(trunc(l_quantity) as bigint) "value" from lineitem join derived on l_partkey % {2 * len(flows.DERIVED)} = k)'
STORAGE = ", ".join(f'sum("{m}")::bigint "{m}"' for m in storage.MEASURES)
HDFS = """
usage as (select event_type cluster, '/user/' || (user_id % 10) path, ((epoch_us(ts) // 1000) // 1000) - ((epoch_us(ts) // 1000) // 1000) % 3600 "hour", cast(cast(json_extract_string(props, '$.k') as bigint) % 3 as varchar) namespace,
  cast(round(value * 100) as bigint) space_consumed, cast(json_extract_string(props, '$.k') as bigint) access_count, cast(user_id as varchar) "owner", 1 file_count,
  cast(json_extract_string(props, '$.k') as bigint) k, k % 5 dir_count, k * 10 quota, k * 1000 space_quota, k % 7 tmp_file_count, k % 11 tmp_space_consumed, k % 3 trash_file_count, k % 13 trash_space_consumed, k * 2 access_cost, k * 3 storage_cost from events),
rolled as (select cluster, path, "hour", STORAGE_SUMS, arg_max("owner", {'a': namespace, 'b': "owner"}) "owner" from usage group by 1, 2, 3)
""".replace("STORAGE_SUMS", STORAGE)
QUEUE = """
, q as (select cluster, case status when 'O' then 'r' when 'F' then 's' else 'f' end status, submit "at", job_seq flow_id, "user" username, app flowname from jobs)
"""
EVENTS = """
fe as (select cast(user_id as varchar) "user", event_type app, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 86400000 run_id, event_id "sequence", (epoch_us(ts) // 1000) "at", props data from events)
"""
CONF = """
k as (select event_id, user_id, ts, cast(json_extract_string(props, '$.k') as bigint) k from events)
"""
RAW = """
hist as (select l_orderkey job_seq, min(epoch_ms(l_shipdate)) history_mtime from lineitem group by 1),
raw as (select coalesce(o_orderkey, hist.job_seq) job_seq, epoch_ms(o_orderdate) conf_mtime, history_mtime, case o_orderstatus when 'F' then 'true' when 'O' then 'false' end success,
  case when coalesce(o_orderkey, hist.job_seq) % 11 = 0 then 'true' end reprocess from orders full join hist on o_orderkey = hist.job_seq)
"""
RECORDS = """
rec as (select d "day", max(t) max_mtime, min(t) min_mtime, count(*)::bigint files, min(o_orderkey) min_job, max(o_orderkey) max_job, cast((d // 86400000) % 4 as integer) state, '/process/' || d manifest
  from (select o_orderkey, epoch_ms(o_orderdate) t, epoch_ms(o_orderdate) - epoch_ms(o_orderdate) % 86400000 d from orders) group by d)
"""


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"with {JOBS} select {FLOW}, {ROLLUP} from jobs group by {FLOW}")
def flow_rollup(spark, d):
    return flows.flow_rollup(A.jobs(spark, d))


@query(f"with {JOBS}, g as (select {FLOW}, min(nullif(submit, 0)) submit, min(nullif(launch, 0)) launch, max(finish) finish from jobs group by {FLOW}) select *, finish - launch duration, finish - submit wall_clock from g")
def flow_wallclock(spark, d):
    return flows.flow_wallclock(A.jobs(spark, d))


@query(f"with {JOBS}, z as (select * replace (case when job_seq % 7 = 0 then 0 else run_id end as run_id) from jobs), o as (select *, case when run_id = 0 then job_seq else 0 end own_job from z) select {FLOW}, own_job, {ROLLUP} from o group by {FLOW}, own_job")
def flow_rollup_zero_run(spark, d):
    return flows.flow_rollup_zero_run(A.jobs(spark, d).withColumn("run_id", F.when(F.col("job_seq") % 7 == 0, 0).otherwise(F.col("run_id"))))


@query(f'with {JOBS}, {COUNTERS} select {FLOW}, "group", "name", sum("value")::bigint "value" from counters join jobs using (job_seq) group by all')
def flow_counters(spark, d):
    return flows.flow_counters(A.jobs(spark, d), A.counters(spark, d))


SERIES = f"with {JOBS}, s as (select {JOB_COLUMNS}, cast(dense_rank() over (partition by {APP} order by run_id desc) as integer) flow_rank from jobs where run_id > {FROM} and run_id <= {TO})"


@query(f"{SERIES} select * from s where flow_rank <= 3")
def flow_series(spark, d):
    return flows.flow_series(A.jobs(spark, d), 3, FROM, TO)


@query(f"with {JOBS}, s as (select {JOB_COLUMNS}, cast(dense_rank() over (partition by {APP} order by run_id desc) as integer) flow_rank from jobs) select * from s where flow_rank <= 1")
def latest_flow(spark, d):
    return flows.latest_flow(A.jobs(spark, d))


@query(f"with {JOBS} select {JOB_COLUMNS} from jobs where cluster = 'ASIA' and \"user\" = 'BUILDING' and app = '1-URGENT' and run_id = {FROM}")
def flow_by_key(spark, d):
    return flows.flow_by_key(A.jobs(spark, d), "ASIA", "BUILDING", "1-URGENT", FROM)


@query(f"with {JOBS} select {JOB_COLUMNS} from jobs where ({FLOW}) in (select ({FLOW}) from jobs where job_seq = {ONE_JOB})")
def flow_by_job_id(spark, d):
    return flows.flow_by_job_id(A.jobs(spark, d), ONE_JOB)


@query(f"""with {JOBS}, g as (select {FLOW}, {ROLLUP} from jobs where run_id <= {TO} group by {FLOW}), p as (select *, cast(row_number() over (partition by {APP} order by run_id desc) as integer) place from g),
 n as (select *, max(case when place = 11 then run_id end) over (partition by {APP}) next_run_id from p where place <= 11) select * from n where place <= 10""")
def flow_stats_page(spark, d):
    return flows.flow_stats_page(A.jobs(spark, d), 10, TO)


@query(f"with {JOBS}, {TASKS}, t as (select job_seq, count(*) c, sum(slot_millis) s from tasks group by 1) select {FLOW}, job_seq, coalesce(c, 0)::bigint task_count, coalesce(s, 0)::bigint task_slot_millis from jobs left join t using (job_seq)")
def flow_with_tasks(spark, d):
    return flows.flow_with_tasks(A.jobs(spark, d), A.tasks(spark, d))


@query(f"with {JOBS}, {TASKS} select j.*, slot_millis, finish, task_status from (select {FLOW}, job_seq from jobs) j left join tasks using (job_seq)")
def flow_task_rows(spark, d):
    return flows.flow_task_rows(A.jobs(spark, d), A.tasks(spark, d))


@query(f"with {JOBS} select {JOB_COLUMNS} from jobs where \"version\" = '1995' or \"version\" is null")
def jobs_of_version(spark, d):
    return flows.of_version(A.jobs(spark, d), "1995")


@query(f"with {JOBS} select {JOB_COLUMNS} from jobs where job_seq = {ONE_JOB}")
def job_by_id(spark, d):
    return flows.job_by_id(A.jobs(spark, d), ONE_JOB)


@query(f"with {TASKS} select * from tasks where job_seq = {ONE_JOB}")
def job_tasks(spark, d):
    return flows.job_tasks(A.tasks(spark, d), ONE_JOB)


@query(f"""with {WIDE}, {SCOPED}, v as (select job_seq, coalesce(hadoop_version, 'ONE') hadoop_version from wide)
 select v.job_seq, hadoop_version, {", ".join(f"coalesce(sum(\"value\") filter (measure = '{m}'), 0)::bigint {m}" for m, *_ in flows.DERIVED)}
 from v left join (select s.*, measure, case when k % 2 = 0 then 'ONE' else 'TWO' end scheme from scoped s join derived using (scope, grp, nam)) x on v.job_seq = x.job_seq and hadoop_version = scheme group by 1, 2""")
def job_details_projection(spark, d):
    return flows.job_details(A.jobs_wide(spark, d), A.scoped_counters(spark, d))


@query(f"""with {WIDE} select {FLOW}, count(*)::bigint job_count, {SUMS}, arg_min(queue, {{'a': submit, 'b': job_seq}}) queue, arg_min_null(hadoop_version, {{'a': submit, 'b': job_seq}}) hadoop_version, arg_max("version", job_seq) "version" from wide group by {FLOW}""")
def flow_sums(spark, d):
    return flows.flow_sums(A.jobs_wide(spark, d))


@query(f'with {JOBS}, {SCOPED} select {FLOW}, scope, grp "group", nam "name", sum("value")::bigint "value" from scoped join jobs using (job_seq) group by all')
def flow_counters_by_scope(spark, d):
    return flows.flow_counters_by_scope(A.jobs(spark, d), A.scoped_counters(spark, d))


@query(f"""with t as (select l_orderkey job_seq, l_linenumber n, l_returnflag "type", l_linestatus status, l_suppkey s, epoch_ms(l_shipdate) ship from lineitem)
 select job_seq, 'task_' || n task_id, "type", status, 'attempt_' || n attempt_id, 'tracker_' || status tracker_name, 'host' || s hostname, '' state, null::varchar "error", ship start_time, ship + n * 1000 finish_time,
  case when n % 2 = 0 then n else 0 end::bigint shuffle_finished, 0::bigint sort_finished, s::bigint http_port, case n when 1 then [] when 2 then ['a', 'b', '2'] else [n::varchar] end splits from t""")
def task_details(spark, d):
    return flows.task_details(A.raw_tasks(spark, d))


@query(f'with {COUNTERS} select job_seq, "group", "name", sum("value")::bigint "value" from counters where "group" || \'.\' || "name" in (\'A.F\', \'N.O\') group by all')
def counter_include_filter(spark, d):
    return flows.counter_include(A.counters(spark, d), ["A.F", "N.O"])


@query(f"with {JOBS}, {TASKS} select 'jobs' kind, count(*)::bigint n from jobs where job_seq % 100 <> 7 union all select 'tasks', count(*)::bigint from tasks where job_seq not in (select job_seq from jobs where job_seq % 100 = 7)")
def remove_job(spark, d):
    jobs, tasks = A.jobs(spark, d), A.tasks(spark, d)
    left = flows.remove_job(jobs, tasks, jobs.where("job_seq % 100 = 7"))
    return left[0].agg(F.lit("jobs").alias("kind"), F.count("*").alias("n")).unionByName(left[1].agg(F.lit("tasks").alias("kind"), F.count("*").alias("n")))


@query(f"with {EV} select run_id - run_id % {DAY} bucket, {APP}, {AGG} from ev group by all")
def app_agg_daily(spark, d):
    return apps.app_agg_daily(A.jobs_ev(spark, d))


@query(f"with {EV} select (run_id // {DAY} - (run_id // {DAY} + 4) % 7) * {DAY} bucket, {APP}, {AGG} from ev group by all")
def app_agg_weekly(spark, d):
    return apps.app_agg_weekly(A.jobs_ev(spark, d))


EARLY, LATE = 1704412800000, 1705708800000  # 2024-01-05 and 2024-01-20


@query(f"""with {EV}, daily as (select run_id - run_id % {DAY} bucket, {APP}, {AGG} from ev group by all), s as (select * from daily where bucket between {EARLY} and {LATE}),
 q as (select {APP}, string_agg(distinct x, '!' order by x) queues from (select {APP}, unnest(string_split(queues, '!')) x from s) group by all)
 select {APP}, min(bucket) first_day, max(bucket) last_day, sum(total_jobs)::bigint total_jobs, sum(number_runs)::bigint number_runs, sum(mb_millis)::bigint mb_millis, any_value(q.queues) queues from s join q using ({APP}) group by {APP}""")
def all_apps_summary(spark, d):
    return apps.all_apps_summary(apps.app_agg_daily(A.jobs_ev(spark, d)), EARLY, LATE)


VERSIONS = f'versions as (select {APP}, "version", min(submit) first_seen from jobs group by all)'


@query(f"with {JOBS}, {VERSIONS} select * from versions")
def app_versions(spark, d):
    return apps.app_versions(A.jobs(spark, d))


@query(f"""with {JOBS}, {VERSIONS} select {APP}, arg_max("version", {{'a': first_seen, 'b': "version"}}) "version", max(first_seen) first_seen, count(*)::bigint versions from versions group by {APP}""")
def latest_version(spark, d):
    return apps.latest_version(apps.app_versions(A.jobs(spark, d)))


@query(f"with {JOBS}, {VERSIONS} select * from versions order by {APP}, first_seen desc, \"version\" desc")
def versions_newest_first(spark, d):
    return apps.versions_newest_first(apps.app_versions(A.jobs(spark, d)))


@query(f"""with {WIDE}, f as (select {FLOW}, count(*)::bigint job_count, {SUMS}, arg_min(queue, {{'a': submit, 'b': job_seq}}) queue from wide group by {FLOW})
 select {APP}, count(*)::bigint number_runs, sum(job_count)::bigint total_jobs, sum(total_maps)::bigint total_maps, sum(total_reduces)::bigint total_reduces, sum(map_slot_millis)::bigint map_slot_millis, sum(reduce_slot_millis)::bigint reduce_slot_millis,
  sum(mb_millis)::bigint mb_millis, string_agg(distinct queue, '!' order by queue) queues, min(run_id) first_run, max(run_id) last_run from f group by {APP}""")
def app_summary(spark, d):
    return apps.app_summary(flows.flow_sums(A.jobs_wide(spark, d)))


@query(f"with {WIDE} select run_id - run_id % {DAY} bucket, {APP}, count(*)::bigint total_jobs, count(distinct run_id)::bigint number_runs, {SUMS}, sum(slot_millis)::bigint slot_millis, string_agg(distinct queue, '!' order by queue) queues from wide group by all")
def app_agg_daily_sums(spark, d):
    return apps.app_agg_daily(A.jobs_wide(spark, d))


@query(f'with {WIDE} select run_id - run_id % {DAY} bucket, {APP}, sum("cost")::bigint "cost" from wide group by all')
def app_cost_daily(spark, d):
    return apps.app_cost(A.jobs_wide(spark, d), scalars.day_bucket(F.col("run_id")))


@query(f'with {WIDE} select "user", count(*)::bigint jobs, sum(hdfs_bytes_written)::bigint hdfs_bytes_written, sum(total_reduces)::bigint total_reduces from wide group by 1 order by hdfs_bytes_written desc, "user" limit 3')
def job_statistics_by_user(spark, d):
    return apps.job_statistics(A.jobs_wide(spark, d), ["hdfs_bytes_written", "total_reduces"], order="hdfs_bytes_written", limit=3)


@query(f"with {RECORDS} select * from rec where state <> 2")
def process_records_of_other_states(spark, d):
    return files.records_by_state(A.process_records(spark, d), 2, other=True)


@query(f'with {RECORDS} select *, sum(files) over (order by max_mtime, manifest)::bigint files_so_far from rec order by max_mtime, manifest')
def process_records_listing(spark, d):
    return files.records_listing(A.process_records(spark, d))


@query(f"""with {CONF}, f as (select event_id, k, epoch_us(ts) // 1000 submit, case k % 3 when 0 then 'PIG' when 1 then 'SCALDING' else 'NONE' end framework, user_id, ts from k)
 select event_id, k, framework, translate(case when k % 5 = 0 then 'batch! ' || k when k % 2 = 0 and framework = 'PIG' then 'job ' || k || ' [step]' when k % 2 = 0 then 'job ' || k || ' ' else 'name ' || k end, ' !', '__') app,
  case framework when 'PIG' then case when k % 9 = 0 then 1700000000000 + k else submit end when 'SCALDING' then case when k % 7 = 1 then 1600000000000 + k else epoch_ms(date_trunc('month', ts)::timestamp) + ('0xAB' || k)::bigint % (30 * {DAY}::bigint) end
   else case when k % 7 = 2 then 1500000000000 + k else submit end end::bigint run_id,
  case when framework = 'PIG' and k % 6 = 0 then 'v' || k when framework = 'SCALDING' and k % 6 = 4 then 'sig' || k else '' end "version",
  case k % 4 when 0 then 'u' || (user_id % 10) when 1 then 'q' || k when 2 then 'pool' || k else 'DEFAULT_QUEUE' end queue, 'u' || (user_id % 10) "user", submit from f""")
def job_rows(spark, d):
    rows = side.job_row(A.conf(spark, d, full=True).select("event_id", "k", "conf", A.ms("ts").alias("submit")))
    return rows.select("event_id", "k", "framework", "app", "run_id", "version", "queue", "user", "submit")


BEGIN, SOON = 788918400000, 789350400000  # 1995-01-01 and five days later


@query(f"with {JOBS}, {VERSIONS} select {APP}, min(first_seen) first_seen from versions group by {APP} having min(first_seen) between {BEGIN} and {SOON}")
def new_app_keys(spark, d):
    return apps.new_app_keys(apps.app_versions(A.jobs(spark, d)), BEGIN, SOON)


@query(f"""with {JOBS}, k as (select {APP}, min(submit) first_seen from jobs group by {APP} having min(submit) between {BEGIN} and {TO}), r as (select {APP}, count(distinct run_id) runs, count(*) n, sum(mb_millis) m from jobs where run_id > {BEGIN} and run_id <= {TO} group by {APP})
 select {APP}, first_seen, coalesce(runs, 0)::bigint number_runs, coalesce(n, 0)::bigint total_jobs, coalesce(m, 0)::bigint mb_millis from k left join r using ({APP})""")
def new_apps(spark, d):
    return apps.new_apps(A.jobs(spark, d), BEGIN, TO)


@query(f'with {JOBS} select "user", app, count(*)::bigint jobs, sum(mb_millis)::bigint mb_millis, sum(slot_millis)::bigint slot_millis from jobs group by 1, 2 order by mb_millis desc, "user", app limit 20')
def job_level_statistics(spark, d):
    return apps.job_level_statistics(A.jobs(spark, d), 20)


@query(f"with {CONF} select event_id, (epoch_us(ts) // 1000) submit from k where k % 3 = 0 and (epoch_us(ts) // 1000) >= {EARLY} and (epoch_us(ts) // 1000) < {LATE}")
def find_framework(spark, d):
    c = A.conf(spark, d).select("event_id", A.ms("ts").alias("submit"), scalars.framework(F.col("conf")).alias("framework"))
    return flows.submitted_between(c.where(F.col("framework") == "PIG"), EARLY, LATE).select("event_id", "submit")


@query(f"with {JOBS}, p as (select job_seq, case when job_seq % 10 = 0 then null when job_seq % 10 = 1 then '' else cast(job_seq as varchar) end job_id from jobs) select job_seq from p where job_id is null or job_id = ''")
def partial_jobs(spark, d):
    k = F.col("job_seq") % 10
    j = A.jobs(spark, d).select("job_seq", F.when(k == 1, "").when(k != 0, F.col("job_seq").cast("string")).alias("job_id"))
    return files.partial_jobs(j).select("job_seq")


@query(f"with {RAW} select job_seq, conf_mtime, history_mtime, success, reprocess from raw where conf_mtime is null or history_mtime is null")
def partial_raw(spark, d):
    return files.partial(A.raw_status(spark, d))


@query(f"with {RAW} select job_seq, conf_mtime, history_mtime, success, reprocess from raw where coalesce(conf_mtime, 0) > 0 and coalesce(history_mtime, 0) > 0 and (coalesce(reprocess, '') = 'true' or coalesce(success, '') <> 'true')")
def raw_pending_jobs(spark, d):
    return files.pending(A.raw_status(spark, d))


@query(f"with {RAW} select o_orderkey job_seq, epoch_ms(o_orderdate) conf_mtime, hist.history_mtime from orders join hist on o_orderkey = job_seq")
def paired_raw_files(spark, d):
    confs = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_seq"), A.ms("o_orderdate").alias("conf_mtime"))
    return files.paired(confs, A.tasks(spark, d).groupBy("job_seq").agg(F.min("finish").alias("history_mtime")))


@query(f"with {RECORDS} select * from rec where state = 2")
def process_records_by_state(spark, d):
    return files.records_by_state(A.process_records(spark, d), 2, "/process/")


@query(f"with {RECORDS} select * from rec where state <> 0 order by max_mtime desc limit 1")
def latest_process_record(spark, d):
    return files.latest_record(A.process_records(spark, d))


@query(f"with {RECORDS} select count(*)::bigint records, sum(files)::bigint files, min(min_mtime) oldest from rec")
def process_records_total(spark, d):
    return A.process_records(spark, d).agg(F.count("*").alias("records"), F.sum("files").alias("files"), F.min("min_mtime").alias("oldest"))


@query("with f as (select doc_id, doc_id // 2 job_id, n_chars size from documents) select doc_id, job_id, size from f where job_id not in (select job_id from f where size > 5000)")
def prune_oversized(spark, d):
    f = A.table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 2).cast("bigint").alias("job_id"), F.col("n_chars").alias("size"))
    return files.prune_oversized(f, 5000).select("doc_id", "job_id", "size")


EVENT_FILES = "f as (select event_id id, (epoch_us(ts) // 1000) mtime, event_type from events)"


def event_files(spark, d):
    return A.table(spark, d, "events").select(F.col("event_id").alias("id"), A.ms("ts").alias("mtime"), "event_type")


@query(f"with {EVENT_FILES}, p as (select *, cast(row_number() over (partition by event_type order by mtime desc, id desc) as integer) place from f) select * from p where place <= 25")
def retain_newest(spark, d):
    return files.retain_newest(event_files(spark, d), 25, "event_type")


@query(f"with {EVENT_FILES} select id, mtime, event_type from f where mtime > {EARLY} and mtime <= {LATE}")
def modified_range(spark, d):
    return files.modified_between(event_files(spark, d), EARLY, LATE)


@query("select strftime(ts, '%Y') \"year\", strftime(ts, '%m') \"month\", strftime(ts, '%d') \"day\", count(*)::bigint files from events group by all")
def partition_by_mtime_day(spark, d):
    return event_files(spark, d).groupBy(*files.by_day(F.col("mtime"))).agg(F.count("*").alias("files"))


BATCHED = f"with {EVENT_FILES}, b as (select *, cast((row_number() over (order by mtime, id) - 1) // 1000 as bigint) batch from f)"


@query(f"{BATCHED} select batch, min(id) min_id, max(id) max_id, min(mtime) min_mtime, max(mtime) max_mtime, count(*)::bigint files from b group by batch")
def batch_min_max(spark, d):
    return files.batch_min_max(files.batches(event_files(spark, d), 1000))


@query("with b as (select o_orderkey, cast((row_number() over (order by o_orderkey) - 1) // 500 as bigint) batch from orders) select batch, min(o_orderkey) min_id, max(o_orderkey) max_id, count(*)::bigint ids from b group by batch")
def job_id_ranges(spark, d):
    ids = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 10_000).alias("mtime"))
    return files.batches(ids, 500).groupBy("batch").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count("*").alias("ids"))


@query("select user_id, arg_max(event_type, event_id) filter (event_type <> 'view') event_type, arg_max(cast(round(value * 100) as bigint), event_id) filter (value > 50) value_cents from events group by user_id")
def task_upsert_collapse(spark, d):
    e = A.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.when(F.col("value") > 50, A.cents("value")).alias("value_cents"))
    return files.upsert_collapse(e, "user_id", "event_id", ["event_type", "value_cents"])


@query(f"with {EVENTS} select * from fe where \"user\" = '7' and app = 'click'")
def flow_events(spark, d):
    return progress.events_of(A.flow_events(spark, d), "7", "click")


@query(f'with {EVENTS} select * from fe where "sequence" > 500')
def flow_events_since(spark, d):
    return progress.events_since(A.flow_events(spark, d), 500)


@query(f"with {JOBS} {QUEUE} select * from q where cluster = 'ASIA' and status = 'r'")
def flow_queue_by_status(spark, d):
    return progress.queue_by_status(A.flow_queue(spark, d), "ASIA", "r")


@query(f"with {JOBS} {QUEUE} select * from q where cluster = 'ASIA' and status = 'r' and (\"at\" < {TO} or \"at\" = {TO} and flow_id >= 0) order by \"at\" desc, flow_id limit 11")
def flow_queue_page(spark, d):
    return progress.queue_page(A.flow_queue(spark, d), "ASIA", "r", 10, (TO, 0))


@query(f"""with {JOBS} {QUEUE}, x as (select *, row_number() over (partition by cluster, username, flowname order by case status when 'r' then 1 when 's' then 2 else 3 end, "at" desc, flow_id) n from q) select cluster, username, flowname, status, flow_id from x where n = 1""")
def flow_from_queue(spark, d):
    return progress.flow_from_queue(A.flow_queue(spark, d))


@query(f"with {HDFS} select * from rolled where cluster = 'click' and starts_with(path, '/user/')")
def hdfs_dirs(spark, d):
    return storage.dirs(A.hdfs_usage(spark, d), "click", "/user/")


@query(f"with {HDFS} select * from rolled where cluster = 'click' and path = '/user/3' and \"hour\" between {EARLY // 1000} and {LATE // 1000}")
def hdfs_path_series(spark, d):
    return storage.path_series(A.hdfs_usage(spark, d), "click", "/USER/3", LATE // 1000, EARLY // 1000)


@query(f'with {HDFS} select cluster, path, max("hour") "hour", arg_max(space_consumed, "hour") space_consumed from rolled where "hour" <= {LATE // 1000} group by 1, 2')
def hdfs_latest_before(spark, d):
    return storage.latest_before(A.hdfs_usage(spark, d), LATE // 1000)


@query("select page_id, translate(url || ' !', ' !', '__') token from pages")
def cleanse_token(spark, d):
    return A.table(spark, d, "pages").select("page_id", scalars.cleanse_token(F.concat("url", F.lit(" !"))).alias("token"))


@query(f"""with {CONF} select event_id, translate(case when k % 5 = 0 then 'batch! ' || k when k % 2 = 0 then 'job ' || k || ' ' else 'name ' || k end, ' !', '__') app_id from k""")
def app_id_resolution(spark, d):
    return A.conf(spark, d).select("event_id", scalars.app_id(F.col("conf")).alias("app_id"))


@query(f"with {CONF} select event_id, case k % 3 when 0 then 'PIG' when 1 then 'SCALDING' else 'NONE' end framework from k")
def framework_detect(spark, d):
    return A.conf(spark, d).select("event_id", scalars.framework(F.col("conf")).alias("framework"))


@query(f"with {CONF} select event_id, case k % 4 when 0 then 'u' || (user_id % 10) when 1 then 'q' || k when 2 then 'pool' || k else 'DEFAULT_QUEUE' end queue from k")
def queue_resolution(spark, d):
    c = F.col("conf")
    return A.conf(spark, d).select("event_id", scalars.queue_name(c, scalars.user_name(c)).alias("queue"))


@query(f"with {CONF}, e as (select event_id, unnest([{{'a': 'mapred.job.name', 'b': case when k % 2 = 0 then 'job ' || k || ' [step]' end}}, {{'a': 'mapreduce.job.name', 'b': 'name ' || k}}]) x from k) select event_id, x.a \"key\", x.b \"value\" from e where x.b is not null")
def conf_regex_projection(spark, d):
    return A.conf(spark, d).select("event_id", F.explode(edge.conf_matching(F.col("conf"), [r"mapre.*\.job\.name"])).alias("key", "value"))


@query(f"with {JOBS} select job_seq, case job_seq % 4 when 0 then 1024 when 1 then total_maps // 1 when 2 then total_maps * 1024 else (total_maps * 4096) // 1024 end::bigint xmx from jobs")
def xmx_mb(spark, d):
    n = F.col("total_maps").cast("string")
    k = F.col("job_seq") % 4
    options = F.when(k == 1, F.concat(F.lit("-server -Xmx"), n, F.lit("m"))).when(k == 2, F.concat(F.lit("-Xmx"), n, F.lit("G -Xmx1m"))).when(k == 3, F.concat(F.lit("-Xmx"), (F.col("total_maps") * 4096).cast("string"), F.lit("K")))
    return A.jobs(spark, d).select("job_seq", scalars.xmx_mb(options).alias("xmx"))


@query(f"with {JOBS} select job_seq, case when job_seq % 5 = 0 then 512 * (finish - launch) else 1024 * slot_millis + 2048 * total_maps + 512 * (finish - launch) end::bigint mb from jobs")
def megabyte_millis(spark, d):
    c = F.col
    return A.jobs(spark, d).select("job_seq", scalars.megabyte_millis(F.lit(1024), c("slot_millis"), F.lit(2048), c("total_maps"), F.lit(512), c("launch"), c("finish"), c("job_seq") % 5 == 0).alias("mb"))


@query(f"with {JOBS}, m(machine, tco, mem) as (values ('AFRICA', 20.0::double, 512), ('ASIA', 30.0::double, 1024)) select job_seq, round(coalesce(mb_millis * tco / (mem * 86400000.0::double), 0), 6) \"cost\" from jobs left join m on cluster = machine")
def job_cost(spark, d):
    props = [("AFRICA.computecost", "20.0"), ("AFRICA.machinememory", "512"), ("ASIA.computecost", "30"), ("ASIA.machinememory", "1024"), ("EUROPE.computecost", "none")]
    costs = side.machine_costs(spark.createDataFrame(props, "key string, value string"))
    return side.with_cost(A.jobs(spark, d), costs, "cluster").select("job_seq", F.round("cost", 6).alias("cost"))


PROCESS_LOG = """
day as (select epoch_ms(o_orderdate) // 86400000 batch, min(epoch_ms(o_orderdate)) min_mtime, max(epoch_ms(o_orderdate)) max_mtime, count(*)::bigint files, min(o_orderkey) min_id, max(o_orderkey) max_id from orders group by 1),
log as (select *, 'c' || (batch % 3) cluster, 'run' || (batch // 30) run, '/m/' || batch manifest, unnest(range(0, batch % 4 + 1 + (batch % 5 = 0)::int))::int step from day),
entry as (select *, case when step > batch % 4 then 0 else step end state from log),
now as (select * from entry qualify row_number() over (partition by cluster, run, batch order by step desc) = 1)
"""


@query(f"with {PROCESS_LOG} select * from now")
def process_log_current(spark, d):
    return process_log.current(A.process_log(spark, d))


@query(f"""with {PROCESS_LOG}, m as (select cluster, coalesce(max(max_mtime) filter (state <> 0), 0) newest, min(min_mtime - 1) filter (state = 0) failed from now group by 1) select cluster, newest, least(newest, coalesce(failed, newest)) low from m""")
def process_low_water(spark, d):
    return process_log.low_water(process_log.current(A.process_log(spark, d)))


@query(f"with {PROCESS_LOG} select * from now where state = 1")
def process_todo(spark, d):
    return process_log.todo(process_log.current(A.process_log(spark, d)), process_log.LOADED)


#: When the three runs of the listing begin: 2024-01-10, 2024-01-25, and long after; a fifth of the files is seen a week late.
RUNS = (1704844800000, 1706140800000, 1893456000000)


@query(f"""with {EVENT_FILES}, seen as (select id, mtime, mtime + case when id % 5 = 0 then 7 * {DAY} else 0 end arrives from f), r as (select *, case when arrives <= {RUNS[0]} then {RUNS[0]} when arrives <= {RUNS[1]} then {RUNS[1]} else {RUNS[2]} end::bigint run_at from seen)
 select id, mtime, run_at, cast((row_number() over (partition by run_at order by mtime, id) - 1) // 700 as bigint) batch from r""")
def incremental_listing(spark, d):
    """Three runs into one folder: what their manifests have together."""
    found, folder = event_files(spark, d).select("id", "mtime"), shared(spark, "process")
    arrives = F.col("mtime") + F.when(F.col("id") % 5 == 0, 7 * DAY).otherwise(0)
    for now in RUNS:
        process_log.preprocess(found.where(arrives <= now), folder, "c", now, 700)
    return process_log.manifests(spark, folder, found).select("id", "mtime", F.substring_index("run", "-", 1).cast("bigint").alias("run_at"), "batch")


@query(ORACLE_SQL["app_agg_daily_sums"])
def app_agg_incremental(spark, d):
    """The daily sums from four batches: one of them comes twice, one after the others were put together."""
    folder = shared(spark, "aggregates")
    A.jobs_wide(spark, d).write.parquet(f"{folder}/all")
    jobs = spark.read.parquet(f"{folder}/all")
    batch = lambda k: jobs.where(F.col("job_seq") % 4 == k)
    for k in (0, 2, 1, 2):
        partials.fold(batch(k), folder, k)
    partials.compact(spark, folder)
    for k in (3, 1):
        partials.fold(batch(k), folder, k)
    return partials.merged(spark, folder, scalars.day_bucket(F.col("run_id")))


AGES = ", ".join(f"({a})" for a in storage.AGES)


@query(f"""with {HDFS}, p as (select cluster, path, "hour", space_consumed, age_days, "hour" - age_days * 86400 t from rolled, (values {AGES}) v(age_days))
 select p.cluster, p.path, p."hour", p.space_consumed, age_days, o."hour" older_hour, o.space_consumed older_space_consumed, p.space_consumed - o.space_consumed growth from p asof join rolled o on p.cluster = o.cluster and p.path = o.path and p.t >= o."hour" """)
def hdfs_older(spark, d):
    return storage.older(A.hdfs_usage(spark, d))


#: 2024-02-09, when no directory was measured any more.
AFTER = 1707436800


@query(f"""with {HDFS}, r as (select *, case when "hour" = {AFTER} then 0 else (select min(age_days) from (values {AGES}) v(age_days) where "hour" between {AFTER} - age_days * 86400 - 79200 and {AFTER} - age_days * 86400) end age from rolled where cluster = 'click' and starts_with(path, '/user/')),
 best as (select arg_min("hour", {{'a': age, 'b': -"hour"}}) "at" from r where age is not null) select r.* exclude (age) from r, best where "hour" = "at" """)
def hdfs_dirs_at(spark, d):
    return storage.dirs_at(A.hdfs_usage(spark, d), "click", "/user/", AFTER)


@query(f"""with {JOBS}, g as (select {FLOW}, {ROLLUP} from jobs group by {FLOW}) select * from g where (cluster, "user", app) > ('ASIA', 'BUILDING', '3-MEDIUM') or (cluster, "user", app) = ('ASIA', 'BUILDING', '3-MEDIUM') and run_id <= {FROM} order by {APP}, run_id desc limit 101""")
def flow_page_from_row(spark, d):
    """A page of 100 flows, and the next page's first, from the encoded key of a row on, out of flows stored in key order."""
    folder = shared(spark, "flows")
    sinks.write_flows(flows.flow_rollup(A.jobs(spark, d)), folder)
    return flows.flow_page(spark.read.parquet(folder), 100, edge.decode_cursor(edge.encode_cursor("ASIA", "BUILDING", "3-MEDIUM", FROM)))


RAW_JOBS = RAW + """, rj as (select 'c' || (job_seq % 2) cluster, job_seq % 3 + 1000 job_epoch, job_seq, 'job_' || (job_seq % 3 + 1000) || '_' || case when job_seq < 1000 then lpad(job_seq::varchar, 4, '0') else job_seq::varchar end job_id, conf_mtime, history_mtime, success, reprocess from raw)
, ready as (select * from rj where coalesce(conf_mtime, 0) > 0 and coalesce(history_mtime, 0) > 0)"""
#: Ids of a block of the test store.
IDS = 50_000
RANGED = "cluster = 'c1' and (job_epoch > 1000 or job_epoch = 1000 and job_seq >= 5001) and (job_epoch < 1002 or job_epoch = 1002 and job_seq <= 2000)"


def stored_raw(spark, d):
    folder = shared(spark, "raw")
    raw_store.write_raw(A.raw_jobs(spark, d), folder, IDS)
    return raw_store.raw_store(spark, folder)


@query(f"with {RAW_JOBS} select job_id, conf_mtime, history_mtime, success, reprocess from ready where {RANGED} and (coalesce(reprocess, '') = 'true' or coalesce(success, '') <> 'true')")
def raw_range_scan(spark, d):
    return raw_store.scan(stored_raw(spark, d), "c1", "job_1000_5001", "job_1002_2000", ids=IDS).select("job_id", "conf_mtime", "history_mtime", "success", "reprocess")


@query(f"""with {RAW_JOBS}, b as (select *, cast((row_number() over (order by job_epoch, job_seq) - 1) // 100 as bigint) batch from ready where {RANGED} and reprocess = 'true')
 select batch, arg_min(job_id, {{'a': job_epoch, 'b': job_seq}}) min_id, arg_max(job_id, {{'a': job_epoch, 'b': job_seq}}) max_id, count(*)::bigint jobs from b group by batch""")
def raw_ranges_to_reprocess(spark, d):
    return raw_store.ranges(stored_raw(spark, d), "c1", "job_1000_5001", "job_1002_2000", 100, True, IDS)


@query(f"with {RAW_JOBS} select cluster, job_id, '<conf>' || job_id || '</conf>' conf, 'history of ' || job_id history from rj where cluster = 'c1' and job_id = 'job_1001_0007'")
def raw_job_content(spark, d):
    return raw_store.of_job(stored_raw(spark, d), "c1", "job_1001_0007", IDS).select("cluster", "job_id", "conf", F.col("history").cast("string").alias("history"))


@query(ORACLE_SQL["flow_task_rows"])
def flow_task_rows_bucketed(spark, d):
    """Jobs and tasks as tables of equal buckets, joined without a shuffle of either."""
    tag, n = uuid.uuid4().hex, 16
    jobs, tasks = sinks.bucketed(A.jobs(spark, d).select(*flows.FLOW, "job_seq"), f"jobs_{tag}", "job_seq", n), sinks.bucketed(A.tasks(spark, d), f"tasks_{tag}", "job_seq", n)
    return flows.flow_task_rows(jobs, tasks)


@query(f'with {EVENTS} select * from fe where "sequence" > 500')
def flow_events_followed(spark, d):
    """Events appended in three parts and polled after each, once more at the end."""
    folder, events = shared(spark, "events"), A.flow_events(spark, d)
    bounds = (F.col("sequence") < 3000, (F.col("sequence") >= 3000) & (F.col("sequence") < 6000), F.col("sequence") >= 6000)
    for part in (*bounds, None):
        if part is not None:
            sinks.append_events(events.where(part), f"{folder}/in")
        stream = follow(spark, f"{folder}/in", 500, events.schema).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark")
        stream.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{folder}/out")


@query(f"""with {JOBS}, s as (select "user", app, mb_millis, slot_millis from jobs where (nullif(status, 'P') = 'F' or nullif(status, 'P') is null) and submit >= {FROM} and submit < {TO})
 select "user", app, count(*)::bigint jobs, sum(mb_millis)::bigint mb_millis, sum(slot_millis)::bigint slot_millis from s group by 1, 2 order by mb_millis desc, "user", app limit 20""")
def job_level_statistics_of_status(spark, d):
    jobs = A.jobs(spark, d).withColumn("status", F.nullif(F.col("status"), F.lit("P")))
    return apps.job_level_statistics(flows.submitted_between(flows.of_status(jobs, "F"), FROM, TO), 20)
