"""Job-history sources: configuration XML, Avro-JSON event files, file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions.scalars import CONF_FILE, HISTORY_FILE, submit_time_of, task_key

#: Fixed names: fields of events and what they are called in job and task rows.
FIELD_NAMES = {
    "jobid": "JOBID", "jobName": "JOBNAME", "userName": "USER", "submitTime": "SUBMIT_TIME", "jobConfPath": "JOBCONF", "jobQueueName": "QUEUE", "launchTime": "LAUNCH_TIME", "totalMaps": "TOTAL_MAPS",
    "totalReduces": "TOTAL_REDUCES", "jobStatus": "JOB_STATUS", "uberized": "UBERIZED", "finishTime": "FINISH_TIME", "finishedMaps": "FINISHED_MAPS", "finishedReduces": "FINISHED_REDUCES",
    "failedMaps": "FAILED_MAPS", "failedReduces": "FAILED_REDUCES", "priority": "JOB_PRIORITY", "taskid": "TASKID", "taskType": "TASK_TYPE", "startTime": "START_TIME", "splitLocations": "SPLITS",
    "status": "TASK_STATUS", "taskStatus": "TASK_STATUS", "attemptId": "TASK_ATTEMPT_ID", "trackerName": "TRACKER_NAME", "httpPort": "HTTP_PORT", "hostname": "HOSTNAME", "rackname": "RACKNAME",
    "state": "STATE_STRING", "error": "ERROR", "shuffleFinishTime": "SHUFFLE_FINISHED", "sortFinishTime": "SORT_FINISHED", "mapFinishTime": "MAP_FINISHED", "containerId": "CONTAINERID",
}
#: Fixed: counter blocks of an event and their scope.
COUNTER_BLOCKS = {"totalCounters": "job", "mapCounters": "map", "reduceCounters": "reduce", "counters": "task"}
COUNTER_TYPE = "struct<name:string,groups:array<struct<name:string,displayName:string,counts:array<struct<name:string,displayName:string,value:bigint>>>>>"


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Conf and history files below a folder: path, mtime, size, kind, job_id. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return classified(files.select("path", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size")))


def classified(files: DataFrame) -> DataFrame:
    """kind (conf, history or other) and job_id of each file name; checksum files go."""
    name = F.element_at(F.split("path", "/"), -1)
    files = files.withColumn("name", name).where(~F.col("name").endswith(".crc"))
    kind = F.when(F.col("name").rlike(CONF_FILE), "conf").when(F.col("name").rlike(HISTORY_FILE), "history").otherwise("other")
    job = F.when(F.col("name").rlike(CONF_FILE), F.regexp_extract("name", CONF_FILE, 1)).when(F.col("name").rlike(HISTORY_FILE), F.regexp_extract("name", HISTORY_FILE, 1))
    return files.withColumn("kind", kind).withColumn("job_id", job)


def configurations(files: DataFrame) -> DataFrame:
    """job_id and configuration map of rows (job_id, content) of XML; later entries of a key win. A row without content fails."""
    body = F.when(F.col("content").isNull(), F.raise_error(F.concat(F.lit("no configuration of "), F.coalesce("job_id", F.lit("a job without id"))))).otherwise(F.col("content").cast("string"))
    parsed = F.from_xml(body, "property array<struct<name:string,value:string>>")
    named = F.filter(F.coalesce(parsed["property"], F.array().cast("array<struct<name:string,value:string>>")), lambda p: p["name"].isNotNull())
    placed = F.array_sort(F.transform(named, lambda p, i: F.struct(F.trim(p["name"]).alias("key"), i.alias("place"), F.coalesce(p["value"], F.lit("")).alias("value"))))
    # in order of key and place, so the last of a key is the one before another key
    beside = files.select("job_id", placed.alias("own")).select("job_id", F.arrays_zip("own", F.slice("own", 2, F.greatest(F.size("own"), F.lit(1))).alias("next")).alias("both"))
    last = F.filter("both", lambda b: ~b["own"]["key"].eqNullSafe(b["next"]["key"]))
    return beside.select("job_id", F.map_from_entries(F.transform(last, lambda b: F.struct(b["own"]["key"].alias("key"), b["own"]["value"].alias("value")))).alias("conf"))


def events(texts: DataFrame) -> DataFrame:
    """job_file, ordinal, type and body of each event of rows (job_file, content).

    Files not headed by Avro-Json fail. Events may span lines or be parted by blank lines;
    types that no one knows are kept and can be counted.
    """
    body = F.col("content").cast("string")
    headed = F.when(F.lower(F.substring(body, 1, 9)) == "avro-json", body).otherwise(F.raise_error(F.lit("not an Avro-Json history file")))
    pieces = texts.select("job_file", F.posexplode(F.split(headed, r'(?=\{\s*"type"\s*:\s*"[A-Z_]+"\s*,\s*"event")')).alias("ordinal", "piece")).where("ordinal > 0")
    parsed = F.from_json(F.trim("piece"), "type string, event map<string,string>")
    return pieces.select("job_file", "ordinal", parsed.alias("e")).select("job_file", "ordinal", F.col("e.type").alias("type"), F.map_values("e.event")[0].alias("body"))


def fields(parsed: DataFrame) -> DataFrame:
    """Long rows (job_file, ordinal, type, row_key, name, value) of the scalar fields of events.

    The end of a job that finished carries no status, unlike that of one which failed or was killed: it succeeded.
    """
    values = F.from_json("body", "map<string,string>")
    ended = F.map_concat(F.map_filter(values, lambda k, _: k != "jobStatus"), F.create_map(F.lit("jobStatus"), F.lit("SUCCEEDED")))
    rows = parsed.withColumn("values", F.when(F.col("type") == "JOB_FINISHED", ended).otherwise(values))
    key = F.coalesce(task_key(F.col("values")["attemptId"]), task_key(F.col("values")["taskid"]), F.when(F.col("type") == "AM_STARTED", F.concat(F.lit("AM_"), F.col("values")["applicationAttemptId"])), F.lit(""))
    named = F.create_map(*(F.lit(x) for kv in FIELD_NAMES.items() for x in kv))
    long = rows.select("job_file", "ordinal", "type", key.alias("row_key"), F.explode("values").alias("field", "value")).where(~F.col("field").isin(list(COUNTER_BLOCKS)))
    return long.select("job_file", "ordinal", "type", "row_key", F.coalesce(named[F.col("field")], F.upper("field")).alias("name"), "value")


def counters(parsed: DataFrame) -> DataFrame:
    """Long rows (job_file, ordinal, type, scope, group, name, value) of the counters of events."""
    blocks = [F.struct(F.lit(scope).alias("scope"), F.from_json(F.get_json_object("body", f"$.{block}"), COUNTER_TYPE).alias("c")) for block, scope in COUNTER_BLOCKS.items()]
    rows = parsed.select("job_file", "ordinal", "type", F.explode(F.array(*blocks)).alias("b")).select("job_file", "ordinal", "type", "b.scope", F.explode("b.c.groups").alias("g"))
    return rows.select("job_file", "ordinal", "type", "scope", F.col("g.name").alias("group"), F.explode("g.counts").alias("n")).select("job_file", "ordinal", "type", "scope", "group", F.col("n.name").alias("name"), F.col("n.value").alias("value"))


def collapsed(long: DataFrame) -> DataFrame:
    """One row per (job_file, row_key): the last value of each name, as a map."""
    last = long.groupBy("job_file", "row_key", "name").agg(F.max_by("value", "ordinal").alias("value"))
    return last.groupBy("job_file", "row_key").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values"))


def submit_times(texts: DataFrame) -> DataFrame:
    return texts.select("job_file", submit_time_of(F.col("content").cast("string")).alias("submit_time"))


def paired_files(files: DataFrame) -> DataFrame:
    """Jobs with both a conf and a history file."""
    conf = files.where("kind = 'conf'").select("job_id", F.col("path").alias("conf_path"))
    return conf.join(files.where("kind = 'history'").select("job_id", F.col("path").alias("history_path")), "job_id")
