"""Domain scalars: names, run ids, queues, memory, cost, time buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
LONG_MAX = 9223372036854775807
DAY_MS, HOUR_MS, THIRTY_DAYS_MS = 86_400_000, 3_600_000, 30 * 86_400_000
DEFAULT_QUEUE, DEFAULT_XMX_MB = "DEFAULT_QUEUE", 1024
PIG_NAME = r"^PigLatin:([^:]*(:.*?)+)_([0-9]{4})/.*"
PIG_LOG = r"pig_([0-9]+)\.log"
SCALDING_STAGE = r"^(.*)/\(\d+/\d+\).*$"
SCALDING_BRACKETS = r"\[.*\]\s*"
CONF_FILE = r"^.*?(job_\d+_\d+).*conf\.xml$"
HISTORY_FILE = r"^(?!.*conf\.xml$).*?(job_\d+_\d+)[-_].*$"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def inverted_run_id(run_id: Column) -> Column:
    """Run ids so that the newest sorts first; applying it twice gives the run id back."""
    return F.lit(LONG_MAX) - run_id


def cleanse_token(text: Column) -> Column:
    """Spaces and '!' (the key separator) become '_'."""
    return F.translate(text, " !", "__")


def job_epoch(job_id: Column) -> Column:
    return F.split(job_id, "_")[1].try_cast("bigint")


def job_seq(job_id: Column) -> Column:
    return F.split(job_id, "_")[2].try_cast("bigint")


def format_job_id(epoch: Column, seq: Column) -> Column:
    """job_<epoch>_<seq>, the sequence padded to four digits and never cut."""
    s = seq.cast("string")
    return F.concat(F.lit("job_"), epoch.cast("string"), F.lit("_"), F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s))


def pig_app_name(name: Column) -> Column:
    return F.when(name.rlike(PIG_NAME), F.concat(F.lit("oink "), F.regexp_extract(name, PIG_NAME, 1))).otherwise(name)


def scalding_app_name(name: Column) -> Column:
    bare = F.regexp_replace(name, SCALDING_BRACKETS, "")
    return F.when(bare.rlike(SCALDING_STAGE), F.regexp_extract(bare, SCALDING_STAGE, 1)).otherwise(bare)


def mr_app_name(name: Column) -> Column:
    return F.substring_index(name, "[", 1)


def framework(conf: Column) -> Column:
    """PIG if pig.version is there, SCALDING if cascading.flow.id is not empty, else NONE."""
    return F.when(conf["pig.version"].isNotNull(), "PIG").when(F.coalesce(conf["cascading.flow.id"], F.lit("")) != "", "SCALDING").otherwise("NONE")


def app_id(conf: Column, stripped=mr_app_name) -> Column:
    """batch.desc, else the job's name less what its framework adds; cleansed, '' if there is none."""
    named = [stripped(conf["mapred.job.name"]), stripped(conf["mapreduce.job.name"])]
    return cleanse_token(F.coalesce(blank_to_null(conf["batch.desc"]), *map(blank_to_null, named), F.lit("")))


def user_name(conf: Column, required: bool = False) -> Column:
    """The user of a configuration; without one null, or an error if it is required."""
    name = F.coalesce(blank_to_null(conf["mapreduce.job.user.name"]), blank_to_null(conf["user.name"]))
    return F.when(name.isNull(), F.raise_error(F.lit("no user in the configuration"))).otherwise(name) if required else name


def queue_name(conf: Column, user: Column) -> Column:
    """Hadoop-2 queue, else fair pool, else capacity queue; 'default' means the user's own."""
    keys = ("mapreduce.job.queuename", "mapred.fairscheduler.pool", "mapred.job.queue.name")
    queue = F.coalesce(*(blank_to_null(conf[k]) for k in keys), F.lit(DEFAULT_QUEUE))
    return F.when(F.lower(queue) == "default", user).otherwise(queue)


def pig_run_id(conf: Column, submit: Column) -> Column:
    log = conf["pig.logfile"]
    from_log = F.when(log.isNotNull(), F.coalesce(F.regexp_extract(log, PIG_LOG, 1).try_cast("bigint"), F.lit(0)))
    return F.coalesce(conf["pig.script.submitted.timestamp"].try_cast("bigint"), from_log, submit)


def month_start(ms: Column) -> Column:
    return F.unix_millis(F.date_trunc("month", F.timestamp_millis(ms)))


def scalding_run_id(conf: Column, submit: Column) -> Column:
    """The submitted time if given, else month start plus the flow id's first 16 hex digits modulo 30 days."""
    flow = F.substring(conf["cascading.flow.id"], 1, 16)
    number = F.when(flow.rlike("^[0-9A-Fa-f]+$"), F.conv(flow, 16, 10).try_cast("bigint"))
    return F.coalesce(conf["scalding.flow.submitted.timestamp"].try_cast("bigint"), month_start(submit) + number % THIRTY_DAYS_MS, submit)


def mr_run_id(conf: Column, submit: Column) -> Column:
    return F.coalesce(conf["mapred.app.submitted.timestamp"].try_cast("bigint"), submit)


def cluster_host(conf: Column) -> Column:
    address = F.coalesce(blank_to_null(conf["yarn.resourcemanager.address"]), conf["mapred.job.tracker"])
    return F.substring_index(address, ":", 1)


def xmx_mb(options: Column) -> Column:
    """Megabytes of the first -Xmx: K, M, G or bytes; 1024 without one; null for a bad suffix."""
    found = F.regexp_extract(options, r"-Xmx(\S+)", 1)
    number, unit = F.regexp_extract(found, r"^(\d+)[a-zA-Z]?$", 1).try_cast("bigint"), F.upper(F.regexp_extract(found, r"^\d+([a-zA-Z]?)$", 1))
    by_unit = F.when(unit == "G", number * 1024).when(unit == "M", number).when(unit == "K", F.floor(number / 1024)).when((unit == "") & number.isNotNull(), F.floor(number / 1048576))
    return F.when(options.isNull() | (found == ""), F.lit(DEFAULT_XMX_MB).cast("bigint")).otherwise(by_unit.cast("bigint"))


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient, as whole numbers; null for a divisor of 0."""
    return F.call_function("div", a.cast("bigint"), F.nullif(b, F.lit(0)).cast("bigint"))


def batch_count(n: Column, size: Column) -> Column:
    """How many batches of a size n rows make; 0 where either is not positive."""
    return F.when((n > 0) & (size > 0), floor_div(n + size - 1, size)).otherwise(0).cast("bigint")


def end_of_day(ms: Column) -> Column:
    """The last millisecond of the UTC day."""
    return ms - ms % DAY_MS + (DAY_MS - 1)


def xmx_total_mb(xmx: Column) -> Column:
    return floor_div(xmx * 100, F.lit(75))


def corrected_slot_millis(value: Column, min_mb: Column, memory_mb: Column) -> Column:
    """Integer division throughout: exact beyond 2^53."""
    return floor_div(value * F.coalesce(min_mb, F.lit(1024)), F.coalesce(memory_mb, F.lit(1024)))


def megabyte_millis(map_mb, map_slots, reduce_mb, reduce_slots, am_mb, launch, finish, uberized, map_reported=None, reduce_reported=None) -> Column:
    """Memory times time of maps, reduces and the application master; of an uber job the latter only.

    What the job's counters report for maps or reduces is taken in place of the product, where it is not null.
    """
    master = am_mb * (finish - launch)
    part = lambda reported, product: product if reported is None else F.coalesce(reported, product)
    return F.when(uberized, master).otherwise(part(map_reported, map_mb * map_slots) + part(reduce_reported, reduce_mb * reduce_slots) + master)


def job_cost(mb_millis: Column, compute_tco: Column, machine_mb: Column) -> Column:
    known = (compute_tco != 0) & (machine_mb != 0)
    return F.when(known, mb_millis * compute_tco / (machine_mb * F.lit(float(DAY_MS)))).otherwise(0.0)


def day_bucket(ms: Column) -> Column:
    return ms - ms % DAY_MS


def week_bucket(ms: Column) -> Column:
    """UTC midnight of the Sunday on or before; 1970-01-04 was one."""
    day = F.floor(ms / DAY_MS)
    return ((day - (day + 4) % 7) * DAY_MS).cast("bigint")


def hour_bucket(seconds: Column) -> Column:
    return seconds - seconds % 3600


def task_key(task_id: Column) -> Column:
    return F.regexp_replace(task_id, r"^(?:task|attempt)_\d+_", "")


def submit_time_of(history: Column) -> Column:
    """The 13 digits of submitTime after JOB_SUBMITTED in a raw history file; 0 if not there."""
    digits = F.regexp_extract(history, r'(?s)"type"\s*:\s*"JOB_SUBMITTED.*?"submitTime"\s*:\s*(\d{13})', 1)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))


def approximate_submit_time(history_mtime: Column) -> Column:
    return history_mtime - HOUR_MS


def safe_long(text: Column) -> Column:
    return F.coalesce(text.try_cast("bigint"), F.lit(0))


def manifest_name(cluster: Column, stamp_ms: Column, batch: Column) -> Column:
    return F.concat_ws("-", F.regexp_replace(cluster, r"\W+", ""), F.date_format(F.timestamp_millis(stamp_ms), "yyyyMMddHHmmss"), batch.cast("string"))
