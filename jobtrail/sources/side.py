"""Side inputs and the job row: costs of machines, names of clusters, raw files, and a job from its configuration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.functions import scalars


#: Fixed: letters that stand for a character behind a backslash in properties.
ESCAPED = {"t": "\t", "n": "\n", "r": "\r", "f": "\f"}


def pairs(text: str) -> list[tuple[str, str]]:
    """Key and value of each entry of a properties file, in order.

    A line that ends in an odd number of backslashes goes on, less its white space, in the next one; empty
    lines and ones that begin with # or ! are none. A key ends at the first =, : or white space that no
    backslash is before; it may have no value.
    """
    out, held = [], None
    for line in re.split(r"\r\n|\n|\r", text):
        line = line.lstrip(" \t\f")
        if held is None and (not line or line[0] in "#!"):
            continue
        line = (held or "") + line
        if (len(line) - len(line.rstrip("\\"))) % 2:
            held = line[:-1]
            continue
        out.append(line)
        held = None
    out += [held] if held else []
    plain = lambda s: re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.?))", lambda m: chr(int(m[1], 16)) if m[1] else ESCAPED.get(m[2], m[2]), s)
    split = (re.match(r"((?:\\.|[^\\=: \t\f])*)[ \t\f]*[=:]?[ \t\f]*(.*)", line, re.S) for line in out)
    return [(plain(m[1]), plain(m[2])) for m in split]


def properties(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the properties files at a path, by the rules of the format; of repeated keys the last one counts (files by name)."""
    entries = F.udf(lambda text: pairs(text), "array<struct<key:string,value:string>>")  # a row for each file: few
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(entries("value")).alias("place", "e"))
    return rows.groupBy(F.col("e.key").alias("key")).agg(F.max_by("e.value", F.struct("file", "place")).alias("value"))


def machine_costs(props: DataFrame) -> DataFrame:
    """(machine, compute_tco, machine_mb) from keys <machine>.computecost and <machine>.machinememory; what is missing or no number is 0."""
    kind, machine = F.substring_index("key", ".", -1), F.expr("substring(key, 1, length(key) - length(substring_index(key, '.', -1)) - 1)")
    of = lambda name, t: F.coalesce(F.max(F.when(kind == name, F.col("value").try_cast(t))), F.lit(0).cast(t))
    return props.where(kind.isin("computecost", "machinememory")).groupBy(machine.alias("machine")).agg(of("computecost", "double").alias("compute_tco"), of("machinememory", "bigint").alias("machine_mb"))


def with_cost(jobs: DataFrame, costs: DataFrame, machine: str) -> DataFrame:
    """Jobs with their cost by machine type; 0 for a type without figures. costs has a row for each machine type: few."""
    known = costs.withColumnRenamed("machine", machine)
    cost = scalars.job_cost(F.col("mb_millis"), F.coalesce("compute_tco", F.lit(0.0)), F.coalesce("machine_mb", F.lit(0)))
    return jobs.join(F.broadcast(known), machine, "left").withColumn("cost", cost).drop("compute_tco", "machine_mb")


def with_cluster(jobs: DataFrame, names: DataFrame, host: Column) -> DataFrame:
    """Jobs with the cluster that their host belongs to by (key, value) of a properties file; null for an unknown host."""
    return jobs.withColumn("key", host).join(F.broadcast(names), "key", "left").withColumnRenamed("value", "cluster").drop("key")


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, content, mtime) of all files below a path."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "content", F.unix_millis("modificationTime").alias("mtime"))


def job_row(confs: DataFrame) -> DataFrame:
    """A job's row from its configuration (conf, submit): framework, application and run by framework, version, user and queue.

    A Pig or Scalding job is named and numbered by its script's or flow's settings, any other by its
    own; one without a user keeps none.
    """
    conf, submit = F.col("conf"), F.col("submit")
    kind = scalars.framework(conf)
    name = F.when(kind == "PIG", scalars.app_id(conf, scalars.pig_app_name)).when(kind == "SCALDING", scalars.app_id(conf, scalars.scalding_app_name)).otherwise(scalars.app_id(conf))
    run = F.when(kind == "PIG", scalars.pig_run_id(conf, submit)).when(kind == "SCALDING", scalars.scalding_run_id(conf, submit)).otherwise(scalars.mr_run_id(conf, submit))
    version = F.when(kind == "PIG", conf["pig.script.version"]).when(kind == "SCALDING", conf["scalding.flow.class.signature"])
    user = scalars.user_name(conf)
    return confs.select(*(c for c in confs.columns if c not in ("framework", "app", "run_id", "version", "user", "queue")), kind.alias("framework"), name.alias("app"), run.alias("run_id"), F.coalesce(version, F.lit("")).alias("version"), user.alias("user"), scalars.queue_name(conf, user).alias("queue"))
