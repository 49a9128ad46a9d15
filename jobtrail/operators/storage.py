"""Storage usage by path and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.functions.scalars import cleanse_token

KEY = ("cluster", "path", "hour")


#: Measures that are summed over namespaces.
MEASURES = (
    "file_count", "dir_count", "space_consumed", "access_count", "quota", "space_quota", "tmp_file_count", "tmp_space_consumed", "trash_file_count", "trash_space_consumed",
    "access_cost", "storage_cost",
)


def rollup(usage: DataFrame) -> DataFrame:
    """Sums of the measures that usage has over namespaces per (cluster, path, hour); owner of the last namespace."""
    return usage.groupBy(*KEY).agg(*(F.sum(m).alias(m) for m in MEASURES if m in usage.columns), F.max_by("owner", F.struct(F.coalesce("namespace", F.lit("")), "owner")).alias("owner"))


def dirs(usage: DataFrame, cluster: str, prefix: str, limit: int = 0) -> DataFrame:
    """Directories below a prefix, all hours; the limit counts result rows."""
    out = rollup(usage.where((F.col("cluster") == cluster) & F.col("path").startswith(prefix)))
    return out.orderBy("path", F.desc("hour")).limit(limit) if limit else out


def path_series(usage: DataFrame, cluster: str, path: str, newest: int, oldest: int) -> DataFrame:
    """One path over time, newest first, hours in [oldest, newest]; case does not matter."""
    same = F.lower("path") == cleanse_token(F.lit(path.lower()))
    return rollup(usage.where((F.col("cluster") == cluster) & same & F.col("hour").between(oldest, newest)))


def latest_before(usage: DataFrame, at: int) -> DataFrame:
    """Of each path the latest hour not after a time."""
    return rollup(usage.where(F.col("hour") <= at)).groupBy("cluster", "path").agg(F.max("hour").alias("hour"), F.max_by("space_consumed", "hour").alias("space_consumed"))


#: Fixed: how many days back older figures of a path are looked for, and within how many hours of that.
AGES = (1, 4, 10, 18, 30, 45, 60, 90, 120, 150)
DAY, WITHIN = 86_400, 22 * 3600


def older(usage: DataFrame, measure: str = "space_consumed") -> DataFrame:
    """Of each path and hour, for each age: the latest hour that is at least so many days older, what was measured then, and the growth since.

    An as-of join of the path's hours with themselves, for all ages at once: each age is one more frame of
    the same window, so the rolled hours are shuffled and sorted once. Ages without an older hour have no row.
    """
    hours = Window.partitionBy("cluster", "path").orderBy("hour")
    rolled = usage.groupBy(*KEY).agg(F.sum(measure).alias(measure))
    then = [F.max(F.struct("hour", measure)).over(hours.rangeBetween(Window.unboundedPreceding, -a * DAY)).alias(f"x{a}") for a in AGES]
    each = F.array(*(F.struct(F.lit(a).alias("age_days"), F.col(f"x{a}").alias("x")) for a in AGES))
    rows = rolled.select(*KEY, measure, *then).select(*KEY, measure, F.explode(each).alias("e")).where("e.x is not null")
    return rows.select(*KEY, measure, "e.age_days", F.col("e.x.hour").alias("older_hour"), F.col(f"e.x.{measure}").alias(f"older_{measure}"), (F.col(measure) - F.col(f"e.x.{measure}")).alias("growth"))


def dirs_at(usage: DataFrame, cluster: str, prefix: str, at: int) -> DataFrame:
    """Directories below a prefix at an hour; where there are none then, at the latest hour of the nearest age that has any.

    An age stands for the hours up to WITHIN before that many days ago. No rows if no age has any.
    """
    rows = usage.where((F.col("cluster") == cluster) & F.col("path").startswith(prefix))
    hour = at - at % 3600
    rungs = F.when(F.col("hour") == hour, 0)
    for a in AGES:
        rungs = rungs.when(F.col("hour").between(hour - a * DAY - WITHIN, hour - a * DAY), a)
    rows = rows.where((F.col("hour") <= hour) & (F.col("hour") >= hour - AGES[-1] * DAY - WITHIN)).withColumn("age_days", rungs.cast("int")).where("age_days is not null")
    found = rows.groupBy("age_days").agg(F.max("hour").alias("at")).agg(F.min_by("at", "age_days").alias("at"))  # one row
    return rollup(rows.join(F.broadcast(found), F.col("hour") == F.col("at"), "left_semi"))
