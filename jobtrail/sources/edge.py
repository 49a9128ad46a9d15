"""The JSON edge: detail levels, projections, and page cursors."""

from __future__ import annotations

import base64
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.functions.scalars import LONG_MAX

#: Fixed: what is left out of flows at the level of statistics.
STATS_OMIT = ("submit", "launch", "finish", "jobs")


def projected(df: DataFrame, include: list[str] | None = None) -> DataFrame:
    """Only the named columns, in the order of df; all without a list."""
    return df.select(*(c for c in df.columns if include is None or c in include))


#: Fixed: the detail levels and what each leaves out of a flow.
LEVELS = {
    "EVERYTHING": (),
    "FLOW_SUMMARY_STATS_ONLY": STATS_OMIT,
    "FLOW_SUMMARY_STATS_WITH_JOB_STATS": ("submit", "launch", "finish"),
}
#: And what the levels for applications show of one.
APP_LEVELS = {
    "APP_SUMMARY_STATS_NEW_JOBS_ONLY": ("cluster", "user", "app", "queues", "first_run", "last_run", "number_runs"),
    "APP_SUMMARY_STATS_ALL_APPS": ("cluster", "user", "app", "queues", "first_run", "last_run", "number_runs", "total_jobs", "total_maps", "total_reduces", "mb_millis"),
}
#: Fixed: rows that a request without a limit gets; 0 is all of them.
DEFAULT_LIMITS = {"flow": 1, "flow_stats": 100, "new_jobs": 0, "all_apps": 0, "hdfs": 0}


def at_level(df: DataFrame, level: str) -> DataFrame:
    """The columns that a detail level shows."""
    if level in APP_LEVELS:
        return df.select(*(c for c in df.columns if c in APP_LEVELS[level]))
    return df.select(*(c for c in df.columns if c not in LEVELS[level]))


def limited(df: DataFrame, kind: str, limit: int | None = None) -> DataFrame:
    """At most so many rows, by default as many as that kind of request gets."""
    n = DEFAULT_LIMITS[kind] if limit is None else limit
    return df.limit(n) if n else df


def stats_only(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in STATS_OMIT))


def conf_matching(conf: Column, patterns: list[str]) -> Column:
    """Entries whose whole key matches one of the patterns."""
    return F.map_filter(conf, lambda k, _: k.rlike("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$"))


def conf_of_queues(conf: Column) -> Column:
    return F.map_filter(conf, lambda k, _: k.contains("queue"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, level: str = "EVERYTHING", include: list[str] | None = None) -> None:
    """Write rows as JSON lines, with the columns that a detail level shows, of these only the named ones if there is a list."""
    as_json(projected(at_level(df, level), include)).write.mode("overwrite").text(path)


def encode_cursor(cluster: str, user: str, app: str, run_id: int) -> str:
    """A page cursor: the flow's key, its run id inverted, as base64."""
    return base64.b64encode("!".join((cluster, user, app)).encode() + b"!" + struct.pack(">q", LONG_MAX - run_id)).decode()


def decode_cursor(cursor: str) -> tuple[str, str, str, int]:
    raw = base64.b64decode(cursor)
    cluster, user, app = raw[:-9].decode().split("!")
    return cluster, user, app, LONG_MAX - struct.unpack(">q", raw[-8:])[0]
