"""Flow queue and flow events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed order in which the status of a flow is looked up: running, succeeded, failed.
STATUS_ORDER = ("r", "s", "f")


def events_of(events: DataFrame, user: str, app: str) -> DataFrame:
    return events.where((F.col("user") == user) & (F.col("app") == app))


def events_since(events: DataFrame, sequence: int) -> DataFrame:
    return events.where(F.col("sequence") > sequence)


def queue_by_status(queue: DataFrame, cluster: str, status: str, user: str | None = None, limit: int = 0) -> DataFrame:
    """Flows of a status, newest first; with a user only those that name that user."""
    q = queue.where((F.col("cluster") == cluster) & (F.col("status") == status))
    q = q.where(F.col("username") == user) if user else q
    q = q.orderBy(F.desc("at"), "flow_id")
    return q.limit(limit) if limit else q


def queue_page(queue: DataFrame, cluster: str, status: str, size: int, cursor: tuple[int, int] | None = None) -> DataFrame:
    """A page from the cursor (at, flow_id) on; one row more than size, the next cursor, is marked."""
    q = queue.where((F.col("cluster") == cluster) & (F.col("status") == status))
    if cursor:
        q = q.where((F.col("at") < cursor[0]) | (F.col("at") == cursor[0]) & (F.col("flow_id") >= cursor[1]))
    return q.orderBy(F.desc("at"), "flow_id").limit(size + 1)


def flow_from_queue(queue: DataFrame) -> DataFrame:
    """One row per (cluster, username, flowname): the first status in order, its newest flow."""
    rank = F.array_position(F.array(*map(F.lit, STATUS_ORDER)), F.col("status"))
    first = F.min_by(F.struct("status", "flow_id"), F.struct(rank, -F.col("at"), "flow_id")).alias("x")
    return queue.groupBy("cluster", "username", "flowname").agg(first).select("cluster", "username", "flowname", "x.*")


def upserted(queue: DataFrame, changes: DataFrame) -> DataFrame:
    """The queue with changed rows in place of those of the same flow_id, and new ones."""
    return queue.join(changes.select("flow_id").distinct(), "flow_id", "left_anti").select(*queue.columns).unionByName(changes.select(*queue.columns))


def moved(queue: DataFrame, flow_ids: list[int], status: str) -> DataFrame:
    """The queue with some flows in another status."""
    return queue.withColumn("status", F.when(F.col("flow_id").isin(flow_ids), status).otherwise(F.col("status")))
