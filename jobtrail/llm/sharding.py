"""Operator 7: balanced shards by longest-processing-time scheduling of groups.

Rows of equal text make a group that stays together. Groups are taken by falling size and each
goes to the least-loaded shard, which a heap yields. Groups of one size are interchangeable, so
the driver needs no more than how many groups each size has: there are at most sqrt(2 * bytes)
different sizes. For every size it runs the heap's steps over all its groups at once (fill()) and
says how many of them each shard gets. In Spark the groups are put in order of size by ranges,
which cut through a size as well, and a group's place among those of its size names its shard.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm.common import drop, partitions, store


def fill(loads: list[int], size: int, count: int) -> list[int]:
    """How many of count groups of one size each shard gets, when each goes to the least-loaded, the first of equal ones.

    The k-th group that a shard gets finds it at load + k * size; the groups take the count least of these places.
    """
    if count <= 4 * len(loads):  # a few are quicker one by one
        heap, given = [(load, shard) for shard, load in enumerate(loads)], [0] * len(loads)
        heapq.heapify(heap)
        for _ in range(count):
            load, shard = heap[0]
            given[shard] += 1
            heapq.heapreplace(heap, (load + size, shard))
        return given

    def below(level: int) -> list[int]:  # places of each shard at loads under level
        return [max(0, -(-(level - load) // size)) for load in loads]

    low, high = min(loads), max(loads) + size * count + 1
    while high - low > 1:  # the highest level under which there are no more than count places
        middle = (low + high) // 2
        low, high = (middle, high) if sum(below(middle)) <= count else (low, middle)
    given = below(low)
    left = count - sum(given)
    for shard, load in enumerate(loads):  # the places at just that level, by shard number
        if left and load + given[shard] * size == low:
            given[shard] += 1
            left -= 1
    return given


def schedule(sizes: list[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """Longest processing time first over (size, number of groups): for each size, largest first, how many go to each shard."""
    loads, out = [0] * shards, []
    for size, count in sorted(sizes, reverse=True):
        given = fill(loads, size, count)
        loads = [load + n * size for load, n in zip(loads, given)]
        out.append((size, given))
    return out


def group_key(text: Column) -> Column:
    """The digest of the text; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def numbered(df: DataFrame, order: list, tag: str) -> tuple[DataFrame, DataFrame]:
    """df put in order by ranges and stored, with place (its part and its row within the part), and the rows before each part."""
    sorted_ = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = store(sorted_.withColumn("place", F.monotonically_increasing_id()), tag)
    parts = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    return placed, parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row of docs (doc_id, text): size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 bytes of the text plus 1 (null: 1). Equal texts, null and empty among
    them, share a shard; repeated rows are rows of one group. Of groups of one size those with
    the least digests go to the first shard, and so on. slot numbers the rows of a shard from 0
    without gaps, by doc_id. Texts of any length are digested whole. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", group_key(F.col("text")).alias("key"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    groups, before = numbered(groups, [F.desc("size"), F.asc("key")], "groups")
    sizes = [tuple(r) for r in groups.groupBy("size").agg(F.count("*").alias("n")).collect()]  # at most sqrt(2 * bytes) rows
    plan = schedule(sizes, shards)
    # a row for each size: its first group's number, and up to which number each shard's groups go
    given = np.array([g for _, g in plan], np.int64).reshape(len(plan), shards)
    first = np.cumsum(given.sum(axis=1)) - given.sum(axis=1)
    ends = first[:, None] + np.cumsum(given, axis=1)
    table = spark.createDataFrame(pd.DataFrame({"size": [s for s, _ in plan], "ends": ends.tolist()}), "size long, ends array<long>")
    number = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)
    numbers = groups.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part").select("key", "size", number.alias("number"))
    owner = F.size(F.filter("ends", lambda e: e <= F.col("number")))
    owners = numbers.join(table, "size").select("key", owner.cast("int").alias("shard"))
    dealt = rows.join(owners, "key").select("doc_id", "size", "text_crc32", "shard")
    placed, before = numbered(dealt, [F.asc("shard"), F.asc_nulls_first("doc_id"), F.asc("text_crc32")], "dealt")
    drop(groups)
    place = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before), "part").withColumn("number", F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1))
    counts = {r.shard: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row for each shard
    firsts = [sum(counts.get(k, 0) for k in range(s)) for s in range(shards)]
    slot = F.col("number") - F.array(*map(F.lit, firsts))[F.col("shard")]
    return place.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
