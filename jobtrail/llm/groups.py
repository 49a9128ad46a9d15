"""Groups that may hold a large share of all rows: their least values, and joins that deal them to parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group is dealt out under so many salts, so no task gets more than about that share of a hot one.
SALTS = 256
#: A key with more than one SHARE-th of all rows is hot; fewer than SHARE keys can be.
SHARE = 1000
#: A group of fewer rows is small enough for any task, whatever its share.
SMALL = 64


def with_least(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """rows with the least value among those of equal keys as column `name`.

    Values are first reduced per (keys, salt), then per keys; the result goes back to the salted
    groups and from there to the rows, so neither a hot group nor its rows meet in one task. Keys
    are compared with null as a value of its own; nulls of `value` are no least one. rows is read
    twice: store it if it is dear.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    some = salted.groupBy(*keys, "salt").agg(F.min(value).alias("least"))
    whole = some.groupBy(*keys).agg(F.min("least").alias("least"))
    a, b = some.select(*keys, "salt").alias("a"), whole.alias("b")
    back = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]).select(*(F.col(f"a.{k}") for k in keys), "a.salt", "b.least")
    r, b = salted.alias("r"), back.alias("b")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "salt")]
    return r.join(b, same).select(*(F.col(f"r.{c}") for c in rows.columns), F.col("b.least").alias(name))


def parts_of(count: str, total: int, root: bool = False) -> Column:
    """Parts of a key with `count` of `total` rows: one for each SHARE-th that it has, or the root of their number; one if it is not hot.

    The parts of all hot keys are fewer than 2 * SHARE, and a key has no more parts than rows.
    """
    parts = F.least(F.ceil(F.col(count) * SHARE / F.lit(max(total, 1))), F.col(count))
    return F.when(F.col(count) * SHARE > total, F.ceil(F.sqrt(parts)) if root else parts).otherwise(1).cast("long")


def hot_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """(keys, parts) of the hot keys of counts (keys, count), whose counts sum up to total at most; short enough to be broadcast."""
    return F.broadcast(counts.where(F.col(count) * SHARE > total).select(*keys, parts_of(count, total).alias("parts")))


def listed_hot_keys(counts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame | None:
    """hot_keys() of SMALL rows or more, looked up now and fewer than SHARE; None if there are none.

    A plan that reads the list has neither the counts nor their shuffle in it, and one without hot keys has
    no broadcast: the driver holds each plan and every broadcast of it while it runs.
    """
    if total < SMALL:
        return None
    found = hot_keys(counts.where(F.col(count) >= SMALL), keys, count, total).toArrow()
    return F.broadcast(counts.sparkSession.createDataFrame(found)) if found.num_rows else None


def join_hot(rows: DataFrame, one: DataFrame, keys: list[str], hot: DataFrame | None, by: str, how: str = "inner") -> DataFrame:
    """rows joined with one, which has few rows of a key: hot keys of rows are dealt to parts by a hash of column `by`.

    Rows with a null key, which join with nothing, are spread as well. Without hot keys the others stay whole.
    """
    if hot is None and how == "inner":
        return rows.join(one, keys)
    with_parts = (lambda df: df.withColumn("parts", F.lit(None).cast("long"))) if hot is None else (lambda df: df.join(hot, keys, "left"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    own = F.when(F.col(keys[0]).isNull(), F.lit(SHARE)).otherwise(parts)
    dealt = with_parts(rows).withColumn("part", F.pmod(F.xxhash64(by), own)).drop("parts")
    each = with_parts(one).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(each, [*keys, "part"], how).drop("part")
