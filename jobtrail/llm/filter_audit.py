"""Operator 12: how filters interact, by a permutation trie over survivors.

Every order of the filters is a path from the root of a trie. What is left after a
prefix depends on the filters in it, not on their order, so prefixes with the same
filters share one state: the trie is walked depth first, each state's survivors are
persisted once, made from those of its parent, and every filter that is still to
come is applied to them and its removals are counted. 120 orders of five filters
have 600 steps; they take 32 states and 80 counted edges.
"""

from __future__ import annotations

import uuid
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import drop, shared_dir, store
from jobtrail.llm.groups import with_least

#: Limits of the five filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
ODD = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
NAMES = "ABCDE"


def failing(text: Column) -> dict[str, Column]:
    """For filters A to D whether a whole text fails them."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n, capitals = F.size(words).cast("long"), F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * n,
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.length(text).cast("long"),
        "D": text.rlike(ODD),
    }


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each document: part, whether it fails A to E, and whether it is labelled good or toxic; no text."""
    text = F.coalesce("text", F.lit(""))
    judged = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in failing(text).items()))
    judged = store(judged, "audit-judged")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # rows without a doc_id have no label; a key of their own for each text keeps them out of one task
    known = known.withColumn("spread", F.lit(0).cast("long"))
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0).alias("spread")
    first = with_least(judged, ["digest"], "doc_id", "first").select("*", spread)
    out = first.join(known, ["doc_id", "spread"], "left").select(
        "part", *"ABCD", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    )
    kept = store(out, "audit-flags")
    drop(judged)
    return kept


def trie_counts(rows: DataFrame, names: str, marks: tuple[str, ...], folder: str) -> None:
    """Walk the trie over rows (part, a boolean for each name and mark) and write the counts of every edge under folder.

    A state's file has, per part and filter still to come: removed, and of these each mark's. Survivors
    are persisted on memory and disk and go when their subtree is done; lost ones are made again from
    the stored rows.
    """
    done: set[frozenset] = set()

    def walk(state: frozenset, survivors: DataFrame) -> None:
        done.add(state)
        survivors.persist(StorageLevel.MEMORY_AND_DISK)
        left = [f for f in names if f not in state]
        sums = [F.count("*").alias("n")]
        for f in left:
            sums += [F.count_if(f).alias(f)] + [F.count_if(F.col(f) & F.col(m)).alias(f"{f}_{m}") for m in marks]
        edges = F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f).alias("removed"), *(F.col(f"{f}_{m}").alias(f"{m}_lost") for m in marks)) for f in left))
        counted = survivors.groupBy("part").agg(*sums).select("part", "n", F.explode(edges).alias("e")).select("part", "n", "e.*")
        counted.coalesce(1).write.parquet(f"{folder}/state={''.join(sorted(state)) or '-'}")  # a row for each part and filter
        for f in left:
            if len(left) > 1 and state | {f} not in done:
                walk(state | {f}, survivors.where(~F.col(f)))
        survivors.unpersist()

    walk(frozenset(), rows)


def audit(rows: DataFrame, names: str = NAMES, marks: tuple[str, ...] = ("good", "toxic")) -> DataFrame:
    """Per part, order of the filters and step what the step's filter removes.

    rows has a column part, and booleans: whether the row fails each of the filters `names` (single
    letters), and its marks. Returns part, filter_order, step, kept (after the step), removed,
    redundant (failing this filter, removed by an earlier one), unique_fails (failing this filter
    alone), <mark>_lost (marked rows removed here) and shapley (removed by this filter, summed over
    all orders); zeros are included, no rows give no rows.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/audit-{uuid.uuid4().hex}"
    trie_counts(rows, names, marks, folder)
    lost = [f"{m}_lost" for m in marks]
    edges = spark.read.schema(f"state string, part string, n long, filter string, removed long, {', '.join(f'{c} long' for c in lost)}").parquet(folder)
    only = [F.count_if(F.col(f) & ~_any([g for g in names if g != f])).alias(f) for f in names]
    alone = rows.groupBy("part").agg(*only).select("part", F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.col(f).alias("unique_fails")) for f in names))).alias("e")).select("part", "e.*")
    fails = edges.where("state = '-'").select("part", "filter", F.col("removed").alias("fails"))
    orders = ["".join(p) for p in permutations(names)]
    steps = [(k * len(names) + i, o, i + 1, f, "".join(sorted(o[:i])) or "-") for k, o in enumerate(orders) for i, f in enumerate(o)]
    trie = spark.createDataFrame(steps, "k int, filter_order string, step int, filter string, state string")
    paths = fails.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1))).alias("k")).join(F.broadcast(trie), "k")  # as many rows as there are steps
    # few rows from here on: parts times steps
    met = paths.join(edges, ["part", "state", "filter"], "left").join(fails, ["part", "filter"]).join(alone, ["part", "filter"])
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    summed = met.groupBy("part", F.col("filter").alias("of")).agg(zero(F.sum("removed")).alias("shapley")).withColumnRenamed("part", "within")
    out = met.join(summed, (F.col("part") == F.col("within")) & (F.col("filter") == F.col("of")))
    return out.select(
        "part", "filter_order", "step", (zero("n") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"), "unique_fails", *(zero(c).alias(c) for c in lost), "shapley"
    )


def _any(names: list[str]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(n)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of five filters over whole texts of docs (doc_id, text, lang), by language.

    A fails texts of under 100 words, B those with under 80 % distinct words, C those of which more
    than 10 % are capitals A-Z, D those with one of #$%&*|, E those equal to the text of any smaller
    doc_id, removed or not. labels (doc_id, quality, toxic) says which documents are good or toxic.

    A null text is empty (it fails A, and E beside a smaller empty one); a null lang is the part ''.
    Rows without a doc_id have no label, and neither fail E nor make others fail it; rows that repeat
    a doc_id and text count each and do not make each other fail E. Of repeated labels any counts.
    An empty table gives no rows; further columns, also of clashing names, are never read.
    """
    return audit(flags(docs, labels))
