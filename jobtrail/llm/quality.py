"""Operator 10: a quality classifier made of sparse rules.

Statistics of a text are counted once per row. On a bounded sample of labelled rows a random
forest of shallow trees is grown (MLlib); every path from a root to a node is a conjunctive
rule over the statistics; an L1-penalised logistic regression on the 0/1 rules keeps a few of
them with weights; these are compiled to one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtrail.llm import words as W
from jobtrail.llm.common import bounded_batches, drop, held_out, map_batches, release, sampled_labels, store, texts_of

#: Of more labelled rows about so many, taken by a hash of doc_id, are learned from.
SAMPLE = 20_000
TREES, DEPTH, PENALTY = 24, 3, 0.002
STATISTICS = (
    "log_bytes", "upper", "digits", "marks", "bangs", "bars", "stops", "spaces", "beyond_ascii",
    "word_length", "longest_word", "distinct_words", "commonest_word", "marked_words", "repeated_lines", "line_words",
)


def _class(chars: str) -> np.ndarray:
    return np.array(sorted(map(ord, chars)))


UPPER, DIGITS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
MARKS = _class("#$%&*+/<=>@[\\]^_`{|}~")


def statistics_of(text: bytes) -> list[float]:
    """The STATISTICS of a text; all 0 for an empty one. Ratios are to bytes, words or lines."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text, np.uint8)
    n, by = len(raw), np.bincount(raw, minlength=256)
    lower, start, end = W.bounds(text, W.NOT_SPACE)
    k = max(1, len(start))
    length = end - start
    _, times = np.unique(W.hashes(lower, start, end), return_counts=True) if len(start) else (None, np.zeros(1))
    marked = np.isin(raw[end - 1], np.append(MARKS, ord("!"))).sum() if len(start) else 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log1p(n)), by[UPPER].sum() / n, by[DIGITS].sum() / n, by[MARKS].sum() / n, by[33] / n, by[124] / n,
        by[46] / n, by[32] / n, by[128:].sum() / n, float(length.mean()) if len(start) else 0.0, float(length.max(initial=0)),
        len(times) / k, float(times.max()) / k, marked / k, 1 - len(set(lines)) / max(1, len(lines)), len(start) / max(1, len(lines)),
    ]


def measure():
    kind = pa.list_(pa.float64())
    return lambda batch: [batch.column(0), pa.array([[float(x) for x in statistics_of(t)] for t in texts_of(batch.column(1))], kind)]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and an array of the statistics, row by row."""
    bounded_batches(docs.sparkSession)
    return map_batches(docs.select("doc_id", "text"), "doc_id long, stats array<double>", measure)


@dataclass(frozen=True)
class Rules:
    """Weighted conjunctions of (statistic, is_greater, threshold) and an intercept."""

    rules: tuple[tuple[float, tuple[tuple[int, bool, float], ...]], ...]
    intercept: float

    def score(self, stats: Column) -> Column:
        """The probability of label 1 as one column expression."""
        parts = [F.when(condition(stats, rule), w).otherwise(0.0) for w, rule in self.rules]
        margin = reduce(lambda a, b: a + b, parts, F.lit(self.intercept))
        return 1 / (1 + F.exp(-margin))


def condition(stats: Column, rule: tuple) -> Column:
    parts = [stats[k] > cut if greater else stats[k] <= cut for k, greater, cut in rule]
    return reduce(lambda a, b: a & b, parts)


def paths(node, above: tuple = ()) -> set[tuple]:
    """Every path from the root of an MLlib tree to a node below it."""
    if node.numDescendants() == 0:
        return set()
    split = node.split()
    k, cut, out = split.featureIndex(), split.threshold(), set()
    for child, greater in ((node.leftChild(), False), (node.rightChild(), True)):
        rule = (*above, (k, greater, cut))
        out |= {tuple(sorted(rule))} | paths(child, rule)
    return out


def fires(stats: np.ndarray, rules: list[tuple]) -> np.ndarray:
    """Which rules hold for which rows of statistics."""
    return np.array([np.logical_and.reduce([stats[:, k] > cut if greater else stats[:, k] <= cut for k, greater, cut in r]) for r in rules]).reshape(len(rules), len(stats)).T


def lasso(fired: np.ndarray, label: np.ndarray, penalty: float, steps: int = 3000) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least mean logistic loss plus penalty times the sum of absolute weights; by accelerated proximal steps.

    Rows that fire the same rules are one row with a weight.
    """
    rows, which = np.unique(fired, axis=0, return_inverse=True)
    n, ones = (np.bincount(which.ravel(), w, len(rows)) / len(label) for w in (np.ones(len(label)), label))
    x = np.column_stack([rows, np.ones(len(rows))]).astype(np.float64)
    rate = 4 / np.linalg.norm(x * np.sqrt(n)[:, None], 2) ** 2
    w, ahead, t = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    w[-1] = ahead[-1] = np.log((ones.sum() + 1e-9) / (n.sum() - ones.sum() + 1e-9))
    for _ in range(steps):
        slope = x.T @ (n / (1 + np.exp(-(x @ ahead))) - ones)
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)  # the intercept is free
        moved = np.abs(new - w).max()
        if slope @ (new - w) > 0:  # it went too far ahead: begin again from here
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
        if moved < 1e-7:
            break
    return w[:-1], float(w[-1])


def learn(stats: DataFrame) -> Rules:
    """Learn from a bounded number of rows (doc_id, stats, label).

    Trees are grown by Spark; then the sample itself, SAMPLE rows of as many numbers as there are
    statistics, comes to the driver, where the weights are fitted in one go instead of a job for every step.
    """
    spark = stats.sparkSession
    # a few partitions: the sample is small, and every level of the trees is a job over them
    rows = store(stats.select(F.col("label").cast("double").alias("label"), "stats").repartition(4), "quality-sample")
    sample = rows.toArrow()
    label = np.array(sample["label"].to_pylist(), float)
    n, ones = len(label), label.sum()
    share = (ones + 1) / (n + 2)
    if not n or ones in (0, n):  # nothing to tell apart: the share of label 1
        return Rules((), float(np.log(share / (1 - share))))
    forest = RandomForestClassifier(featuresCol="v", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7)
    model = forest.fit(rows.withColumn("v", array_to_vector("stats")))
    rules = sorted(set().union(*(paths(t._call_java("rootNode")) for t in model.trees)))
    weights, intercept = lasso(fires(np.array(sample["stats"].to_pylist(), float), rules), label, PENALTY) if rules else ((), float(np.log(share / (1 - share))))
    kept = tuple((float(w), r) for w, r in zip(weights, rules) if abs(w) > 1e-6)
    del model
    drop(rows)
    release(spark)
    return Rules(kept, intercept)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, score, predicted (1 if score >= threshold).

    Learns from labels (doc_id, quality) of rows that are not held out; null labels are left
    out, of several labels of a doc_id the least counts. Null and empty texts have statistics
    of 0 and a score like any other. Repeated rows are scored each; with no labels, or labels
    of one kind, all rows get the (smoothed) share of label 1. An empty table gives no rows.
    """
    stats = store(with_statistics(docs), "quality-stats")
    known = sampled_labels(labels, F.min("quality"), SAMPLE)
    model = learn(stats.join(F.broadcast(known), "doc_id"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("stats")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
