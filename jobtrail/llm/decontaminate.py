"""Operator 8: benchmark passages in documents by a prefix-filtered set join.

A document contains a window of an item if it contains all of the window's shingles, so
any one of them is a sufficient prefix. Shingles (runs of three words) are ordered by
their frequency in all documents; a window is found under its rarest one. Documents emit
the occurrences of such shingles (a bitmap leaves out most others), a join
on the shingle brings the windows, bounds on position and length leave those that fit into
the document, and the words themselves are compared. A shingle that many documents have is
joined in parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm import words as W
from jobtrail.llm.common import bounded_batches, map_batches, store, texts_of

WINDOW, SHINGLE = 10, 3
#: The map that documents are filtered by has 256 bits for each shingle, 2^20 at least, and at most this power of two (16 MB).
MOST_BITS = 27
#: 32-bit words of the map that one row brings to the driver.
BLOCK = 4096
#: Occurrences of one shingle that a part of the join takes, as a share of those of all shingles; parts of a shingle, at most.
SHARE, MOST_PARTS = 1000, 1000


def cut_items():
    """f(batch of item_id, text) -> item_id, windows (each its text, length, shingle hashes)."""
    kind = pa.list_(pa.struct([("words", pa.string()), ("len", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for text in texts_of(batch.column(1)):
            raw, start, end = W.bounds(text, W.ALNUM)
            h, n = W.hashes(raw, start, end), len(start)
            own = [raw[a:b].tobytes().decode() for a, b in zip(start, end)]
            size = min(WINDOW, n)
            at = range(n - size + 1) if n else ()
            grams = W.runs(h, min(SHINGLE, size)).view(np.int64) if n else []
            per = size - min(SHINGLE, size) + 1
            out.append([{"words": " ".join(own[i : i + size]), "len": size, "shingles": grams[i : i + per].tolist()} for i in at])
        return [batch.column(0), pa.array(out, kind)]

    return run


def map_bits(n: int) -> int:
    """The power of two of a map's bits for n shingles."""
    return min(MOST_BITS, max(20, (256 * n).bit_length()))


def bitmap(df: DataFrame, column: str) -> bytes:
    """A map of the hashes in a column, gathered by Spark in blocks; 1024 rows of 16 kB at most come to the driver."""
    power = map_bits(df.count())
    at = F.shiftrightunsigned(F.col(column), 64 - power)
    marks = df.select(at.alias("at")).selectExpr("cast(at div 32 as int) as k", "shiftleft(1L, cast(at % 32 as int)) as bit")
    words = marks.groupBy("k").agg(F.bit_or("bit").alias("bits")).selectExpr(f"k div {BLOCK} as block", f"cast(k % {BLOCK} as int) as k", "bits")

    def packed(part: pa.Table) -> pa.Table:
        own = np.zeros(BLOCK, "<u4")
        own[part["k"].to_numpy()] = part["bits"].to_numpy() & 0xFFFFFFFF
        return pa.table({"block": part["block"].slice(0, 1), "bits": [own.tobytes()]})

    out = np.zeros(max(BLOCK, 1 << (power - 5)), "<u4")
    for block, bits in words.groupBy("block").applyInArrow(packed, "block long, bits binary").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(bits, "<u4")
    return out.tobytes()


def marked(grams: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = grams >> np.uint64(64 - (len(bits).bit_length() + 4))
    return np.flatnonzero(bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1))


def counting(bits: bytes, sizes: list[int]):
    """f(batch of text) -> the marked shingles of each document, once each."""
    table = np.frombuffer(bits, "<u4")

    def run(batch: pa.RecordBatch) -> list:
        out = []
        for text in texts_of(batch.column(0)):
            h = W.hashes(*W.bounds(text, W.ALNUM))
            found = [g[marked(g, table)] for g in (W.runs(h, n) for n in sizes)]
            out.append(np.unique(np.concatenate(found)).view(np.int64))
        return [pa.array(out, pa.list_(pa.int64()))]

    return run


def finding(bits: bytes, sizes: list[int]):
    """f(batch of doc_id, text) -> doc_id, n_words, marked shingles: hash, position, words around."""
    table = np.frombuffer(bits, "<u4")
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("pos", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))

    def run(batch: pa.RecordBatch) -> list:
        counts, out = [], []
        for text in texts_of(batch.column(1)):
            raw, start, end = W.bounds(text, W.ALNUM)
            h, own = W.hashes(raw, start, end), []
            n = len(start)
            for size in sizes:
                grams = W.runs(h, size)
                for p in marked(grams, table).tolist():
                    a, b = max(0, p - WINDOW + 1), min(n, p + WINDOW)
                    around = " ".join(raw[x:y].tobytes().decode() for x, y in zip(start[a:b], end[a:b]))
                    own.append({"gram": int(grams[p].view(np.int64)), "pos": p, "before": p - a, "around": around})
            counts.append(n)
            out.append(own)
        return [batch.column(0), counts, pa.array(out, kind)]

    return run


def in_parts(places: DataFrame, prefix: DataFrame) -> DataFrame:
    """places joined with prefix on the shingle; one that many documents have is dealt to parts by doc_id and position.

    Windows come once for each part of their shingle. Shingles in parts have more than one SHARE-th of the
    documents' shingles each, so there are at most SHARE of them, and their list can be broadcast.
    """
    each = prefix.select("gram", "docs").distinct()
    total = each.agg(F.sum("docs")).first()[0] or 0
    parts = each.where(F.col("docs") * SHARE > total).select("gram", F.least(F.ceil(F.col("docs") * SHARE / F.lit(max(total, 1))), F.lit(MOST_PARTS)).cast("int").alias("parts"))
    dealt = places.join(F.broadcast(parts), "gram", "left").withColumn("part", F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("parts", F.lit(1)))).drop("parts")
    windows = prefix.drop("docs").join(F.broadcast(parts), "gram", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1))).drop("parts")
    return dealt.join(windows, ["gram", "part"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per doc_id of docs (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies inside an occurrence of a window of 10 item words (or of a
    whole shorter item). Null texts and texts without words have no words and no hits; items
    without words or id have no windows. Items with equal windows count each. Rows that share a
    doc_id each come back with their own words; their hits and items are those of all of them, so
    n_hit is at most each row's own n_words. Of equally rare shingles the first in the window counts.
    Texts of any length are searched whole. Empty tables of documents give no rows, of items no hits.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    cut = map_batches(items.where("item_id is not null").select("item_id", "text"), "item_id long, windows array<struct<words:string,len:int,shingles:array<long>>>", cut_items)
    windows = store(cut.select("item_id", F.explode("windows").alias("w")).select("item_id", "w.*").distinct(), "windows")
    sizes = [r[0] for r in windows.select(F.least("len", F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect()]  # of 1, 2, 3
    grams = windows.select(F.explode("shingles").alias("gram"))
    bits = bitmap(grams, "gram")
    if sizes:
        seen = map_batches(docs.select("text"), "grams array<long>", lambda: counting(bits, sizes))
        rarity = seen.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("docs"))
    else:
        rarity = spark.createDataFrame([], "gram long, docs long")
    # each distinct window once, under the rarest of its shingles (the first of equally rare ones)
    each = windows.select("words", "len", F.posexplode("shingles").alias("offset", "gram")).dropDuplicates(["words", "offset"])
    rank = Window.partitionBy("words").orderBy(F.coalesce("docs", F.lit(0)), "offset")
    first = each.join(rarity, "gram", "left").withColumn("r", F.row_number().over(rank)).where("r = 1")
    prefix = store(first.select("words", "len", "gram", "offset", F.coalesce("docs", F.lit(0)).alias("docs")), "prefix")

    bits = bitmap(prefix, "gram")
    found = store(map_batches(docs.select("doc_id", "text"), "doc_id long, n_words long, found array<struct<gram:long,pos:int,before:int,around:string>>", lambda: finding(bits, sizes)), "found")
    places = found.select("doc_id", "n_words", F.explode("found").alias("f")).select("doc_id", "n_words", "f.*")
    near = in_parts(places, prefix).withColumn("start", F.col("pos") - F.col("offset"))
    near = near.where("start >= 0 and start + len <= n_words and offset <= before")
    same = near.where(F.expr("array_join(slice(split(around, ' '), before - offset + 1, len), ' ') = words"))
    hits = store(same.select("doc_id", "start", "len", "words").distinct(), "hits")

    before = Window.partitionBy("doc_id").orderBy("start", "len").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select("doc_id", "start", (F.col("start") + F.col("len")).alias("stop")).distinct()
    spans = spans.withColumn("reached", F.coalesce(F.max("stop").over(before.orderBy("start", "stop")), F.lit(0)))
    covered = spans.groupBy("doc_id").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).cast("long").alias("n_hit"))
    named = hits.select("doc_id", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
    named = named.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))
    out = found.select("doc_id", "n_words").join(covered, "doc_id", "left").join(named, "doc_id", "left")
    listed = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.least(F.coalesce("n_hit", F.lit(0)), "n_words").cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
