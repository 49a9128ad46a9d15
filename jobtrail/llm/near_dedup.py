"""Operator 5: near-duplicates by one-permutation MinHash with optimal densification.

1. sketch(): each document's set of 5-word shingles is hashed once; the hash range is cut
   into BINS bins, the least hash of each is its value; an empty bin takes the value of a
   bin picked by a hash of (bin, attempt), the same for all documents. ROWS bins make a band.
2. Documents of equal sets are represented by their smallest doc_id.
3. In every bucket (band, value) edges run from one hub to the other members: a star, so
   a bucket of k documents gives k-1 pairs.
4. Pairs are confirmed on the full sets, computed from the texts.
5. Confirmed links form components (min-label propagation on stars).
6. A bucket whose members are still in several components may hide links between members
   that its hub does not share. Members outside a bucket's largest component meet all its
   members; where these are many, members are searched by a prefix-filtered join on their
   rarest shingles instead, which finds every pair above the threshold. Pairs across
   components that pass bounds on size, position and a parity map are confirmed as well, and
   components are joined. So no pair that meets in a bucket is left out unless both are
   already in one component. The bounds are exact: sets differ in at least as many shingles
   as their parity maps in bits.

Every join on a key that many rows may share (bucket, hub, centre, shingle, equal sets) deals keys
with more than a thousandth of the rows to parts, so no task gets a whole hot group; only the
sets of doc_ids that repeat with different texts are joined plainly.

Bands and bounds follow from the threshold. With 28 bands of 6 bins a pair of similarity
0.85 meets in no bucket with probability 2e-6, with 33 bands of 5 bins one of 0.8.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtrail.llm import words as W
from jobtrail.llm.common import bounded_batches, drop, map_batches, release, store, texts_of
from jobtrail.llm.groups import SALTS, SMALL, hot_keys, join_hot, listed_hot_keys, parts_of

SHINGLE, PERCENT = 5, 85
#: Bins of a sketch; a pair at the threshold meets in no band with at most this probability.
BINS, MISSED = 168, 3e-6
#: Longs of the parity map: bit k tells whether an odd number of shingles hash to k.
PARITY = 16
#: A bucket with more members than this outside its largest component is searched by rare shingles.
CROWD = 100


def bands_of(percent: int) -> tuple[int, int]:
    """Number of bands and bins of each: the longest bands that miss few enough pairs at the threshold."""
    rows = max((r for r in range(1, 13) if (1 - (percent / 100) ** r) ** (BINS // r) <= MISSED), default=1)
    return BINS // rows, rows


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; of the whole if there are fewer words."""
    h = W.hashes(*W.bounds(text, W.NOT_SPACE))
    if not len(h):
        return h
    return np.unique(W.runs(h, min(SHINGLE, len(h))))


@lru_cache(maxsize=None)
def picks(block: int) -> np.ndarray:
    """For each bin 64 bins to try, by attempt; blocks follow each other without end."""
    k = np.arange(BINS * 64, dtype=np.uint64) + np.uint64(block * BINS * 64)
    return (W.mixed(k + np.uint64(1 << 40)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, 64)


def densified(h: np.ndarray) -> np.ndarray:
    """The BINS values of a set of sorted hashes."""
    bins = ((h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted, so the first is the least
    value, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    value[bins[first]], full[bins[first]] = h[first], True
    empty = np.flatnonzero(~full)
    if len(first) == 1:
        value[empty] = h[0]
        return value
    block = 0
    while len(empty):
        tried = picks(block)[empty]
        ok = full[tried]
        hit = ok.any(axis=1)
        value[empty[hit]] = value[tried[hit, ok[hit].argmax(axis=1)]]
        empty = empty[~hit]
        block += 1
    return value


def parity_map(h: np.ndarray) -> np.ndarray:
    """PARITY longs of a set of hashes."""
    odd = np.bincount((h & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketcher(percent: int):
    n_bands, n_rows = bands_of(percent)
    salt = W.mixed(np.arange(n_bands, dtype=np.uint64) + np.uint64(77))

    def sketch(batch: pa.RecordBatch) -> list:
        n, low, high, bands, bits = [], [], [], [], []
        for text in texts_of(batch.column(1)):
            h = shingles(text)
            n.append(len(h))
            if not len(h):
                low.append(None), high.append(None), bands.append(None), bits.append(None)
                continue
            low.append(int(np.bitwise_xor.reduce(W.mixed(h)).view(np.int64)))
            high.append(int(np.add.reduce(W.mixed(h + np.uint64(99))).view(np.int64)))
            v = densified(h)
            b = salt.copy()
            for r in range(n_rows):
                b = W.mixed(b * np.uint64(W.BASE) + v[r : n_bands * n_rows : n_rows])
            bands.append(b.view(np.int64))
            bits.append(parity_map(h))
        return [batch.column(0), n, low, high, pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))]

    return sketch


def judge(percent: int):
    """f(batch of a, text_a, b, text_b) -> a, b, linked; pairs of one a come together."""
    last: list = [None, None]

    def run(batch: pa.RecordBatch) -> list:
        a, ta, b, tb = (c.to_pylist() for c in batch.columns)
        linked = []
        for x, tx, ty in zip(a, ta, tb):
            if last[0] != x:
                last[:] = [x, shingles(tx.encode())]
            one, two = last[1], shingles(ty.encode())
            both = len(np.intersect1d(one, two, assume_unique=True))
            linked.append(100 * both >= percent * (len(one) + len(two) - both))
        return [batch.column(0), batch.column(2), linked]

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of a stored table whose full sets are similar enough."""
    total = pairs.count()
    one = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    hot_a, hot_b = (listed_hot_keys(pairs.groupBy(c).agg(F.count("*").alias("k")), [c], "k", total) for c in "ab")
    full = join_hot(join_hot(pairs, one, ["b"], hot_b, "a"), two, ["a"], hot_a, "b").select("a", "text_a", "b", "text_b")
    return map_batches(full, "a long, b long, linked boolean", lambda: judge(percent)).where("linked").select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(doc_id, component) of every document in links: its smallest reachable doc_id.

    Alternates large-star and small-star steps; every round shrinks what is not yet a star
    and is written to the shared folder.
    """
    edges = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        total = 2 * edges.count()
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        around = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        least = around.select("a", F.least("m", "a").alias("m"))
        large = store(join_hot(both, least, ["a"], listed_hot_keys(around, ["a"], "k", total), "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        around = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
        small = join_hot(large, around.select("a", "m"), ["a"], listed_hot_keys(around, ["a"], "k", total), "b").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = store(small, "edges")
        # a forest of stars: nobody has two centres, and no centre has one
        open_ends = after.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
        centres = after.select("b").distinct()
        done = open_ends.where("lo <> hi").isEmpty() and centres.join(open_ends.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        drop(edges, large)
        edges = after
        release(edges.sparkSession)
        if done:
            return edges.select(F.col("a").alias("doc_id"), F.col("b").alias("component"))


def largest(placed: DataFrame, key: str) -> DataFrame:
    """(key, largest, others, k) of rows (key, doc_id, component): the component with most members, how many are in others and in all."""
    sizes = placed.groupBy(key, "component").agg(F.count("*").alias("k"))
    most = F.max_by("component", F.struct("k", "component")).alias("largest")
    return sizes.groupBy(key).agg(most, (F.sum("k") - F.max("k")).alias("others"), F.sum("k").alias("k"))


def across(rows: DataFrame, fit: str, grid: bool = False) -> DataFrame:
    """Pairs (a, b) of rows (key, doc_id, component, largest, parts, ...) of one key and two components that fit.

    One of the two is outside the key's largest component, so only such rows meet all rows of their key.
    All rows of a key are dealt to its parts, those outside meet each part; in a grid both are dealt.
    """
    apart = "p.key = q.key and p.part = q.part and p.component <> q.component and (q.component = q.largest or p.doc_id < q.doc_id)"
    own, each = F.expr("pmod(xxhash64(doc_id), parts)"), F.expr("explode(sequence(0L, parts - 1))")
    outside, whole = rows.where("component <> largest").withColumn("part", each), rows.withColumn("part", own)
    if grid:
        apart += " and p.line = q.line"
        outside, whole = outside.withColumn("line", own), whole.withColumn("line", each)
    found = outside.alias("p").join(whole.alias("q"), F.expr(f"{apart} and {fit}"))
    return found.select(F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b"))


def fits(percent: int) -> str:
    """Whether sizes and parity maps of p and q allow the similarity."""
    differ = " + ".join(f"bit_count(p.m{k} ^ q.m{k})" for k in range(PARITY))
    sizes = f"100 * least(p.n_shingles, q.n_shingles) >= {percent} * greatest(p.n_shingles, q.n_shingles)"
    return f"{sizes} and {100 + percent} * ({differ}) <= {100 - percent} * (p.n_shingles + q.n_shingles)"


def rare_pairs(crowd: DataFrame, texts: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """All pairs (a, b) of crowd (doc_id, component) that may be similar enough, across components; the stored tables they read.

    A prefix-filtered join: the shingles of each document are ordered from the rarest in crowd to the most
    frequent. Similar sets have their first common shingle within a prefix of both, and what follows it in
    both is long enough. A passage that very many documents share is so no key of them unless their other
    shingles are too few to tell them apart.
    """
    def spell():
        def run(batch: pa.RecordBatch) -> list:
            sets = [shingles(t) for t in texts_of(batch.column(2))]
            keys, maps = [h.view(np.int64) for h in sets], [parity_map(h) for h in sets]
            return [batch.column(0), batch.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.list_(pa.int64()))]

        return run

    whole = crowd.join(texts, "doc_id").select("doc_id", "component", "text")
    spelled = store(map_batches(whole, "doc_id long, component long, keys array<long>, bits array<long>", spell), "spelled")
    rows = spelled.select("doc_id", "component", F.size("keys").cast("long").alias("n_shingles"), F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("df"))
    often = hot_keys(shared.where(F.col("df") >= SMALL), ["key"], "df", spelled.agg(F.sum(F.size("keys"))).first()[0] or 0)
    hot = F.col("key").isin([r.key for r in often.collect()])  # fewer than SHARE
    salts = F.sequence(F.lit(0), F.when(hot, SALTS - 1).otherwise(0))
    salted = rows.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    known = salted.join(shared.withColumn("salt", F.explode(salts)), ["key", "salt"])
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("df", "key"))
    ranked = known.withColumn("at", rank).where(f"at <= n_shingles - ceil({percent} * n_shingles / 100) + 1 and df > 1")
    prefix = store(ranked.select("key", "doc_id", "component", "n_shingles", "at"), "prefixes")
    maps = spelled.select("doc_id", *(F.col("bits")[k].alias(f"m{k}") for k in range(PARITY)))
    total = prefix.count()
    split = store(largest(prefix, "key").where("others > 0").withColumn("p", parts_of("k", total, root=True)), "split")
    hot = listed_hot_keys(split, ["key"], "k", total)
    keyed = join_hot(prefix, split.drop("k"), ["key"], hot, "doc_id").withColumnRenamed("p", "parts").join(maps, "doc_id")
    # of the smaller set a shorter prefix is enough: as long as among sets of its own size
    need = f"ceil({percent} * (p.n_shingles + q.n_shingles) / {100 + percent})"
    bound = f"{need} <= 1 + least(p.n_shingles - p.at, q.n_shingles - q.at)"
    found = across(keyed, f"{fits(percent)} and {bound}", grid=True)
    return found.distinct(), [spelled, prefix, split]


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles, component_id, kept.

    Linked are documents whose shingle sets have a similarity of percent / 100 or more.

    Texts without words and null texts have 0 shingles and are linked with nothing. Rows of
    one doc_id share a component, whatever their texts, and each has its own n_shingles; of several
    texts the first in order is compared, while equal sets are found for all. Rows with a
    null doc_id come back with a null component and are kept. Texts of any length are compared on
    their full sets. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    sketch = store(map_batches(docs, "doc_id long, n_shingles long, low long, high long, bands array<long>, bits array<long>", lambda: sketcher(percent)), "sketch")
    sets = sketch.where("n_shingles > 0 and doc_id is not null")
    alike = ["low", "high", "n_shingles"]
    same = store(sets.groupBy(alike).agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.count("*").alias("k")), "sets")
    hot_sets = listed_hot_keys(same, alike, "k", same.agg(F.sum("k")).first()[0] or 0)
    reps = sets.join(same.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    buckets = reps.select("doc_id", F.explode("bands").alias("bucket"))
    # members of buckets with company; the hub is the least by a hash of both, so hubs differ between bands
    hubs = buckets.groupBy("bucket").agg(F.min_by("doc_id", F.xxhash64("bucket", "doc_id")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    hubs = store(hubs, "hubs")
    hot_buckets = listed_hot_keys(hubs, ["bucket"], "k", hubs.agg(F.sum("k")).first()[0] or 0)
    members = store(join_hot(buckets, hubs.drop("k"), ["bucket"], hot_buckets, "doc_id").select("bucket", "hub", "doc_id"), "buckets")
    pairs = store(members.where("hub <> doc_id").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct(), "pairs")
    involved = members.select("doc_id").distinct()
    texts = store(docs.where("text is not null").join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")), "texts")
    sure = store(confirmed(pairs, texts, percent), "links")
    release(spark)
    repeats = sets.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    # a doc_id with several sets links them
    twice = sets.join(repeats, "doc_id", "left_semi").join(same, alike).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = sure.unionByName(twice)
    labels = components(links)

    placed = members.select("bucket", "doc_id").distinct().join(labels, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = placed.withColumnRenamed("bucket", "key")
    total = members.count()
    split = store(largest(placed, "key").where("others > 0").withColumn("p", parts_of("k", total)), "split")
    hot = listed_hot_keys(split, ["key"], "k", total)
    bits = reps.select("doc_id", "n_shingles", *(F.col("bits")[k].alias(f"m{k}") for k in range(PARITY)))
    left = store(join_hot(placed, split.drop("k"), ["key"], hot, "doc_id").withColumnRenamed("p", "parts").join(bits, "doc_id"), "left")
    # a bucket with few members outside its largest component is searched by itself, all others by rare shingles
    found, spelled = across(left.where(F.col("others") <= CROWD), fits(percent)), []
    crowd = left.where(F.col("others") > CROWD).select("doc_id", "component").distinct()
    if not crowd.isEmpty():
        rare, spelled = rare_pairs(crowd, texts, percent)
        found = found.unionByName(rare)
    release(spark)
    rest = store(found.distinct().join(pairs, ["a", "b"], "left_anti"), "rest")
    more = store(confirmed(rest, texts, percent), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    drop(hubs, members, pairs, texts, sure, split, left, *spelled, rest, more)
    release(spark)

    reached = same.join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    moved = reached.where("component_id <> rep or rep <> last").select(*alike, "component_id")
    out = join_hot(sketch.select("doc_id", *alike), moved, alike, hot_sets, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
