"""Operator 1: order-independent document fingerprints by a homomorphic multiset hash.

A paragraph (a line of the text) is hashed to a wide vector; the fingerprint of a document is
the sum of its paragraphs' vectors modulo a power of two, so their order does not matter
and paragraphs can be added or taken out without reading the rest. A vector has two parts:

* LANES lanes of 16 bits from an extendable-output hash of the paragraph. Sums of such
  vectors are equal for equal multisets of paragraphs, and by chance for no others.
* SKETCH lanes of 32 bits with +-1 for each run of 16 bytes that begins a word. The sum
  estimates by scalar products how many such runs two documents share.

A fingerprint is all these sums, as text: update() adds and takes out paragraphs of a stored one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm import words as W
from jobtrail.llm.common import bounded_batches, deal, partitions

LANES, SKETCH, RUN = 256, 256, 16
#: Null doc_ids are sorted as the least.
LEAST = -(1 << 63)
SPACE = ~W.NOT_SPACE
#: Keeps the first so many bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def features(lines: bytes) -> np.ndarray:
    """A hash of the 16 bytes from each word's start, or of fewer where the line ends before."""
    padded = lines + b"\n" + bytes(RUN)
    raw = np.frombuffer(padded, np.uint8)[: len(lines) + 1]
    space = SPACE[raw]
    start = np.flatnonzero(~space & np.append(True, space[:-1]))
    ends = np.flatnonzero(raw == 0x0A)
    left = ends[np.searchsorted(ends, start)] - start
    eight = np.ndarray((len(lines) + 10,), "<u8", buffer=padded, strides=(1,))
    first = eight[start] & FIRST[np.minimum(left, 8)]
    second = eight[start + 8] & FIRST[np.clip(left - 8, 0, 8)]
    return W.mixed(W.mixed(first) * np.uint64(W.BASE) + second)


def lattice(line: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(line).digest(2 * LANES), "<u2")


def sketch_of(lines: list[bytes]) -> np.ndarray:
    """The sum of the lines' sketch lanes."""
    if not lines:
        return np.zeros(SKETCH, np.int64)
    h = features(b"\n".join(lines))
    sign = 1.0 - 2.0 * (h & np.uint64(1)).astype(np.float64)
    return np.bincount((h >> np.uint64(56)).astype(np.int64), sign, SKETCH).astype(np.int64)


class Fingerprint:
    """A sum of paragraph vectors: modulo 2^16, its sketch lanes modulo 2^32."""

    def __init__(self, sums: np.ndarray | None = None, sketch: np.ndarray | None = None):
        self.sums = np.zeros(LANES, np.uint16) if sums is None else sums
        self.sketch = np.zeros(SKETCH, np.int64) if sketch is None else sketch

    def changed(self, add: list[bytes] = (), remove: list[bytes] = ()) -> Fingerprint:
        """The fingerprint with paragraphs inserted and deleted."""
        sums = self.sums.copy()
        for line in add:
            sums += lattice(line)
        for line in remove:
            sums -= lattice(line)
        return Fingerprint(sums, self.sketch + sketch_of(add) - sketch_of(remove))

    def lanes(self) -> np.ndarray:
        """Sketch lanes modulo 2^32, as signed numbers."""
        return self.sketch.astype(np.uint32).view(np.int32).astype(np.float64)

    def text(self) -> str:
        """All lanes of both parts."""
        return base64.b64encode(self.sums.astype("<u2").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    @staticmethod
    def of_text(text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        return Fingerprint(np.frombuffer(raw, "<u2", LANES).astype(np.uint16), np.frombuffer(raw, "<u4", SKETCH, 2 * LANES).astype(np.int64))


def update(fingerprint: str, added: list[str] = (), removed: list[str] = ()) -> str:
    """A stored fingerprint after paragraphs were added and taken out; their order does not matter."""
    return Fingerprint.of_text(fingerprint).changed([p.encode() for p in added], [p.encode() for p in removed]).text()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """2ab/(aa+bb) of the sketch lanes, not below 0; 1 for equal sums (also of no paragraphs)."""
    if np.array_equal(a.sums, b.sums):
        return 1.0
    x, y = a.lanes(), b.lanes()
    norm = float(x @ x + y @ y)
    return min(1.0, max(0.0, 2.0 * float(x @ y) / norm)) if norm else 0.0


def paragraphs(text: str) -> list[bytes]:
    return text.encode().split(b"\n") if text else []


def common_prefix(a: list, b: list) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by the first as many characters of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, doc_id, text, halo), by falling doc_id within a chunk; each meets its successor.

    A halo row is the first row of the next chunk, there only as successor.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None
    for batch in batches:
        rows = []
        for chunk, doc_id, text, halo in zip(*(batch.column(k).to_pylist() for k in range(4))):
            lines = paragraphs(text)
            own = (chunk, doc_id, text, lines, Fingerprint().changed(lines), halo)
            if held and held[0] == chunk and not held[5]:
                _, before_id, before, before_lines, mark, _ = held
                new = edited(before, text)
                new_lines = paragraphs(new)
                k = common_prefix(before_lines, new_lines)
                new_mark = mark.changed(new_lines[k:], before_lines[k:])
                rows.append((before_id, len(before), hashlib.sha256(new.encode()).hexdigest(), mark.text(), new_mark.text(), likeness(mark, new_mark), likeness(mark, own[4])))
            held = own
        columns = list(zip(*rows)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def ties(n: int) -> list[int]:
    """Where to cut a doc_id that fills n ranges: evenly over all hashes, the least first."""
    return [LEAST + k * (1 << 64) // n for k in range(n)]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty. The next document is the one before in doc_id; rows of one doc_id
    follow each other by the hash of their text; the last document's next is the first, and a
    single row is its own next. Null doc_ids come last. Equal texts have equal fingerprints; texts of
    any length are taken whole; further columns are not read. Tasks get ranges of (doc_id, hash of the text). An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("d", F.coalesce("doc_id", F.lit(LEAST)))
    n = max(1, partitions(spark))
    cuts = rows.select(F.percentile_approx("d", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    # a doc_id that is several cuts is cut by the hash of the text as well
    found = sorted(((int(c), t) for c in set(cuts) for t in ties(cuts.count(c))), reverse=True)
    bounds = F.array(*(F.struct(F.lit(c).cast("long").alias("d"), F.lit(t).cast("long").alias("tie")) for c, t in found)) if found else None
    chunk = F.lit(0) if not found else F.size(F.filter(bounds, lambda x: F.struct("d", "tie") < x))
    placed = rows.withColumn("chunk", chunk.cast("int"))
    # the first row of each chunk (a row for each chunk) goes to the chunk before it as well
    firsts = placed.groupBy("chunk").agg(F.max(F.struct("d", "tie")).alias("f")).orderBy("chunk").collect()
    if not firsts:
        return spark.createDataFrame([], kind)
    to = [(r.f.d, r.f.tie, firsts[k - 1].chunk) for k, r in enumerate(firsts)]
    edges = spark.createDataFrame(to, "d long, tie long, to int")
    halos = placed.join(F.broadcast(edges), ["d", "tie"]).dropDuplicates(["d", "tie"])
    every = placed.select("chunk", "doc_id", "text", F.lit(False).alias("halo"), "d", "tie").unionByName(halos.select(F.col("to").alias("chunk"), "doc_id", "text", F.lit(True).alias("halo"), "d", "tie"))
    dealt = deal(every, [r.chunk for r in firsts], "chunk").sortWithinPartitions("chunk", "halo", F.desc("d"), F.desc("tie"))
    return dealt.select("chunk", "doc_id", "text", "halo").mapInArrow(compared, kind)
