"""Operator 4: token ids in seekable binary files.

A file holds one independent zstandard frame per document (its ids, little-endian
unsigned 32-bit, with the frame's own checksum), a skippable frame with the doc_ids,
and the public seek table as trailing skippable frame: compressed size, raw size and
checksum of every frame. A reader that wants some documents reads the seek table and
decompresses only their frames.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, drop, map_batches, partitions, qualified, shared_dir, store
from jobtrail.llm.pieces import Known, library_ids, special_strings

#: Fixed values of the public seekable format.
SEEK_MAGIC, SKIPPABLE, IDS_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Descriptor bit 7: checksums are present.
DESCRIPTOR = 0x80
#: Byte-level BPE shows a space as this letter.
SPACE = "\u0120"
SUFFIX = ".ids.zst"
LEVEL = 3


def tokens_of(path: str) -> Known:
    """The table of pieces' ids, which the tokenizers library gives."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    spaced = np.array([(tokenizer.id_to_token(i) or "").startswith(SPACE) for i in range(size)])
    return Known(library_ids(tokenizer, spaced, None), special_strings(tokenizer))


@lru_cache(maxsize=1)
def worker_state(path: str) -> Known:
    """One per Python worker; its size is bounded by bytes."""
    return tokens_of(path)


def encoder(path: str, end_id: int | None):
    """f(batch of doc_id, text) -> doc_id, n_tokens, checksum, frame."""
    known = worker_state(path)
    end = b"" if end_id is None else struct.pack("<I", end_id)
    compress = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True).compress

    def run(batch: pa.RecordBatch) -> list:
        flat, at = known.of_texts(batch.column(1))
        raw, stops = memoryview(flat.tobytes()), (4 * at).tolist()
        rows = [bytes(raw[a:b]) + end for a, b in zip(stops, stops[1:])]
        return [batch.column(0), [len(r) // 4 for r in rows], [xxhash.xxh64_intdigest(r) & 0xFFFFFFFF for r in rows], [compress(r) for r in rows]]

    return run


class Writer:
    """Writes one file: under a name of its own first, then renamed, so a task that runs again does no harm."""

    def __init__(self, folder: str, number: int):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/part-{number:06d}{SUFFIX}"
        self.draft = f"{self.path}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.table, self.doc_ids, self.tokens = [], [], 0

    def add(self, doc_id: int | None, n_tokens: int, check: int, frame: bytes) -> None:
        self.out.write(frame)
        self.table.append(struct.pack("<III", len(frame), n_tokens * 4, check))
        self.doc_ids.append(struct.pack("<?q", doc_id is not None, doc_id or 0))
        self.tokens += n_tokens

    def close(self) -> tuple[str, int, int]:
        ids = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(self.doc_ids))
        self.out.write(struct.pack("<II", IDS_FRAME, len(ids)) + ids)
        body = b"".join(self.table)
        foot = struct.pack("<IBI", len(self.table), DESCRIPTOR, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body) + len(foot)) + body + foot)
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.path, len(self.table), self.tokens


class Reader:
    """Random access to one file: doc_ids and sizes from its end, frames one at a time."""

    def __init__(self, folder: str, path: str):
        fs, _ = pafs.FileSystem.from_uri(folder)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{path}: no seek table with checksums")
        table_at = end - 9 - 12 * frames
        self.table = np.frombuffer(self.file.read_at(12 * frames, table_at), "<u4").reshape(-1, 3)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        ids_at = int(self.at[-1])
        packed = self.file.read_at(table_at - 8 - ids_at, ids_at)[8:]
        flat = zstandard.ZstdDecompressor().decompress(packed)
        self.doc_ids = [i if there else None for there, i in struct.iter_unpack("<?q", flat)]

    def ids(self, k: int) -> bytes:
        """Raw ids of the k-th document; only its frame is read and decompressed."""
        packed = self.file.read_at(int(self.table[k, 0]), int(self.at[k]))
        raw = zstandard.ZstdDecompressor().decompress(packed)
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k}: checksum differs from the seek table")
        return raw


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 2) -> DataFrame:
    """Encode docs (doc_id, text) and write them in ascending doc_id order; one row per file: number, path, docs, tokens.

    Files hold consecutive ranges of (doc_id, checksum), a task each, so rows of one doc_id may be in several.
    folder is a URI that all executors reach. Null texts are empty; null doc_ids come first; rows with
    equal doc_ids are all kept, ordered by their ids' checksums. Texts of any length are one frame. An
    empty table writes no file. Drafts that lost tasks left are removed.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    # encoded once: finding the ranges reads the stored frames, not the texts
    encoded = store(map_batches(docs.select("doc_id", "text"), "doc_id long, n_tokens long, check long, frame binary", lambda: encoder(tokenizer, end_id)), "frames")
    order = (F.asc_nulls_first("doc_id"), F.asc("check"), F.asc("row"))
    dealt = encoded.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for doc_id, n_tokens, check, frame in zip(*(c.to_pylist() for c in batch.columns[:4])):
                writer = writer or Writer(folder, number)
                writer.add(doc_id, n_tokens, check, frame)
        if writer:
            columns = zip((number, *writer.close()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["file", "path", "docs", "tokens"])

    files = store(dealt.mapInArrow(write, "file int, path string, docs long, tokens long"), "token-files")
    drop(encoded)
    fs, base = pafs.FileSystem.from_uri(folder)
    for found in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        if not found.path.endswith(SUFFIX):
            fs.delete_file(found.path)
    return files


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it), n_tokens, ids (binary)."""
    listed = sorted((r.file, r.path, r.tokens) for r in files.collect())  # a row per file, as many as partitions
    starts, before = [], 0
    for k, (_, path, tokens) in enumerate(listed):
        starts.append((k, path, before))
        before += tokens

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reader, rows = Reader(folder, path), []
                held = 0
                for k, doc_id in enumerate(reader.doc_ids):
                    raw = reader.ids(k)
                    rows.append((doc_id, start, len(raw) // 4, raw))
                    start += len(raw) // 4
                    held += len(raw)
                    if held > 4 << 20 or k + 1 == len(reader.doc_ids):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                        rows, held = [], 0

    listing = spark.createDataFrame(starts, "k int, path string, start long")
    return listing.repartition(max(1, len(starts)), "k").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def crc32_of(column: pa.Array) -> list[int]:
    return [zlib.crc32(raw) for raw in column.to_pylist()]


def token_output(docs: DataFrame, tokenizer: str, folder: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write docs as token files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/token-output-{uuid.uuid4().hex}"
    folder = qualified(spark, folder)
    files = write_token_files(docs, tokenizer, folder, end_id)
    back = read_token_files(spark, folder, files)
    return map_batches(back, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda: lambda b: [b.column(0), b.column(1), b.column(2), crc32_of(b.column(3))])
