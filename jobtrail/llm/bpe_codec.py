"""Operator 9: BPE encoding and decoding with content-defined chunk reuse.

1. A rolling hash over 8 bytes cuts texts into chunks at places that depend on the bytes alone,
   so a passage that documents share gives the same chunks in each.
2. Documents are dealt in the order of the least hash of their chunks: those that share most of
   their text come together, in one task or in two next to each other. However many share a
   chunk, ranges are cut by row as well, so no task gets a hot passage whole.
3. A chunk is encoded once and kept, in a table bounded by bytes: the ids between its first
   and its last cut (see pieces.py), which it knows by itself, and its two open ends.
4. A joint of two chunks is the end of one and the head of the next, encoded anew. It is
   taken only if it agrees: the joint is encoded together with the kept pieces on both sides, and
   these must come out as they were kept. If not, the stretch takes in the chunks on both sides and
   is tried again at the next ones, until it agrees or is the whole text.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, map_batches, partitions
from jobtrail.llm.pieces import Known, bytes_of, cuts, library_ids, ragged, special_strings

#: A chunk ends where the hash of 8 bytes is 0 in so many leading bits: 512 bytes on average.
CUT_BITS = 9
#: A cut that near to the one before is none; runs of one byte stay whole.
LEAST = 64
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of kept chunks, and joints known to agree, beyond which they are forgotten.
KEPT_BYTES, KEPT_JOINTS = 16 << 20, 50_000
#: Marks the last token of a word.
WORD_END = "</w>"


def chunk_ends(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the chunks of texts end, that of each text included; raw and at as from bytes_of()."""
    last = at[1:][np.diff(at) > 0]
    if len(raw) < 2 * LEAST:
        return last
    windows = np.ndarray((len(raw) - 7,), "<u8", buffer=raw.tobytes(), strides=(1,))
    hits = np.flatnonzero((windows * MULTIPLIER) >> np.uint64(64 - CUT_BITS) == 0) + 8
    hits = hits[hits < len(raw)]
    hits = hits[raw[hits] & 0xC0 != 0x80]  # never inside a character
    text = np.searchsorted(at, hits, side="right") - 1
    hits = hits[(np.diff(hits, prepend=-LEAST) >= LEAST) & (hits - at[text] >= LEAST)]
    return np.union1d(hits, last)


def chunk_key(chunk: bytes) -> int:
    return xxhash.xxh3_128_intdigest(chunk)


class Codec:
    """Ids of texts by chunks; one per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        shown = [tokenizer.id_to_token(i) or "" for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        if tokenizer.decode([1, 2], skip_special_tokens=False) != f"{shown[1]} {shown[2]}":
            raise ValueError(f"{path}: only tokens that are decoded with a space between them are supported")
        ends = np.array([t.endswith(WORD_END) for t in shown])
        words = [t.encode() + b" " for t in shown]
        self.shown, self.long = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
        self.from_ = np.cumsum(self.long) - self.long
        self.encode = lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        self.specials = special_strings(tokenizer)
        self.known = Known(library_ids(tokenizer, None, ends), self.specials)
        #: Of a chunk: its head, its tail, the ids between; and the first and the last piece between with the number of their ids.
        self.kept: dict[int, tuple | None] = {}
        self.bytes, self.agreed = 0, {}
        self.seen = self.made = 0

    def learn(self, fresh: dict[int, bytes]) -> None:
        """Keep chunks; one with fewer than two cuts has no ids of its own."""
        self.made += len(fresh)
        texts = list(fresh.values())
        column = pa.array(texts, pa.binary()).cast(pa.string())
        raw, at = bytes_of(column)
        start, first = cuts(raw, at, [])  # special strings are met by whole texts
        number, _ = self.numbers_of(raw, start)
        size, where = self.known.size[number].astype(np.int64), self.known.start[number]
        before = np.append(0, np.cumsum(size))
        flat = ragged(self.known.values, where, size)
        start = np.append(start, len(raw))
        for k, (key, text) in enumerate(fresh.items()):
            a, b = int(first[k]), int(first[k + 1])
            self.bytes += 2 * len(text) + 500
            if b - a < 3:
                self.kept[key] = None
                continue
            o = int(at[k])
            s = (start[[a + 1, a + 2, b - 2, b - 1]] - o).tolist()
            ids = flat[before[a + 1] : before[b - 1]].tobytes()
            self.kept[key] = (text[: s[0]], text[s[3] :], ids, text[s[0] : s[1]], int(size[a + 1]), text[s[2] : s[3]], int(size[b - 2]))

    def numbers_of(self, raw: np.ndarray, start: np.ndarray):
        """As Known.numbers(), of texts that are pieces."""
        at = np.append(start, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])
        return self.known.numbers(pieces)

    def joint(self, left: tuple | None, middle: bytes, right: tuple | None) -> bytes | None:
        """The ids of the stretch between the kept ids of two chunks, or None where they do not agree with it."""
        if left is None and right is None:
            return self.ids(middle.decode())
        a, na = (left[5], left[6]) if left else (b"", 0)
        b, nb = (right[3], right[4]) if right else (b"", 0)
        key = (a, middle, b)
        if key not in self.agreed:
            if len(self.agreed) > KEPT_JOINTS:
                self.agreed.clear()
            ids = self.ids((a + middle + b).decode())
            end = len(ids) - 4 * nb
            same = end >= 4 * na and (not left or left[2].endswith(ids[: 4 * na])) and (not right or right[2].startswith(ids[end:]))
            self.agreed[key] = ids[4 * na : end] if same else None
        return self.agreed[key]

    def ids(self, text: str) -> bytes:
        return np.array(self.encode([text])[0].ids, "<u4").tobytes() if text else b""

    def text_ids(self, parts: list[bytes], keys: list[int]) -> bytes:
        """The ids of a text from its chunks and the joints between them.

        A joint that does not agree opens the chunks on both sides of it: they belong to the stretch that is
        encoded anew, whose ends are those of the chunks beyond. With none left the stretch is the whole text.
        """
        taken: list[tuple] = []  # chunk, its ids with those of the joint before, text from the end of the chunk before to its own tail
        open_end = b""
        for part, key in zip(parts, keys):
            chunk = self.kept[key]
            if chunk is None:
                open_end += part  # no ids of its own: the stretch to encode anew grows
                continue
            between = self.joint(taken[-1][0] if taken else None, open_end + chunk[0], chunk)
            if between is not None:
                taken.append((chunk, between + chunk[2], open_end + part[: len(part) - len(chunk[1])]))
                open_end = chunk[1]
            else:
                open_end = (taken.pop()[2] if taken else b"") + open_end + part
        while (last := self.joint(taken[-1][0] if taken else None, open_end, None)) is None:
            open_end = taken.pop()[2] + open_end
        return b"".join([*(ids for _, ids, _ in taken), last])

    def of_texts(self, column: pa.Array) -> list[bytes]:
        raw, at = bytes_of(column)
        ends = chunk_ends(raw, at)
        data, starts = raw.tobytes(), np.append(0, ends[:-1]) if len(ends) else ends
        parts = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        keys = [chunk_key(p) for p in parts]
        if self.bytes > KEPT_BYTES:
            self.kept, self.bytes = {}, 0
        self.seen += len(parts)
        fresh = {k: p for k, p in zip(keys, parts) if k not in self.kept}
        if fresh:
            self.learn(fresh)
        first = np.searchsorted(starts, at).tolist()
        low = data.lower() if any(s.lower() in data.lower() for s in self.specials) else b""
        out = []
        for k, (a, b) in enumerate(zip(first, first[1:])):
            own = low[at[k] : at[k + 1]]
            whole = bool(own) and any(s.lower() in own for s in self.specials)
            out.append(self.ids(data[at[k] : at[k + 1]].decode()) if whole else self.text_ids(parts[a:b], keys[a:b]))
        return out

    def decoded(self, ids: np.ndarray) -> bytes:
        """Tokens with a space between them, as the library decodes."""
        return ragged(self.shown, self.from_[ids], self.long[ids])[:-1].tobytes()


@lru_cache(maxsize=1)
def worker_state(path: str) -> Codec:
    return Codec(path)


def codec(path: str):
    state = worker_state(path)

    def run(batch: pa.RecordBatch) -> list:
        seen, made = state.seen, state.made
        ids = state.of_texts(batch.column(1))
        flat = np.frombuffer(b"".join(ids), "<u4")
        stops = np.cumsum([len(i) // 4 for i in ids]).tolist()
        text = [state.decoded(flat[a:b]) for a, b in zip([0, *stops], stops)]
        sha = lambda raw: hashlib.sha256(raw).hexdigest()
        n = len(ids)
        met = [state.seen - seen] + [0] * (n - 1) if n else []
        new = [state.made - made] + [0] * (n - 1) if n else []
        return [batch.column(0), [len(i) // 4 for i in ids], [sha(i) for i in ids], [sha(t) for t in text], met, new]

    return run


def least_chunk():
    """f(batch of doc_id, text) -> doc_id, text, the least key of the text's chunks."""

    def run(batch: pa.RecordBatch) -> list:
        raw, at = bytes_of(batch.column(1))
        ends = chunk_ends(raw, at)
        data, starts = raw.tobytes(), np.append(0, ends[:-1]) if len(ends) else ends
        keys = [xxhash.xxh3_64_intdigest(data[a:b]) >> 1 for a, b in zip(starts.tolist(), ends.tolist())]
        first = np.searchsorted(starts, at).tolist()
        return [batch.column(0), batch.column(1), [min(keys[a:b], default=-1) for a, b in zip(first, first[1:])]]

    return run


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """bpe_codec() with the number of chunks met and encoded, on one row of each batch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    # not stored: finding the ranges hashes the chunks once more, which costs less than a second copy of the texts on disk
    keyed = map_batches(docs.select("doc_id", "text"), "doc_id long, text string, chunk long", least_chunk)
    order = ("chunk", "row")
    dealt = keyed.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    return map_batches(dealt.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, chunks_met long, chunks_encoded long", lambda: codec(tokenizer))


def bpe_codec(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row of docs (doc_id, text): n_tokens, ids_sha256, decoded_sha256.

    tokenizer is the path of a word-end BPE file, the same on every executor. Repeated rows
    give repeated results, a null text is empty (no ids, digests of nothing), an empty table
    gives an empty result, a null doc_id stays null. Texts of any length are encoded whole;
    further columns are not read.
    """
    return encoded(docs, tokenizer).drop("chunks_met", "chunks_encoded")
