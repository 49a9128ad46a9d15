"""Operator 2: token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a whole batch lie in one flat array of symbols. In every round each
pre-token that still has a mergeable pair applies its own lowest-rank pair, all of
them at once; pre-tokens without one leave the arrays. What is left are the tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, map_batches
from jobtrail.llm.pieces import Known, bytes_of

#: Fixed value: the public pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens merged at once.
ROUND = 20_000
NO_RANK = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge ranks of a tokenizer file, looked up for whole arrays of symbol pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        rule = spec["pre_tokenizer"]
        if rule["type"] != "ByteLevel" or rule["add_prefix_space"] or not rule.get("use_regex", True) or spec["normalizer"]:
            raise ValueError(f"{path}: only byte-level BPE with the public pattern and without normalisation is counted")
        vocab = spec["model"]["vocab"]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank, made_sorted = key[order], order.astype(np.int64), made[order]
        self.made = made_sorted
        #: Merges whose product other merges make too: applied one at a time, leftmost first.
        self.shared = np.bincount(made, minlength=self.size)[made_sorted] > 1
        self.special = [t["content"] for t in spec["added_tokens"]]

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table and rank of each pair (NO_RANK where there is none)."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return at, np.where(self.key[at] == key, self.rank[at], NO_RANK)

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Number of symbols that survive in each pre-token."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        done = np.minimum(lengths, 1)
        owner = np.flatnonzero(lengths > 1)
        if not len(owner):
            return done
        symbols = self.first[np.frombuffer(b"".join(tokens[i] for i in owner), np.uint8)]
        size = lengths[owner]
        while len(owner):
            start = np.cumsum(size) - size
            row = np.repeat(np.arange(len(owner)), size)
            at, rank = self.look(symbols[:-1], symbols[1:])
            at, rank = np.append(at, 0), np.append(rank, NO_RANK)
            rank[start + size - 1] = NO_RANK  # no pair reaches into the next pre-token
            lowest = np.minimum.reduceat(rank, start)
            live = lowest < NO_RANK
            done[owner[~live]] = size[~live]
            hit = np.flatnonzero((rank == lowest[row]) & live[row])
            # of a run of overlapping hits (one symbol repeated) every second one merges
            fresh = np.append(True, np.diff(hit) > 1)
            run = np.maximum.accumulate(np.where(fresh, hit, 0))
            hit = hit[(hit - run) % 2 == 0]
            lone = self.shared[at[hit]]
            if lone.any():
                first = np.append(True, row[hit][1:] != row[hit][:-1])
                hit = hit[first | ~lone]
            symbols[hit] = self.made[at[hit]]
            keep = live[row]
            keep[hit + 1] = False
            size = (size - np.bincount(row[hit], minlength=len(owner)))[live]
            owner, symbols = owner[live], symbols[keep]
        return done


@lru_cache(maxsize=1)
def worker_state(path: str) -> Known:
    """One per Python worker: how to count, and the counts known so far."""
    merges, pre = Merges(path), regex.compile(PRE_TOKEN)
    special = regex.compile("(" + "|".join(map(regex.escape, merges.special)) + ")") if merges.special else None

    def learn(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        tokens, owner, extra = [], [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            text = piece.decode()
            if text[0] == " " and text[1:].isalpha():
                tokens.append(piece)
                owner.append(k)
                continue
            parts = special.split(text) if special and special.search(text) else [text]
            extra[k] = len(parts) // 2
            own = [t.encode() for p in parts[::2] for t in pre.findall(p)]
            tokens += own
            owner += [k] * len(own)
        counts = np.concatenate([merges.count(tokens[at : at + ROUND]) for at in range(0, max(1, len(tokens)), ROUND)])
        return np.ones(len(pieces), np.int64), np.bincount(np.array(owner, np.int64), counts, len(pieces)).astype(np.int64) + extra

    return Known(learn, [t.encode() for t in merges.special], "<i8")


def counter(path: str):
    known = worker_state(path)

    def count(batch: pa.RecordBatch) -> list:
        _, at = bytes_of(batch.column(1))
        return [batch.column(0), np.diff(at), known.totals(batch.column(1))]

    return count


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Per row of docs (doc_id, text): n_bytes, n_tokens, over_limit (n_tokens > limit).

    tokenizer is the path of a byte-level BPE file, the same on every executor. Rows
    stay as they are: repeated rows are counted each, a null text is empty (0 tokens),
    an empty table gives an empty result, a null doc_id stays null.
    """
    bounded_batches(docs.sparkSession)
    counted = map_batches(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long", lambda: counter(tokenizer))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
