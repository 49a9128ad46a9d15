"""Operator 11: byte-level BPE by recursive queries of DuckDB, one connection per task's worker.

Every token of a word is a row (word, id, token, next id). A round of the recursive query joins
neighbours with the merge table, finds each word's leftmost pair of least rank and contracts it;
words without a pair drop out, and the query ends when no word is left. Ids are decoded by a join
with the vocabulary and an aggregation in token order.

Words are distinct pre-tokens of the pieces that a worker has not met yet, so each is contracted
once per worker as long as the bounded table of pieces holds.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from jobtrail.llm.common import bounded_batches, map_batches
from jobtrail.llm.pieces import Known, ragged

#: Words of more bytes contract all places of their least pair in one round, where that gives the same.
LONG_WORD = 64
#: Bytes of words in one query, rounds of long words in one query, and tokens that are decoded at once.
WORD_BYTES, ROUNDS, DECODED = 400_000, 32, 500_000

#: What joins a row with the one after it: pairs that the merge table has, by their rank (the id of what they make).
PAIRS = """
  select a.w, a.id, b.id gone, b.nxt after, made, lone
  from s a join s b on a.nxt = b.id join merges on pair = (a.tok::bigint << 20 | b.tok)
"""
ONE_PAIR = f"""
with recursive s(n, w, id, tok, nxt) as (
  select 0, w, id, tok, nxt from start
  union all
  select s.n + 1, s.w, s.id, case when s.id = best.id then best.made else s.tok end, case when s.id = best.id then best.after else s.nxt end
  from s join (
    select w, min({{'made': made, 'id': id, 'gone': gone, 'after': after}}) best from ({PAIRS}) group by w
  ) using (w)
  where s.id <> best.gone
), ended as (select w, max(n) n from s group by w)
select w, id, tok, nxt, n from s join ended using (w, n) order by id
"""
#: As above for all places of the least pair: of overlapping ones every second, of a pair whose product may
#: be part of a pair of lower rank only the first.
ALL_PAIRS = f"""
with recursive s(n, w, id, tok, nxt) as (
  select 0, w, id, tok, nxt from start
  union all
  (with least as (select * from ({PAIRS}) qualify made = min(made) over (partition by w)),
  fresh as (select *, lag(gone) over (partition by w order by id) is distinct from id first, row_number() over (partition by w order by id) place from least),
  runs as (select *, sum(first::int) over (partition by w order by id) run from fresh),
  turns as (select *, row_number() over (partition by w, run order by id) turn from runs),
  hit as (select w, id, gone, after, made from turns where turn % 2 = 1 and (place = 1 or not lone))
  select s.n + 1, s.w, s.id, coalesce(hit.made, s.tok), coalesce(hit.after, s.nxt)
  from s left join hit on s.id = hit.id
  where s.n < {ROUNDS} and s.w in (select w from hit) and s.id not in (select gone from hit))
), ended as (select w, max(n) n from s group by w)
select w, id, tok, nxt, n from s join ended using (w, n) order by id
"""
#: Bytes of each document's stretch of ids, as hexadecimal digits.
DECODE = "select doc, string_agg(shown, '' order by place) shown from ids join vocabulary using (id) group by doc order by doc"


def alone(ranks: dict[bytes, int], made: list[tuple[int, int, int]]) -> np.ndarray:
    """For each merge whether its product may at once be part of a pair of lower rank.

    Such a pair (product, y) matters only if the merge's right part and y had none of lower rank
    themselves, as else that one came first; so also on the left.
    """
    token = {rank: t for t, rank in ranks.items()}
    none = len(ranks) + max(ranks.values())
    after, before = {}, {}
    for a, b, rank in made:
        if rank < a:
            after.setdefault(a, []).append(token[b])
        if rank < b:
            before.setdefault(b, []).append(token[a])
    right = lambda b, rank: any(ranks.get(token[b] + y, none) >= rank for y in after.get(rank, ()))
    left = lambda a, rank: any(ranks.get(x + token[a], none) >= rank for x in before.get(rank, ()))
    return np.array([right(b, rank) or left(a, rank) for a, b, rank in made], bool)


class Codec:
    """A vocabulary with its merge table in DuckDB: which pairs of tokens make which token."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        left, right, rank = np.array(made, np.int64).reshape(-1, 3).T
        lone = alone(ranks, made)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        self.fill("merges", pair=left << 20 | right, made=rank.astype(np.int32), lone=lone)
        self.fill("vocabulary", id=np.array(list(ranks.values()), np.uint32), shown=[t.hex() for t in ranks])

    def fill(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"create or replace table {name} as select * from given")
        self.con.unregister("given")

    def contract(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all ids, by one of the recursive queries."""
        size = np.array([len(w) for w in words], np.int64)
        tok, w = self.first[np.frombuffer(b"".join(words), np.uint8)], np.repeat(np.arange(len(words)), size)
        count, ended = np.zeros(len(words), np.int64), []
        while len(tok):
            nxt = np.arange(1, len(tok) + 1, dtype=np.int32)
            nxt[np.append(np.flatnonzero(np.diff(w)), len(w) - 1)] = -1
            self.con.register("start", pa.table({"w": w.astype(np.int32), "id": np.arange(len(tok), dtype=np.int32), "tok": tok, "nxt": nxt}))
            out = self.con.execute(query).fetchnumpy()
            w, tok = out["w"].astype(np.int64), out["tok"]
            over = query is ONE_PAIR or out["n"] < ROUNDS  # words that have no pair left
            more = np.zeros(len(tok), bool) if over is True else ~over
            count += np.bincount(w[~more], minlength=len(words))
            ended.append((w[~more], tok[~more]))
            w, tok = w[more], tok[more]
        w, tok = np.concatenate([e[0] for e in ended]), np.concatenate([e[1] for e in ended])
        return count, tok[np.argsort(w, kind="stable")]

    def ids_of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each word, and all ids. A word that is a token is that one."""
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        size, flat = np.ones(len(words), np.int64), [whole[whole >= 0].astype(np.int32)]
        order = [np.flatnonzero(whole >= 0)]
        others = np.flatnonzero(whole < 0)
        length = np.array([len(words[k]) for k in others], np.int64)
        for query, rows in ((ONE_PAIR, others[length <= LONG_WORD]), (ALL_PAIRS, others[length > LONG_WORD])):
            block = np.cumsum([len(words[k]) for k in rows]) // WORD_BYTES
            for part in np.split(rows, np.flatnonzero(np.diff(block)) + 1) if len(rows) else ():
                size[part], ids = self.contract([words[k] for k in part], query)
                flat.append(ids)
                order.append(part)
        flat, order = np.concatenate(flat), np.concatenate(order)
        at = np.empty(len(words), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return size, ragged(flat, at, size)

    def learn(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of tokens of each piece of text, and all ids."""
        number: dict[str, int] = {}
        met, per_piece = [], np.zeros(len(pieces), np.int64)
        for k, piece in enumerate(pieces):
            own = self.pattern.findall(piece.decode())
            met += [number.setdefault(t, len(number)) for t in own]
            per_piece[k] = len(own)
        size, flat = self.ids_of_words([t.encode() for t in number])
        met = np.array(met, np.int64)
        ids = ragged(flat, (np.cumsum(size) - size)[met], size[met])
        return np.diff(np.append(0, np.cumsum(size[met]))[np.append(0, np.cumsum(per_piece))]), ids.astype("<u4")

    def decoded(self, flat: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(text number, bytes) of the ids of texts, each text's bytes in one or more stretches in order."""
        doc = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
        for a in range(0, len(flat), DECODED):
            part = slice(a, a + DECODED)
            self.con.register("ids", pa.table({"doc": doc[part], "place": np.arange(len(doc[part]), dtype=np.int32), "id": flat[part]}))
            for k, shown in self.con.execute(DECODE).fetchall():
                yield k, bytes.fromhex(shown)


@lru_cache(maxsize=1)
def worker_state(path: str, pattern: str) -> tuple[Codec, Known]:
    """One per Python worker: the codec, and the bounded table of pieces' ids."""
    codec = Codec(path, pattern)
    return codec, Known(codec.learn, [])


def coder(path: str, pattern: str, with_text: bool) -> Callable[[pa.RecordBatch], list]:
    codec, known = worker_state(path, pattern)

    def run(batch: pa.RecordBatch) -> list:
        flat, at = known.of_texts(batch.column(1))
        raw, stops = memoryview(flat.tobytes()), (4 * at).tolist()
        digests = [hashlib.sha256() for _ in stops[1:]]
        texts = [[] for _ in stops[1:]] if with_text else None
        for k, part in codec.decoded(flat, at):
            digests[k].update(part)
            if with_text:
                texts[k].append(part)
        ids = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(stops, stops[1:])]
        out = [batch.column(0), np.diff(at), ids, [d.hexdigest() for d in digests]]
        return out + [[flat[a // 4 : b // 4].tolist() for a, b in zip(stops, stops[1:])], [b"".join(t) for t in texts]] if with_text else out

    return run


def byte_bpe(docs: DataFrame, vocabulary: str, pattern: str, with_text: bool = False) -> DataFrame:
    """Encode and decode whole texts of docs (doc_id, text) by a vocabulary of byte tokens and ranks.

    Every match of the pattern is encoded by itself; no string is special. vocabulary is a path that
    is the same on every executor. Returns doc_id, n_tokens, ids_sha256 (of the ids as little-endian
    unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode to); with_text
    adds ids and decoded themselves.

    Rows stay as they are: repeated rows are encoded each, a null text is empty (no tokens), a null
    doc_id stays null, an empty table gives an empty result. Long texts are whole; of a long word
    the rounds are as many as it has different merges. Further columns are not read. The pattern
    must end a match at spaces and line feeds and between ASCII letters and punctuation as the
    public one does: that is where pieces are cut.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded binary" if with_text else "")
    return map_batches(docs.select("doc_id", "text"), schema, lambda: coder(vocabulary, pattern, with_text))
