"""Operator 13: the cheapest repair of conversations, by a time-major tensor DP.

Turns are sorted by one range shuffle over (conversation, turn, role, text digest, row), so a
conversation of any size lies in consecutive partitions. A task buckets the conversations it holds
whole by their length; a bucket is a tensor turn x conversation, every step of the DP is one array
operation over all of its conversations: backward costs per state are stored for every turn, then
the edits are traced forward, also for all conversations at once.

Pieces at the edges of partitions, and blocks of conversations longer than BLOCK_ROWS, are solved by
the same DP in three streams over small rows: every block gives the costs between its entry and exit
states; a pass from each conversation's end gives the costs behind each block; every block is traced
for all sets of entry states; a pass from the start picks the set. Blocks are then written out and
hashed in order. No pass holds more than a block.

Roles are states of the automaton s?(ua)+: 0 nothing so far, 1 after system, 2 after user, 3 after
assistant; 0 and 3 end a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, drop, partitions, store
from jobtrail.llm.groups import with_least

#: Fixed: the role of each code, its initial, and what the edits cost.
ROLES, INITIALS = ("system", "user", "assistant"), "sua"
RETELL, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE = " \t\n\v\f\r"
#: Rows and bytes of text of a block; turns that a task holds before it solves them.
BLOCK_ROWS, BLOCK_BYTES, HELD = 4096, 8 << 20, 20_000
NEVER = 1 << 40
#: State after a turn of role s, u, a or another one from each state; -1 where there is none. And after an inserted turn.
AFTER = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
INSERTED = np.array([2, 2, 3, 2])
END = np.array([0, NEVER, NEVER, 0])
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
D, I, K, R = b"DIKR"
#: Sets of states, by bits.
SETS = (np.arange(16)[:, None] >> np.arange(4) & 1).astype(bool)


def with_inserts(cost: np.ndarray) -> np.ndarray:
    """Least costs (..., state) if turns may be inserted first."""
    two, three = np.minimum(cost[..., 2], INSERT + cost[..., 3]), np.minimum(cost[..., 3], INSERT + cost[..., 2])
    return np.stack([np.minimum(cost[..., 0], INSERT + two), np.minimum(cost[..., 1], INSERT + two), two, three], -1)


def choices(code: np.ndarray, gone: np.ndarray, cut: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs (conversation, state) of deleting, keeping and renaming one turn of each conversation."""
    after = AFTER.T[code]  # conversation, state
    kept = np.where((after >= 0) & ~gone[:, None], np.take_along_axis(later, np.maximum(after, 0), 1) + cut[:, None], NEVER)
    renamed = np.where(gone[:, None], NEVER, later[:, INSERTED] + RETELL + cut[:, None])
    return later + DELETE, kept, renamed


def backward(code: np.ndarray, gone: np.ndarray, cut: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Least costs (turn + 1, conversation, state) of all that follows, with end (conversation, state) behind the last turn."""
    costs = np.empty((len(code) + 1, *end.shape), np.int64)
    costs[-1] = np.minimum(with_inserts(end), NEVER)
    for t in range(len(code) - 1, -1, -1):
        costs[t] = np.minimum(with_inserts(np.minimum.reduce(choices(code[t], gone[t], cut[t], costs[t + 1]))), NEVER)
    return costs


def forward(code: np.ndarray, gone: np.ndarray, cut: np.ndarray, costs: np.ndarray, states: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edits (3 * (turn + 1), conversation; 0 is none) in the least order of letters, and the states at the end.

    states (conversation, state) are all that the edits so far may have led to: equal letters stay
    together until they differ. Where last, turns may be inserted behind the last one.
    """
    edits = np.zeros((len(code) + 1, 3, len(states)), np.uint8)
    rows = np.arange(len(states))
    for t in range(len(code) + 1):
        now, ends = costs[t], t == len(code)
        options = choices(code[t], gone[t], cut[t], costs[t + 1]) if not ends else None
        for k in (0, 1):  # more than two inserted turns at one place come back to the same state
            first = (states & (options[0] == now)).any(1) if not ends else (states & (now == 0) & (END == 0)).any(1) | ~last
            fit = states & (now[:, INSERTED] + INSERT == now) & (now < NEVER) & ~first[:, None]
            some = fit.any(1)
            edits[t, k, some] = I
            moved = np.zeros_like(states)
            for q in range(4):
                moved[:, INSERTED[q]] |= fit[:, q]
            states = np.where(some[:, None], moved, states)
        if ends:
            break
        done = np.zeros(len(states), bool)
        reached = np.zeros_like(states)
        targets = (np.broadcast_to(np.arange(4), states.shape), AFTER.T[code[t]], np.broadcast_to(INSERTED, states.shape))
        for letter, option, target in zip((D, K, R), options, targets):
            fit = states & (option == now) & (now < NEVER) & ~done[:, None]
            some = fit.any(1)
            edits[t, 2, some] = letter
            for q in range(4):
                on = fit[:, q]
                reached[rows[on], target[on, q]] = True
            done |= some
        states = reached
    return edits.reshape(-1, len(rows)), states


class Turns(NamedTuple):
    """The turns of one piece of a conversation, in order."""

    role: list[str]
    text: list[str]
    turn: list[int | None]
    code: np.ndarray
    gone: np.ndarray
    cut: np.ndarray
    blank: int
    duplicate: int


def judged(role: list[str], text: list[str], turn: list[int | None], again: list[bool]) -> Turns:
    """again: role and text of the row were seen before it."""
    bare = [t.strip(WHITE) for t in text]
    blank = np.array([not b for b in bare], bool)
    duplicate = np.array(again, bool) & ~blank
    gone = blank | duplicate
    cut = np.array([b[-1:] not in (".", "!", "?") for b in bare], bool) & ~gone
    code = np.array([INITIALS.find(r[:1]) if r else 3 for r in role], np.int64) % 4
    return Turns(role, text, turn, code, gone, cut, int(blank.sum()), int(duplicate.sum()))


def solved(pieces: list[Turns], end: np.ndarray, entry: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Costs at the start (piece, state), edits and states at the end of pieces, bucketed by length."""
    costs, edits, states = np.empty((len(pieces), 4), np.int64), [b""] * len(pieces), np.zeros((len(pieces), 4), bool)
    length = np.array([len(p.role) for p in pieces])
    for n in np.unique(length):
        bucket = np.flatnonzero(length == n)
        tensor = [np.array([getattr(pieces[k], f) for k in bucket]).reshape(len(bucket), n).T for f in ("code", "gone", "cut")]
        cost = backward(*tensor, end[bucket])
        traced, states[bucket] = forward(*tensor, cost, entry[bucket], last[bucket])
        costs[bucket] = cost[0]
        for k, column in zip(bucket, np.ascontiguousarray(traced.T)):
            edits[k] = column.tobytes().translate(None, b"\0")
    return costs, edits, states


def repaired(piece: Turns, edits: bytes, place: int, system: bool) -> Iterator[tuple[str, str]]:
    """Role and text of the turns that the edits leave; the first of them has that place in its conversation."""
    at = 0
    for e in edits:
        if e != D:
            name = ROLES[1 + (place + system) % 2]
            yield (piece.role[at] if e == K else name), ("" if e == I else piece.text[at])
            place += 1
        at += e != I


def begins_with_system(piece: Turns, edits: bytes) -> bool:
    """Whether the first turn that is left is one of the system."""
    at = 0
    for e in edits:
        if e == K:
            return bool(piece.code[at] == 0)
        if e != D:
            return False
        at += 1
    return False


def tally(piece: Turns) -> dict:
    """What a piece adds to the counts of its conversation, and its edges."""
    initials = [r[:1] for r in piece.role]
    turns = [t for t in piece.turn if t is not None]  # in order
    return {
        "n": len(initials), "blank": piece.blank, "duplicate": piece.duplicate, "truncated": int(piece.cut.sum()), "illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])),
        "initials": [initials[0], initials[-1]] if initials else [], "turns": [turns[0], turns[-1]] if turns else [], "distinct": len(set(turns)),
    }


class Summary:
    """The row of one conversation, from its pieces in order."""

    def __init__(self):
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.initial, self.low, self.high, self.distinct = None, None, None, 0
        self.edits, self.hash, self.left = [], hashlib.sha256(), 0

    def add(self, t: dict, edits: bytes, text: bytes, left: int) -> None:
        for k in self.counts:
            self.counts[k] += t[k]
        if t["n"]:
            self.counts["illegal"] += self.initial is not None and (self.initial, t["initials"][0]) not in LEGAL
            self.initial = t["initials"][1]
        if t["turns"]:
            self.distinct += t["distinct"] - (self.high == t["turns"][0])
            self.low, self.high = t["turns"][0] if self.low is None else self.low, t["turns"][1]
        if left:
            self.hash.update((b"\n" if self.left else b"") + text)
            self.left += left
        self.edits.append(edits)

    def row(self, cost: int) -> dict:
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)
        return {"gaps": gaps, **self.counts, "cost": cost, "audit": b"".join(self.edits).decode(), "repaired_sha256": self.hash.hexdigest()}


def written(turns: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{r}:{t}" for r, t in turns).encode()


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "array<struct<role:string,text:string>>"
PIECE = "part int, block int, role array<string>, text array<string>, turn array<long>, key array<string>"


def arrow(schema: str, df: DataFrame) -> tuple:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = df.sparkSession.createDataFrame([], schema).schema
    return fields, to_arrow_schema(fields)


def mapped(df: DataFrame, schema: str, make: Callable[[], Callable[[Iterator[dict]], Iterator[dict]]]) -> DataFrame:
    """Rows of a partition in order, as a stream of dicts to a stream of dicts."""
    fields, types = arrow(schema, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in make()(r for b in batches for r in b.to_pylist()):
            held.append(row)
            size += sum(map(len, row.get("text") or ())) + 2 * len(row.get("written") or ()) + 200
            if size > BLOCK_BYTES or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=types)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=types)

    return df.mapInArrow(run, fields)


def split(with_turns: bool, block_rows: int) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Sorted rows of a partition: the results of conversations that lie in it whole, and blocks of the others."""

    def results(whole: list[tuple[int | None, Turns]]) -> Iterator[dict]:
        if not whole:
            return
        pieces, n = [p for _, p in whole], len(whole)
        costs, edits, _ = solved(pieces, np.tile(END, (n, 1)), np.tile(SETS[1], (n, 1)), np.ones(n, bool))
        for (conv, piece), cost, e in zip(whole, costs[:, 0].tolist(), edits):
            left, s = list(repaired(piece, e, 0, begins_with_system(piece, e))), Summary()
            s.add(tally(piece), e, written(left), len(left))
            yield {"conv_id": conv, "whole": True, **s.row(cost)} | ({"turns": [{"role": r, "text": t} for r, t in left]} if with_turns else {})

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        part, block, begun, first = TaskContext.get().partitionId(), 0, False, True
        conv, held, size, whole, waiting = None, [], 0, [], 0

        def cut() -> dict:
            nonlocal block, held, size
            block += 1
            out = {"conv_id": conv, "whole": False, "part": part, "block": block, "role": [r["role"] for r in held], "text": [r["text"] for r in held], "turn": [r["turn"] for r in held], "key": [r["key"] for r in held]}
            held, size = [], 0
            return out

        broken = True  # the first conversation may have begun in an earlier partition
        for r in rows:
            if begun and r["conv_id"] != conv:
                if broken:
                    yield cut()
                else:
                    seen, again = set(), []
                    for h in held:
                        again.append((h["role"], h["key"]) in seen)
                        seen.add((h["role"], h["key"]))
                    whole.append((conv, judged([h["role"] for h in held], [h["text"] for h in held], [h["turn"] for h in held], again)))
                    waiting += len(held) + 1
                    held, size = [], 0
                    if waiting >= HELD:
                        yield from results(whole)
                        whole, waiting = [], 0
                broken = False
            conv, begun = r["conv_id"], True
            for _ in range(r["copies"]):
                held.append(r)
                size += len(r["text"])
            if len(held) >= block_rows or size > BLOCK_BYTES:
                broken = True
                yield cut()
        if begun:
            yield cut()  # the last one may go on
        yield from results(whole)

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, key, copies) of which some are dropped (no copies), emptied, cut of stops, doubled or renamed."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    k = F.col("kind")
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("key", F.sha2("text", 256))


def as_turns(r: dict) -> Turns:
    return judged(r["role"], r["text"], r["turn"], r["again"])


def in_order(df: DataFrame, schema: str, make: Callable, backwards: bool = False) -> DataFrame:
    """A stream over the blocks of each conversation in order; the step keeps what it needs of the block before."""
    way = F.desc if backwards else F.asc
    return mapped(df.repartition("conv_id").sortWithinPartitions("conv_id", way("part"), way("block")), schema, make)


def by_conversation(rows: Iterator[dict]) -> Iterator[tuple[dict, bool]]:
    """Rows, and whether each is the first of its conversation."""
    before = None
    for r in rows:
        yield r, before is None or before != (r["conv_id"],)
        before = (r["conv_id"],)


def gates() -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Of each block the costs from each entry to each exit state."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            p = as_turns(r)
            tensor = [np.repeat(x[:, None], 4, 1) for x in (p.code, p.gone, p.cut)]
            yield {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "gate": backward(*tensor, np.where(np.eye(4, dtype=bool), 0, NEVER))[0].T.ravel().tolist()}

    return run


def behind() -> Callable[[Iterator[dict]], Iterator[dict]]:
    """From each conversation's end: the costs behind each block, and whether it is the last."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        cost = END
        for r, last in by_conversation(rows):
            cost = np.minimum(with_inserts(END), NEVER) if last else cost
            yield {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "end": (END if last else cost).tolist(), "last": last}
            cost = np.minimum((np.array(r["gate"]).reshape(4, 4) + cost).min(1), NEVER)

    return run


def ways() -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Of each block, for every set of entry states: the exit states, how many turns are left, whether the first is the system's."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            p = as_turns(r)
            costs, edits, states = solved([p] * 16, np.tile(r["end"], (16, 1)), SETS, np.full(16, r["last"]))
            left = [len(e) - e.count(D) for e in edits]
            yield {
                "conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "exit": (states @ (1 << np.arange(4))).tolist(), "left": left,
                "system": [begins_with_system(p, e) for e in edits], "start": int(costs[0, 0]),
            }

    return run


def entered() -> Callable[[Iterator[dict]], Iterator[dict]]:
    """From each conversation's start: the set of states at each block's entry, and how many turns are left before it."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        entry, place, system, cost = 1, 0, False, 0
        for r, first in by_conversation(rows):
            if first:
                entry, place, system, cost = 1, 0, False, r["start"]
            if not place and r["left"][entry]:
                system = r["system"][entry]
            yield {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "entry": entry, "place": place, "system": system, "cost": cost}
            entry, place = r["exit"][entry], place + r["left"][entry]

    return run


def spelled(with_turns: bool) -> Callable[[Iterator[dict]], Iterator[dict]]:
    """Of each block its edits, the text that is left, and its counts."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for r in rows:
            p = as_turns(r)
            _, (edits,), _ = solved([p], np.array([r["end"]]), SETS[[r["entry"]]], np.array([r["last"]]))
            left = list(repaired(p, edits, r["place"], r["system"]))
            out = {"conv_id": r["conv_id"], "part": r["part"], "block": r["block"], "edits": edits, "written": written(left), "left": len(left), "cost": r["cost"], **tally(p)}
            yield out | ({"turns_left": [{"role": a, "text": b} for a, b in left]} if with_turns else {})

    return run


def joined() -> Callable[[Iterator[dict]], Iterator[dict]]:
    """One row of each conversation from its blocks in order."""

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        s, conv, cost = None, None, 0
        for r, first in by_conversation(rows):
            if first and s:
                yield {"conv_id": conv, **s.row(cost)}
            if first:
                s, conv, cost = Summary(), r["conv_id"], r["cost"]
            s.add(r, r["edits"], r["written"], r["left"])
        if s:
            yield {"conv_id": conv, **s.row(cost)}

    return run


AT = ("conv_id", "part", "block")
KEY = "conv_id long, part int, block int"
TALLY = "n long, blank long, duplicate long, truncated long, illegal long, initials array<string>, turns array<long>, distinct long"


def blocks_solved(blocks: DataFrame, with_turns: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Blocks with their edits and the text that is left, and the stored tables that they need."""
    turns = blocks.select(*AT, F.posexplode(F.arrays_zip("role", "key")).alias("i", "x")).select(*AT, "i", F.col("x.role").alias("role"), F.col("x.key").alias("key"), F.struct("part", "block", "i").alias("place"))
    marked = with_least(turns, ["conv_id", "role", "key"], "place", "first").groupBy(*AT).agg(F.array_sort(F.collect_list(F.struct("i", (F.col("place") != F.col("first")).alias("again")))).alias("marks"))

    def beside(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in AT]
        return a.alias("a").join(b.alias("b"), same, "left").select("a.*", *(f"b.{c}" for c in columns))

    base = store(beside(blocks, marked, "marks").select(*AT, "role", "text", "turn", F.coalesce(F.col("marks.again"), F.array().cast("array<boolean>")).alias("again")), "repair-blocks")
    ends = in_order(mapped(base, f"{KEY}, gate array<long>", gates), f"{KEY}, end array<long>, last boolean", behind, backwards=True)
    based = store(beside(base, ends, "end", "last"), "repair-ends")
    starts = in_order(mapped(based, f"{KEY}, exit array<int>, left array<long>, system array<boolean>, start long", ways), f"{KEY}, entry int, place long, system boolean, cost long", entered)
    done = mapped(beside(based, starts, "entry", "place", "system", "cost"), f"{KEY}, edits binary, written binary, left long, cost long, {TALLY}" + (f", turns_left {TURNS}" if with_turns else ""), lambda: spelled(with_turns))
    return done, [base, based]


def split_rows(rows: DataFrame, with_turns: bool, block_rows: int) -> DataFrame:
    bounded_batches(rows.sparkSession)
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "key", "tie")]
    ranged = tied.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).drop("tie")
    return store(mapped(ranged, f"conv_id long, whole boolean, {RESULT}, {PIECE}" + (f", turns {TURNS}" if with_turns else ""), lambda: split(with_turns, block_rows)), "repair-split")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The cheapest repair of each conversation of rows (conv_id, turn, role, text, key, copies), as damaged() gives them.

    Edits are K (keep, 0), R (another role, user or assistant, 2), D (delete, 3; a must for blank and
    duplicate turns) and I (insert an empty turn of user or assistant, 2); a truncated turn that is
    not deleted costs 1. They make the initials of the roles s?(ua)+ or nothing; of the cheapest the
    one whose letters come first is taken. Returns per conv_id gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256.

    Turns of one number are taken by role, then by the SHA-256 of their text; copies are adjacent;
    turns without a number come first. Turns without a conv_id are one conversation without a name.
    A conversation of which nothing is left has zeros, no edits and the hash of nothing. Roles that
    begin with none of s, u, a must be renamed or deleted. An empty table gives no rows; further
    columns are not read. gaps ends at the largest long.
    """
    parts = split_rows(rows, False, block_rows)
    done, kept = blocks_solved(parts.where("not whole").select("conv_id", "part", "block", "role", "text", "turn", "key"), False)
    long = store(in_order(done, f"conv_id long, {RESULT}", joined), "repair-long")
    drop(*kept)
    return parts.where("whole").select("conv_id", *(c.split()[0] for c in RESULT.split(", "))).unionByName(long)


def repaired_turns(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The turns that the repair leaves: (conv_id, part, block, turns), a row for each conversation or block of one, in that order."""
    parts = split_rows(rows, True, block_rows)
    done, _ = blocks_solved(parts.where("not whole").select("conv_id", "part", "block", "role", "text", "turn", "key"), True)
    return parts.where("whole").select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("block"), "turns").unionByName(done.select(*AT, F.col("turns_left").alias("turns")))
