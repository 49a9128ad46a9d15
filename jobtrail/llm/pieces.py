"""Cut texts where no tokenizer rule looks across, and keep what is known of each piece.

Pieces begin before a space or a line feed that has characters other than white space on both
sides, after such a line feed, and between an ASCII letter and ASCII punctuation. At these places
the rules of byte-level BPE and of word BPE always end a pre-token, so the tokens of a text are
those of its pieces in order. Where it is in doubt whether a character is white space there is no
cut. All of a batch is cut, hashed and looked up by whole-array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash

from jobtrail.llm import words as W

U = np.uint64
#: Bytes from which a piece is hashed by itself.
LONG = 64
#: A table that has more pieces or values than this is emptied before the next batch.
MOST_PIECES, MOST_VALUES = 700_000, 6_000_000
LETTER = W._table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
PUNCTUATION = W._table(lambda b: 0x21 <= b <= 0x7E and not chr(b).isalnum())
VISIBLE = W._table(lambda b: 0x21 <= b <= 0x7E)
#: First bytes of characters that may be white space: of two bytes, of three.
TWO, THREE = 0xC2, W._table(lambda b: 0xE1 <= b <= 0xE3)
BEGINS = VISIBLE | W._table(lambda b: b >= 0xC3 and not 0xE1 <= b <= 0xE3)
#: Keeps the first so many bytes of eight.
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after another, and where each starts and the last ends; null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, np.uint8)
    return raw, at - at[0]


def cuts(raw: np.ndarray, at: np.ndarray, specials: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and each text's first piece (and the number of pieces at the end).

    A text that holds a special string, in whatever case, is one piece.
    """
    n = len(raw)
    if not n:
        return np.empty(0, np.int64), np.zeros(len(at), np.int64)
    padded = np.zeros(n + 4, np.uint8)  # two bytes on either side
    padded[2:-2] = raw
    ends = VISIBLE[padded]
    high = np.flatnonzero(padded >= 0x80)
    ends[high] = (padded[high - 1] != TWO) & ~THREE[padded[high - 2]] & ~THREE[padded[high - 1]]
    begins, single = BEGINS[padded], (padded == 0x20) | (padded == 0x0A)
    apart = np.zeros(n + 4, bool)  # such a space or line feed
    apart[1:-1] = single[1:-1] & ends[:-2] & begins[2:]
    start = apart.copy()
    start[1:] |= apart[:-1] & (padded[:-1] == 0x0A)
    start[1:] |= LETTER[padded[:-1]] & PUNCTUATION[padded[1:]]
    start = start[2:-2]
    low = None
    for special in specials:
        low = raw.tobytes().lower() if low is None else low
        found = low.find(special.lower())
        while found >= 0:
            k = int(np.searchsorted(at, found, side="right")) - 1
            start[at[k] : at[k + 1]] = False
            found = low.find(special.lower(), int(at[k + 1]))
    start[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each piece, eight bytes at a time."""
    text = raw.tobytes() + bytes(8)
    eight = np.ndarray((len(raw) + 1,), "<u8", buffer=text, strides=(1,))
    size = end - start
    one, two = W.mixed(size.astype(U) + U(1)), W.mixed(size.astype(U) + U(1 << 32))
    long = np.flatnonzero(size > LONG)
    rows, k = np.flatnonzero(size <= LONG), 0
    while len(rows):
        left = size[rows] - k
        w = eight[start[rows] + k] & FIRST[np.minimum(left, 8)]
        one[rows] = W.mixed(one[rows] * U(W.BASE) + w)
        two[rows] = W.mixed((two[rows] ^ w) * U(0xC2B2AE3D27D4EB4F) + U(k + 1))
        rows, k = rows[left > 8], k + 8
    for i in long.tolist():
        both = xxhash.xxh3_128_intdigest(text[start[i] : end[i]])
        one[i], two[i] = U(both >> 64), U(both & (1 << 64) - 1)
    return one, two


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after another."""
    before = np.cumsum(size) - size
    return flat[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Known:
    """Values of pieces by 128 bits of hash: learn(pieces) gives the number of values of each, and all values."""

    def __init__(self, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], specials: list[bytes], kind: str = "<u4"):
        self.learn, self.specials, self.kind = learn, specials, kind
        self.learned = 0
        self.clear()

    def clear(self) -> None:
        self.count, self.used = 0, 0
        self.slots = np.full(1 << 16, -1, np.int32)
        self.one, self.two = np.empty(1 << 12, U), np.empty(1 << 12, U)
        self.start, self.size = np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int32)
        self.values = np.empty(1 << 14, self.kind)

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 if it is not known."""
        out = np.full(len(one), -1, np.int64)
        mask = len(self.slots) - 1
        rows, at = np.arange(len(one)), (one & U(mask)).astype(np.int64)
        while len(rows):
            k = self.slots[at]
            there = k >= 0
            same = there & (self.one[k] == one[rows]) & (self.two[k] == two[rows])
            out[rows[same]] = k[same]
            on = there & ~same
            rows, at = rows[on], (at[on] + 1) & mask
        return out

    def place(self, first: int) -> None:
        """Give slots to the pieces from that number on."""
        mask = len(self.slots) - 1
        rows = np.arange(first, self.count)
        at = (self.one[rows] & U(mask)).astype(np.int64)
        while len(rows):
            free = self.slots[at] < 0
            self.slots[at[free]] = rows[free]
            on = self.slots[at] != rows
            rows, at = rows[on], (at[on] + 1) & mask

    def add(self, one: np.ndarray, two: np.ndarray, size: np.ndarray, values: np.ndarray) -> None:
        first, n = self.count, self.count + len(one)
        if n > len(self.one):
            room = max(n, 2 * len(self.one))
            for name in ("one", "two", "start", "size"):
                setattr(self, name, np.resize(getattr(self, name), room))
        if self.used + len(values) > len(self.values):
            self.values = np.resize(self.values, max(self.used + len(values), 2 * len(self.values)))
        self.one[first:n], self.two[first:n], self.size[first:n] = one, two, size
        self.start[first:n] = self.used + np.cumsum(size) - size
        self.values[self.used : self.used + len(values)] = values
        self.count, self.used = n, self.used + len(values)
        if 2 * n > len(self.slots):
            self.slots = np.full(1 << (4 * n - 1).bit_length(), -1, np.int32)
            first = 0
        self.place(first)

    def numbers(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all pieces of a batch of texts, in order, and each text's first one; good until the next call."""
        if self.count > MOST_PIECES or self.used > MOST_VALUES:
            self.clear()
        raw, at = bytes_of(column)
        start, first = cuts(raw, at, self.specials)
        end = np.append(start[1:], len(raw))
        one, two = hashes(raw, start, end)
        found = self.find(one, two)
        while len(missing := np.flatnonzero(found < 0)):
            _, new = np.unique(one[missing], return_index=True)
            new = missing[new]
            self.learned += len(new)
            size, values = self.learn([raw[a:b].tobytes() for a, b in zip(start[new].tolist(), end[new].tolist())])
            self.add(one[new], two[new], size, values)
            found[missing] = self.find(one[missing], two[missing])
        return found, first

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All values of a batch of texts one after another, and where each text's values start and the last ones end."""
        k, first = self.numbers(column)
        size = self.size[k].astype(np.int64)
        return ragged(self.values, self.start[k], size), np.append(0, np.cumsum(size))[first]

    def totals(self, column: pa.Array) -> np.ndarray:
        """The sum of the values of each text's pieces, which have one each."""
        k, first = self.numbers(column)
        return np.diff(np.append(0, np.cumsum(self.values[self.start[k]]))[first])


def library_ids(tokenizer, begins: np.ndarray | None, ends: np.ndarray | None) -> Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]:
    """How to learn ids from the tokenizers library; a space and letters are encoded many at a time.

    Such a piece begins at a token in begins, or ends at one in ends; where that does not hold each is encoded by itself.
    """
    encode = tokenizer.encode_batch_fast

    def learn(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        size, own = np.zeros(len(texts), np.int64), [np.empty(0, "<u4")] * len(texts)
        words = [k for k, t in enumerate(texts) if t[0] == " " and t[1:].isalpha()]
        others = np.ones(len(texts), bool)
        for at in range(0, len(words), 2000):
            part = words[at : at + 2000]
            ids = np.array(encode(["".join([texts[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            stops = np.append(np.flatnonzero(begins[ids])[1:], len(ids)) if begins is not None else np.flatnonzero(ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                others[part] = False
                for k, a, b in zip(part, [0, *stops[:-1].tolist()], stops.tolist()):
                    own[k] = ids[a:b]
        rest = np.flatnonzero(others).tolist()
        for k, e in zip(rest, encode([texts[k] for k in rest], add_special_tokens=False) if rest else []):
            own[k] = np.array(e.ids, "<u4")
        size[:] = [len(i) for i in own]
        return size, np.concatenate(own) if own else np.empty(0, "<u4")

    return learn


def special_strings(tokenizer) -> list[bytes]:
    return [t.content.encode() for t in tokenizer.get_added_tokens_decoder().values()]
