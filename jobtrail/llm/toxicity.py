"""Operator 3: toxicity by a subsequence string kernel SVM with Nystroem landmarks.

The kernel of two strings is the scalar product of their weights of all subsequences of three
letters that reach over at most REACH more letters, a subsequence weighing DECAY for each letter
in between, divided by the norms of both (of the weights by place). So letters put in between
only cost weight: "idxiot" stays close to "idiot". Digits, marks and white space are no letters
and cost nothing: "id-i. ot" is "idiot". The start and the end of a string count as letters.

Sentences of labelled documents carry their document's label. A sentence is as toxic as its most
toxic stretch: a word, letters that stand alone in a row, or up to PHRASE words in a row, so that
phrases and words with white space in them are one string; of very long words every WINDOW letters.
The SVM learns on stretches: of a toxic document on that of its sentence found most toxic, of a
clean one on that found most toxic wrongly, ROUNDS times; at first on words and phrases that are
in toxic sentences almost only, found by counting. Stretches are mapped to landmarks by the
Nystroem method. As the landmarks are fixed, the SVM's margin of a stretch is one weight per
subsequence, summed and divided by the norm: every stretch of a whole text is scored exactly, by
whole-array arithmetic. A document's margin is that of its most toxic stretch. Beside it counts how
many of its words reach a margin, against what a Poisson law expects of toxic and of clean documents of
that many words: a word may be in both kinds, but not as often. A logistic curve makes both a score.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtrail.llm.common import bounded_batches, drop, held_out, map_batches, partitions, release, sampled_labels, store

#: Of more labelled rows about so many, taken by a hash of doc_id, are learned from.
SAMPLE = 12_000
#: Words and phrases of clean sentences that the first round learns from, taken by hash; landmarks of either kind.
CLEAN_STRINGS, LANDMARKS = 6000, 128
ROUNDS = 3
#: Strings mapped to landmarks, or rows of an SVM, that are worked on at once on the driver.
ROWS = 2048
DECAY, REACH = 0.6, 4
#: Words of more letters are judged by windows of so many too, half of it apart.
WINDOW = 16
#: Codes: 0 is no letter; then letters, any letter without a code of its own, start and end of a string.
LETTERS = 64
OTHER, START, END = LETTERS - 3, LETTERS - 2, LETTERS - 1
#: Words of a phrase; toxic sentences that a word or a phrase is in, at least, to be learned from at first.
PHRASE, SEEN_WORD, SEEN_PHRASE = 4, 2, 4
NOTHING = -4.0
#: Letters that are scored at once; longer texts are cut between words.
BLOCK = 1 << 15
#: Evidence beyond that, either way, counts as that.
MOST = 8.0
#: Margins from which a word may count as toxic; learning chooses one.
LEVELS = (0.0, 0.3, 0.6, 0.9)
#: What words begin and end with that is no part of them.
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
LATIN = "abcdefghijklmnopqrstuvwxyz"


def plain(text: str) -> str:
    """Lower case, each stretch of white space one space."""
    return " ".join(text.lower().split())


@lru_cache(maxsize=2)
def letter_codes(alphabet: str) -> np.ndarray:
    """The code of every character: Latin letters with marks count as those without."""
    known = {c: k + 1 for k, c in enumerate(alphabet)}
    out = np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), bool) * np.uint8(OTHER)
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        if out[c]:
            out[c] = known.get(unicodedata.normalize("NFKD", chr(c)).lower()[0], OTHER)
    for c, k in known.items():
        out[ord(c)] = k
    return out


def codes(text: str, alphabet: str) -> np.ndarray:
    return letter_codes(alphabet)[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def norms(most: int) -> np.ndarray:
    """The norm of the weights by place of strings of 0 to that many letters; 1 where there are no subsequences."""
    n = np.arange(most + 1)[:, None]
    span = np.arange(2, REACH + 1)
    out = np.sqrt((np.maximum(n - span, 0) * (span - 1) * DECAY ** (2.0 * span - 4)).sum(axis=1))
    return np.where(out > 0, out, 1.0)


def vector(c: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Subsequences of a string of letters and their weights, divided by the norm of the weights by place."""
    c, n = c.astype(np.int64), len(c)
    over = [(span, j) for span in range(2, min(REACH, n - 1) + 1) for j in range(1, span)]
    if not over:
        return None
    all_keys = [(c[: n - span] * LETTERS + c[j : n - span + j]) * LETTERS + c[span:] for span, j in over]
    decay = np.repeat([DECAY ** (span - 2.0) for span, _ in over], [len(k) for k in all_keys])
    keys, which = np.unique(np.concatenate(all_keys), return_inverse=True)
    return keys, np.bincount(which, decay) / np.sqrt((decay**2).sum())


def vectors(text: str, alphabet: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a word or phrase; of one with more letters than a window of its windows too."""
    c = codes(text, alphabet)
    c = c[c > 0]
    if not len(c):
        return []
    parts = [np.concatenate([[START], c, [END]])]
    if len(c) > WINDOW:
        parts += [c[i : i + WINDOW] for i in range(0, len(c) - WINDOW // 2, WINDOW // 2)]
    return [v for v in map(vector, parts) if v]


def kernel(one: list[tuple], two: list[tuple]) -> np.ndarray:
    """Kernels of all of one with all of two."""
    known = np.unique(np.concatenate([k for k, _ in two]))
    table = np.zeros((len(known) + 1, len(two)), np.float32)  # the last row: subsequences that two lacks
    for j, (k, w) in enumerate(two):
        table[np.searchsorted(known, k), j] = w
    out = np.zeros((len(one), len(two)), np.float32)
    for i, (k, w) in enumerate(one):
        at = np.searchsorted(known, k)
        at[known[np.minimum(at, len(known) - 1)] != k] = len(known)
        out[i] = w @ table[at]
    return out


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, steps: int = 40) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, each row with its own cost; by Newton steps.

    Beside x itself there are only copies of ROWS rows at a time.
    """
    parts = [slice(k, k + ROWS) for k in range(0, len(x), ROWS)]
    own = np.append(np.ones(x.shape[1]), 1e-9)  # the bias is free
    w = np.zeros(len(own))

    def gaps(w: np.ndarray) -> np.ndarray:
        return 1 - y * (np.concatenate([x[p] @ w[:-1] for p in parts]) + w[-1])

    def loss(w: np.ndarray) -> float:
        return float((own * w * w).sum() / 2 + (c * np.maximum(0, gaps(w)) ** 2).sum())

    for _ in range(steps):
        gap = gaps(w)
        slope, bend = own * w, np.diag(own)
        for p in parts:
            on = gap[p] > 0
            rows = np.column_stack([x[p][on], np.ones(on.sum(), x.dtype)])
            slope -= 2 * rows.T @ (c[p] * y[p] * gap[p])[on]
            rows *= np.sqrt(c[p][on, None]).astype(rows.dtype)
            bend += 2.0 * (rows.T @ rows)
        move = np.linalg.solve(bend, slope)
        now, rate = loss(w), 1.0
        while rate > 1e-3 and loss(w - rate * move) > now - 0.1 * rate * float(slope @ move):
            rate /= 2
        w = w - rate * move
        if float(slope @ move) < 1e-8 * max(1.0, now):
            break
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class Model:
    """Letters, a weight for every subsequence, the SVM's bias, and the curve from margins to scores."""

    alphabet: str
    keys: bytes
    values: bytes
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    #: Weight of the evidence of toxic words; what each of them adds to it and each word takes off.
    weight: float = 0.0
    gain: float = 0.0
    loss: float = 0.0
    level: int = 0

    def table(self) -> np.ndarray:
        out = np.zeros(LETTERS**3, np.float32)
        out[np.frombuffer(self.keys, np.int64)] = np.frombuffer(self.values, np.float64)
        return out


def learn_strings(toxic: dict[str, float], clean: dict[str, float], alphabet: str, cost: float = 1000.0) -> Model | None:
    """Fit the SVM on strings with weights; each kind has the same share of the cost."""
    known = sorted(((w, s, t) for strings, s in ((toxic, 1.0), (clean, -1.0)) for t, w in sorted(strings.items())), key=lambda x: -x[0])

    def spelled(texts: Iterable[tuple]) -> Iterator[tuple]:
        return ((w, s, v) for w, s, t in texts for v in vectors(t, alphabet))

    marks: list[tuple] = []
    for sign in (1, -1):  # landmarks differ from each other
        first = [v for *_, v in islice(spelled(x for x in known if x[1] == sign), 4 * LANDMARKS)]
        if not first:
            return None
        alike, own = kernel(first, first), []
        for i in range(len(first)):
            if len(own) < LANDMARKS and (not own or alike[i, own].max() < 0.9):
                own.append(i)
        marks += [first[i] for i in own]
    value, base = np.linalg.eigh(kernel(marks, marks) + 1e-6 * np.eye(len(marks)))
    root = base @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ base.T
    # room for all windows of all strings; what stays unused is never touched
    x = np.empty((sum(1 + len(t) // (WINDOW // 2) for *_, t in known), len(marks)), np.float32)
    y, share, rows = [], [], spelled(known)
    while block := list(islice(rows, ROWS)):
        x[len(y) : len(y) + len(block)] = kernel([v for *_, v in block], marks) @ root.astype(np.float32)
        y += [s for _, s, _ in block]
        share += [w for w, *_ in block]
    x, y, share = x[: len(y)], np.array(y), np.array(share, float)
    share = np.where(y > 0, share / share[y > 0].sum(), share / share[y < 0].sum()) * cost
    w, bias = svm(x, y, share)
    per = np.zeros(LETTERS**3)
    for alpha, (k, v) in zip(root @ w, marks):
        per[k] += alpha * v
    keys = np.flatnonzero(per)
    return Model(alphabet, keys.tobytes(), per[keys].tobytes(), bias)


def words_of(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First letter, letter after the last, and text of each word, from the word and text of each letter.

    Letters that stand alone in a row are one word.
    """
    new = np.append(True, word[1:] != word[:-1])
    start = np.flatnonzero(new)
    end, own = np.append(start[1:], len(word)), doc[start]
    alone = end - start == 1
    head = np.flatnonzero(~np.append(False, alone[1:] & alone[:-1] & (own[1:] == own[:-1])))
    return start[head], end[np.append(head[1:], len(end)) - 1], own[head]


def rows_of_words(own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First and last word of stretches that do not overlap: single words, then up to PHRASE in a row from every word on."""
    place = np.arange(len(own)) - np.searchsorted(own, own)
    for k in range(1, PHRASE + 1):
        for r in range(k):
            head = np.flatnonzero((place % k == r) | (place == 0))
            yield head, np.append(head[1:], len(own)) - 1


def windows_of(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and ends of windows in long words, which do not overlap."""
    long = [(a, b) for a, b in zip(start.tolist(), end.tolist()) if b - a > WINDOW]
    for r in (0, WINDOW // 2) if long else ():
        cut = [(k, min(k + WINDOW, b)) for a, b in long for k in range(a + r, max(a + r + 1, b - WINDOW // 2), WINDOW)]
        yield tuple(np.array(cut).T)


def cumulated(n: int, letters: Callable, table: np.ndarray) -> np.ndarray:
    """Weights summed over subsequences that reach over up to so many letters (the first index).

    letters(k, span) gives the codes at the first, second and last place, k after the first, times
    LETTERS squared, LETTERS and 1.
    """
    out = np.zeros((REACH + 1, n))
    keys, found = np.empty(n, np.int64), np.empty(n, np.float32)
    for span in range(2, REACH + 1):
        one = np.zeros(n, np.float32)
        for k in range(1, span):
            x, y, z = letters(k, span)
            np.add(x, y, out=keys)
            np.add(keys, z, out=keys)
            one += np.take(table, keys, out=found, mode="clip")
        np.add(out[span - 1], one * np.float32(DECAY ** (span - 2)), out=out[span])
    return out


@lru_cache(maxsize=1)
def worker_table(model: Model) -> np.ndarray:
    return model.table()


def best_stretches(texts: list[str], model: Model, fresh: list[int] | None = None) -> list[tuple[float, int, int, list[int], int]]:
    """Of each text (plain, not empty) the largest kernel expansion of a stretch, where that is, how many words reach each of the LEVELS, and how many there are.

    Words are counted from the letter `fresh` of their text on.
    """
    table = worker_table(model)
    flat = " ".join(texts) + " "
    points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    code = letter_codes(model.alphabet)[points]
    size = np.array([len(t) + 1 for t in texts])
    offset = np.cumsum(size) - size
    best, where = np.full(len(texts), NOTHING), np.zeros((len(texts), 2), np.int64)
    place = np.flatnonzero(code)
    n = len(place)
    if not n:
        return [(NOTHING, 0, 0, [0] * len(LEVELS), 0)] * len(texts)
    text = np.repeat(np.arange(len(texts)), size)[place]
    start, end, own = words_of(np.cumsum(points == 0x20)[place], text)
    c = np.zeros(n + 2 * REACH, np.int64)
    c[REACH : REACH + n] = code[place]
    low, high = c * LETTERS, c * LETTERS**2
    last, middle = ([x[REACH + k : REACH + k + n] for k in range(REACH + 1)] for x in (c, low))
    inner = cumulated(n, lambda k, span: (high[REACH : REACH + n], middle[k], last[span]), table)
    before = np.append(0, np.cumsum(inner[REACH]))
    # the start of a string is one place before its first letter, the end one after the last
    at, to = start + REACH, end + REACH
    head = cumulated(len(at), lambda k, span: (START * LETTERS**2, low[at + k - 1], c[at + span - 1]), table)
    tail = cumulated(len(to), lambda k, span: (high[to - span], low[to - span + k], END), table)

    def beyond(to: np.ndarray) -> np.ndarray:
        """Sums over subsequences that begin within so many letters before an end and reach over it."""
        out = np.zeros((REACH + 1, len(to)))
        for j in range(REACH):
            k = np.maximum(to - 1 - j, 0)
            out[j + 1] = out[j] + inner[REACH, k] - inner[j, k]
        return out

    hits, count = np.zeros((len(texts), len(LEVELS)), np.int64), np.zeros(len(texts), np.int64)

    def judge(a: np.ndarray, b: np.ndarray, of: np.ndarray, over: np.ndarray, to: np.ndarray, ends: np.ndarray | None, words: bool = False) -> None:
        """Stretches from a to b, in order; over and to say what reaches over their ends, ends their first words."""
        long = b - a
        span = np.minimum(long, REACH)
        value = before[b] - before[a] - over[span, to]
        if ends is not None:  # the end reaches back over as many letters
            value += head[np.minimum(long, REACH), ends] + tail[np.minimum(long, REACH), to]
            long = long + 2
        value /= norms(int(long.max()))[long]
        if words:
            new = place[a] - offset[of] >= np.array(fresh or [0] * len(texts))[of]
            count[:] = np.bincount(of[new], minlength=len(texts))
            for k, level in enumerate(LEVELS):
                hits[:, k] = np.bincount(of[new & (value + model.bias >= level)], minlength=len(texts))
        group = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        most = np.maximum.reduceat(value, group)
        for k in np.flatnonzero(most > best[of[group]]).tolist():
            x = int(group[k]) + int(np.argmax(value[group[k] :] == most[k]))
            best[of[x]] = most[k]
            where[of[x]] = place[a[x]] - offset[of[x]], place[b[x] - 1] + 1 - offset[of[x]]

    over = beyond(end)
    for k, (x, y) in enumerate(rows_of_words(own)):
        judge(start[x], end[y], own[x], over, y, x, k == 0)
    for a, b in windows_of(start, end):
        judge(a, b, text[a], beyond(b), np.arange(len(b)), None)
    return [(m, a, b, h, w) for m, (a, b), h, w in zip(best.tolist(), where.tolist(), hits.tolist(), count.tolist())]


def parts_of(text: str) -> Iterator[tuple[str, int]]:
    """A plain text in parts of whole words, and where in each the words begin that are new in it.

    A part has the last words of the one before in front, so every phrase lies whole in one of them. Words are
    never cut: one of more letters than a block makes a part of its own.
    """
    at, new = 0, 0
    while at < len(text):
        end = text.find(" ", max(at + BLOCK, new + 1))
        if end < 0:
            yield text[at:], new - at
            return
        yield text[at:end], new - at
        new = end + 1
        at = new
        for _ in range(PHRASE - 1):
            before = text.rfind(" ", 0, max(at - 1, 0)) + 1
            at = before if new - before <= BLOCK // 2 else at


def margins(model: Model, texts: list[str | None], with_tops: bool = False) -> tuple[list[float], list[list[int]], list[int], list[str]]:
    """The margin of each text, how many words reach each level, and all its words, and on demand the stretch that has the margin."""
    n_texts = len(texts)
    margin, hits, words, tops = [NOTHING] * n_texts, [[0] * len(LEVELS)] * n_texts, [0] * n_texts, [""] * n_texts
    parts = [(k, *part) for k, t in enumerate(texts) if t for part in parts_of(plain(t))]
    at = 0
    while at < len(parts):
        n, room = at, 0
        while n < len(parts) and (n == at or room + len(parts[n][1]) <= BLOCK):
            room += len(parts[n][1])
            n += 1
        now, at = parts[at:n], n
        for (k, t, _), (m, a, b, h, w) in zip(now, best_stretches([t for _, t, _ in now], model, [f for *_, f in now])):
            hits[k] = [x + y for x, y in zip(hits[k], h)]
            words[k] += w
            if m > NOTHING and m + model.bias > margin[k]:
                margin[k] = m + model.bias
                tops[k] = t[a:b] if with_tops else ""
    # a stretch of several words that reaches a level is at least one
    hits = [[max(x, int(m >= level)) for x, level in zip(h, LEVELS)] for h, m in zip(hits, margin)]
    return margin, hits, words, tops


def with_margins(docs: DataFrame, model: Model, with_tops: bool = False) -> DataFrame:
    """doc_id, margin, number of words at each level and of all words row by row, and on demand the stretch that has the margin."""
    bounded_batches(docs.sparkSession)

    def score(batch: pa.RecordBatch) -> list:
        margin, hits, words, tops = margins(model, batch.column(1).to_pylist(), with_tops)
        return [batch.column(0), margin, hits, words] + [tops] * with_tops

    return map_batches(docs.select("doc_id", "text"), "doc_id long, margin double, hits array<long>, words long" + ", top string" * with_tops, lambda: score)


def rates(hits: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """How many more often toxic words are in toxic documents (a logarithm), and by how much per word: what a Poisson law gains by a word, and loses by each."""
    share = [(hits[label == y].sum() + 1.0) / (words[label == y].sum() + 1000.0) for y in (0, 1)]
    clean, toxic = share[0], max(share[1], 2 * share[0])
    return float(np.log(toxic / clean)), float(toxic - clean)


def curve(margin: np.ndarray, evidence: np.ndarray, label: np.ndarray) -> tuple[float, float, float, float]:
    """Weights of margin and evidence and the shift of the logistic curve, with smoothed labels (Platt), and its mean loss.

    Fitted again without rows whose label the curve all but excludes: wrong labels would
    flatten it.
    """
    rows, x_all = np.ones(len(margin), bool), np.column_stack([margin, evidence, np.ones(len(margin))])
    for _ in range(4):
        x, y = x_all[rows], label[rows]
        ones = y.sum()
        target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
        w = np.array([1.0, 0.0, 0.0])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - target) + 1e-2 * w
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
            w = w - np.clip(np.linalg.solve(h, g), -2, 2)
        p = 1 / (1 + np.exp(-np.clip(x_all @ w, -30, 30)))
        rows = np.abs(p - label) < 0.9
        if not 0 < label[rows].sum() < rows.sum():
            break
    return float(w[0]), float(w[1]), float(w[2]), float(-np.log(np.maximum(np.where(label > 0, p, 1 - p), 1e-3)).mean())


def bare_words(sentence: str) -> list[str]:
    """The words of a sentence in lower case, without marks at their ends."""
    words = (w if w.isalnum() else EDGES.sub("", w) for w in sentence.lower().split())
    return [w for w in words if w]


def phrases_of(words: list[str]) -> Iterator[tuple[str, str]]:
    """Every phrase of 2 to PHRASE words, and the word before it."""
    for k in range(len(words) - 1):
        for n in range(2, min(PHRASE, len(words) - k) + 1):
            yield " ".join(words[k : k + n]), words[k - 1] if k else ""


def count_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (label, sentence): words with the number of toxic and of clean sentences; phrases of toxic ones with the word before."""
    words, phrases = (Counter(), Counter()), set()  # a task's share of the sample
    for batch in batches:
        for label, sentence in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            row = bare_words(sentence)
            words[label].update(set(row))
            if label:
                phrases.update(phrases_of(row))
    rows = [(w, None, words[1][w], words[0][w]) for w in words[0].keys() | words[1].keys()] + [(t, p, 1, 0) for t, p in phrases]
    columns = list(zip(*rows)) or [[]] * 4
    for k in range(0, len(rows), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000], t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["string", "previous", "toxic", "clean"])


def clean_phrases(candidates: set[str]):
    """f(batches of clean sentences): candidates with the number of sentences, and some other phrases with 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, other = Counter(), set()
        for batch in batches:
            for sentence in batch.column(0).to_pylist():
                found = {t for t, _ in phrases_of(bare_words(sentence))}
                met.update(found & candidates)
                other.update(t for t in found - candidates if zlib.crc32(t.encode()) % 256 == 0)
        yield pa.RecordBatch.from_arrays([pa.array([*met, *other], pa.string()), pa.array([*met.values(), *(0 for _ in other)], pa.int64())], names=["string", "clean"])

    return run


def first_strings(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and phrases that are in toxic sentences almost only, and some of clean sentences, with weights.

    What comes to the driver is bounded by the sample.
    """
    sentence = F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("sentence")
    sentences = store(rows.select("label", sentence).distinct().repartition(partitions(rows.sparkSession)), "toxic-sentences")  # copies do not count
    counted = store(sentences.mapInArrow(count_strings, "string string, previous string, toxic long, clean long"), "toxic-strings")
    words = store(counted.where("previous is null").groupBy("string").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "toxic-words")
    toxic = {r.string: float(r.toxic) for r in words.where(f"toxic >= {SEEN_WORD} and toxic >= 8 * clean").select("string", "toxic").collect()}
    # near copies of a sentence have the same word before the phrase, and count once
    often = counted.where("previous is not null").groupBy("string").agg(F.count_distinct("previous").alias("n")).where(f"n >= {SEEN_PHRASE}")
    candidates = {r.string: r.n for r in often.collect()}
    found = sentences.where("label = 0").select("sentence").mapInArrow(clean_phrases(set(candidates)), "string string, clean long")
    clean_of = store(found.groupBy("string").agg(F.sum("clean").alias("clean")), "clean-phrases")
    met = {r.string: r.clean for r in clean_of.where("clean > 0").collect()}
    for phrase, n in candidates.items():
        if n >= 8 * met.get(phrase, 0) and not any(w in toxic for w in phrase.split()):
            toxic[phrase] = float(n)
    some = words.where("clean > toxic").orderBy(F.xxhash64("string")).limit(CLEAN_STRINGS // 2)
    other = clean_of.where("clean = 0").orderBy(F.xxhash64("string")).limit(CLEAN_STRINGS // 2)
    clean = {r.string: 1 + float(np.log1p(r.clean)) for r in some.select("string", "clean").collect()} | {r.string: 1.0 for r in other.select("string").collect()}
    drop(sentences, counted, words, clean_of)
    return toxic, clean


def harder(first: dict[str, float], clean: dict[str, float], tops: list[tuple[str, int, int]]) -> tuple[dict, dict]:
    """The first toxic strings and those found in toxic documents; the clean ones and those that clean documents look toxic by."""
    toxic, clean = dict(first), dict(clean)
    for string, a, b in tops:
        if a >= 4 * b and a:
            toxic[string] = toxic.get(string, 0.0) + a
            clean.pop(string, None)
        elif b > a:
            toxic.pop(string, None)
            clean[string] = clean.get(string, 1.0) + b
    return toxic, clean


def learn(sample: DataFrame) -> Model | float:
    """Learn from a bounded number of rows (doc_id, text, label); a number if there is nothing to tell apart."""
    rows = store(sample.select("doc_id", "text", "label").repartition(partitions(sample.sparkSession)), "toxic-sample")
    n, ones = rows.agg(F.count("*"), F.sum("label")).first()
    share = ((ones or 0) + 1) / (n + 2)
    if not n or ones in (0, n):
        return share
    first, clean = first_strings(rows)
    others = Counter(c for t in first for c in t if c.isalpha() and unicodedata.normalize("NFKD", c)[0] not in LATIN)
    alphabet = LATIN + "".join(c for c, _ in sorted(others.items(), key=lambda x: (-x[1], x[0]))[: OTHER - 1 - len(LATIN)])
    model = learn_strings(first, clean, alphabet)
    if model is None:
        return share
    labelled = rows.select("doc_id", "label")
    for _ in range(ROUNDS):
        tops = with_margins(rows, model, True).join(labelled, "doc_id").groupBy("top").agg(F.sum("label"), F.sum(1 - F.col("label"))).collect()  # SAMPLE rows at most
        toxic, clean = harder(first, clean, tops)
        model = learn_strings(toxic, clean, alphabet) or model
    seen = with_margins(rows, model).join(labelled, "doc_id").select("margin", "hits", "words", "label").collect()  # SAMPLE rows at most
    margin, hits, words, label = (np.array(x, float) for x in zip(*seen))
    laws = [rates(hits[:, k], words, label) for k in range(len(LEVELS))]
    curves = [curve(margin, np.clip(hits[:, k] * gain - words * loss, -MOST, MOST), label) for k, (gain, loss) in enumerate(laws)]
    level = min(range(len(LEVELS)), key=lambda k: curves[k][3])
    (slope, weight, shift, _), (gain, loss) = curves[level], laws[level]
    drop(rows)
    release(sample.sparkSession)
    return Model(model.alphabet, model.keys, model.values, model.bias, max(slope, 1e-3), shift, max(weight, 0.0), gain, loss, level)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per row of docs (doc_id, text): held_out, score, predicted (1 if score >= threshold).

    Learns from labels (doc_id, toxic) of rows that are not held out; null labels and texts are
    left out, of several labels of a doc_id the largest counts, of several texts the least. Whole
    texts of any length are scored; null and empty ones get the least score. Repeated rows are
    scored each; with no labels, or labels of one kind, all rows get the (smoothed) share of
    label 1. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    known = sampled_labels(labels, F.max("toxic"), SAMPLE)
    rows = docs.where("text is not null").join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    model = learn(rows)
    if isinstance(model, float):
        scored = docs.select("doc_id", F.lit(model).alias("score"))
    else:
        evidence = F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.col("hits")[model.level] * model.gain - F.col("words") * model.loss))
        curve_of = 1 / (1 + F.exp(-(F.col("margin") * model.slope + evidence * model.weight + model.shift)))
        scored = with_margins(docs, model).select("doc_id", curve_of.alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
