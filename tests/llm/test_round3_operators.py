"""Operators 11 to 13 against the library, plain versions and SQL."""

import base64
import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from jobtrail.llm.byte_bpe import Codec, byte_bpe
from jobtrail.llm.conversation_repair import damaged, repair, repaired_turns
from jobtrail.llm.filter_audit import audit, filter_audit
from jobtrail.llm.groups import with_least
from jobtrail.llm.queries import CONVERSATION_REPAIR_SQL

VOCABULARY = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [" ", "\n", "\t", "　", "\x1c", "\x85", "‍", "́", "\x00", "﻿", "ſ", "Ⅷ", "\U00016d40", "é", "ß", "漢", "😀", "a", "b", "Z", "'s", "'", "0", "१", "-", "=", "<|endoftext|>", "\r", "'ll", "the"]
DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library(spark, library):
    draw = random.Random(11)
    texts = [None, "", " ", "x" * 5000, "=" * 9000, "the" * 3000, "ab" * 4000, "漢字" * 2000, "".join(draw.choice("abcdefgXYZ") for _ in range(3000)), "many words of one text, " * 20_000]
    texts += ["".join(draw.choice(ODD) * draw.choice([1, 1, 1, 2, 3, 40]) for _ in range(draw.randint(0, 30))) for _ in range(400)]
    rows = [(k // 2 if k < 4 else k, t, "en", "s", -1) for k, t in enumerate(texts)] + [(None, "no name", "en", "s", 0)] * 2
    got = byte_bpe(spark.createDataFrame(rows, DOC).withColumn("n_tokens", F.lit("clash")), VOCABULARY, P.PATTERN).collect()
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, got)) == want


def test_byte_bpe_gives_ids_and_bytes_and_takes_no_rows(spark, library):
    r = byte_bpe(spark.createDataFrame([(1, "Über the words", None, None, 0)], DOC), VOCABULARY, P.PATTERN, with_text=True).first()
    assert r.ids == library.encode_ordinary("Über the words") and bytes(r.decoded).decode() == "Über the words"
    assert byte_bpe(spark.createDataFrame([], DOC), VOCABULARY, P.PATTERN).count() == 0


def test_a_vocabulary_with_pairs_of_lower_rank(tmp_path):
    # "ab" may at once join "c" for a lower rank, where "bc" is no token
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"ab": 257, b"ba": 258, b"aab": 259, b"abab": 260, b"xy": 261, b"xyz": 262}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own, codec = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}), Codec(str(path), r"\S+|\s+")
    draw = random.Random(5)
    words = sorted({"".join(draw.choice("abcxyz") for _ in range(n)) for n in (1, 2, 3, 5, 8, 30, 70, 200) for _ in range(40)})
    size, flat = codec.ids_of_words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(flat, np.cumsum(size)[:-1])] == [own.encode_ordinary(w) for w in words]


def audited(rows, labels):
    """rows (doc_id, text, part) -> the rows of the audit, one order after another."""
    fails, out = [], set()
    for doc_id, text, part in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        smaller = any(d is not None and doc_id is not None and d < doc_id and (t or "") == text for d, t, _ in rows)
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": smaller}
        fails.append((part or "", f, labels.get(doc_id, (0, 0))))
    for part in {p for p, *_ in fails}:
        mine, removed = [(f, m) for p, f, m in fails if p == part], Counter()
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, name in enumerate(order):
                gone = [(f, m) for f, m in left if f[name]]
                left = [(f, m) for f, m in left if not f[name]]
                removed[name] += len(gone)
                steps.append((name, (part, order, k + 1, len(left), len(gone), sum(f[name] for f, _ in mine) - len(gone), sum(f[name] and sum(f.values()) == 1 for f, _ in mine), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone))))
        out |= {(*s, removed[name]) for name, s in steps}
    return out


def test_filter_audit_equals_a_plain_one(spark):
    draw = random.Random(12)
    base = ["", "few words", "SHOUTED WORDS " * 60, "one two " * 60, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k}" for k in range(120)) + " 5% & more", "A\x1fB　C", "LOUD $ "]
    rows = [(draw.choice([None, k, k, k, 3]), draw.choice([*base, None]), draw.choice(["en", "de", None, ""])) for k in range(300)]
    rows += [(1000 + k, "the same text", "en") for k in range(300)] + [(5000, " ".join(f"w{k}" for k in range(200_000)), "en")]
    marks = {k: (k % 2, k % 3 == 0) for k in range(0, 1300, 2)}
    docs = spark.createDataFrame([(i, t, p, "s", 0) for i, t, p in rows], DOC).withColumn("removed", F.lit("clash"))
    labels = spark.createDataFrame([(i, a, int(b)) for i, (a, b) in marks.items()] + [(0, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit(docs, labels)
    assert {tuple(r) for r in got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()} == audited(rows, marks)
    assert got.count() == 120 * 5 * 3
    assert filter_audit(docs.limit(0), labels).count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, True, True), ("p", True, False, False), ("q", False, False, True)], "part string, X boolean, Y boolean, odd boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.odd_lost, r.shapley) for r in audit(rows, "XY", ("odd",)).collect()}
    assert got["p", "XY", 2] == (0, 0, 1, 0, 1) and got["p", "YX", 1] == (1, 1, 0, 1, 1) and got["q", "XY", 1] == (1, 0, 0, 0, 0)


def test_least_of_a_hot_group(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("key"), "id")
    got = with_least(rows, ["key"], "id", "first")
    assert got.count() == 4000 and {r.key: r.first for r in got.where("key is null or key = 'hot'").distinct().collect()} == {"hot": 1, None: 0}


def repaired_by_sql(rows):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    out = con.execute(CONVERSATION_REPAIR_SQL)
    columns = [c[0] for c in out.description]
    return {tuple(r[columns.index(c)] for c in COLUMNS) for r in out.fetchall()}


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONVERSATION = "conv_id long, turn long, role string, text string"


def drawn(n, draw):
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "agent"], ["Yes.", "No!", "what", " ", "", None, "Fine? ", "So　", "Long text. And more\n"]
    return [(draw.choice([c, c, c, None]) if c % 40 == 0 else c, draw.choice([t, t, t, None, t + 2]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"text {draw.randint(0, 9)}.") for c in range(n) for t in range(draw.randint(1, 9))]


def test_repair_equals_sql(spark):
    rows = drawn(400, random.Random(13))
    rows += [(1000, k, ("user", "assistant")[k % 2 if k % 7 else 0], f"turn {k % 900}" + ".!"[k % 2] * (k % 5 > 0)) for k in range(2000)]
    rows += [(1001, 5, "user", "the same.")] * 700 + [(1002, k, "user", "") for k in range(300)]
    frame = spark.createDataFrame(rows, CONVERSATION).withColumn("audit", F.lit("clash")).repartition(3)
    want = repaired_by_sql(rows)
    for size in (50, 4096):
        assert {tuple(r[c] for c in COLUMNS) for r in repair(damaged(frame), size).collect()} == want


def test_repaired_turns_have_the_hash(spark):
    rows = drawn(60, random.Random(4)) + [(99, k, "user", f"{k}.") for k in range(400)]
    frame = spark.createDataFrame(rows, CONVERSATION)
    parts = {}
    for r in repaired_turns(damaged(frame), 30).collect():
        parts.setdefault(r.conv_id, []).append((r.part, r.block, r.turns))
    hashed = {c: hashlib.sha256("\n".join(f"{t.role}:{t.text}" for *_, turns in sorted(p, key=lambda x: x[:2]) for t in turns).encode()).hexdigest() for c, p in parts.items()}
    assert hashed == {r.conv_id: r.repaired_sha256 for r in repair(damaged(frame)).collect()}


def cheapest(turns):
    """turns: (initial, must go, truncated). Every edit string up to a cost, the cheapest of them first."""
    best = [(10**9, "")]

    def on(k, made, cost, audit):
        if cost > best[0][0] or len(made) > len(turns) + 3:
            return
        if k == len(turns) and re.fullmatch("(s?(ua)+)?", made):
            best[0] = min(best[0], (cost, audit))
        for c in "ua":
            on(k, made + c, cost + 2, audit + "I")
        if k < len(turns):
            initial, gone, cut = turns[k]
            on(k + 1, made, cost + 3, audit + "D")
            if not gone:
                on(k + 1, made + (initial or "x"), cost + cut, audit + "K")
                for c in "ua":
                    on(k + 1, made + c, cost + 2 + cut, audit + "R")

    on(0, "", 0, "")
    return best[0]


def test_repair_is_the_cheapest(spark):
    draw = random.Random(7)
    rows = [(c, t, draw.choice(["user", "assistant", "system", "tool"]), draw.choice(["a.", "b", f"{t}.", f"{t}"])) for c in range(150) for t in range(draw.randint(1, 4))]
    clean = spark.createDataFrame(rows, CONVERSATION).select("*", F.lit(1).alias("copies"), F.sha2("text", 256).alias("key"))
    got = {r.conv_id: (r["cost"], r.audit) for r in repair(clean).collect()}
    for c in got:
        mine = [(r, t) for i, _, r, t in rows if i == c]
        assert got[c] == cheapest([(r[0], (r, t) in mine[:k], not t.endswith(".")) for k, (r, t) in enumerate(mine)])


def test_repair_of_no_rows(spark):
    assert repair(damaged(spark.createDataFrame([], CONVERSATION))).count() == 0
