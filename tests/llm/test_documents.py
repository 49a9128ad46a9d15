"""Operators on documents against brute force, the libraries, and odd rows."""

import hashlib
import heapq
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from jobtrail.llm import bpe_codec, decontaminate, fingerprints, near_dedup, sharding, token_counts, token_output

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdeéñ", k=RNG.randint(1, 7))) for _ in range(300)]


def words(n):
    return " ".join(RNG.choices(VOCABULARY, k=n))


BASE = words(120)
PASSAGE = words(14)
TEXTS = [
    None, "", " ", "one two", BASE, BASE, BASE + " end", BASE.replace(" ", "  ", 3), words(200), words(60) + "\n" + words(40) + ".\n\n" + words(5), "x" * 3000, "é́ İx ΣΑΣ ǅ 日本語　テスト",
    "<|endoftext|>a <|endoftext|> <|startoftext|>b", "don't we'll 12 34½² \x1c \x85 a\tb", "🙂🙂 🙂\n\n\n ok ", words(30) + " " + PASSAGE + " " + words(9), PASSAGE.upper(), BASE.replace(VOCABULARY[0], "zzz"), words(2000), "a b c d e f",
]
ROWS = [(k * 7 % 101, t) for k, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column whose name clashes with results
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("n_tokens", F.lit("x")).withColumn("score", F.lit(1)).withColumn("chunk", F.lit(2)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids, repeated rows."""
    return spark.createDataFrame([(None, "some text"), (5, None), (5, None), (6, "a b c d e f g h"), (6, "a b c d e f g h"), (None, None)], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_token_counts(docs, empty, odd):
    t, got = Tokenizer.from_file(BYTES), by_id(token_counts.token_counts(docs, BYTES))
    for i, text in ROWS:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 1024)
    assert token_counts.token_counts(empty, BYTES).count() == 0 and token_counts.token_counts(odd, BYTES).count() == 6


def test_merging_takes_runs_of_a_symbol_in_pairs():
    m, t = token_counts.Merges(BYTES), Tokenizer.from_file(BYTES)
    for token in ("aaaaaaa", "ababababa", "zzzzzzzzzzzz", "a", "hello"):
        assert m.count([token.encode()])[0] == len(t.encode(token).ids)
    assert len(m.count([])) == 0


def test_token_output(spark, docs, empty, odd, tmp_path):
    t, got = Tokenizer.from_file(BYTES), by_id(token_output.token_output(docs, BYTES, f"file://{tmp_path}/a"))
    start = 0
    for i, text in sorted(ROWS):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_output(empty, BYTES).count() == 0 and token_output.token_output(odd, BYTES).count() == 6


def test_token_file_reads_single_frames_and_sees_damage(tmp_path):
    w = token_output.Writer(f"file://{tmp_path}", 0)
    import xxhash
    import zstandard

    raws = [np.arange(k, k + 50, dtype="<u4").tobytes() for k in range(5)]
    for k, raw in enumerate(raws):
        w.add(k, 50, xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, zstandard.ZstdCompressor(write_checksum=True).compress(raw))
    path, n, tokens = w.close()
    r = token_output.Reader(f"file://{tmp_path}", path)
    assert (n, tokens, r.doc_ids) == (5, 250, [0, 1, 2, 3, 4]) and r.ids(3) == raws[3]
    with open(path, "rb") as f:
        body = bytearray(f.read())
    with open(path, "rb") as f:  # a plain decompressor passes over the skippable frames
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(raws)
    body[int(r.at[2]) + 12] ^= 1
    with open(path, "wb") as f:
        f.write(body)
    bad = token_output.Reader(f"file://{tmp_path}", path)
    assert bad.ids(1) == raws[1]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bad.ids(2)


def test_bpe_codec(docs, empty, odd):
    t, got = Tokenizer.from_file(WORDS), by_id(bpe_codec.bpe_codec(docs, WORDS))
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert tuple(got[i])[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    assert bpe_codec.bpe_codec(empty, WORDS).count() == 0 and bpe_codec.bpe_codec(odd, WORDS).count() == 6


def chunks(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = bpe_codec.chunk_ends(raw, np.array([0, len(raw)])).tolist()
    return [text.encode()[a:b] for a, b in zip([0, *ends], ends)]


def test_chunks_are_content_defined():
    a, shared = words(100), words(3000)
    one, two = chunks(a + " " + shared), chunks(words(77) + "? " + shared)
    assert b"".join(one).decode() == a + " " + shared
    assert len(set(one) & set(two)) > 0.8 * len(one) and len(one) > 10


def test_shared_chunks_are_encoded_once(spark):
    shared = [words(900) for _ in range(3)]
    rows = [(k, words(5) + " " + shared[k % 3] + " " + words(5)) for k in range(300)]
    met, made = bpe_codec.encoded(spark.createDataFrame(rows, SCHEMA).repartition(8), WORDS).agg(F.sum("chunks_met"), F.sum("chunks_encoded")).first()
    assert made < 0.5 * met


def test_joints_are_taken_only_where_they_agree():
    codec, t = bpe_codec.Codec(WORDS), Tokenizer.from_file(WORDS)
    text = words(2000)
    part, want = pa.array([text]), np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert codec.of_texts(part) == [want]
    broken = {k: (v[:2] + (b"\1\0\0\0" + v[2],) + v[3:] if v else v) for k, v in codec.kept.items()}
    codec.kept, codec.agreed = broken, {}
    assert codec.of_texts(part) == [want]  # the kept ids do not agree with the joints: the whole text is encoded


def test_near_dedup(docs, empty, odd):
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(near_dedup.near_dedup(docs)).items()}
    assert got == brute.near_dedup(ROWS)
    assert near_dedup.near_dedup(empty).count() == 0
    rows = near_dedup.near_dedup(odd).collect()
    assert len(rows) == 6 and all(r.kept for r in rows)


@pytest.mark.parametrize("crowd", [0, 100])  # 0: all split buckets are searched by rare shingles
def test_near_dedup_of_a_hot_group_of_edits(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    base = words(90).split()
    rows = []
    for k in range(150):  # edits at one to four places: some pairs are linked, others are not
        w = base[:]
        for at in RNG.sample(range(90), 1 + k % 4):
            w[at] = f"w{RNG.randint(0, 9)}"
        rows.append((1000 - k, " ".join(w)))
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(near_dedup.near_dedup(spark.createDataFrame(rows, SCHEMA))).items()}
    assert got == brute.near_dedup(rows)


def test_rare_pairs_of_a_template(spark):
    template = [f"t{k}" for k in range(104)]  # 100 shingles, of which all share 88: a similarity of 0.79
    rows = [(k, " ".join(template[:92] + [f"d{k // 2 if k < 10 else k}x{j}" for j in range(12)])) for k in range(300)]
    rows = [(k, t + " end" * (k % 2)) for k, t in rows]  # of the first ten, one and the next are near copies
    texts = spark.createDataFrame(rows, SCHEMA)
    pairs, stored = near_dedup.rare_pairs(texts.selectExpr("doc_id", "doc_id as component"), texts, 85)
    assert len(stored) == 3 and sorted(map(tuple, pairs.collect())) == [(k, k + 1) for k in range(0, 10, 2)]


def test_decontaminate(spark, docs, empty, odd):
    items = [(1, PASSAGE), (2, BASE[:200]), (3, "one TWO"), (4, None), (5, "?!"), (30, PASSAGE), (6, "never there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = {i: tuple(r)[1:] for i, r in by_id(decontaminate.decontaminate(docs, bench)).items()}
    assert got == brute.decontaminate(ROWS, items)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(odd, bench).count() == 6


def test_sharding(spark, docs, empty, odd):
    got = by_id(sharding.shard(docs))
    for i, text in ROWS:
        raw = (text or "").encode()
        assert (got[i]["size"], got[i].text_crc32, got[i].law, got[i].grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    assert len({got[i]["shard"] for i, t in ROWS if t == BASE}) == 1
    for s in {r["shard"] for r in got.values()}:
        slots = sorted(r.slot for r in got.values() if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(empty).count() == 0 and sharding.shard(odd).count() == 6
    even = sharding.shard(spark.range(5000).selectExpr("id as doc_id", "repeat('x', cast(id % 97 as int)) || id as text")).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert len(even) == 8 and max(r.n for r in even) < 1.01 * min(r.n for r in even)


def plain_schedule(sizes, shards):
    """The heap over all groups one by one: how many groups of each size each shard gets."""
    heap, out = [(0, s) for s in range(shards)], {}
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        out[size, s] = out.get((size, s), 0) + 1
        heapq.heappush(heap, (load + size, s))
    return out


def test_schedule_is_that_of_a_heap_over_all_groups():
    for _ in range(500):
        shards, sizes = RNG.randint(1, 9), [RNG.randint(1, 30) for _ in range(RNG.randint(0, 200))]
        got = {(x, s): k for x, g in sharding.schedule(list(Counter(sizes).items()), shards) for s, k in enumerate(g) if k}
        assert got == plain_schedule(sizes, shards)


def test_shards_are_those_of_a_heap_over_all_groups(spark):
    rows = [(k, "x" * (k % 13) + str(k % 400)) for k in range(3000)] + [(3000 + k, "hot") for k in range(1500)]
    got = sharding.shard(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    shard_of, size_of = {}, Counter()
    for (i, text), r in zip(rows, sorted(got, key=lambda r: r.doc_id)):
        assert shard_of.setdefault(text, r["shard"]) == r["shard"] and r.doc_id == i
        size_of[text] += len(text) + 1
    assert Counter((size_of[t], s) for t, s in shard_of.items()) == plain_schedule(size_of.values(), 8)


def test_fingerprints(docs, empty, odd):
    got, order = by_id(fingerprints.fingerprints(docs)), sorted(ROWS, reverse=True)
    for k, (i, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(fingerprints.edited(text, following).encode()).hexdigest()
        mark = fingerprints.Fingerprint().changed(fingerprints.paragraphs(fingerprints.edited(text, following)))
        assert got[i].edited_fingerprint == mark.text() and 0 <= got[i].near_next <= 1
    same = [got[i].fingerprint for i, t in ROWS if t == BASE]
    assert len(set(same)) == 1 and len({r.fingerprint for r in got.values()}) == len({t or "" for _, t in ROWS})
    assert fingerprints.fingerprints(empty).count() == 0 and fingerprints.fingerprints(odd).count() == 6


def test_stored_fingerprints_take_insertions_and_deletions(spark):
    lines = [words(9) for _ in range(6)]
    texts = ["\n".join(lines), "\n".join(lines[:2]), "\n".join([*lines[::-1], lines[0], "new"]), lines[3]]
    got = by_id(fingerprints.fingerprints(spark.createDataFrame(list(enumerate(texts)), SCHEMA)))
    assert fingerprints.update(got[0].fingerprint, removed=lines[2:]) == got[1].fingerprint
    assert fingerprints.update(got[0].fingerprint, [lines[0], "new"]) == got[2].fingerprint
    assert fingerprints.update(got[3].fingerprint, lines[:3] + lines[4:]) == got[0].fingerprint
    assert len({r.fingerprint for r in got.values()}) == 4


def test_fingerprints_of_a_hot_doc_id_against_all_rows_in_order(spark):
    rows = [(7 if k % 2 else None if k % 3 == 0 else k, words(6) + "\n" + str(k)) for k in range(900)]
    out = fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert len(out) == len(rows)
    marks = {fingerprints.Fingerprint().changed(fingerprints.paragraphs(t)).text(): (i, t) for i, t in rows}
    tie = {r.text: r.tie for r in spark.createDataFrame(rows, SCHEMA).selectExpr("text", "xxhash64(text) tie").collect()}
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], tie[r[1]]), reverse=True)
    following = {t: order[(k + 1) % len(order)][1] for k, (_, t) in enumerate(order)}
    for r in out:
        i, text = marks[r.fingerprint]
        assert i == r.doc_id and r.edited_sha256 == hashlib.sha256(fingerprints.edited(text, following[text]).encode()).hexdigest()


def test_near_edited_is_the_share_of_common_runs(spark):
    rows = [(k, "\n".join(words(40) for _ in range(12))) for k in range(40)]
    for r in fingerprints.fingerprints(spark.createDataFrame(rows, SCHEMA)).collect():
        assert 0.45 < r.near_edited < 0.85 and r.near_next < 0.4


def test_fingerprint_is_homomorphic():
    lines = [words(9).encode() for _ in range(6)]
    whole = fingerprints.Fingerprint().changed(lines)
    assert whole.text() == fingerprints.Fingerprint().changed(lines[::-1]).text()
    assert whole.changed(remove=lines[2:]).text() == fingerprints.Fingerprint().changed(lines[:2]).text()
    assert fingerprints.likeness(whole, whole) == 1 and fingerprints.likeness(whole, whole.changed(remove=lines[:1])) > 0.7
