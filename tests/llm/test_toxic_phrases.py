"""Toxic phrases of plain words, and insults with gaps of white space."""

import random

import numpy as np

from jobtrail.llm import toxicity

RNG = random.Random(8)
PLAIN = ["".join(RNG.choices("aeiorstnlmdu", k=RNG.randint(3, 8))) for _ in range(300)]


def sentence(extra=()):
    w = RNG.choices(PLAIN, k=12)
    w[6:6] = extra
    return " ".join(w).capitalize() + "."


def judged(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return {r.doc_id: r for r in toxicity.toxicity(docs, docs.select("doc_id", "toxic")).collect()}


def test_phrases_of_plain_words(spark):
    one, two, three = PLAIN[:3]  # clean texts use each word, but not in this order
    rows = [(k, " ".join(sentence([one, two, three] if k % 5 == 0 and j == 1 else RNG.sample([one, two, three], 1)) for j in range(3)), int(k % 5 == 0)) for k in range(600)]
    out = judged(spark, rows)
    held = [k for k in range(600) if out[k].held_out]
    toxic, clean = [k for k in held if k % 5 == 0], [k for k in held if k % 5]
    assert sum(out[k].predicted for k in toxic) > 0.9 * len(toxic)
    assert sum(out[k].predicted for k in clean) < 0.05 * len(clean)


def test_insults_with_gaps(spark):
    rows = [(k, " ".join(sentence(["blockhead" if k % 2 else "worthwackle"] if k % 5 == 0 and j == 1 else ()) for j in range(3)), int(k % 5 == 0)) for k in range(600)]
    rows += [(900, sentence(["block", "head"]), None), (901, sentence(["wor", "th", "wackle"]), None), (902, sentence(["blo", "ckh", "ead"]), None), (903, sentence(), None)]
    out = judged(spark, rows)
    assert [out[k].predicted for k in (900, 901, 902, 903)] == [1, 1, 1, 0], [out[k].score for k in (900, 901, 902, 903)]


def test_every_stretch_counts():
    """The margin of a text against kernels of each of its words and up to four in a row, one by one."""
    model = toxicity.learn_strings({"blockhead": 3.0, "you are a fool": 2.0}, {"restaurant": 1.0, "mister": 2.0, "a plain word": 1.0}, toxicity.LATIN)
    table = model.table()

    def value(string):
        c = toxicity.codes(string, toxicity.LATIN)
        v = toxicity.vector(np.concatenate([[toxicity.START], c[c > 0], [toxicity.END]]))
        return float((table[v[0]] * v[1]).sum()) if v else 0.0

    texts = []
    for _ in range(200):
        words = [RNG.choice(["blockhead", "b.l.o,ckhead", "mister", "you", "are", "a", "fool", "x", "blo", "ckhead", "i", "é!", "...", "mi5ster"]) for _ in range(RNG.randint(1, 9))]
        texts.append(" ".join(words))
    got = toxicity.margins(model, texts)[0]
    for text, margin in zip(texts, got):
        rows = []
        for w in (w for w in text.split() if toxicity.codes(w, toxicity.LATIN).any()):
            alone = (toxicity.codes(w, toxicity.LATIN) > 0).sum() == 1
            if alone and rows and rows[-1][1]:
                rows[-1] = (rows[-1][0] + w, True)
            else:
                rows.append((w, alone))
        values = [value(" ".join(w for w, _ in rows[i:j])) for i in range(len(rows)) for j in range(i + 1, min(len(rows), i + toxicity.PHRASE) + 1)]
        want = max(values) + model.bias if values else toxicity.NOTHING
        assert abs(margin - want) < 1e-4, text


def test_long_texts_and_words_are_seen_to_their_end():
    model = toxicity.learn_strings({"blockhead": 3.0}, {"restaurant": 1.0, "mister": 2.0}, toxicity.LATIN)
    whole = toxicity.margins(model, ["blockhead"])[0][0]
    words = "mister " * 30_000
    glued = "zq" * 200_000
    got = toxicity.margins(model, [words + "blockhead", "blockhead " + words, words, glued + "blockhead" + glued, glued, "", None, " . "])[0]
    assert abs(got[0] - whole) < 1e-4 and abs(got[1] - whole) < 1e-4 and got[2] < whole - 0.5
    assert got[3] > got[4] + 0.3 and got[5] == got[6] == got[7] == toxicity.NOTHING


def test_cuts_between_words_change_nothing(monkeypatch):
    """Margin, counts and stretch of long texts, cut into many parts or not at all."""
    model = toxicity.learn_strings({"blockhead": 3.0, "you are a fool": 2.0}, {"restaurant": 1.0, "mister": 2.0}, toxicity.LATIN)
    words = ["blockhead", "mister", "you", "are", "an", "fool", "fine", "...", "restaurant"] + ["long" * 30]  # no letters that stand alone
    texts = [" ".join(RNG.choices(words, k=RNG.randint(1, 900))) for _ in range(20)] + ["mister " * 70 + "you are a fool " + "mister " * 70]
    monkeypatch.setattr(toxicity, "BLOCK", 1 << 20)
    whole = [toxicity.margins(model, [t], True) for t in texts]
    monkeypatch.setattr(toxicity, "BLOCK", 257)
    assert any(len(list(toxicity.parts_of(t))) > 10 for t in texts)
    for t, (margin, hits, n, top) in zip(texts, whole):
        m, h, k, s = toxicity.margins(model, [t], True)
        assert abs(m[0] - margin[0]) < 1e-4 and h == hits and k == n == [sum(any(map(str.isalpha, w)) for w in t.split())] and s == top


def test_words_that_clean_texts_have_as_well(spark):
    """A word of toxic texts that every eighth clean text has once: how often it is there tells them apart."""
    rows = []
    for k in range(900):
        toxic = k % 6 == 0
        plain = [w for _ in range(6) for w in sentence().split()]
        for _ in range(6 if toxic else int(k % 8 == 1)):
            plain.insert(RNG.randrange(len(plain)), "gruff" + RNG.choice(["el", "ot", "ism", "or", "ing", "ace"]))
        rows.append((k, " ".join(plain), int(toxic)))
    out = judged(spark, rows)
    held = [k for k in range(900) if out[k].held_out]
    assert sum(out[k].predicted for k in held if k % 6 == 0) > 0.85 * sum(k % 6 == 0 for k in held)
    assert sum(out[k].predicted for k in held if k % 6) < 0.05 * sum(k % 6 > 0 for k in held)


def test_svm_is_at_its_least():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=80))
    c = rng.uniform(0.5, 2, 80)
    w, b = toxicity.svm(x, y, c)
    loss = lambda w, b: (w * w).sum() / 2 + (c * np.maximum(0, 1 - y * (x @ w + b)) ** 2).sum()
    assert all(loss(w + d[:5], b + d[5]) >= loss(w, b) - 1e-7 for d in rng.normal(size=(200, 6)) * 1e-3)
