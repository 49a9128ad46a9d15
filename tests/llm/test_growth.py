"""Operator 9's stretches that grow, operator 10's lasso, and operator 1 on long repetitive texts."""

import hashlib
import os
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

from jobtrail.llm import quality
from jobtrail.llm.bpe_codec import Codec
from jobtrail.llm.fingerprints import Fingerprint, edited, likeness, paragraphs, update


def test_a_joint_that_disagrees_grows_until_it_agrees(monkeypatch):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path, draw = P.path("word_bpe_49k.json"), random.Random(9)
    library, codec = Tokenizer.from_file(path), Codec(path)
    library.no_truncation()
    words = ["".join(draw.choices("abcdeilnorstu", k=draw.randint(1, 9))) for _ in range(4000)]
    text = " ".join(draw.choices(words, k=6000))
    want = library.encode(text, add_special_tokens=False).ids
    real_joint, real_ids = codec.joint, codec.ids
    for refused in ({3}, {3, 4}, {0}, {1, 2, 3}, {5, 20, 21, 22}, set(range(8)), set(range(10_000))):
        calls, whole = [], []

        def joint(left, middle, right):
            calls.append(1)
            return None if len(calls) - 1 in refused and (left is not None or right is not None) else real_joint(left, middle, right)

        def ids(t):
            whole.append(len(t))
            return real_ids(t)

        monkeypatch.setattr(codec, "joint", joint)
        monkeypatch.setattr(codec, "ids", ids)
        codec.agreed.clear()
        got = codec.of_texts(pa.array([text]))[0]
        assert np.frombuffer(got, "<u4").tolist() == want
        assert (max(whole) == len(text)) == (len(refused) == 10_000) and len(calls) > 5  # the whole text only where nothing agrees


def test_lasso_has_the_least_loss():
    rng = np.random.default_rng(2)
    fired = rng.random((400, 12)) < 0.4
    label = (rng.random(400) < 1 / (1 + np.exp(-(2.0 * fired[:, 0] - 3.0 * fired[:, 1] + 0.5)))).astype(float)
    w, b = quality.lasso(fired, label, 0.01)

    def loss(w, b):
        z = fired @ w + b
        return np.mean(np.logaddexp(0, z) - label * z) + 0.01 * np.abs(w).sum()

    assert all(loss(w + d[:12], b + d[12]) >= loss(w, b) - 1e-7 for d in rng.normal(size=(300, 13)) * 1e-2)
    assert 0 < (np.abs(w) < 1e-9).sum() < 12 and w[0] > 0 > w[1]


def test_likeness_of_a_long_repetitive_text():
    for n in (1000, 60_000, 250_000):
        text = "word " * n
        new = edited(text, "other things in " + "many new words of all kinds " * n)
        a, b = (Fingerprint().changed(paragraphs(t)) for t in (text, new))
        share = 2 / 3  # of the runs of one kind: 2ab / (aa + bb) of their numbers
        assert abs(likeness(a, b) - 2 * share / (1 + share**2)) < 0.15
        assert likeness(a, Fingerprint.of_text(a.text())) == 1.0
        assert likeness(a, Fingerprint().changed(paragraphs("word " * (2 * n // 3)))) > 0.92 - 0.02
    grown = Fingerprint().changed(["x".encode()] * 3)
    assert update(Fingerprint().text(), ["x", "x", "x"]) == grown.text() and hashlib.sha256(grown.text().encode()).hexdigest()
