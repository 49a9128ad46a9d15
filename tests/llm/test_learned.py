"""Learned operators by held-out accuracy, main text by planted pages, and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

from jobtrail.llm import html_extract, quality, toxicity

RNG = random.Random(5)
PLAIN = ["".join(RNG.choices("aeiorstn", k=RNG.randint(2, 8))) for _ in range(400)]


def sentence(extra=()):
    w = RNG.choices(PLAIN, k=12)
    for x in extra:
        w.insert(RNG.randrange(len(w)), x)
    return " ".join(w).capitalize() + "."


@pytest.fixture(scope="module")
def toxic(spark):
    rows = []
    for k in range(600):
        bad = k % 5 == 0
        rows.append((k, " ".join(sentence(RNG.sample(["blockhead", "dumkopf", "vilezza"], 1) if bad and j == 2 else ()) for j in range(4)), int(bad)))
    rows += [(9000, sentence(["b-l-o.c.khead"]), None), (9001, sentence(["blo1ckh2ead"]), None), (9002, "b l o c k h e a d", None), (9003, "", None), (9004, None, None), (9005, sentence(), None)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity(spark, toxic):
    out = {r.doc_id: r for r in toxicity.toxicity(toxic.drop("toxic").withColumn("score", F.lit(0)), toxic.select("doc_id", "toxic")).collect()}
    held = [k for k in range(600) if out[k].held_out]
    right = sum(out[k].predicted == (k % 5 == 0) for k in held) / len(held)
    assert 100 < len(held) < 300 and right > 0.95
    assert all(out[k].predicted == 1 for k in (9000, 9001, 9002)), [out[k].score for k in (9000, 9001, 9002)]
    assert all(out[k].predicted == 0 for k in (9003, 9004, 9005))


def test_toxicity_without_labels(spark, toxic):
    none = toxic.select("doc_id", "toxic").limit(0)
    assert {r.score for r in toxicity.toxicity(toxic, none).collect()} == {0.5}
    assert toxicity.toxicity(toxic.limit(0), none).count() == 0
    same = toxic.select("doc_id", F.lit(0).alias("toxic"))
    assert toxicity.toxicity(toxic, same).where("predicted = 1").count() == 0


def test_kernel_tolerates_gaps():
    v = lambda t: toxicity.vectors(t, toxicity.LATIN)[0]
    k = toxicity.kernel([v("blockhead"), v("b.l.o.c.k.h.e.a.d"), v("bloxckhead"), v("blohead"), v("restaurant")], [v("blockhead")])[:, 0]
    assert abs(k[0] - 1) < 1e-6 and abs(k[1] - 1) < 1e-6 and k[2] > 0.7 and k[3] > 0.5 and k[4] < 0.1


def test_quality(spark):
    good = lambda: "\n".join(sentence() for _ in range(4))
    junk = lambda: " ".join(w.upper() + "!!" for w in RNG.choices(PLAIN, k=30)) if RNG.random() < 0.5 else " | ".join(RNG.choices(PLAIN, k=40))
    rows = [(k, good() if k % 4 else junk(), int(k % 4 > 0)) for k in range(500)] + [(1000, None, None), (1001, "", None), (1001, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    out = quality.quality(docs.withColumn("held_out", F.lit("x")), docs.select("doc_id", "quality")).collect()
    held = [r for r in out if r.held_out and r.doc_id < 500]
    assert len(out) == 503 and sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.quality(docs, docs.select("doc_id", "quality").limit(0)).collect()} == {0.5}
    assert quality.quality(docs.limit(0), docs).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>";</script></head><body><header>top</header><nav class="menu"><ul><li><a href="/a">a</a></ul></nav>'
    '<div class="wrap w%d"><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class="post post-%d"><h1>Ti&amp;tle %d</h1><p>First  <b>bold</b>\n text &eacute;&#33;<p>Second<br>line %s</p>'
    '<form><p>search</p></form><ul><li>point one<li>point two</ul></div><div id="comments"><p>I like it very much indeed, %s</p></div></div><aside>side</aside><footer>&copy; x</footer></body></html>'
)


def test_main_text(spark):
    pages = [(k, f"http://host{k % 2}.example/{k}", PAGE % (k, k, k, "long " * 30, "so " * (80 if k == 3 else 2))) for k in range(6)]
    pages += [(10, None, None), (11, "x", ""), (12, "http://host0.example/q", "<p>only this &lt;p&gt;"), (12, "http://host0.example/q", "<p>only this &lt;p&gt;")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit("y")).withColumn("host", F.lit("z"))
    rows = html_extract.main_text(df).collect()
    out = {r.page_id: r for r in rows}
    for k in range(6):
        text = "\n\n".join([f"Ti&tle {k}", "First bold text é!", ("Second line " + "long " * 30).strip(), "point one", "point two"])
        assert (out[k].text, out[k].n_chars) == (text, len(text))
    assert len(rows) == 10 and out[10].text == "" and out[11].text == "" and out[12].text == "only this <p>"
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_pipeline_equals_its_stages(spark, tmp_path):
    import os

    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near-duplicates", "decontamination", "bpe"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    seen = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0.5 * seen < docs.count() <= seen
        seen = docs.count()
    want = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).collect())) == want
