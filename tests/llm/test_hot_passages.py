"""Operator 8 where one benchmark passage is in most documents, texts are very long, and the map comes in blocks."""

import brute
import numpy as np
from pyspark.sql import functions as F

from jobtrail.llm import decontaminate as op8


def test_bitmap_by_blocks(spark):
    hashes = [int(h) for h in np.random.default_rng(3).integers(-(2**63), 2**63, 5000)] + [0, -1, 2**63 - 1, -(2**63)]
    bits = np.frombuffer(op8.bitmap(spark.createDataFrame([(h,) for h in hashes], "gram long"), "gram"), "<u4")
    power = op8.map_bits(len(hashes))
    want = np.zeros(1 << (power - 5), "<u4")
    for h in hashes:
        at = (h % 2**64) >> (64 - power)
        want[at >> 5] |= np.uint32(1 << (at & 31))
    assert (bits == want).all()
    assert len(op8.marked(np.array(hashes).astype(np.int64).view(np.uint64), bits)) == len(hashes)
    assert not np.frombuffer(op8.bitmap(spark.createDataFrame([], "gram long"), "gram"), "<u4").any()


def hot_rows():
    shared = "one passage that very many of the documents hold word by word"
    rows = [(k, f"{'x ' * (k % 5)}{shared} {'y ' * (k % 3)}tail{k}") for k in range(2000)]
    rows += [(5000, ("long text of many words " * 40_000) + shared), (5001, None), (5002, ""), (5003, shared), (5003, "other " + shared), (5004, f"{shared} " * 300)]
    items = [(1, shared), (2, "tail7"), (3, "y"), (4, None), (5, f"before {shared} after"), (6, shared)]
    return rows, items


def test_one_passage_in_most_documents(spark):
    rows, items = hot_rows()
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = [r for r in rows if r[0] != 5003]
    got = {r.doc_id: tuple(r)[1:] for r in op8.decontaminate(docs.where("doc_id != 5003"), bench).collect()}
    assert got == brute.decontaminate(one, items)
    assert [r.contaminated for r in op8.decontaminate(docs, bench).where("doc_id = 5003").collect()] == [True, True]


def test_hot_shingle_is_dealt_to_parts(spark):
    places = spark.range(10_000).selectExpr("id as doc_id", "if(id % 3 = 0, 7L, id % 50 + 100) as gram", "cast(id % 11 as int) as pos")
    prefix = places.groupBy("gram").agg(F.count("*").alias("docs")).withColumn("words", F.concat(F.lit("w"), "gram")).unionByName(spark.createDataFrame([(7, 3334, "w7b"), (9, 0, "none")], "gram long, docs long, words string"))
    near = op8.in_parts(places, prefix)
    plain = places.join(prefix.drop("docs"), "gram")
    columns = ["doc_id", "gram", "pos", "words"]
    assert sorted(map(tuple, near.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))
    sizes = near.groupBy("gram", "part").count().groupBy("gram").agg(F.max("count").alias("most"), F.count("*").alias("parts")).where("gram = 7").first()
    assert sizes.parts > 100 and sizes.most < 100
