"""Vector alignment and reports, on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import consistency as C
from termweave.operators import report, vector_align

SEGMENT = "seg_ord bigint, sid string, file string, source string, target string"


def brute_mutual(sim):
    return {(i, j) for i in range(len(sim)) for j in range(len(sim[0])) if sim[i][j] == max(sim[i]) and sim[i][j] == max(r[j] for r in sim)}


def test_matrix_rules():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sim = rng.normal(size=(int(rng.integers(1, 7)), int(rng.integers(1, 7))))
        one = vector_align.mutual(sim)
        assert set(zip(*map(list, np.nonzero(one)))) == brute_mutual(sim.tolist())
        assert not (one & ~vector_align.iterated(sim)).any()
        e = np.exp(sim)
        assert (vector_align.softmax(sim, 0.1) == ((e / e.sum(1, keepdims=True) > 0.1) & (e / e.sum(0) > 0.1))).all()
    sim = np.array([[0.9, 0.8], [0.1, 0.7], [0.6, 0.2]])
    assert np.argwhere(vector_align.mutual(sim)).tolist() == [[0, 0]]
    assert [2, 0] in np.argwhere(vector_align.iterated(np.array([[0.9, 0.1], [0.1, 0.8], [0.6, 0.2]]))).tolist()


def test_vector_links(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [0.0, 0.9]
    rows = [(1, [a, b], [b, a], [0, 1], [0, 1]), (2, [a, b, c], [c, a], [0, 1, 1], [0, 1]), (3, None, [a], [0], [0]), (4, [], [], [], []), (5, [a], [a, b], [0, 1, 2], [0, 0])]
    pairs = spark.createDataFrame(rows, "pair int, src_vecs array<array<double>>, tgt_vecs array<array<double>>, src_word array<int>, tgt_word array<int>").withColumn("links", F.lit(0))
    got = {r["pair"]: [tuple(x) for x in r["links"]] for r in vector_align.vector_links(pairs, "pair").collect()}
    assert got == {1: [(0, 1), (1, 0)], 2: [(0, 1), (1, 0)], 3: [], 4: [], 5: [(0, 0)]}
    assert vector_align.vector_links(pairs.where("false"), "pair", "softmax").count() == 0
    with pytest.raises(ValueError):
        vector_align.vector_links(pairs, "pair", "other")


def test_reports(spark):
    rows = [(i, f"f#{i}", "f", "red button %s" if i == 0 else "red button", t) for i, t in enumerate(["aaaa bbbb", "cccc dddd", "cccc dddd", "eeee ffff"])]
    segments = spark.createDataFrame(rows, SEGMENT)
    cfg = C.Config(nmax=2, merge_contained=False)
    occ = C.occurrences(segments, cfg)
    found = C.flags(occ, cfg).where("key = 'red button'")
    one = json.loads(report.flags_json(found).first()["json"])
    assert one["ngram"] == "red button" and one["total"] == 4 and one["variants"][0] == {"span": "cccc dddd", "raw": "cccc dddd", "count": 2} and one["score"] == round(one["score"], 3)
    edits = spark.createDataFrame([("f#1", "new")], "sid string, text string")
    shown = {r["sid"]: (r["target"], r["original"]) for r in report.flag_occurrences(found, occ, segments, edits).collect()}
    assert len(shown) == 4 and shown["f#1"] == ("new", "cccc dddd") and shown["f#3"] == ("eeee ffff", "eeee ffff")
    both = found.withColumn("decided", F.lit(True)).unionByName(found.withColumns({"decided": F.lit(False), "key": F.lit("second"), "total": F.lit(1).cast("long")}))
    assert [r["key"] for r in report.significance(both).collect()] == ["second", "red button"]
    assert [r["sid"] for r in report.placeholder_report(segments).collect()] == ["f#0"]
    frame, total, seen = report.listing(segments, 2)
    assert (frame.count(), total, seen) == (2, 4, 2) and report.listing(segments, 0)[2] == 4
    reverse = C.reverse_flags(C.occurrences(segments.withColumn("target", F.lit("zz yy")).withColumn("source", F.when(F.col("seg_ord") < 2, "one two").otherwise("six ten")), cfg))
    assert {json.loads(r["json"])["distinct"] for r in report.reverse_json(reverse).collect()} == {2}


def test_verify_all(spark):
    items = spark.createDataFrame([("k", "k", ["a", "b"]), ("one", "one", ["a"])], "key string, ngram string, spans array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "text string, vec array<double>")
    got = {r["key"]: (round(r["agreement"], 6), r["verdict"]) for r in report.verify_all(items, "vectors", vectors).collect()}
    assert got == {"k": (0.6, "distinct"), "one": (1.0, "duplicate")}
    english = spark.createDataFrame([("a", "Stop"), ("b", " stop")], "text string, english string")
    assert {r["verdict"] for r in report.verify_all(items, "translations", english).collect()} == {"duplicate"}
    with pytest.raises(ValueError):
        report.verify_all(items, "other", vectors)
