"""Aligners by name, their cache, the whole analysis, and the smaller rules of review."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import aligners, analysis, judge, report, vector_align
from termweave.operators import consistency as C
from termweave.operators import review as R
from termweave.sources import side

SEGMENT = "seg_ord bigint, sid string, file string, source string, target string"


def test_weight_matching():
    rng = np.random.default_rng(7)
    for _ in range(60):
        n, m = int(rng.integers(1, 6)), int(rng.integers(1, 6))
        sim = np.round(rng.normal(size=(n, m)), 2)
        got = vector_align.weight(sim)
        assert got.sum() == min(n, m) and got.sum(0).max() <= 1 and got.sum(1).max() <= 1
        best = max(sum(sim[i, j] for i, j in zip(rows, columns)) for rows in itertools.combinations(range(n), min(n, m)) for columns in itertools.permutations(range(m), min(n, m)))
        assert abs(sim[got].sum() - best) < 1e-9


def segments(spark):
    rows = [(i, f"f#{i}", "f", "red button", t) for i, t in enumerate(["aa bb", "aa bb", "cc dd", "ee", "aa bb"])]
    return spark.createDataFrame(rows, SEGMENT)


def test_factory_and_cache(spark, tmp_path):
    asked = []

    def encode(pairs):
        asked.append(pairs.count())
        one = F.array(F.lit(1.0), F.lit(0.0))
        two = F.array(F.lit(0.0), F.lit(1.0))
        return pairs.select("src", "tgt", F.array(one, two).alias("src_vecs"), F.array(two, one).alias("tgt_vecs"), F.array(F.lit(0), F.lit(1)).alias("src_word"), F.array(F.lit(0), F.lit(1)).alias("tgt_word"))

    cache = aligners.Cache(f"file://{tmp_path}/cache")
    for kind in ("simalign", "awesome"):
        own = aligners.build_aligner(kind, model="xlmr", encode=encode, cache=cache)
        got = {(r["seg_ord"]): [tuple(x) for x in r["links"]] for r in C.align(segments(spark).where("seg_ord <> 3"), own).collect()}
        assert own.name.endswith("xlm-roberta-base")
        want = [(0, 1), (1, 0)] if kind == "simalign" else [(0, 0), (0, 1), (1, 0), (1, 1)]
        assert got == dict.fromkeys((0, 1, 2, 4), want)
    assert asked == [2, 2]  # each distinct pair once
    again = aligners.build_aligner("simalign", model="xlmr", encode=encode, cache=cache)
    assert C.align(segments(spark), again).count() == 5 and asked == [2, 2, 1]  # only what is new
    assert C.align(segments(spark), again).count() == 5 and asked == [2, 2, 1]
    assert aligners.build_aligner("simalign", encode=encode, methods=("weight",)).method == "weight"
    for bad in ({"kind": "other"}, {"kind": "mock"}, {"kind": "awesome"}, {"kind": "ensemble"}, {"kind": "ensemble", "parts": [own], "how": "both"}, {"kind": "simalign", "encode": encode, "methods": ()}):
        with pytest.raises(ValueError):
            aligners.build_aligner(**bad)
    table = C.distinct_pairs(segments(spark)).withColumn("links", F.expr("array(named_struct('s', 0, 't', 0))")).where("tgt[0] = 'aa'")
    both = aligners.build_aligner("ensemble", parts=[aligners.build_aligner("mock", table=table), aligners.build_aligner()], how="union")
    got = {r["seg_ord"]: [tuple(x) for x in r["links"]] for r in C.align(segments(spark), both).collect()}
    assert got[0] == [(0, 0), (1, 1)] and got[3] == [(0, 0), (1, 0)]


def test_analyze_all(spark):
    rows = segments(spark).unionByName(spark.createDataFrame([(9, "f#9", "f", "go %s now", "go now")], SEGMENT))
    cfg = C.Config(nmax=2)
    done = analysis.analyze_all(rows, cfg)
    assert done.summary.first().asDict() == {"segments": 6, "files": 1, "inconsistent": 1, "flags": 1, "reverse_flags": 0, "placeholder_issues": 1, "violations": 0}
    decided = spark.createDataFrame([("red button",)], "key string")
    assert analysis.analyze_all(rows, cfg, decisions=decided).summary.first()["flags"] == 0
    keep = C.Config(nmax=2, include_consistent=True)
    marked = analysis.analyze_all(rows, keep, decisions=decided)
    assert marked.summary.first()["inconsistent"] == 0 and marked.flags.where("key = 'red button'").first()["decided"]
    encode = lambda t: t.select("text", F.array(F.lit(2.0), F.lit(0.0)).alias("vec"))
    vectors = R.embeddings(R.payload(done.flags), encode)
    assert all(r["vec"] == [1.0, 0.0] for r in vectors.collect())
    assert analysis.analyze_all(rows, cfg, vectors=vectors, identical=0.98).summary.first()["flags"] == 0
    assert analysis.analyze_all(rows, cfg, vectors=vectors, faithful=0.6).flags.first()["key"] == "red button"
    vault = spark.createDataFrame([("red button", "cc dd")], "key string, target string")
    assert analysis.analyze_all(rows, cfg, vault=vault).summary.first()["violations"] == 1
    found = done.flags
    text = report.full_json(found, done.occurrences, rows).first()["json"]
    assert text.count('"sid"') == 5 and '"span":"aa bb"' in text
    reverse = C.reverse_flags(C.occurrences(rows.withColumn("target", F.lit("zz yy")), cfg))
    assert report.reverse_full_json(reverse, C.occurrences(rows.withColumn("target", F.lit("zz yy")), cfg), rows).first()["json"].count('"sid"') >= 5


def test_merged_spans_keep_their_occurrences(spark):
    rows = spark.createDataFrame([(i, f"f#{i}", "f", "red button", t) for i, t in enumerate(["abcdef xx", "abcdeg xx", "abcdef", "zz", "zz", "q"])], SEGMENT)
    occ = C.occurrences(rows)
    found = C.flags(occ, C.Config())
    assert sorted(map(sorted, (v["spans"] for v in found.first()["variants"]))) == [["abcdef", "abcdef xx", "abcdeg xx"], ["q"], ["zz"]]
    assert report.full_json(found, occ, rows).first()["json"].count('"sid"') == 6


def test_verdicts(spark):
    replies = ['{"verdict":"acceptable"}', '```json\n{"verdict":"inconsistent","preferred":"x"}\n```', '```JSON\n{"verdict":"a"}\n```', '```json{"verdict":"b"}```', '{"reason":"r"}', "no", "", None, "[1]", '{"verdict":']
    got = [r["v"] for r in spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string").select("i", R.parse_verdict(F.col("reply")).alias("v")).orderBy("i").collect()]
    assert [v["verdict"] for v in got] == ["acceptable", "inconsistent", "a", "b", None, *["unknown"] * 5]
    assert got[1]["preferred"] == "x" and got[4]["reason"] == "r" and got[5]["raw"] == "no"


def test_judging_without_a_server(spark):
    one = judge.Judge("http://127.0.0.1:9/v1", "m", timeout=1)
    assert not judge.test_connection(one)["ok"]
    items = spark.createDataFrame([("k2", "n2", ["a"]), ("k1", "n1", ["b"])], "key string, ngram string, spans array<string>").coalesce(1)
    rows = judge.judge_all(items, one).collect()
    assert [r["key"] for r in rows] == ["k2", "k1"] and all(r["error"] and r["reply"] is None for r in rows)
    assert one.endpoint() == "http://127.0.0.1:9/v1/chat/completions" and judge.Judge("https://api.anthropic.com", "m").endpoint().endswith("/v1/messages")


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text('﻿source,target\r\n"say ""hi"" now",\t x \r\nEN,y\r\nlone\r\n"two\nlines",z\r\n', encoding="utf-8")
    assert sorted(map(tuple, side.glossary(spark, str(tmp_path / "g.csv")).collect())) == [('say "hi" now', "x"), ("two\nlines", "z")]
    (tmp_path / "bad.tbx").write_text("<martif>")
    rows, errors = side.glossary_files(spark, str(tmp_path / "*.tbx"))
    assert rows.count() == 0 and [r["file"] for r in errors.collect()] == ["bad.tbx"]
    assert side.load_store(spark, f"file://{tmp_path}/none.json") == {"entries": {}} and side.load_store(spark, f"file://{tmp_path}/bad.tbx") == {"entries": {}}


def test_reverted_and_removed(spark):
    rows = segments(spark)
    edits = spark.createDataFrame([("f#1", "x"), ("f#2", "y")], "sid string, text string")
    assert [r["sid"] for r in R.revert(edits, rows.where("seg_ord = 1").select("sid")).collect()] == ["f#2"] and R.revert(edits).count() == 0
    two = rows.withColumn("file", F.when(F.col("seg_ord") < 2, "old").otherwise("f")).withColumn("seg_ord", F.col("seg_ord") * 1000)
    left, kept = R.remove_file(two, edits, "old")
    assert [(r["seg_ord"], r["sid"]) for r in left.orderBy("seg_ord").collect()] == [(0, "f#2"), (1, "f#3"), (2, "f#4")] and [r["sid"] for r in kept.collect()] == ["f#2"]
    found = C.flags(C.occurrences(rows), C.Config(nmax=2))
    assert R.approve_dominant(found).count() == 1 and R.approve_dominant(found.withColumn("cleared", F.lit(True))).count() == 0
