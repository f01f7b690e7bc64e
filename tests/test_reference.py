"""The library's rules, on literal fixtures."""

from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import consistency as C
from termweave.operators import review as R
from termweave.sources import side, xliff

UNITS = [
    ("Go to the main dashboard now.", "انتقل إلى اللوحة الرئيسية الآن."),
    ("The main dashboard shows statistics.", "لوحة رئيسية تعرض الإحصاءات."),
    ("Open the main dashboard again.", "افتح اللوحة الرئيسية مرة أخرى."),
    ("Click the cancel button here.", "انقر على زر الإلغاء هنا."),
    ("Press the cancel button twice.", "اضغط على زر الإبطال مرتين."),
    ("Find the cancel button below.", "ابحث عن زر الإلغاء بالأسفل."),
    ("You can save file quickly.", "يمكنك حفظ الملف بسرعة."),
    ("Please save file before exit.", "يرجى حفظ الملف قبل الخروج."),
]
XLIFF = "<?xml version='1.0' encoding='UTF-8'?>\n<xliff version=\"1.2\"><!-- c --><file><body>" + "".join(f'<trans-unit id="{i}"><source>{s}</source><target>{t}</target></trans-unit>' for i, (s, t) in enumerate(UNITS, 1)) + "</body></file></xliff>"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()[0]


def segments(spark):
    return spark.createDataFrame([(i, f"f#{i}", "f", s, t) for i, (s, t) in enumerate(UNITS)], "seg_ord bigint, sid string, file string, source string, target string")


def test_text(spark):
    c = F.col("a")
    for word, stem in (("الزر", "زر"), ("بالزر", "زر"), ("وبالزر", "زر"), ("الف", "الف"), ("كتاب", "كتاب"), ("باب", "باب"), ("ولد", "ولد")):
        assert one(spark, T.light_stem_ar(c), a=word) == stem
    for token, bare in (("file.", "file"), ("(file)", "file"), ("مرتين؟", "مرتين؟")):
        assert one(spark, T.strip_token(c), a=token) == bare
    assert one(spark, T.normalize_ar(c), a="الرئيسية") == "الرىيسيه"
    assert one(spark, T.splice(c, F.lit(1), F.lit(2), F.lit("X")), a="a b c d") == "a X d"
    assert one(spark, T.splice(c, F.lit(1), F.lit(5), F.lit("X")), a="a b") == "X"
    assert one(spark, T.literal_placeholders(c), a="Hi %s {0} {{x}} %1$s") == ["%1$s", "%s", "{0}", "{{x}}"]
    assert one(spark, T.char_diff(F.col("a"), F.col("b")), a="abc", b="axc") == "=a-b+x=c"
    assert one(spark, T.char_class(c), a="ـ") == "tatweel"
    for counts, h in (([1, 1], 1.0), ([3], 0.0), ([2, 1], 0.918296)):
        assert abs(spark.range(1).select(T.entropy(F.array(*map(F.lit, map(float, counts))))).first()[0] - h) < 1e-6


def test_runs(spark):
    for at, want in (([2, 3, 15], (2, 3)), ([0, 1, 5, 6], (0, 1)), ([0, 2, 6, 7], (6, 7))):
        r = spark.createDataFrame([(at,)], "a array<int>").select(C.best_run(F.col("a")).alias("r")).first()["r"]
        assert (r["lo"], r["hi"]) == want


def test_sample_flags(spark):
    cfg = C.Config(nmin=2, nmax=3)
    rows = C.ranked(C.flags(C.occurrences(segments(spark), cfg), cfg)).collect()
    assert [(r["ngram"], [(v["span"], v["count"]) for v in r["variants"]], round(r["score"], 6), r["total"]) for r in rows] == [
        ("main dashboard", [("لوحه رىيسيه", 2), ("رىيسيه مره", 1)], 0.918296, 3),
        ("cancel button", [("زر الغاء", 2), ("زر ابطال", 1)], 0.918296, 3),
    ]


def test_fold_rules(spark):
    rows = [(i, f"s#{i}", "f", "red button", t) for i, t in enumerate(["abcdef xx", "abcdeg xx", "abcdef", "zz", "zz", "q"])]
    occ = C.occurrences(spark.createDataFrame(rows, "seg_ord bigint, sid string, file string, source string, target string"), C.Config())
    got = C.flags(occ, C.Config()).first()
    assert [(v["span"], v["count"]) for v in got["variants"]] == [("abcdef xx", 3), ("zz", 2), ("q", 1)]
    assert sum(v["count"] for v in got["variants"]) == 6


def test_alignment_gold(spark, tmp_path):
    lines = ["# gold", "save the file\tاحفظ الملف\t0-0 2-1 1?1", "open the settings menu\tافتح قائمة الإعدادات\t0-0 3-1 2-2 1?2", "the user guide\tدليل المستخدم\t2-0 1-1 0?1", "click the cancel button\tانقر على زر الإلغاء\t0-0 3-2 2-3", "please save your changes\tيرجى حفظ تغييراتك\t0-0 1-1 3-2 2?2"]
    (tmp_path / "gold.tsv").write_text("\n".join(lines))
    g = side.gold(spark, str(tmp_path / "gold.tsv"))
    q = C.alignment_quality(g.withColumn("links", C.heuristic_links(F.col("src"), F.col("tgt")))).first()
    assert [round(x, 3) for x in q] == [0.333, 0.462, 0.613]


def test_xliff(spark, tmp_path):
    (tmp_path / "a.xlf").write_text(XLIFF)
    (tmp_path / "bad.xlf").write_text("<xliff>")
    segs, errors = xliff.read(spark, [str(tmp_path / "a.xlf"), str(tmp_path / "bad.xlf")])
    assert [(r["sid"], r["source"], r["target"]) for r in segs.orderBy("seg_ord").collect()] == [(f"a.xlf#{i}", s, t) for i, (s, t) in enumerate(UNITS)]
    assert [r["file"] for r in errors.collect()] == ["bad.xlf"]
    edits = spark.createDataFrame([("a.xlf#3", "جديد <b>")], "sid string, text string")
    out = xliff.export(spark, [str(tmp_path / "a.xlf")], edits).first()
    assert out["name"] == "a-corrected.xlf" and out["dropped_tags"] == 0
    assert bytes(out["content"]) == XLIFF.replace(UNITS[3][1], "جديد &lt;b&gt;", 1).encode()


def test_review(spark):
    segs = segments(spark)
    g = spark.createDataFrame([("cancel button", "زر الإلغاء"), ("save", "حفظ")], "source string, target string")
    assert [r["sid"] for r in R.glossary_violations(segs, g).collect()] == ["f#4"]
    occ = C.occurrences(segs)
    fixed = {r["sid"]: r["text"] for r in R.apply_correction(occ, segs, "cancel button", "زر الإلغاء").collect()}
    assert set(fixed) == {"f#3", "f#4", "f#5"}
    vault = spark.createDataFrame([("cancel button", "زر الغاء")], "key string, target string")
    assert [r["violation"] for r in C.ranked(C.flags(occ, C.Config(), vault)).collect()] == [True, False]
    lists = spark.createDataFrame([], side.ENTRY)
    new = spark.createDataFrame([(" A ", "x", "1", 0), ("a", "y", "2", 1), ("", "z", "3", 2)], "source string, target string, updated string, ord int")
    v = R.vault_upsert(lists, new)
    assert [(r["key"], r["target"]) for r in v.collect()] == [("a", "y")]
    assert [r["key"] for r in R.vault_list(R.vault_rename(v, "a", "b", "y", "3"), trash=True).collect()] == ["a"]


def test_stores(spark, tmp_path):
    p = "file://" + str(tmp_path / "v.json")
    frame = spark.createDataFrame([("k", "K", "t", "u", False), ("g", "G", "t", "u", True)], side.ENTRY)
    side.save_vault(frame, p)
    assert sorted(map(tuple, side.vault(spark, p).collect())) == sorted(map(tuple, frame.collect()))
    (tmp_path / "g.csv").write_text("﻿source,target\nsave, حفظ \nTerm,x\n,y\n")
    assert [tuple(r) for r in side.glossary(spark, str(tmp_path / "g.csv")).collect()] == [("save", "حفظ")]
    (tmp_path / "g.tbx").write_text('<m><!-- c --><termEntry><langSet xml:lang="en-US"><tig><term>save</term></tig></langSet><langSet xml:lang="ar"><tig><term>حفظ</term></tig></langSet></termEntry></m>')
    assert [tuple(r) for r in side.glossary(spark, str(tmp_path / "g.tbx")).collect()] == [("save", "حفظ")]


def test_stream(spark, tmp_path):
    from termweave.streaming.watch import watch

    segments(spark).write.parquet(str(tmp_path / "in"))
    got = []
    watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda f, n: got.extend(r["ngram"] for r in f.collect())).awaitTermination(120)
    assert sorted(got) == ["cancel button", "main dashboard"]


def test_stream_over_batches(spark, tmp_path):
    """An n-gram whose spans differ between batches is found by the second; a batch run again counts once."""
    from termweave.streaming.watch import SEGMENT, watch

    got = {}
    for n, target in enumerate(["aa bb", "cc dd"]):
        spark.createDataFrame([(n, f"s#{n}", "f", "red button", target)], SEGMENT).write.mode("append").parquet(str(tmp_path / "in"))
        watch(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda f, k: got.update({k: [(r["key"], r["total"]) for r in f.collect()]})).awaitTermination(120)
    assert got == {0: [], 1: [("red button", 2)]}


def test_terms_with_other_characters(spark):
    rows = spark.createDataFrame([(0, "s0", "f", "Use C++ now (really)", "x"), (1, "s1", "f", "use c now", "x"), (2, "s2", "f", "100 % sure", "x"), (3, "s3", "f", "the re-use, of it", "x")], "seg_ord bigint, sid string, file string, source string, target string")
    g = spark.createDataFrame([("C++", "y"), ("%", "y"), ("re-use", "y"), ("(really)", "x"), ("e-use", "y"), ("use c", "y")], "source string, target string")
    assert {(r["sid"], r["source_term"]) for r in R.glossary_violations(rows, g).collect()} == {("s0", "C++"), ("s0", "use c"), ("s1", "use c"), ("s2", "%"), ("s3", "re-use")}
