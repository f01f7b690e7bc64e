"""Queries of the sources and sinks: files are made of the driver's tables, then read, corrected and written by the
library; DuckDB has the rows they were made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave import staging
from termweave.functions import text as T
from termweave.operators import consistency as C
from termweave.operators import judge, report
from termweave.operators import review as R
from termweave.plans.catalogue import PARTS, parts, query, table
from termweave.sources import side, xliff


def _text(*pieces) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in pieces])


def _joined(rows: DataFrame, piece: Column, head: str, tail: str, end: str) -> DataFrame:
    """file, file_ord, content: the pieces of each file, by seg_ord, between head and tail."""
    files = rows.select("file", F.struct("seg_ord", piece.alias("x")).alias("one")).groupBy("file").agg(F.array_sort(F.collect_list("one")).alias("all"))
    content = _text(head, F.array_join(F.transform("all", lambda r: r["x"]), ""), tail)
    return files.select(F.concat("file", F.lit(end)).alias("file"), F.regexp_extract("file", "[0-9]+", 0).cast("int").alias("file_ord"), content.cast("binary").alias("content"))


def _xliff12(s: SparkSession, d: str) -> DataFrame:
    unit = _text('<trans-unit id="', F.col("seg_ord").cast("string"), '"><source>\n  ', F.col("source"), ' <ph id="1"/></source><note>n</note><target>', F.col("target"), "</target></trans-unit>")
    return _joined(parts(s, d), unit, '<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2"><!-- made --><file><body>', '<trans-unit id="none"><source>no target</source></trans-unit></body></file></xliff>', ".xlf")


def _xliff20(s: SparkSession, d: str) -> DataFrame:
    unit = _text('<unit id="u', F.col("seg_ord").cast("string"), '"><segment><source>', F.col("source"), "</source><target>", F.col("target"), '</target></segment><segment><source>twice <pc id="2">', F.col("source"), "</pc></source><target/></segment></unit>")
    return _joined(parts(s, d), unit, '<x:xliff xmlns:x="urn:oasis:names:tc:xliff:document:2.0" xmlns="urn:oasis:names:tc:xliff:document:2.0" version="2.0"><x:file id="f">', "</x:file></x:xliff>", ".xlf")


@query("xliff_12_segments", f"with {PARTS} select 'size' || p_size || '.xlf' file, p_partkey::varchar unit, source, target, (p_size::bigint << 32) + row_number() over (partition by p_size order by p_partkey) - 1 seg_ord from (select p.*, part.p_size, part.p_partkey from parts p join part on part.p_partkey = p.seg_ord)")
def _(s, d):
    return xliff.parse_files(_xliff12(s, d))[0].select("file", "unit", "source", "target", "seg_ord")


@query("xliff_20_segments", f"with {PARTS} select file || '.xlf' file, 'u' || seg_ord unit, source, target from parts union all select file || '.xlf', 'u' || seg_ord, 'twice ' || source, '' from parts")
def _(s, d):
    return xliff.parse_files(_xliff20(s, d))[0].select("file", "unit", "source", "target")


@query("xliff_read_from_disk", f"with {PARTS}, n as (select file || '.xlf#' || (row_number() over (partition by file order by seg_ord) - 1) sid, source from parts where file in ('size1', 'size2', 'size3')) select sid, source from n")
def _(s, d):
    """Through a folder: files of the same name are one, at the first one's place; a bad one is an error."""
    folder, files = staging.new_folder(s), _xliff12(s, d).where("file in ('size1.xlf', 'size2.xlf', 'size3.xlf')")
    for r in files.collect():  # three files
        staging.write_text(s, f"{folder}/{r['file']}", bytes(r["content"]).decode())
    staging.write_text(s, f"{folder}/old/size2.xlf", "<xliff><trans-unit><source>a</source><target>b</target></trans-unit></xliff>")
    staging.write_text(s, f"{folder}/bad.xlf", "<xliff>")
    return xliff.read(s, [f"{folder}/{p}" for p in ("size3.xlf", "old/size2.xlf", "bad.xlf", "size1.xlf", "size2.xlf")])[0].select("sid", "source")


@query("xliff_bad_files", "select 'size' || p_size || '.xlf' file from part where p_size % 2 = 0 group by p_size")
def _(s, d):
    files = _xliff12(s, d).withColumn("content", F.when(F.col("file_ord") % 2 == 0, F.substring("content", 1, 40)).otherwise(F.col("content")))
    return xliff.parse_files(files)[1].select("file")


@query("xliff_corrected", f"""with {PARTS} select file || '-corrected.xlf' "name", '<?xml version="1.0" encoding="UTF-8"?>\n<xliff version="1.2"><!-- made --><file><body>' || string_agg('<trans-unit id="' || seg_ord || '"><source>\n  ' || source || ' <ph id="1"/></source><note>n</note><target>' || case when seg_ord % 3 = 0 then 'A &lt;b&gt; &amp; ' || target else target end || '</target></trans-unit>', '' order by seg_ord) || '<trans-unit id="none"><source>no target</source></trans-unit></body></file></xliff>' as content, 0 dropped_tags from parts group by file having bool_or(seg_ord % 3 = 0)""")
def _(s, d):
    files = _xliff12(s, d)
    segments = xliff.parse_files(files)[0]
    edits = segments.where("cast(unit as bigint) % 3 = 0").select("sid", _text("A <b> & ", F.col("target")).alias("text"))
    return xliff.correct_files(files, edits).select("name", F.col("content").cast("string").alias("content"), "dropped_tags")


@query("placeholder_report", f"with {PARTS} select file || '.xlf' file, 'ph:1' src_found, '' tgt_found, count(*) n from parts group by file")
def _(s, d):
    """Every source has an inline element that no target has."""
    rows = report.placeholder_report(xliff.parse_files(_xliff12(s, d))[0])
    return rows.select("file", F.array_join("src_found", "|").alias("src_found"), F.array_join("tgt_found", "|").alias("tgt_found")).groupBy("file", "src_found", "tgt_found").agg(F.count("*").alias("n"))


@query("dense_batches", f"with {PARTS}, n as (select source, row_number() over (order by regexp_extract(file, '[0-9]+')::int, seg_ord) - 1 i from parts) select i::bigint seg_ord, source from n where i >= 150 and i < 300")
def _(s, d):
    return R.batch(R.dense(xliff.parse_files(_xliff12(s, d))[0]), 2, 150).select("seg_ord", "source")


@query("segment_listing", f"with {PARTS} select sid, source from parts order by seg_ord limit 500")
def _(s, d):
    return report.listing(parts(s, d), 500)[0].select("sid", "source")


@query("glossary_csv", "select p_name || ' \"big\", ' || p_brand source, p_type target from part union all select p_name, p_brand from part")
def _(s, d):
    """Quotes, doubled quotes, commas and line breaks in cells, tabs around them, a header, blanks and short rows."""
    p = table(s, d, "part").select(F.col("p_partkey").alias("seg_ord"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("file"), "p_name", "p_type", "p_brand")
    line = _text('"', F.col("p_name"), ' ""big"", ', F.col("p_brand"), '"\t,\t', F.col("p_type"), " ,more\r\n", F.col("p_name"), ',"\n', F.col("p_brand"), '"\r\n', "English,x\r\n,blank\r\nshort\r\n")
    return side.parse_glossaries(_joined(p, line, "﻿source,target\r\n", "", ".csv"))[0]


@query("glossary_tbx", "select p_name source, p_type target from part")
def _(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").alias("seg_ord"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("file"), "p_name", "p_type")
    term = lambda lang, x: _text(f'<langSet xml:lang="{lang}"><tig><term>', x, "</term></tig></langSet>")
    entry = _text("<termEntry><!-- c -->", term("en-US", F.col("p_name")), term("ar", F.col("p_type")), "</termEntry><termEntry>", term("en", F.lit("no arabic")), "</termEntry>")
    files = _joined(p, entry, "<martif>", "</martif>", ".tbx")
    return side.parse_glossaries(files.unionByName(s.createDataFrame([("bad.tbx", 0, b"<martif>")], files.schema)))[0]


@query("alignment_gold", "select [p_name] src, [p_type] tgt, p_size % 2 = 0 is_sure from part where p_size > 2")
def _(s, d):
    line = _text(F.regexp_replace("p_name", " ", "_"), "\t", F.regexp_replace("p_type", " ", "_"), "\t", F.when(F.col("p_size") % 2 == 0, "0-0").otherwise("0?0"))
    rows = side.gold_rows(table(s, d, "part").select(F.when(F.col("p_size") == 1, _text("# ", line)).when(F.col("p_size") == 2, "").otherwise(line).alias("value")))
    plain = lambda c: F.transform(c, lambda w: F.regexp_replace(w, "_", " ")).alias(c)
    return rows.select(plain("src"), plain("tgt"), (F.size("sure") > 0).alias("is_sure")).where("size(src) = 1")


def _vault(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "part").groupBy(F.lower("p_name").alias("key")).agg(F.max("p_name").alias("source"), F.max("p_type").alias("target"), F.max("p_size").alias("size"))
    return p.select("key", "source", "target", F.concat(F.lit("d"), F.col("size").cast("string")).alias("updated"), (F.col("key") < "m").alias("deleted"))


@query("vault_store", "select lower(p_name) as key, max(p_name) source, max(p_type) target, 'd' || max(p_size) updated, lower(p_name) < 'm' deleted from part group by lower(p_name)")
def _(s, d):
    path = f"{staging.new_folder(s)}/vault.json"
    side.save_vault(_vault(s, d), path)
    side.save_vault(side.vault(s, path), path)
    return side.vault(s, path)


@query("decision_store", "select lower(p_name) as key, max(p_name) ngram, 'accepted' status, max(p_type) note, '' updated from part group by lower(p_name)")
def _(s, d):
    path = f"{staging.new_folder(s)}/decisions.json"
    side.save_decisions(_vault(s, d).select("key", F.col("source").alias("ngram"), F.lit("accepted").alias("status"), F.col("target").alias("note"), F.lit("").alias("updated")), path)
    return side.decisions(s, path)


@query("vault_csv_exchange", "select max(p_name) source, max(p_type) target from part where lower(p_name) >= 'm' group by lower(p_name)")
def _(s, d):
    path = f"{staging.new_folder(s)}/vault.csv"
    staging.write_text(s, path, side.vault_csv(_vault(s, d)))
    return side.import_vault(s, path)


@query("vault_json_import", "select max(p_name) source, max(p_type) target from part where lower(p_name) >= 'm' group by lower(p_name)")
def _(s, d):
    path = f"{staging.new_folder(s)}/vault.json"
    side.save_vault(_vault(s, d), path)
    return side.import_vault(s, path)


@query("align_by_table", f"with {PARTS} select seg_ord, 1 s, 0 t from parts where seg_ord % 2 = 0")
def _(s, d):
    rows = parts(s, d)
    known = rows.where("seg_ord % 2 = 0").select(T.tokens(F.col("source")).alias("src"), T.tokens(F.col("target")).alias("tgt"), F.expr("array(named_struct('s', 1, 't', 0))").alias("links"), "seg_ord")
    unique = rows.withColumn("source", F.concat("source", F.lit(" "), F.col("seg_ord").cast("string")))
    known = known.withColumn("src", F.concat("src", F.array(F.col("seg_ord").cast("string"))))
    return C.align(unique, "table", known).select("seg_ord", F.explode("links").alias("l")).select("seg_ord", "l.s", "l.t")


@query("verdicts_parsed", "select p_partkey, case p_partkey % 5 when 0 then 'inconsistent' when 1 then 'acceptable' when 2 then null when 3 then 'unknown' else 'inconsistent' end verdict, case when p_partkey % 5 in (0, 1, 4) then p_type end preferred, case when p_partkey % 5 = 3 then 'I think: ' || p_name end raw from part")
def _(s, d):
    """Bare, fenced in three ways, without a verdict, and no JSON."""
    preferred, n = _text('"preferred":"', F.col("p_type"), '"}'), F.col("p_partkey") % 5
    reply = (
        F.when(n == 0, _text('```json\n{"verdict":"inconsistent",', preferred, "\n```")).when(n == 1, _text(' {"verdict":"acceptable",', preferred)).when(n == 2, '```\n{"reason":"none"}\n```')
        .when(n == 3, _text("I think: ", F.col("p_name"))).otherwise(_text('```JSON\n{"verdict":"inconsistent",', preferred, "```"))
    )
    return table(s, d, "part").select("p_partkey", R.parse_verdict(reply).alias("v")).select("p_partkey", "v.verdict", "v.preferred", "v.raw")


@query("judge_without_answer", f"with {PARTS}, k as (select lower(source) as key from parts group by 1 having count(distinct target) >= 2) select row_number() over (order by key) - 1 place, key, true failed from k")
def _(s, d):
    """No server answers: each item has an error, in its place."""
    found = C.flags(C.occurrences(parts(s, d), C.Config(nmax=2, cluster_spans=False, merge_contained=False)), C.Config(nmax=2, cluster_spans=False, merge_contained=False))
    items = R.payload(found).orderBy("key").coalesce(1)
    rows = judge.judge_all(items, judge.Judge("http://127.0.0.1:9", "none", timeout=1))
    return rows.select("place", "key", F.col("error").isNotNull().alias("failed"))


@query("word_counts", f"with {PARTS} select sid, len(string_split(source, ' '))::int source_words, len(string_split(target, ' '))::int target_words from parts")
def _(s, d):
    return report.words(parts(s, d))
