"""The queries of the library over the driver's tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import analysis
from termweave.operators import consistency as C
from termweave.operators import review as R


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as segments: the name is the source, type and brand the target."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("seg_ord"), F.concat(F.lit("part#"), F.col("p_partkey").cast("string")).alias("sid"), F.concat(F.lit("size"), F.col("p_size").cast("string")).alias("file"), F.col("p_name").alias("source"), F.concat("p_type", F.lit(" "), "p_brand").alias("target"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns and the assistant's answers as segments."""
    t = table(spark, d, "conversations")
    a, b = t.where("role = 'user'"), t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    both = a.join(b, ["conv_id", "turn"])
    return both.select((F.col("conv_id") * 1000 + F.col("turn")).alias("seg_ord"), F.concat(F.lit("conv#"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("sid"), F.lit("conv").alias("file"), F.col("text").alias("source"), "target")


PARTS = "parts as (select p_partkey::bigint seg_ord, 'part#' || p_partkey sid, 'size' || p_size file, p_name source, p_type || ' ' || p_brand target from part)"
PAIRS = "pairs as (select a.conv_id * 1000 + a.turn seg_ord, a.text source, b.text target from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant')"
STRIP = r"regexp_replace(x, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g')"
WORDS = "', '".join(C.STOPWORDS)
#: Key and span of the parts' bigrams: source and target have two words each, which align one to one.
VARIANTS = f"{PARTS}, v as (select lower(source) as key, target span, count(*) n, min(seg_ord) first_seg from parts group by all)"
SCORE = "case when count(*) < 2 then 0.0 else -sum(n / t * log2(n / t)) / log2(count(*)) end"
FLAGS = f"{VARIANTS}, w as (select *, sum(n) over (partition by key) t from v), f as (select key, count(*) n_variants, sum(n)::bigint total, {SCORE} score, max_by(span, [n, -first_seg]) best from w group by key)"
Q: dict = {}
O: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return put


RAW = C.Config(nmax=2, cluster_spans=False, merge_contained=False, strip_clitics=False)


def _flag_rows(f: DataFrame) -> DataFrame:
    return f.select("key", F.col("distinct").cast("long").alias("n_variants"), "total", F.round("score", 6).alias("score"))


@query("tokenize_counts", r"select doc_id, len(regexp_extract_all(text, '[^\s\x0b]+'))::bigint n_tokens from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", T.word_count(F.col("text")).cast("long").alias("n_tokens"))


@query("whitespace_collapse", r"select doc_id, length(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')))::bigint n from documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.length(T.collapse(F.col("text"))).cast("long").alias("n"))


@query("normalize_key", r"select p_partkey, trim(regexp_replace(lower(p_name), '\s+', ' ', 'g')) as key from part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", T.normalize_key(F.col("p_name")).alias("key"))


@query("edge_punct_strip", rf"with t as (select unnest(regexp_extract_all(text, '[^\s\x0b]+')) x from conversations), u as (select {STRIP} w from t) select w, count(*) n from u where w <> '' group by w")
def _(s, d):
    return table(s, d, "conversations").select(F.explode(T.tokens(F.col("text"))).alias("t")).select(T.strip_token(F.col("t")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))


@query("span_strip", rf"select conv_id, turn, array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^\s\x0b]+'), lambda x: {STRIP}), lambda x: x <> ''), ' ') span from conversations")
def _(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", T.strip_span(F.col("text")).alias("span"))


def _gram_sql(cond: str) -> str:
    return rf"""with {PAIRS}, t as (select seg_ord, list_transform(regexp_extract_all(source, '[^\s\x0b]+'), lambda x: {STRIP}) toks from pairs),
        w as (select seg_ord, list_slice(toks, i + 1, i + n) ws from t, unnest([2, 3]) a(n), unnest(range(0, greatest(len(toks) - n + 1, 0))) b(i))
        select array_to_string(list_transform(ws, lambda x: lower(x)), ' ') as key, count(distinct seg_ord) n from w where not list_contains(ws, '') and {cond} group by 1"""


def _grams(mode: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        return C.explode_ngrams(C.align(pairs(s, d)), C.Config(stop_mode=mode)).groupBy("key").agg(F.count("*").alias("n"))

    return run


query("ngrams_off", _gram_sql("true"))(_grams("off"))
query("ngrams_trim", _gram_sql(f"lower(ws[1]) not in ('{WORDS}') and lower(ws[-1]) not in ('{WORDS}')"))(_grams("trim"))
query("ngrams_strict", _gram_sql(f"not list_has_any(list_transform(ws, lambda x: lower(x)), ['{WORDS}'])"))(_grams("strict"))
LINKS = r"l as (select seg_ord, i s, least(i * m // n, m - 1) t from (select seg_ord, len(regexp_extract_all(source, '[^\s\x0b]+')) n, len(regexp_extract_all(target, '[^\s\x0b]+')) m from pairs), unnest(range(0, n)) a(i) where m > 0)"


@query("align_heuristic", f"with {PAIRS}, {LINKS} select seg_ord, s::int s, t::int t from l")
def _(s, d):
    return C.align(pairs(s, d)).select("seg_ord", F.explode("links").alias("l")).select("seg_ord", "l.s", "l.t")


def _ensemble(how: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        diagonal = F.expr("transform(filter(links, x -> x.s < size(tgt)), x -> named_struct('s', x.s, 't', x.s))")
        return C.align(pairs(s, d)).select("seg_ord", F.explode(C.merge_links([F.col("links"), diagonal], how)).alias("l")).select("seg_ord", "l.s", "l.t")

    return run


DIAGONAL = f"with {PAIRS}, {LINKS}, g as (select seg_ord, s, s t from l where s < (select len(regexp_extract_all(target, '[^\\s\\x0b]+')) from pairs p where p.seg_ord = l.seg_ord))"
query("align_union", f"{DIAGONAL} select seg_ord, s::int s, t::int t from (select * from l union select * from g)")(_ensemble("union"))
query("align_intersect", f"{DIAGONAL} select seg_ord, s::int s, t::int t from (select * from l intersect select * from g)")(_ensemble("intersect"))


@query("alignment_eval", f"{DIAGONAL}, x as (select (select count(*) from l) a, (select count(*) from g) g, (select count(*) from (select * from l intersect select * from g)) b) select round(b / a, 6) as precision, round(b / g, 6) as recall, round(1 - 2 * b / (a + g), 6) as aer from x")
def _(s, d):
    diagonal = F.expr("transform(filter(links, x -> x.s < size(tgt)), x -> named_struct('s', x.s, 't', x.s))")
    return C.alignment_quality(C.align(pairs(s, d)).withColumn("sure", diagonal).withColumn("poss", diagonal)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "aer")))


@query("distinct_pairs", f"with {PARTS} select count(*) n from (select distinct source, target from parts)")
def _(s, d):
    return C.distinct_pairs(parts(s, d)).agg(F.count("*").alias("n"))


@query("alignment_cache_miss", f"with {PARTS} select count(*) n from (select source, target from parts except select source, target from parts where file = 'size1')")
def _(s, d):
    rows = parts(s, d)
    return C.distinct_pairs(rows, C.distinct_pairs(rows.where("file = 'size1'"))).agg(F.count("*").alias("n"))  # one file is in the cache


ISLANDS = rf"""with {PAIRS}, tk as (select seg_ord, regexp_extract_all(source, '[^\s\x0b]+') st, regexp_extract_all(target, '[^\s\x0b]+') tt from pairs),
    g as (select seg_ord, i start from tk, unnest(range(0, greatest(len(st) - 1, 0))) a(i) where regexp_replace(st[i + 1], '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') <> '' and regexp_replace(st[i + 2], '^[^\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+$', '', 'g') <> ''),
    {LINKS}, p as (select distinct g.seg_ord, start, t from g join l on l.seg_ord = g.seg_ord and l.s between start and start + 1),
    q as (select *, case when t - lag(t) over (partition by seg_ord, start order by t) <= 2 then 0 else 1 end nw from p),
    r as (select *, sum(nw) over (partition by seg_ord, start order by t) run from q),
    u as (select seg_ord, start, run, count(*) n, min(t) lo, max(t) hi from r group by all),
    z as (select *, row_number() over (partition by seg_ord, start order by n desc, hi - lo, lo) k from u)"""


@query("span_islands", f"{ISLANDS} select lo::int lo, hi::int hi, count(*) n from z where k = 1 group by 1, 2")
def _(s, d):
    cfg = C.Config(nmax=2, stop_mode="off")
    a = C.once(C.align(pairs(s, d)), "words", F.transform("src", T.strip_token)).withColumn("g", F.explode(C.ngrams(F.col("words"), cfg)))
    return C.spans(a.select("seg_ord", "src", "tgt", "links", "g.*"), cfg).where("lo is not null").groupBy("lo", "hi").agg(F.count("*").alias("n"))


@query("aligned_spans", f"with {PARTS} select seg_ord, lower(source) as key, target span from parts")
def _(s, d):
    return C.occurrences(parts(s, d), RAW).select("seg_ord", "key", "span")


@query("variants_raw", f"with {VARIANTS} select key, span, n, first_seg from v")
def _(s, d):
    return C.variants(C.occurrences(parts(s, d), RAW)).select("key", "span", F.col("count").alias("n"), "first_seg")


@query("entropy_score", f"with {FLAGS} select key, round(score, 6) score from f where total >= 2")
def _(s, d):
    return C.flags(C.occurrences(parts(s, d), RAW), C.Config(**{**RAW.__dict__, "include_consistent": True})).select("key", F.round("score", 6).alias("score"))


@query("flags_forward", f"with {FLAGS} select key, n_variants, total, round(score, 6) score from f where n_variants >= 2 and total >= 2")
def _(s, d):
    return _flag_rows(C.flags(C.occurrences(parts(s, d), RAW), RAW))


@query("flags_include_consistent", f"with {FLAGS} select key, n_variants, total, round(score, 6) score from f where total >= 2")
def _(s, d):
    cfg = C.Config(**{**RAW.__dict__, "include_consistent": True})
    return _flag_rows(C.flags(C.occurrences(parts(s, d), cfg), cfg))


@query("flags_min_variant", f"with {VARIANTS}, k as (select key, max(n) most from v group by key), w as (select v.*, sum(n) over (partition by key) t from v join k using (key) where n >= 2 or most < 2), f as (select key, count(*) n_variants, sum(n)::bigint total, {SCORE} score from w group by key) select key, n_variants, total, round(score, 6) score from f where n_variants >= 2 and total >= 2")
def _(s, d):
    cfg = C.Config(**{**RAW.__dict__, "min_variant_count": 2})
    return _flag_rows(C.flags(C.occurrences(parts(s, d), cfg), cfg))


@query("reverse_flags", f"with {PARTS}, v as (select target span, lower(source) as key, count(*) n from parts group by all), w as (select *, sum(n) over (partition by span) t from v), f as (select span, count(*) n_terms, sum(n)::bigint total, {SCORE} score from w group by span) select span, n_terms, total, round(score, 6) score from f where n_terms >= 2 and total >= 2")
def _(s, d):
    return C.reverse_flags(C.occurrences(parts(s, d), RAW)).select("span", F.col("distinct").cast("long").alias("n_terms"), "total", F.round("score", 6).alias("score"))


@query("approve_dominant", f"with {FLAGS} select key as source, best as target from f where n_variants >= 2 and total >= 2")
def _(s, d):
    return R.approve_dominant(C.flags(C.occurrences(parts(s, d), RAW), RAW)).select(F.lower("source").alias("source"), "target")


VAULT = "vault as (select lower(p_name) as key, min(p_type || ' ' || p_brand) target from part where p_size <= 10 group by 1)"


def _vault(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where("p_size <= 10").groupBy(T.normalize_key(F.col("p_name")).alias("key")).agg(F.min(F.concat("p_type", F.lit(" "), "p_brand")).alias("target"))


@query("vault_violations", f"with {VARIANTS}, {VAULT} select v.key, max(target) approved from v join vault using (key) group by v.key having bool_or(span <> target)")
def _(s, d):
    return C.flags(C.occurrences(parts(s, d), RAW), RAW, _vault(s, d)).where("violation").select("key", "approved")


STORE = "st as (select lower(p_name) as key, max(p_name) source, max_by(p_type, p_partkey) target, 'd' || max(p_size) updated, lower(max(p_name)) < 'm' deleted from part group by 1)"


def _store(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").groupBy(F.lower("p_name").alias("key")).agg(F.max("p_name").alias("source"), F.max_by("p_type", "p_partkey").alias("target"), F.concat(F.lit("d"), F.max("p_size").cast("string")).alias("updated"), (F.lower(F.max("p_name")) < "m").alias("deleted"))


@query("vault_upsert", f"with {STORE}, nw as (select lower(p_name) as key, max_by(p_name, p_partkey) source, max_by(p_brand, p_partkey) target from part where p_size > 40 group by 1) select key, source, target, deleted from st where key not in (select key from nw) union all select key, source, target, false from nw")
def _(s, d):
    new = table(s, d, "part").where("p_size > 40").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target"), F.lit("now").alias("updated"), F.col("p_partkey").alias("ord"))
    return R.vault_upsert(_store(s, d), new).select("key", "source", "target", "deleted")


@query("vault_soft_delete", f"with {STORE} select key, deleted or key like '%a%' deleted from st")
def _(s, d):
    v = _store(s, d)
    return R.vault_remove(v, v.where("key like '%a%'").select("key")).select("key", "deleted")


@query("vault_restore", f"with {STORE} select key, source from st")
def _(s, d):
    return R.vault_list(R.vault_remove(_store(s, d), restore=True)).select("key", "source")


@query("vault_search_sort", f"with {STORE} select key, target from st where not deleted and (contains(lower(source), 'o') or contains(lower(target), 'o'))")
def _(s, d):
    return R.vault_search(_store(s, d), "O", sort="date-new").select("key", "target")


DECIDED = "dc as (select distinct lower(p_name) as key from part where p_size = 1)"


def _decided(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").where("p_size = 1").select(T.normalize_key(F.col("p_name")).alias("key")).distinct()


@query("decisions_suppress", f"with {FLAGS}, {DECIDED} select key, n_variants, total, round(score, 6) score from f where n_variants >= 2 and total >= 2 and key not in (select key from dc)")
def _(s, d):
    return _flag_rows(R.suppress(C.flags(C.occurrences(parts(s, d), RAW), RAW), _decided(s, d)))


@query("decisions_mark", f"with {FLAGS}, {DECIDED} select key, key in (select key from dc) decided from f where n_variants >= 2 and total >= 2")
def _(s, d):
    return R.suppress(C.flags(C.occurrences(parts(s, d), RAW), RAW), _decided(s, d), True).select("key", "decided")


@query("glossary_adherence", f"with {PARTS}, g as (select lower(p_name) term, min(p_brand) want from part where p_size <= 5 group by 1) select sid, term, want from parts join g on contains(' ' || lower(source) || ' ', ' ' || term || ' ') where not contains(target, want)")
def _(s, d):
    g = table(s, d, "part").where("p_size <= 5").groupBy(F.lower("p_name").alias("source")).agg(F.min("p_brand").alias("target"))
    return R.glossary_violations(parts(s, d), g, strip_clitics=False).select("sid", F.col("source_term").alias("term"), F.col("approved").alias("want"))


MARKED = f"{PARTS}, mk as (select seg_ord, sid, case seg_ord % 3 when 0 then '%s {{0}}' when 1 then '{{{{a}}}}' else '' end sp, case seg_ord % 4 when 0 then '{{0}} %s' when 1 then '{{{{a}}}}' else '' end tp from parts)"


@query("placeholder_issues", f"with {MARKED}, e as (select sid, list_sort(string_split(sp, ' ')) a, list_sort(string_split(tp, ' ')) b from mk) select sid from e where a <> b")
def _(s, d):
    lit = lambda c, n, a, b: F.concat(F.col(c), F.when(F.col("seg_ord") % n == 0, a).when(F.col("seg_ord") % n == 1, b).otherwise(""))
    rows = parts(s, d).withColumn("source", lit("source", 3, " %s {0}", " {{a}}")).withColumn("target", lit("target", 4, " {0} %s", " {{a}}"))
    return R.placeholder_issues(rows).select("sid")


EDITS = f"{PARTS}, ed as (select sid, case when seg_ord % 10 = 0 then target else 'X ' || target end as text from parts where seg_ord % 5 = 0)"


def _edits(s: SparkSession, d: str) -> DataFrame:
    rows = parts(s, d)
    new = rows.where("seg_ord % 5 = 0").select("sid", F.when(F.col("seg_ord") % 10 == 0, F.col("target")).otherwise(F.concat(F.lit("X "), "target")).alias("text"))
    return R.set_edits(s.createDataFrame([], "sid string, text string"), new, rows)


@query("edits_overlay", f"with {EDITS} select p.sid, coalesce(case when e.text <> p.target then e.text end, p.target) target, p.target original from parts p left join ed e using (sid)")
def _(s, d):
    return R.overlay(parts(s, d), _edits(s, d)).select("sid", "target", "original")


@query("edit_summary", f"with {EDITS} select count(*) edits, count(distinct file) files from ed join parts p using (sid) where ed.text <> p.target")
def _(s, d):
    return R.edit_count(_edits(s, d), parts(s, d))


@query("splice_correction", f"with {PARTS} select sid, string_split(target, ' ')[1] || ' FIX' as text from parts")
def _(s, d):
    return parts(s, d).select("sid", T.splice(F.col("target"), F.lit(1), F.lit(1), F.lit("FIX")).alias("text"))


@query("batch_slice", f"with {PARTS}, n as (select *, row_number() over (order by seg_ord) - 1 i from parts) select sid from n where i >= 100 and i < 200")
def _(s, d):
    return R.batch(R.numbered(parts(s, d).withColumnRenamed("seg_ord", "old"), ["old"]), 2, 100).select("sid")


@query("file_summary", f"with {PARTS} select file, count(*) segments from parts group by file")
def _(s, d):
    rows = parts(s, d)
    return R.file_summary(rows.select("file").distinct(), rows)


@query("run_summary", f"with {FLAGS}, r as (select target from parts group by target having count(distinct lower(source)) >= 2) select (select count(*) from parts) segments, (select count(distinct file) from parts) files, (select count(*) from f where n_variants >= 2 and total >= 2) flags, (select count(*) from r) reverse_flags")
def _(s, d):
    return analysis.analyze_all(parts(s, d), RAW).summary.select("segments", "files", "flags", "reverse_flags")


@query("search_flags", f"with {FLAGS}, h as (select distinct key from v where contains(lower(span), '11') or contains(key, '11')) select key from f where n_variants >= 2 and total >= 2 and key in (select key from h)")
def _(s, d):
    return R.search_flags(C.flags(C.occurrences(parts(s, d), RAW), RAW), "11", inconsistent=True).select("key")


#: Verifier groups: the spans of a term are ten vectors that follow each other.
SPANS_OF_TERM = 10


@query("embedding_min_cosine", f"with g as (select vec_id // {SPANS_OF_TERM} term, vec_id, embedding::double[] v from embeddings) select a.term, round(min(list_dot_product(a.v, b.v)), 4) agreement from g a join g b on a.term = b.term and a.vec_id < b.vec_id group by a.term")
def _(s, d):
    rows = table(s, d, "embeddings").withColumn("term", F.floor(F.col("vec_id") / SPANS_OF_TERM))
    vs = rows.groupBy("term").agg(F.transform(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"]).alias("vs"))
    return vs.where(F.size("vs") > 1).select("term", F.round(R.least_dot(F.col("vs")), 4).alias("agreement"))


@query("char_classes", "select ch, case when cp between 65 and 90 or cp between 97 and 122 then 'Latin letter' when cp between 48 and 57 then 'ASCII digit' else '' end cls, count(*) n from (select ch, ascii(ch) cp from (select unnest(string_split(p_name, '')) ch from part)) where ch <> '' group by 1, 2")
def _(s, d):
    ch = table(s, d, "part").select(F.explode(F.split("p_name", "")).alias("ch")).where("ch <> ''")
    return ch.groupBy("ch").agg(F.count("*").alias("n")).select("ch", T.char_class(F.col("ch")).alias("cls"), "n")


@query("edit_distance_pairs", f"with {VARIANTS} select a.key, a.span a, b.span b, levenshtein(a.span, b.span)::int distance, round(levenshtein(a.span, b.span) / greatest(length(a.span), length(b.span)), 6) ratio from v a join v b on a.key = b.key and a.span < b.span")
def _(s, d):
    """Distances of the variants of each n-gram."""
    v = C.variants(C.occurrences(parts(s, d), RAW)).select("key", "span")
    j = v.withColumnRenamed("span", "a").join(v.withColumnRenamed("span", "b"), "key").where("a < b")
    return j.select("key", "a", "b", F.levenshtein("a", "b").alias("distance"), F.round(T.norm_edit_distance(F.col("a"), F.col("b")), 6).alias("ratio"))


@query("arabic_normalize", "select p_partkey, trim(translate(lower(p_name), 'aeioulwt', 'اااهىوx')) normal from part")
def _(s, d):
    """Names whose vowels are written with letters that are folded, and t with a tatweel."""
    return table(s, d, "part").select("p_partkey", T.normalize_ar(F.translate(F.lower("p_name"), "aeioulwt", "أإآةئؤxـ")).alias("normal"))


#: 26 letters that begin no prefix.
LETTERS = "تجحخدذرزسشصضطظعغقمنهيثپچژگ"


@query("light_stem", f"select p_partkey, translate(lower(p_name), 'abcdefghijklmnopqrstuvwxyz', '{LETTERS}') stem from part")
def _(s, d):
    """Names in Arabic letters, each word behind one of the prefixes, or none."""
    n = F.col("p_partkey") % 4
    prefix = F.when(n == 0, "ال").when(n == 1, "وبال").when(n == 2, "لل").otherwise("")
    words = F.transform(F.split(F.translate(F.lower("p_name"), "abcdefghijklmnopqrstuvwxyz", LETTERS), " "), lambda w: F.concat(prefix, w))
    return table(s, d, "part").select("p_partkey", T.light_stem_ar(F.array_join(words, " ")).alias("stem"))
