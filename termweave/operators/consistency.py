"""From segments to flags: n-grams, alignment, spans, grouping, clustering, scoring. Data frames in, data frames out.

segments: seg_ord (bigint, the corpus order), sid, file, source, target. Occurrences stay narrow; variants are
summed to (key, span) before any array is collected, so a frequent n-gram is as many rows as it has spans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T

#: Default English function words. Fixed values.
STOPWORDS = tuple(
    (
        "a an the this that these those of to in on at by for with from into "
        "and or but if then else as is are was were be been being am do does did has have had "
        "will would shall should can could may might must it its he she they them his her "
        "their your our my me you we i us not no nor so than too very just also each every any "
        "all some such only own same up out off over under again further about against between"
    ).split()
)
VARIANT = "struct<count:bigint,first_seg:bigint,span:string,raw:string,spans:array<string>>"
LINKS = "array<struct<s:int,t:int>>"


@dataclass(frozen=True)
class Config:
    nmin: int = 2
    nmax: int = 3
    stop_mode: str = "trim"  # off, strict or trim
    min_occurrences: int = 2
    fold_taa: bool = True
    strip_clitics: bool = True
    strip_diacritics: bool = True
    cluster_spans: bool = True
    cluster_max_dist: float = 0.2
    cluster_unit: str = "characters"  # what edits are counted in; bytes: of UTF-8, as DuckDB's levenshtein, still over lengths in characters
    merge_contained: bool = True
    min_variant_count: int = 1
    include_consistent: bool = False
    stopwords: tuple[str, ...] = field(default=())  # empty: the default ones

    def __post_init__(self):
        if self.stop_mode not in ("off", "strict", "trim") or not 1 <= self.nmin <= self.nmax:
            raise ValueError("bad stop mode or n-gram lengths")
        if self.cluster_unit not in ("characters", "bytes"):
            raise ValueError("bad unit of edits")


def heuristic_links(s: Column, t: Column) -> Column:
    """Source word i to target word floor(i T / S)."""
    n, m = F.size(s), F.size(t)
    link = lambda i: F.struct(i.alias("s"), F.least(F.floor(i * m / n).cast("int"), m - 1).alias("t"))
    return F.when((n > 0) & (m > 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), link)).otherwise(F.array().cast("array<struct<s:int,t:int>>"))


def merge_links(all_links: list[Column], how: str = "intersect") -> Column:
    """Ensemble of link arrays: intersection or union, sorted."""
    if not all_links or how not in ("intersect", "union"):
        raise ValueError("one set of links at least; intersect or union")
    out = all_links[0]
    for x in all_links[1:]:
        out = F.array_intersect(out, x) if how == "intersect" else F.array_union(out, x)
    return F.array_sort(F.array_distinct(out))


def align(segments: DataFrame, backend="heuristic", table: DataFrame | None = None) -> DataFrame:
    """Adds src, tgt (tokens) and links. backend: "heuristic", worked out row by row; "table": links from rows (src,
    tgt, links) by equal tokens, none where they're missing; or an aligner, which gets each distinct pair once."""
    out = once(once(segments, "src", T.tokens(F.col("source"))), "tgt", T.tokens(F.col("target")))
    if backend == "heuristic":
        return once(out, "links", heuristic_links(F.col("src"), F.col("tgt")))
    if backend == "table" and table is not None:
        out = out.join(table.select("src", "tgt", "links").dropDuplicates(["src", "tgt"]), ["src", "tgt"], "left")
    elif hasattr(backend, "links"):
        out = out.join(backend.links(distinct_pairs(segments)), ["src", "tgt"], "left")
    else:
        raise ValueError(f"no backend {backend}")
    return out.withColumn("links", F.coalesce("links", F.array().cast(LINKS)))


def distinct_pairs(segments: DataFrame, cached: DataFrame | None = None) -> DataFrame:
    """Token pairs to align: each once, without those in the cache (src, tgt)."""
    pairs = segments.select(T.tokens(F.col("source")).alias("src"), T.tokens(F.col("target")).alias("tgt")).distinct()
    return pairs.join(cached, ["src", "tgt"], "left_anti") if cached is not None else pairs


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once a row: what uses it in lambdas would else hold its whole expression."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def ngrams(words: Column, cfg: Config) -> Column:
    """Array of (key, ng_ord, ngram, start, len) of stripped words, sorted by key, then order (length, start)."""
    stop = F.array(*[F.lit(w) for w in (cfg.stopwords or STOPWORDS)])
    n = F.size(words)

    def of_length(length: int) -> Column:
        at = lambda i: F.struct(F.slice(words, i + 1, F.lit(length)).alias("w"), i.cast("int").alias("start"), F.lit(length).alias("len"))
        return F.when(n >= length, F.transform(F.sequence(F.lit(0), F.greatest(n - length, F.lit(0))), at)).otherwise(F.array().cast("array<struct<w:array<string>,start:int,len:int>>"))

    grams = F.filter(F.concat(*[of_length(k) for k in range(cfg.nmin, cfg.nmax + 1)]), lambda g: ~F.array_contains(g["w"], ""))
    if cfg.stop_mode == "strict":
        grams = F.filter(grams, lambda g: ~F.arrays_overlap(F.transform(g["w"], F.lower), stop))
    elif cfg.stop_mode == "trim":
        grams = F.filter(grams, lambda g: ~F.array_contains(stop, F.lower(g["w"][0])) & ~F.array_contains(stop, F.lower(F.element_at(g["w"], -1))))
    named = F.transform(grams, lambda g, i: F.struct(F.lower(F.array_join(g["w"], " ")).alias("key"), i.cast("int").alias("ng_ord"), F.array_join(g["w"], " ").alias("ngram"), g["start"].alias("start"), g["len"].alias("len")))
    return F.array_sort(named)


def explode_ngrams(aligned: DataFrame, cfg: Config) -> DataFrame:
    """One row for each segment and key: its first n-gram, by length, then start."""
    rows = once(once(aligned, "words", F.transform("src", T.strip_token)), "grams", ngrams(F.col("words"), cfg))
    first = F.expr("filter(grams, (g, i) -> i = 0 or grams[greatest(i - 1, 0)].key <> g.key)")
    rows = rows.select(*aligned.columns, F.explode(first).alias("g"))
    return rows.select(*aligned.columns, "g.ng_ord", "g.ngram", "g.key", "g.start", "g.len")


def best_run(at: Column) -> Column:
    """The run (lo, hi) of sorted indices with gaps up to 2 that has the most, then is narrowest, then first."""
    kind = "array<struct<lo:int,hi:int,n:int>>"
    add = lambda acc, x: F.when(
        (F.size(acc) > 0) & (x - F.get(acc, F.size(acc) - 1)["hi"] <= 2),
        F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.get(acc, F.size(acc) - 1)["lo"].alias("lo"), x.alias("hi"), (F.get(acc, F.size(acc) - 1)["n"] + 1).alias("n")))),
    ).otherwise(F.concat(acc, F.array(F.struct(x.alias("lo"), x.alias("hi"), F.lit(1).alias("n")))))
    runs = F.aggregate(at, F.array().cast(kind), lambda acc, x: add(acc, x).cast(kind))
    return F.array_min(F.transform(runs, lambda r: F.struct((-r["n"]).alias("n"), (r["hi"] - r["lo"]).alias("w"), r["lo"].alias("lo"), r["hi"].alias("hi"))))


def spans(grams: DataFrame, cfg: Config) -> DataFrame:
    """Adds lo, hi, raw and span: what of the target translates the n-gram ('' and nulls where nothing does)."""
    linked = F.array_sort(F.array_distinct(F.transform(F.filter("links", lambda x: (x["s"] >= F.col("start")) & (x["s"] < F.col("start") + F.col("len"))), lambda x: x["t"])))
    out = once(once(grams, "at", linked), "run", best_run(F.col("at"))).withColumns({"lo": F.col("run.lo"), "hi": F.col("run.hi")})
    raw = F.when(F.col("lo").isNull(), "").otherwise(T.strip_span(F.array_join(F.slice("tgt", F.coalesce("lo", F.lit(0)) + 1, F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)) + 1), " ")))
    out = once(out, "raw", raw).withColumn("span", T.normalize_span(F.col("raw"), cfg.fold_taa, cfg.strip_clitics, cfg.strip_diacritics))
    return out.drop("at", "run")


def occurrences(segments: DataFrame, cfg: Config = Config(), backend="heuristic", table: DataFrame | None = None) -> DataFrame:
    """seg_ord, sid, file, ng_ord, ngram, key, lo, hi, raw, span for each segment and key, unaligned ones included."""
    rows = spans(explode_ngrams(align(segments, backend, table).where("size(src) > 0 and size(tgt) > 0"), cfg), cfg)
    return rows.select("seg_ord", "sid", "file", "ng_ord", "ngram", "key", "lo", "hi", "raw", "span")


def variants(occ: DataFrame) -> DataFrame:
    """key, span, count, first_seg, raw (of the first) before clustering."""
    return occ.where("span <> ''").groupBy("key", "span").agg(F.count("*").alias("count"), F.min("seg_ord").alias("first_seg"), F.min_by("raw", "seg_ord").alias("raw"))


def greedy(items: str, meets: str) -> str:
    """SQL, of a column of structs in their order: first, the indices of those that stand by themselves, and joined (to, i),
    the others with the place in first of the first one that `meets`, of r and v, holds for. Only that one is looked for
    in every item; a row's groups are put together afterwards."""
    at = f"array_position(transform(acc.kept, r -> {meets}), true)"
    step = lambda kept, first, joined: f"named_struct('kept', {kept}, 'first', {first}, 'joined', {joined}, 'n', acc.n + 1)"
    alone = step("concat(acc.kept, array(v))", "concat(acc.first, array(acc.n))", "acc.joined")
    joins = step("acc.kept", "acc.first", "concat(acc.joined, array(named_struct('to', cast(p - 1 as int), 'i', acc.n)))")
    none = f"named_struct('kept', filter({items}, x -> false), 'first', cast(array() as array<int>), 'joined', cast(array() as array<struct<to:int,i:int>>), 'n', 0)"
    return f"aggregate({items}, {none}, (acc, v) -> get(transform(array({at}), p -> if(p = 0, {alone}, {joins})), 0), acc -> named_struct('first', acc.first, 'joined', acc.joined))"


def gathered(vs: str, groups: str) -> str:
    """SQL: the variants that stand by themselves, each with the counts and spans of those that joined it."""
    own = f"filter({groups}.joined, j -> j.to = k)"
    whole = f"""transform(array({own}), js -> cast(named_struct('count', get({vs}, f).count + aggregate(js, 0L, (a, j) -> a + get({vs}, j.i).count), 'first_seg', get({vs}, f).first_seg, 'span', get({vs}, f).span,
        'raw', get({vs}, f).raw, 'spans', concat(get({vs}, f).spans, flatten(transform(js, j -> get({vs}, j.i).spans)))) as {VARIANT}))"""
    return f"if(size({groups}.joined) = 0, {vs}, transform({groups}.first, (f, k) -> get({whole}, 0)))"


def grouped(rows: DataFrame, items: str, meets: str) -> DataFrame:
    """Rows whose variants are grouped greedily, in their order; each step is worked out once a row."""
    rows = once(once(rows, "__items", F.expr(items)), "__groups", F.expr(greedy("__items", meets)))
    return once(rows.withColumnRenamed("variants", "__all"), "variants", F.expr(gathered("__all", "__groups"))).drop("__items", "__groups", "__all")


def clustered(rows: DataFrame, most: float, unit: str = "characters") -> DataFrame:
    """Each variant joins the first representative near enough, in the order of variants."""
    text = "v.span" if unit == "characters" else "decode(cast(v.span as binary), 'ISO-8859-1')"  # a character for each byte
    # b: distances beyond it are given up early; no shorter text than l is near enough
    bound = f"cast(floor({most}D * length(v.span) + 1e-9D) as int)"
    items = f"transform(variants, v -> named_struct('d', {text}, 'n', length(v.span), 'b', {bound}, 'l', length(v.span) - {bound}))"
    distance = "levenshtein(r.d, v.d, greatest(r.b, v.b))"
    return grouped(rows, items, f"(r.n >= v.l and v.n >= r.l and {distance} >= 0 and coalesce({distance} / nullif(greatest(r.n, v.n), 0), 0D) <= {most}D)")


def merged(rows: DataFrame) -> DataFrame:
    """Variants whose words are a run of a longer kept one's are counted there; longest first."""
    by_length = "transform(array_sort(transform(__own, (x, i) -> named_struct('n', -size(split(x.span, ' ')), 'i', i, 'x', x)), (a, b) -> case when a.n < b.n or a.n = b.n and a.i < b.i then -1 else 1 end), y -> y.x)"
    rows = once(rows.withColumnRenamed("variants", "__own"), "variants", F.expr(by_length)).drop("__own")
    items = "transform(variants, v -> named_struct('h', concat(' ', v.span, ' '), 'w', size(split(v.span, ' '))))"
    return grouped(rows, items, "(r.w > v.w and contains(r.h, v.h))")  # T.is_contained


def by_count(vs: str) -> str:
    return f"transform(array_sort(transform({vs}, (x, i) -> named_struct('n', -x.count, 'i', i, 'x', x)), (a, b) -> case when a.n < b.n or a.n = b.n and a.i < b.i then -1 else 1 end), y -> y.x)"


def flags(occ: DataFrame, cfg: Config = Config(), vault: DataFrame | None = None) -> DataFrame:
    """key, ngram, variants, distinct, total, score, violation, approved, first (seg_ord, ng_ord): n-grams that several
    spans translate. A variant's spans are all that it stands for. vault: key, target; an n-gram any of whose spans differs from the approved text is a violation."""
    return flags_of(counts(occ), cfg, vault)


def counts(occ: DataFrame) -> DataFrame:
    """key, span, count, first_seg, raw (of the first), head (seg_ord, ng_ord, ngram of the first): what flags need."""
    return occ.groupBy("key", "span").agg(F.count("*").alias("count"), F.min("seg_ord").alias("first_seg"), F.min_by("raw", "seg_ord").alias("raw"), F.min(F.struct("seg_ord", "ng_ord", "ngram")).alias("head"))


def summed(parts: DataFrame) -> DataFrame:
    """The counts() of a whole from those of its parts."""
    return parts.groupBy("key", "span").agg(F.sum("count").alias("count"), F.min("first_seg").alias("first_seg"), F.min_by("raw", "first_seg").alias("raw"), F.min("head").alias("head"))


def flags_of(each: DataFrame, cfg: Config = Config(), vault: DataFrame | None = None) -> DataFrame:
    """flags() from counts()."""
    spanned = F.col("span") != ""
    one = F.struct((-F.col("count")).alias("n"), "first_seg", "span", "raw")
    per_key = each.groupBy("key").agg(
        F.min("head")["ngram"].alias("ngram"), F.collect_list(F.when(spanned, one)).alias("found"), F.min(F.when(spanned, F.struct(F.col("head.seg_ord"), F.col("head.ng_ord")))).alias("first")
    ).where(f"size(found) >= {1 if cfg.include_consistent or vault is not None else 2}")  # one span is one variant, which only these can keep
    named = F.expr(f"transform(array_sort(found), v -> cast(named_struct('count', -v.n, 'first_seg', v.first_seg, 'span', v.span, 'raw', v.raw, 'spans', array(v.span)) as {VARIANT}))")
    per_key = once(per_key, "sorted", named).drop("found")
    if vault is not None:
        per_key = per_key.join(vault.select("key", F.col("target").alias("approved")), "key", "left")
    else:
        per_key = per_key.withColumn("approved", F.lit(None).cast("string"))
    out = per_key.withColumn("violation", F.expr("coalesce(exists(sorted, v -> v.span <> approved), false)")).withColumn("variants", F.col("sorted"))
    if cfg.cluster_spans:
        out = clustered(out, cfg.cluster_max_dist, cfg.cluster_unit)
    if cfg.merge_contained:
        out = merged(out)
    if cfg.min_variant_count > 1:
        out = out.withColumn("kept", F.expr(f"filter(variants, v -> v.count >= {cfg.min_variant_count})")).withColumn("variants", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("sorted"))).drop("kept")
    out = once(out.withColumnRenamed("variants", "__own"), "variants", F.expr(by_count("__own"))).drop("__own")
    out = out.withColumns({"distinct": F.size("variants"), "total": F.expr("aggregate(variants, 0L, (a, v) -> a + v.count)"), "score": T.entropy(F.transform("variants", lambda v: v["count"].cast("double")))})
    keep = (F.col("distinct") >= 2) | F.lit(cfg.include_consistent) | F.col("violation")
    return out.where(keep & ((F.col("total") >= cfg.min_occurrences) | F.col("violation"))).drop("sorted")


def ranked(found: DataFrame) -> DataFrame:
    """Flags in reading order: violations, inconsistent ones, score, total, distinct; ties by first appearance."""
    return found.orderBy(F.desc("violation"), F.desc(F.col("distinct") >= 2), F.desc(F.round("score", 12)), F.desc("total"), F.desc("distinct"), "first")


def reverse_flags(occ: DataFrame, min_occurrences: int = 2) -> DataFrame:
    """span, uses, distinct, total, score, first: spans that translate several n-grams."""
    each = occ.where("span <> ''").groupBy("span", "key").agg(F.count("*").alias("count"), F.min(F.struct("seg_ord", "ng_ord", "ngram")).alias("head"))
    one = F.struct((-F.col("count")).alias("n"), F.col("head.seg_ord").alias("seg"), F.col("head.ng_ord").alias("ng"), F.col("head.ngram").alias("term"))
    out = each.groupBy("span").agg(F.array_sort(F.collect_list(one)).alias("uses"), F.min(F.struct("head.seg_ord", "head.ng_ord")).alias("first"))
    out = out.withColumn("uses", F.expr("transform(uses, u -> named_struct('term', u.term, 'count', -u.n))"))
    out = out.withColumns({"distinct": F.size("uses"), "total": F.expr("aggregate(uses, 0L, (a, u) -> a + u.count)"), "score": T.entropy(F.transform("uses", lambda u: u["count"].cast("double")))})
    return out.where(f"distinct >= 2 and total >= {min_occurrences}")


def active(found: DataFrame) -> DataFrame:
    """Adds structural (several variants, not cleared) and active (nor decided) to flags with cleared and decided."""
    structural = (F.col("distinct") >= 2) & ~F.coalesce("cleared", F.lit(False))
    return found.withColumns({"structural": structural, "active": structural & ~F.coalesce("decided", F.lit(False))})


def alignment_quality(gold: DataFrame) -> DataFrame:
    """precision, recall, aer over rows of src, tgt, sure, poss and links, summed over all rows."""
    a = gold.agg(*[F.sum(c).alias(n) for n, c in (("a", F.size("links")), ("s", F.size("sure")), ("a_s", F.size(F.array_intersect("links", "sure"))), ("a_p", F.size(F.array_intersect("links", "poss"))))])
    part = lambda x, y, zero: F.when(F.expr(y) > 0, F.expr(x) / F.expr(y)).otherwise(F.lit(zero))
    return a.select(part("a_p", "a", 0.0).alias("precision"), part("a_s", "s", 0.0).alias("recall"), part("a + s - a_s - a_p", "a + s", 1.0).alias("aer"))
