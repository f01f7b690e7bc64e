"""What follows the flags: verifiers, decisions, vault, glossary, placeholders, edits. Data frames in and out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators.consistency import ranked
from termweave.staging import staged


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def payload(found: DataFrame, least: int = 2) -> DataFrame:
    """ngram and spans of flags with at least so many variants: what a verifier gets."""
    return found.where(F.col("distinct") >= least).select("key", "ngram", F.transform("variants", lambda v: v["span"]).alias("spans"))


def faithfulness(found: DataFrame, vectors: DataFrame, threshold: float = 0.6, include_consistent: bool = False) -> DataFrame:
    """Drops variants whose vector isn't near the n-gram's (text, vec; unit vectors), rounded to 3 places; they are
    listed in dropped. Flags with one variant stay as they are; flags left without variants go."""
    v = found.where("distinct >= 2").select("key", "ngram", F.posexplode("variants").alias("pos", "v"))
    v = v.join(vectors.select(F.col("text").alias("ngram"), F.col("vec").alias("a")), "ngram", "left").join(vectors.select(F.col("text").alias("span"), F.col("vec").alias("b")), F.col("v.span") == F.col("span"), "left")
    v = v.withColumn("sim", F.bround(F.coalesce(dot(F.col("a"), F.col("b")), F.lit(0.0)), 3))
    ok = F.col("sim") >= threshold
    sums = v.groupBy("key").agg(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "v")))).alias("good"), F.array_sort(F.collect_list(F.when(~ok, F.struct("pos", F.col("v.span").alias("span"), "sim")))).alias("bad"))
    out = found.join(sums, "key", "left")
    one = F.col("good").isNull()
    out = out.withColumn("variants", F.when(one, F.col("variants")).otherwise(F.transform("good", lambda x: x["v"])))
    out = out.withColumn("dropped", F.when(~one, F.transform("bad", lambda x: F.struct(x["span"].alias("span"), x["sim"].alias("sim")))))
    out = out.withColumns({"distinct": F.size("variants"), "total": F.expr("aggregate(variants, 0L, (a, v) -> a + v.count)"), "score": T.entropy(F.transform("variants", lambda v: v["count"].cast("double")))})
    return out.where(one | (F.col("distinct") >= 2) | ((F.col("distinct") == 1) & F.lit(include_consistent))).drop("good", "bad")


def embeddings(items: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """text, vec (of length 1) of all n-grams and spans of payload items, each text encoded once; encode: a frame of text
    -> text, vec."""
    texts = items.select(F.explode(F.concat(F.array("ngram"), "spans")).alias("text")).distinct()
    size = F.sqrt(dot(F.col("vec"), F.col("vec")))
    return encode(texts).select("text", F.transform("vec", lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0)).alias("vec"))


def term_similarity(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """key, span and its similarity to the n-gram, for each span of payload items."""
    rows = items.select("key", "ngram", F.explode("spans").alias("span"))
    rows = rows.join(vectors.select(F.col("text").alias("ngram"), F.col("vec").alias("a")), "ngram", "left").join(vectors.select(F.col("text").alias("span"), F.col("vec").alias("b")), "span", "left")
    return rows.select("key", "span", F.coalesce(dot(F.col("a"), F.col("b")), F.lit(0.0)).alias("sim"))


def min_cosine(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """key and agreement: the least dot product of any two spans' vectors, 1 for fewer than two."""
    each = items.select("key", F.explode("spans").alias("text")).join(vectors, "text").groupBy("key", "vec").agg(F.count("*").alias("n"))
    # spans of one vector are as near to others as one of them; two of them stand for their dot product with each other
    own = each.groupBy("key").agg(F.sort_array(F.collect_list("vec")).alias("vs"), F.min(F.when(F.col("n") > 1, dot(F.col("vec"), F.col("vec")))).alias("same"))
    return own.select("key", F.coalesce(F.least(_least(F.col("vs")), "same"), F.lit(1.0)).alias("agreement"))


def least_dot(vs: Column) -> Column:
    return F.coalesce(_least(vs), F.lit(1.0))


def _least(vs: Column) -> Column:
    """The least dot product of any two of the vectors, null for fewer than two; it holds one product at a time."""
    at = F.transform(vs, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    none = F.lit(None).cast("double")
    return F.get(F.transform(F.array(at), lambda all_: F.aggregate(all_, none, lambda m, a: F.aggregate(F.slice(all_, a["i"] + 2, F.size(all_)), m, lambda n, b: F.least(n, dot(a["x"], b["x"]))))), F.lit(0))


def verdict(agreement: Column, threshold: float) -> Column:
    return F.when(agreement >= threshold, "duplicate").otherwise("distinct")


def back_translation(items: DataFrame, table: DataFrame, threshold: float = 0.9) -> DataFrame:
    """key, agreement, verdict from translations (text, english) of the spans: 1 less the largest edit distance of two."""
    own = items.select("key", F.explode("spans").alias("text")).join(table.select("text", T.normalize_key(F.col("english")).alias("en")), "text")
    own = own.groupBy("key").agg(F.sort_array(F.collect_list("en")).alias("en"))
    far = F.array_max(F.flatten(F.transform("en", lambda a: F.transform("en", lambda b: T.norm_edit_distance(a, b)))))
    agreement = F.bround(1 - F.coalesce(far, F.lit(0.0)), 3)
    return own.select("key", agreement.alias("agreement"), verdict(agreement, threshold).alias("verdict"))


def clear_duplicates(found: DataFrame, verdicts: DataFrame, include_consistent: bool = False) -> DataFrame:
    """Marks flags whose verdict is duplicate as cleared; drops them unless consistent ones are wanted."""
    out = found.join(verdicts.select("key", (F.col("verdict") == "duplicate").alias("cleared")), "key", "left").withColumn("cleared", F.coalesce("cleared", F.lit(False)))
    return out if include_consistent else out.where("not cleared")


def parse_verdict(reply: Column) -> Column:
    """A judge's reply, fenced or not, as (verdict, preferred, reason); what its JSON lacks is null. unknown and the first
    400 characters if it is no JSON object. Of a fenced reply the first line goes, or a "json" it begins with."""
    text = F.trim(reply)
    bare = F.regexp_replace(text, "^`+|`+$", "")
    line = F.instr(bare, "\n")
    bare = F.when(line > 0, F.substring(bare, line + 1, F.length(bare))).otherwise(bare)
    bare = F.when(F.startswith(F.lower(bare), F.lit("json")), F.trim(F.regexp_replace(bare, "^(.*?)json", "$1"))).otherwise(bare)
    body = F.trim(F.when(F.startswith(text, F.lit("```")), bare).otherwise(text))
    got = F.from_json(body, "verdict string, preferred string, reason string")
    valid = F.startswith(body, F.lit("{")) & F.get_json_object(body, "$").isNotNull()
    none = F.lit(None).cast("string")
    return F.when(valid, F.struct(got["verdict"].alias("verdict"), got["preferred"].alias("preferred"), got["reason"].alias("reason"), none.alias("raw"))).otherwise(
        F.struct(F.lit("unknown").alias("verdict"), none.alias("preferred"), none.alias("reason"), F.substring(F.coalesce(body, F.lit("")), 1, 400).alias("raw"))
    )


def suppress(found: DataFrame, decisions: DataFrame, include_consistent: bool = False) -> DataFrame:
    """Flags without those decided (decisions: key); or all, marked decided."""
    on = T.normalize_key(F.col("ngram"))
    if not include_consistent:
        return found.withColumn("__k", on).join(decisions.select(F.col("key").alias("__k")), "__k", "left_anti").drop("__k")
    return found.withColumn("__k", on).join(decisions.select(F.col("key").alias("__k"), F.lit(True).alias("decided")).distinct(), "__k", "left").drop("__k").withColumn("decided", F.coalesce("decided", F.lit(False)))


def decide(decisions: DataFrame, ngram: str, status: str, note: str, updated: str) -> DataFrame:
    """Adds or replaces a decision; any status other than accepted or dismissed changes nothing."""
    if status not in ("accepted", "dismissed"):
        return decisions
    spark = decisions.sparkSession
    new = spark.createDataFrame([(ngram, status, note, updated)], "ngram string, status string, note string, updated string").withColumn("key", T.normalize_key(F.col("ngram"))).select(decisions.columns)
    return decisions.join(new.select("key"), "key", "left_anti").select(decisions.columns).unionByName(new)


def undecide(decisions: DataFrame, ngram: str) -> DataFrame:
    return decisions.where(F.col("key") != T.normalize_key(F.lit(ngram)))


def vault_upsert(vault: DataFrame, new: DataFrame) -> DataFrame:
    """vault(key, source, target, updated, deleted) with rows new(source, target, updated, ord) added: trimmed, blank
    ones ignored, the last of a batch wins; a deleted key comes back."""
    rows = new.select(F.trim("source").alias("source"), F.trim("target").alias("target"), "updated", "ord").where("source <> '' and target <> ''").withColumn("key", T.normalize_key(F.col("source")))
    last = rows.groupBy("key").agg(F.max_by(F.struct("source", "target", "updated"), "ord").alias("x")).select("key", "x.*", F.lit(False).alias("deleted"))
    return vault.join(last.select("key"), "key", "left_anti").select("key", "source", "target", "updated", "deleted").unionByName(last)


def vault_remove(vault: DataFrame, keys: DataFrame | None = None, restore: bool = False) -> DataFrame:
    """Soft delete (or restore) of the keys; of all without keys."""
    if keys is None:
        return vault.withColumn("deleted", F.lit(not restore))
    hit = keys.select("key", F.lit(True).alias("__hit")).distinct()
    return vault.join(hit, "key", "left").withColumn("deleted", F.when(F.col("__hit"), F.lit(not restore)).otherwise(F.col("deleted"))).drop("__hit")


def vault_list(vault: DataFrame, trash: bool = False) -> DataFrame:
    return vault.where(F.col("deleted") == trash).orderBy("key")


def empty_trash(vault: DataFrame) -> DataFrame:
    return vault.where("not deleted")


def vault_rename(vault: DataFrame, old: str, source: str, target: str, updated: str) -> DataFrame:
    """Replaces an entry's texts; under a changed key the old entry goes to the trash."""
    spark = vault.sparkSession
    key = T.normalize_key(F.lit(old))
    new = spark.createDataFrame([(source, target, updated, 0)], "source string, target string, updated string, ord int")
    changed = vault.withColumn("deleted", F.when((F.col("key") == key) & (key != T.normalize_key(F.lit(source))), True).otherwise(F.col("deleted")))
    return vault_upsert(changed, new)


SORTS = {
    "src": [F.asc, "source"], "src-desc": [F.desc, "source"], "tgt": [F.asc, "target"], "date-new": [F.desc, "updated"], "date-old": [F.asc, "updated"], "len-asc": [F.asc, "words"], "len-desc": [F.desc, "words"],
}


def vault_search(vault: DataFrame, query: str = "", regex: bool = False, scope: str = "both", words: int = 0, sort: str = "src") -> DataFrame:
    """Entries that hold the query (ignoring case), of so many words (6: six or more; 0: any), in the wanted order."""
    out = vault.where("not deleted").withColumn("words", T.word_count(F.col("source")))
    if query:
        hit = (lambda c: F.col(c).rlike(f"(?i){query}")) if regex else (lambda c: F.contains(F.lower(c), F.lit(query.lower())))
        cols = ["source", "target"] if scope == "both" else [scope]
        cond = hit(cols[0])
        for c in cols[1:]:
            cond = cond | hit(c)
        out = out.where(cond)
    if words:
        out = out.where(F.col("words") >= 6 if words >= 6 else F.col("words") == words)
    order, column = SORTS[sort]
    return out.orderBy(order(column), "key")


def approve_dominant(found: DataFrame) -> DataFrame:
    """source, target: the most frequent span of every flag with several variants that is neither cleared nor decided."""
    open_ = F.col("distinct") >= 2
    for name in ("cleared", "decided"):
        if name in found.columns:
            open_ = open_ & ~F.coalesce(F.col(name), F.lit(False))
    return found.where(open_).select(F.col("ngram").alias("source"), F.get("variants", F.lit(0))["span"].alias("target"))


def glossary_violations(segments: DataFrame, glossary: DataFrame, fold_taa: bool = True, strip_clitics: bool = True, strip_diacritics: bool = True, longest: int = 12) -> DataFrame:
    """Segments whose source holds a term (as whole words, ignoring case) but whose target lacks the approved text.

    Plain terms, words joined by single spaces, meet the segments' n-grams of up to `longest` words; others, and longer
    ones, meet segments that hold their first word, and are then matched whole. Only terms without any word are held
    against every segment. Joins carry segment numbers (seg_ord, unique), not texts; only hits fetch their segment.
    """
    norm = lambda c: T.normalize_span(c, fold_taa, strip_clitics, strip_diacritics)
    g = glossary.select(F.col("source").alias("source_term"), F.col("target").alias("approved"), F.lower("source").alias("low"), norm(F.col("target")).alias("want")).where("want <> ''")
    word = r"[\p{L}\p{N}_]"
    plain = F.col("low").rlike(rf"^{word}+( {word}+)*$") & (F.size(F.split("low", " ")) <= longest)
    runs = F.split(F.regexp_replace(F.lower("source"), rf"([^\p{{L}}\p{{N}}_]+)", "\u0001$1\u0001"), "\u0001")
    # n-grams of words that single spaces part; worked out once a row, not in every lambda
    pieces = segments.select("seg_ord", F.explode(F.array(runs)).alias("p"))
    grams = F.expr(
        f"""array_distinct(flatten(transform(sequence(0, size(p) - 1, 2), i -> transform(sequence(1, {longest}), n ->
            case when i + 2 * n - 2 < size(p) and get(p, i) <> '' and get(p, i + 2 * n - 2) <> ''
                and size(filter(slice(p, i + 1, 2 * n - 1), (x, j) -> j % 2 = 1 and x <> ' ')) = 0 then array_join(slice(p, i + 1, 2 * n - 1), '') end))))"""
    )
    terms = ["source_term", "approved", "want"]
    easy = pieces.select("seg_ord", F.explode(grams).alias("low")).where("low is not null").join(g.where(plain), "low").select("seg_ord", *terms)
    held = segments.select("seg_ord", F.lower("source").alias("src_low"))
    bound = word.replace("\\", "\\\\")
    whole = F.expr(rf"src_low rlike concat('(?<!{bound})\\Q', low, '\\E(?!{bound})')")
    hard = g.where(~plain).withColumn("word", F.regexp_extract("low", f"{word}+", 0))
    words = held.select("seg_ord", F.explode(F.array_distinct(F.regexp_extract_all("src_low", F.lit(f"{word}+"), F.lit(0)))).alias("word"))
    near = words.join(hard.where("word <> ''"), "word").join(held, "seg_ord").where(whole).select("seg_ord", *terms)
    bare = held.join(hard.where("word = ''"), whole).select("seg_ord", *terms)
    hits = easy.unionByName(near).unionByName(bare)
    texts = segments.select("seg_ord", "sid", "file", F.col("source").alias("segment_source"), F.col("target").alias("segment_target"))
    found = hits.join(texts, "seg_ord").where(~F.contains(norm(F.col("segment_target")), F.col("want")))
    return found.select("seg_ord", "sid", "file", "source_term", "approved", "segment_source", "segment_target")


def placeholder_issues(segments: DataFrame, src: Column | None = None, tgt: Column | None = None) -> DataFrame:
    """Segments whose placeholders differ as multisets; literal ones unless arrays are given."""
    a, b = (src, tgt) if src is not None else (T.literal_placeholders(F.col("source")), T.literal_placeholders(F.col("target")))
    return segments.withColumns({"src_found": F.array_sort(a), "tgt_found": F.array_sort(b)}).where("src_found <> tgt_found")


def set_edits(edits: DataFrame, new: DataFrame, segments: DataFrame) -> DataFrame:
    """edits(sid, text) after new(sid, text): unknown segments are ignored, a text equal to the original reverts."""
    live = new.join(segments.select("sid", "target"), "sid")
    return edits.join(live.select("sid"), "sid", "left_anti").select("sid", "text").unionByName(live.where("not (text <=> target)").select("sid", "text"))


def revert(edits: DataFrame, sids: DataFrame | None = None) -> DataFrame:
    """edits without those of the segments (sid); without any, if none are given."""
    return edits.where("false") if sids is None else edits.join(sids.select("sid").distinct(), "sid", "left_anti").select(edits.columns)


def remove_file(segments: DataFrame, edits: DataFrame, file: str) -> tuple[DataFrame, DataFrame]:
    """Segments without a file's, numbered anew from 0, and the edits that still have a segment."""
    left = dense(segments.where(F.col("file") != file))
    return left, prune_edits(edits, left)


def dense(segments: DataFrame) -> DataFrame:
    """Segments with a seg_ord from 0 on, in their order: what batch() needs of segments read from files."""
    return numbered(segments.withColumnRenamed("seg_ord", "__old"), ["__old"]).select(segments.columns)


def prune_edits(edits: DataFrame, segments: DataFrame) -> DataFrame:
    return edits.join(segments.select("sid"), "sid", "left_semi")


def overlay(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Segments with the edited text as target and the original kept."""
    return segments.join(edits.select("sid", "text"), "sid", "left").withColumn("original", F.col("target")).withColumn("target", F.coalesce("text", "target")).drop("text")


def edit_count(edits: DataFrame, segments: DataFrame) -> DataFrame:
    return edits.join(segments.select("sid", "file"), "sid").agg(F.count("*").alias("edits"), F.count_distinct("file").alias("files"))


def apply_correction(occ: DataFrame, segments: DataFrame, ngram: str, corrected: str) -> DataFrame:
    """sid, text: the corrected span put into every occurrence of the n-gram, from the original target."""
    hit = occ.where((F.col("key") == F.lower(F.lit(ngram))) & (F.col("span") != "")).select("sid", "lo", "hi")
    return hit.join(segments.select("sid", "target"), "sid").select("sid", T.splice(F.col("target"), F.col("lo"), F.col("hi"), F.lit(corrected)).alias("text"))


def batch(segments: DataFrame, number: int, size: int) -> DataFrame:
    """Rows [(number - 1) size, number size) by dense order seg_ord; all for size 0; number 1 at least."""
    n = max(1, number)
    return segments if size <= 0 else segments.where((F.col("seg_ord") >= (n - 1) * size) & (F.col("seg_ord") < n * size))


def file_summary(files: DataFrame, segments: DataFrame) -> DataFrame:
    return files.select("file").join(segments.groupBy("file").agg(F.count("*").alias("segments")), "file", "left").select("file", F.coalesce("segments", F.lit(0)).alias("segments"))


def search_flags(found: DataFrame, query: str = "", regex: bool = False, inconsistent: bool = False, most: int | None = None) -> DataFrame:
    """Flags whose n-gram or a span holds the query, ignoring case; `most` of them, in reading order, if it is given."""
    hit = (lambda c: c.rlike(f"(?i){query}")) if regex else (lambda c: F.contains(F.lower(c), F.lit(query.lower())))
    out = found.where(F.col("distinct") >= 2) if inconsistent else found
    if query:
        out = out.where(hit(F.col("ngram")) | F.exists("variants", lambda v: hit(v["span"])))
    return out if most is None else ranked(out).limit(most)


def top_variants(found: DataFrame) -> DataFrame:
    """Why flagged: unusual characters of all variants, and the edit script of the first two."""
    return found.where("distinct >= 2").select("key", "ngram", T.unusual_chars(F.array_join(F.transform("variants", lambda v: v["span"]), "")).alias("unusual"), T.char_diff(F.get("variants", F.lit(0))["span"], F.get("variants", F.lit(1))["span"]).alias("diff"))


def numbered(rows: DataFrame, order: list) -> DataFrame:
    """Adds a dense seg_ord from 0 without one task for all: ranks within ranges, and the ranges' sums before. The ranges
    are written once, as another computation of them, of fewer columns, would draw them elsewhere."""
    own = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__i", F.monotonically_increasing_id()))
    own = own.withColumns({"__p": F.shiftright("__i", 33), "__r": F.col("__i").bitwiseAND((1 << 33) - 1)})  # partition, and the row's place in it
    sums = own.groupBy("__p").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(sums.select("__p", "before")), "__p").withColumn("seg_ord", F.col("before") + F.col("__r")).drop("__p", "__i", "__r", "before")  # a row a partition
