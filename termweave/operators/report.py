"""Reports: flags in the order of their significance, as JSON rows, and the occurrences behind them with edits applied.

A flag's occurrences stay rows, as a frequent n-gram can have more than one record may hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.functions import text as T
from termweave.operators import consistency as C
from termweave.operators import review as R


def significance(found: DataFrame) -> DataFrame:
    """Active flags first, then by score and total; ties in reading order. Takes the place of the reading order."""
    marked = found
    for name in ("cleared", "decided"):
        if name not in found.columns:
            marked = marked.withColumn(name, F.lit(False))
    return C.active(marked).orderBy(F.desc("active"), F.desc(F.round("score", 12)), F.desc("total"), F.desc("violation"), F.desc(F.col("distinct") >= 2), F.desc("distinct"), "first")


def flags_json(found: DataFrame) -> DataFrame:
    """key and json: one object a flag, score to three places; a variant's raw is that of its first occurrence."""
    seen = F.transform("variants", lambda v: F.struct(v["span"].alias("span"), v["raw"].alias("raw"), v["count"].alias("count")))
    more = [F.col(c) for c in ("dropped", "decided", "cleared") if c in found.columns]
    return found.select("key", F.to_json(F.struct("ngram", F.bround("score", 3).alias("score"), "distinct", "total", "violation", "approved", seen.alias("variants"), *more)).alias("json"))


def reverse_json(found: DataFrame) -> DataFrame:
    """span and json: one object for each span that translates several n-grams."""
    return found.select("span", F.to_json(F.struct("span", F.bround("score", 3).alias("score"), "distinct", "total", "uses")).alias("json"))


def flag_occurrences(found: DataFrame, occ: DataFrame, segments: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """key, span, raw, lo, hi, sid, file, source, target (edited where it is) and original of the flags' occurrences."""
    hits = occ.where("span <> ''").join(found.select("key"), "key", "left_semi").select("key", "span", "raw", "lo", "hi", "sid", "file")
    shown = R.overlay(segments, edits) if edits is not None else segments.withColumn("original", F.col("target"))
    return hits.join(shown.select("sid", "source", "target", "original"), "sid")


def full_json(found: DataFrame, occ: DataFrame, segments: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """key and json as flags_json(), with the occurrences of each variant, of all spans it stands for, in their order.
    For people to read: a frequent n-gram is better served by the rows of flag_occurrences()."""
    rows = flag_occurrences(found, occ, segments, edits).join(segments.select("sid", "seg_ord"), "sid")
    each = found.select("key", F.posexplode("variants").alias("pos", "v")).select("key", "pos", "v", F.explode("v.spans").alias("span"))
    one = F.struct("seg_ord", "sid", "file", "source", "target", "original")
    shown = each.join(rows.drop("raw"), ["key", "span"]).groupBy("key", "pos").agg(F.first("v").alias("v"), F.array_sort(F.collect_list(one)).alias("occurrences"))
    variant = F.struct("pos", F.col("v.span").alias("span"), F.col("v.raw").alias("raw"), F.col("v.count").alias("count"), "occurrences")
    lists = shown.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(variant)), lambda v: v.dropFields("pos")).alias("variants"))
    more = [F.col(c) for c in ("dropped", "decided", "cleared") if c in found.columns]
    named = found.select("key", "ngram", F.bround("score", 3).alias("score"), "distinct", "total", "violation", "approved", *more)
    return named.join(lists, "key").select("key", F.to_json(F.struct("ngram", "score", "distinct", "total", "violation", "approved", "variants", *[c for c in ("dropped", "decided", "cleared") if c in found.columns])).alias("json"))


def reverse_full_json(found: DataFrame, occ: DataFrame, segments: DataFrame, edits: DataFrame | None = None) -> DataFrame:
    """span and json as reverse_json(), with the occurrences of the span."""
    shown = R.overlay(segments, edits) if edits is not None else segments
    rows = occ.join(found.select("span"), "span", "left_semi").select("span", "ngram", "sid").join(shown.select("sid", "seg_ord", "file", "source", "target"), "sid")
    lists = rows.groupBy("span").agg(F.array_sort(F.collect_list(F.struct("seg_ord", "ngram", "sid", "file", "source", "target"))).alias("occurrences"))
    return found.join(lists, "span").select("span", F.to_json(F.struct("span", F.bround("score", 3).alias("score"), "distinct", "total", "uses", "occurrences")).alias("json"))


def placeholder_report(segments: DataFrame) -> DataFrame:
    """sid, file and both lists of the segments whose placeholders differ; those that the file's reader found, inline
    elements among them, where the segments have them, else those in the texts."""
    found = (F.col("src_ph"), F.col("tgt_ph")) if {"src_ph", "tgt_ph"} <= set(segments.columns) else ()
    return R.placeholder_issues(segments, *found).select("sid", "file", "src_found", "tgt_found")


def listing(segments: DataFrame, most: int = 2000) -> tuple[DataFrame, int, int]:
    """The first `most` segments in their order (0: all), how many there are, and how many are shown."""
    total = segments.count()
    shown = segments.orderBy("seg_ord")
    return (shown.limit(most), total, min(most, total)) if most > 0 else (shown, total, total)


def verify_all(items: DataFrame, method: str, table: DataFrame, threshold: float | None = None) -> DataFrame:
    """key, agreement, verdict of payload items: "vectors" (text, vec; 0.98) or "translations" (text, english; 0.9)."""
    if method == "vectors":
        agreed = R.min_cosine(items, table)
        return agreed.withColumn("verdict", R.verdict(F.col("agreement"), 0.98 if threshold is None else threshold))
    if method == "translations":
        return R.back_translation(items, table, 0.9 if threshold is None else threshold)
    raise ValueError(f"no verifier {method}")


def words(segments: DataFrame) -> DataFrame:
    """sid and the number of words of source and target."""
    return segments.select("sid", T.word_count(F.col("source")).alias("source_words"), T.word_count(F.col("target")).alias("target_words"))
