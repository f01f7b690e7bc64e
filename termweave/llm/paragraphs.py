"""Substring dedup by paragraphs: MinHash banding, exact verification, components.

Units are paragraphs (all lines that have words) and, as passages repeat inside paragraphs too, windows of words that start
at content-selected positions: minimisers, so a passage of `least` words holds a window that begins at the same word
wherever the passage stands. Equal units are one row from the start. Paragraphs collide in bands of their MinHash
signature, tuned for the target recall; colliding ones are verified by exact Jaccard similarity; sets so small
that only an equal one reaches the threshold have no bands. Windows match only where they are equal: a passage's first
window does wherever the passage stands. Equal units are known by 128 bits of hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, WORDS, Staging, components, mix64, window_hashes
from termweave.llm.lsh_forest import signatures
from termweave.llm.near import cells, verify
from termweave.llm.suffix_dedup import anchors_of


def bands(threshold: float, recall: float, rows: int) -> int:
    """How many bands of `rows` values make a pair at the threshold collide with the target probability."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))


def unit_hash(h: np.ndarray) -> int:
    """Identifies a shingle set, as a signed number."""
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(h).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)).astype(np.int64)[0])


def line_sets(h: np.ndarray, a: np.ndarray, z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle sets of the word runs [a, z), all of k words or more, one after another, and where each begins."""
    n = z - a - k + 1
    which = np.repeat(np.arange(len(n)), n)
    v = window_hashes(h, k)[np.arange(n.sum()) + np.repeat(a - (np.cumsum(n) - n), n)]
    order = np.lexsort((v, which))
    v, which = v[order], which[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (which[1:] != which[:-1])
    return v[new], np.searchsorted(which[new], np.arange(len(n)))


def duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, least_words: int = 1, least: int = 50, span: int = 30, recall: float = 0.995, rows: int = 3, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end, class_id, removed of every unit that has a duplicate: words [start, end) of the row.

    A class is a connected component of units whose sets of k-word shingles (lower case) are similar to at least the
    threshold; its first unit, by key and place, is kept and the others are removed. Windows to be removed that
    overlap in a row are one unit, under the smallest class of theirs; kept windows are not listed unless as such.
    Every line with words is a unit (least_words: at least so many); one of fewer than k words is one shingle. Null and
    empty texts have no units; very long ones are whole; rows with a null key take no part; rows that repeat a key are
    all units of that key, equal units at one place counting once. Other columns, whatever their names, are left out.
    The plan is the same at every size: no side that grows with the input is broadcast because it is still small.
    """
    import pyarrow as pa

    staging = staging or Staging(docs.sparkSession)
    n_bands = bands(threshold, recall, rows)

    def lines_of(h: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Two unit hashes, a number for each band, and whether only equal sets are similar, of the word runs [a, z)."""
        units, checks, codes, alone = np.empty(len(a), np.int64), np.empty(len(a), np.int64), np.zeros((len(a), n_bands), np.int64), np.zeros(len(a), bool)
        size = np.minimum(k, z - a)
        for own in np.unique(size).tolist():  # runs of fewer than k words are one shingle
            at = np.flatnonzero(size == own)
            v, starts = line_sets(h, a[at], z[at], own)
            sizes = np.diff(np.append(starts, len(v)))
            with np.errstate(over="ignore"):
                units[at] = mix64(np.add.reduceat(mix64(v), starts) + sizes.astype(np.uint64)).astype(np.int64)
                checks[at] = mix64(np.add.reduceat(mix64(v ^ GOLDEN), starts) + sizes.astype(np.uint64)).astype(np.int64)
            few = sizes < threshold * (sizes + 1) - 1e-6  # n of n + 1 shingles is the nearest that another set can be
            alone[at] = few
            v, starts, at = v[np.repeat(~few, sizes)], np.cumsum(sizes[~few]) - sizes[~few], at[~few]
            if not len(at):
                continue
            s = signatures(v, starts, n_bands * rows).reshape(len(at), n_bands, rows)
            with np.errstate(over="ignore"):
                code = np.tile(np.arange(n_bands, dtype=np.uint64), (len(at), 1))
                for r in range(rows):
                    code = mix64(code * np.uint64(0x9E3779B97F4A7C15) + s[:, :, r])
                codes[at] = code.astype(np.int64)
        return units, checks, codes, alone

    def cut(batches: Iterator) -> Iterator:
        names = ["id", "line", "start", "end", "chars", "hash", "check", "bands"]
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for low in range(0, batch.num_rows, 64):
                lines, hashes, windows, base = [], [], [], 0
                for i, x in zip(ids[low : low + 64], batch.column(1).slice(low, 64)):
                    at, words = 0, []
                    for number, line in enumerate((x.as_py() or "").lower().split("\n")):
                        own = line.split()
                        words += own
                        if len(own) >= max(1, least_words):
                            lines.append((i, number, at, at + len(own), len(line), base + at))
                        at += len(own)
                    h = WORDS.of(words)
                    hashes.append(h)
                    base += len(h)
                    places, v = anchors_of(h, 8, least - span + 1, span)
                    with np.errstate(over="ignore"):
                        check = window_hashes(mix64(h + GOLDEN), span)[places] if len(places) else v
                    windows.append((np.full(len(places), i, np.int64), places, v.astype(np.int64), check.astype(np.int64)))
                if lines:
                    cols = np.array(lines, np.int64).T
                    unit, checks, codes, alone = lines_of(np.concatenate(hashes), cols[5], cols[5] + cols[3] - cols[2])
                    n = np.where(alone, 0, n_bands)
                    listed = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(codes[~alone].ravel()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(cols[:5], types)), pa.array(unit), pa.array(checks), listed], names=names)
                i, places, v, check = (np.concatenate(c) for c in zip(*windows))
                if len(i):
                    start = places.astype(np.int32)
                    none = [pa.nulls(len(i), t) for t in (types[1], types[7])]
                    yield pa.RecordBatch.from_arrays([pa.array(i), none[0], pa.array(start), pa.array(start + np.int32(span)), pa.array(np.zeros(len(i), np.int32)), pa.array(v), pa.array(check), none[1]], names=names)

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    units = staging.put(texts.mapInArrow(cut, "id bigint, line int, start int, end int, chars int, hash bigint, check bigint, bands array<bigint>"), "units")
    lines = units.where("line is not null")
    distinct = lines.groupBy("hash", "check").agg(F.min(F.struct("id", "line", "chars")).alias("own"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    distinct = staging.put(distinct.select(F.monotonically_increasing_id().alias("id"), "*"), "distinct")
    nodes = distinct.select("id", F.explode("bands").alias("band"))
    shared = nodes.groupBy("band").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("band", "low")
    edges = nodes.join(staging.put(shared, "shared").hint("merge"), "band").where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct()
    groups = components(edges, staging, "candidates").select(F.col("node").alias("id"), F.col("root").alias("grp"))
    members = distinct.join(groups.hint("merge"), "id").select("id", "grp", "n", F.col("hash").alias("mark"), F.col("own.chars").cast("long").alias("chars"), F.col("own.id").alias("doc"), F.col("own.line").alias("line"))
    members = staging.put(members, "members")
    staging.drop("shared")
    staging.collect_garbage()
    found = members.select("id", "doc", "line").hint("merge").join(texts.withColumnRenamed("id", "doc"), "doc")
    found = found.select("id", F.get(F.split("text", "\n", -1), F.col("line")).alias("text"))
    dealt = cells(members.drop("doc", "line"), staging).hint("merge").join(found, "id")

    def sets_of(text, own):
        h = np.unique(window_hashes(WORDS.of((text or "").lower().split()), k))
        return h if unit_hash(h) == own else None

    def similar(common, a, b, *_):
        return common >= threshold * (a + b - common) - 1e-6

    verified = staging.put(verify(dealt, sets_of, similar).where("other is not null"), "verified")
    staging.collect_garbage()
    classes = components(verified.select(F.col("id").alias("a"), F.col("other").alias("b")), staging, "classes").withColumnRenamed("node", "id")
    named = distinct.select("id", "hash", "check").join(classes.hint("merge"), "id", "left").select("hash", "check", F.coalesce("root", "id").alias("class_id"))
    named = staging.put(named, "named")
    staging.drop("distinct", "members", "verified")
    staging.collect_garbage()
    # written, as a join and the first of each class read them; what they were made of goes before
    in_class = lines.select("id", "start", "end", "hash", "check").distinct().join(named.hint("merge"), ["hash", "check"]).select("class_id", F.lit(0).cast("long").alias("check"), "id", "start", "end")
    in_class = staging.put(in_class, "in_class")
    # classes of lines are numbers from 0, of windows negative ones
    windows = units.where("line is null").select(F.col("hash").bitwiseOR(F.lit(-(1 << 63))).alias("class_id"), "check", "id", "start", "end").distinct()
    windows = staging.put(windows, "windows")
    staging.drop("units", "named")
    staging.collect_garbage()

    def judged(rows: DataFrame, name: str) -> DataFrame:
        heads = rows.groupBy("class_id", "check").agg(F.min(F.struct("id", "start")).alias("own"), F.count("*").alias("n")).where("n > 1").drop("n")
        return rows.join(staging.put(heads, name).hint("merge"), ["class_id", "check"]).select("id", "start", "end", "class_id", ((F.col("id") != F.col("own.id")) | (F.col("start") != F.col("own.start"))).alias("removed"))

    spare, repeated = judged(windows, "window_heads"), judged(in_class, "line_heads")
    staging.collect_garbage()
    by_start = Window.partitionBy("id", "removed").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = spare.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "removed", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("class_id").alias("class_id"))
    out = repeated.unionByName(merged.select("id", "start", "end", "class_id", "removed"))
    return out.select(F.col("id").alias(key), "start", "end", "class_id", "removed")
