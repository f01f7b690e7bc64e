"""Repeated passages by a sparse suffix array.

Content-selected places (the minimisers of runs of words) find where passages can repeat: two equal passages of at
least `least` words have such places at the same words, the first early enough to share its first words (the key).
Places whose key occurs once are dropped. The suffixes that begin at the others, or up to as many words before as a
passage can, are sorted over the whole cluster by the hash of their first `least` words, key and place; neighbours with
equal first words are a run, whose first row is the first occurrence. Longer passages are the union of such suffixes,
each under its own owner, so nothing is removed that no earlier place holds. The order is by ranges, so a passage that
a third of all documents share is many tasks; runs that cross a range are joined at its ends.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, WORDS, Staging, mix64, window_hashes


def minimisers(h: np.ndarray, w: int, dense: bool = False) -> np.ndarray:
    """Positions that hold the smallest hash of some window of w. Of equal neighbours only every w-th counts, so text
    that repeats one word has few; if dense, all do, and the positions depend on nothing outside their window."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    same = np.concatenate(([False], h[1:] == h[:-1]))
    if same.any() and not dense:
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(h))))
        h = np.where((np.arange(len(h)) - begin) % w == 0, h, np.uint64(2**64 - 1))
    views = np.lib.stride_tricks.sliding_window_view(h, w)
    return np.unique(views.argmin(axis=1) + np.arange(len(views)))


def anchors_of(h: np.ndarray, k: int, w: int, length: int, dense: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Selected positions of the words' hashes, and the hashes of the `length` words that start there."""
    if len(h) < max(length, k + w - 1):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = minimisers(window_hashes(h, k), w, dense)
    at = at[at <= len(h) - length]
    return at, window_hashes(h, length)[at]


def repeats(docs: DataFrame, least: int = 50, k: int = 12, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, start, end, n_words, first_id, row_hash of every passage to remove: words [start, end) of the row repeat a
    passage of at least `least` words whose first occurrence, by key and place, is elsewhere (in the row first_id).

    Words are runs of characters that are not white space, compared by 128 bits of hash over `least` words. What is
    removed at a place stands at an earlier one, where it stays or is itself removed for a still earlier one; so its
    first occurrence stays. Passages that overlap or touch in a row
    are one (first_id: the smallest). Null and short texts have none; rows with a null key take no part; rows that
    repeat a key are told apart, and ordered, by 31 bits of their texts' hash (row_hash), and rows equal in both count
    as one. Other columns, whatever their names, are left out. The plan is the same at every size: no side that grows
    with the input is broadcast because it is still small.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    staging = staging or Staging(spark)
    w = (least - k + 2) // 2 + k // 2 - 2  # minimiser window
    shared = least - w + 1  # words that the first selected place of a passage is sure to share
    back = w - 1  # words of a passage before it, at most

    def select(batches: Iterator) -> Iterator:
        for batch in batches:
            which, keys = [], []
            for i, x in enumerate(batch.column(2)):
                h = np.sort(anchors_of(WORDS.of((x.as_py() or "").split()), k, w, shared, dense=True)[1])
                first = np.ones(len(h), bool)
                first[1:] = h[1:] != h[:-1]
                own, n = h[first], np.diff(np.append(np.flatnonzero(first), len(h)))
                which.append(np.repeat(i, len(own) + (n > 1).sum()))
                keys += [own, own[n > 1]]  # twice, if the text itself repeats it
            if which and len(which := np.concatenate(which)):
                at = pa.array(which.astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(keys).astype(np.int64))], names=["id", "own", "hash"])

    def suffix(batches: Iterator) -> Iterator:
        names = ["hash", "check", "id", "spot"]

        def rows_of(parts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

        parts, size = [], 0
        for batch in batches:
            wanted, bounds = batch.column(3).flatten().to_numpy(), np.asarray(batch.column(3).offsets)
            bounds = bounds - bounds[0]
            for n, (i, own, x) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))):
                h = WORDS.of((x.as_py() or "").split())
                places, keys = anchors_of(h, k, w, shared, dense=True)
                places = places[np.isin(keys.astype(np.int64), wanted[bounds[n] : bounds[n + 1]])]
                near = np.zeros(len(h) + 1, np.int64)  # starts from `back` words before a place to the place
                np.add.at(near, np.maximum(places - back, 0), 1)
                np.add.at(near, places + 1, -1)
                at = np.flatnonzero(np.cumsum(near)[: max(0, len(h) - least + 1)] > 0)
                if not len(at):
                    continue
                with np.errstate(over="ignore"):
                    parts.append((window_hashes(h, least)[at].astype(np.int64), window_hashes(mix64(h + GOLDEN), least)[at].astype(np.int64), np.full(len(at), i, np.int64), (own << 32) + at))
                size += len(at)
                if size >= 65536:
                    yield rows_of(parts)
                    parts, size = [], 0
        if parts:
            yield rows_of(parts)

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), row_hash(text).alias("own"), F.col(text).alias("text"))
    kept = staging.put(rows.mapInArrow(select, "id bigint, own bigint, hash bigint"), "anchors")
    # written, so that the join deals both sides anew and can split a hot passage
    often = staging.put(kept.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    by_doc = kept.join(often.hint("merge"), "hash").groupBy("id", "own").agg(F.collect_set("hash").alias("keys"))
    wanted = rows.join(by_doc.hint("merge"), ["id", "own"]).select("id", "own", "text", "keys")
    suffixes = staging.put(wanted.mapInArrow(suffix, "hash bigint, check bigint, id bigint, spot bigint"), "suffixes")
    staging.drop("anchors", "often")
    staging.collect_garbage()  # the shuffled texts go

    def compare(batches: Iterator) -> Iterator:
        """Neighbours: a suffix whose first words are those of the one before it repeats the first of their run."""
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = ["kind", "part", "hash", "check", "id", "spot", "own_id", "own_spot"]
        types = (pa.int32(), *[pa.int64()] * 7)
        last = head = opening = None  # the last suffix, the first of its run, the range's first run

        def record(kind: int, cols: list, own: tuple, n: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c), t) for c, t in zip([np.full(n, kind), np.full(n, part), *cols, *own], types)], names=names)

        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            n = len(cols[0])
            if not n:
                continue
            start = np.ones(n, bool)
            start[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            again = np.zeros(n, bool)  # a row that repeats its key and its words
            again[1:] = ~start[1:] & (cols[2][1:] == cols[2][:-1]) & (cols[3][1:] == cols[3][:-1])
            if last is None:
                opening = (cols[0][0], cols[1][0])
                yield record(1, [c[:1] for c in cols], (cols[2][:1], cols[3][:1]), 1)
                head = (cols[2][0], cols[3][0])
            else:
                start[0] = last[:2] != (cols[0][0], cols[1][0])
                again[0] = last == tuple(c[0] for c in cols)
            first = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            own_id, own_at = (np.where(first >= 0, c[np.maximum(first, 0)], h) for c, h in zip(cols[2:], head))
            # the range's first run may go on from the range before: its rows are told apart, the first one with them
            open_run = (cols[0] == opening[0]) & (cols[1] == opening[1])
            spare = ~again & (~start | open_run)
            for kind, which in ((0, spare & ~open_run), (3, spare & open_run)):
                if n := int(which.sum()):  # words and the owner's place are told for a range's ends only
                    none = np.zeros(n, np.int64)
                    yield record(kind, [none, none, *(c[which] for c in cols[2:])], (own_id[which], none), n)
            last, head = tuple(c[-1] for c in cols), (own_id[-1], own_at[-1])
        if last is not None:
            yield record(2, [np.array([x]) for x in last], (np.array([head[0]]), np.array([head[1]])), 1)

    order = ["hash", "check", "id", "spot"]
    # no number given: small ranges that lie next to each other may become one task and one file
    ranged = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    compared = staging.put(ranged.mapInArrow(compare, "kind int, part bigint, hash bigint, check bigint, id bigint, spot bigint, own_id bigint, own_spot bigint"), "compared")
    staging.drop("suffixes")
    staging.collect_garbage()
    ends = {}
    for r in compared.where("kind in (1, 2)").collect():  # two rows a range
        ends.setdefault(r["part"], {})[r["kind"]] = r
    firsts, before, owner = [], None, None
    for part in sorted(ends):
        first, last = ends[part][1], ends[part][2]
        goes_on = before is not None and before[2:4] == first[2:4]
        firsts.append((part, *(owner if goes_on else (first["id"], first["spot"]))))
        owner = owner if goes_on and last[2:4] == first[2:4] else (last["own_id"], last["own_spot"])
        before = last
    parts, ids, spots = (np.array(c, np.int64) for c in zip(*(firsts or [(-1, 0, 0)])))  # a row a range

    def owned(batches: Iterator) -> Iterator:
        """What repeats the first of its run; of a run that a range opens with, the first in the ranges before."""
        for batch in batches:
            kind, part, i, spot, own_id = (c.to_numpy() for c in batch.columns)
            own = np.minimum(np.searchsorted(parts, part), len(parts) - 1)
            over = kind == 3
            other = ~over | (i != ids[own]) | (spot != spots[own])
            at = (spot & 0xFFFFFFFF).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (i, spot >> 32, at, at + np.int32(least), np.where(over, ids[own], own_id))], names=["id", "own", "start", "end", "first_id"])

    spare = compared.where("kind in (0, 3)").select("kind", "part", "id", "spot", "own_id").mapInArrow(owned, "id bigint, own bigint, start int, end int, first_id bigint")
    by_start = Window.partitionBy("id", "own").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = spare.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("id", "own", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_id").alias("first_id"))
    return merged.select(F.col("id").alias(key), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "first_id", F.col("own").alias("row_hash"))


def row_hash(text: Column | str) -> Column:
    """Tells rows of one key apart: 31 bits of the text's hash."""
    return F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1))


def remove(docs: DataFrame, spans: DataFrame, text: str = "text", key: str = "doc_id", emptied: bool = True) -> DataFrame:
    """docs without the words of the spans (key, start, end, row_hash), each with the white space before it; all columns
    stay. Rows that lose nothing, null keys and texts among them, keep their text as it is; other rows of a span's key
    lose nothing by it. A row whose words are all removed keeps a text without words, or goes if `emptied` is false."""
    lists = spans.groupBy(F.col(key).alias("__id"), F.col("row_hash").alias("__own")).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("a"), F.col("end").cast("int").alias("z")))).alias("__cut"))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, cuts):
            if spans_ is None or t is None or not len(spans_):
                out.append(t)
                continue
            at = [m.span() for m in re.finditer(r"\S+", t)]
            kept, here = [], 0
            for s in spans_:
                a, z = s["a"], min(s["z"], len(at))
                if a < z:
                    kept.append(t[here : at[a - 1][1] if a else 0])
                    here = at[z - 1][1]
            out.append("".join(kept) + t[here:] if here else t)
        return pd.Series(out)

    both = docs.join(lists.hint("merge"), (docs[key].cast("long") == F.col("__id")) & (row_hash(docs[text]) == F.col("__own")), "left")
    fixed = both.where("__cut is not null").withColumn(text, cut(F.col(text), F.col("__cut"))).select(docs.columns)
    if not emptied:
        fixed = fixed.where(F.col(text).rlike(r"\S"))
    return both.where("__cut is null").select(docs.columns).unionByName(fixed)
