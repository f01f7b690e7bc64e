"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each tree of the forest is the prefix trie of its part of the signatures; rows meet sorted by trie node, a node being
the hash of its prefix, so that a node that very many texts stand below can be dealt to many tasks. The prefix that a
text must match is shortened from the full depth until the chance that a similar text meets it in some tree reaches
the target recall. How far depends on its set: a set of few shingles can't be just at the threshold with any other, so
its prefixes stay longer, or it needs none. Texts below a common node are compared by their whole signatures; those
not ruled out join groups, and every pair of a group is verified exactly. Texts with equal shingle sets are one row
from the start.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, Staging, components, mix64, shingles
from termweave.llm.near import alike, cells, verify


def prefix_depth(threshold: float, recall: float, trees: int, deepest: int) -> int:
    """The longest prefix with which a pair at the threshold meets in one of the trees with the target probability."""
    for depth in range(deepest, 1, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


@lru_cache(maxsize=None)
def nearest(n: int, threshold: float) -> float | None:
    """The least similarity, from the threshold on, that a set of n can have with a different set; None if none can.
    Of large sets the threshold itself, or nearly."""
    if n > 200:
        return threshold
    found = []
    for m in range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1):
        c = math.ceil(threshold * (n + m) / (1 + threshold) - 1e-9)
        if c <= min(n, m) and not c == n == m:
            found.append(c / (n + m - c))
    return min(found, default=None)


@lru_cache(maxsize=None)
def depths(n: int, threshold: float, recall: float, trees: int, deepest: int) -> tuple[int, frozenset[int]]:
    """How long a prefix of a set of n must match (0: it needs no trees), and all that sets it can be similar to ask for."""
    own = nearest(n, threshold)
    if own is None:
        return 0, frozenset()
    if n > 400:  # its partners are large as well
        return prefix_depth(threshold, recall, trees, deepest), frozenset([prefix_depth(threshold, recall, trees, deepest)])
    sizes = range(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9) + 1)
    others = [s for m in sizes if (s := nearest(m, threshold)) is not None]
    return prefix_depth(own, recall, trees, deepest), frozenset(prefix_depth(s, recall, trees, deepest) for s in [own, *others])


def signature(h: np.ndarray, n: int) -> np.ndarray:
    """MinHash values of a set of hashes, one for each of n functions."""
    seeds = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.full(n, np.uint64(2**64 - 1))
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):
            part = h[at : at + 4096, None] * seeds[None, :]
            part ^= part >> np.uint64(29)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            out = np.minimum(out, part.min(axis=0))
    return out


def signatures(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The signatures of many sets, none empty, that lie one after another in h: a row each."""
    seeds = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(starts), n), np.uint64)
    with np.errstate(over="ignore"):
        for f in range(n):
            part = h * seeds[f]
            part ^= part >> np.uint64(29)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, f] = np.minimum.reduceat(part, starts)
    return out


def mark(h: np.ndarray) -> bytes:
    """Identifies a shingle set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def links(docs: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 16, deepest: int = 8, recall: float = 0.999, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, class_id, n_links of every row.

    Rows are linked if the Jaccard similarity of their sets of k-word shingles (lower case; fewer than k words: one
    shingle of all) is at least the threshold. class_id is the smallest key of a row's connected component, n_links
    its number of linked rows, copies included. Rows without words, or null, have no links and are classes of their
    own, by their key. Rows that repeat a key are told apart by their texts. Null keys: such rows join classes, but
    don't name them (null, if no row of the class has a key). Very long texts are whole sets; other columns, whatever
    their names, are left out.
    """
    staging = staging or Staging(docs.sparkSession)
    signed, named = _classes(docs, threshold, k, trees, deepest, recall, staging, text, key)
    out = signed.select("id", "mark").join(named, "mark", "left")
    return out.select(F.col("id").alias(key), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def first_of_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, trees: int = 16, deepest: int = 8, recall: float = 0.999, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, that come first in their class of links(), by key, then the text's hash (null keys
    last); of rows equal in both one. Rows without words all stay."""
    staging = staging or Staging(docs.sparkSession)
    signed, named = _classes(docs, threshold, k, trees, deepest, recall, staging, text, key)
    first = named.select("first.id", "first.own").distinct()
    times = signed.where("mark is not null").groupBy("id", "own").agg(F.count("*").alias("times"))
    first = first.withColumnsRenamed({"id": "i", "own": "o"}).join(times, F.col("i").eqNullSafe(F.col("id")) & (F.col("o") == F.col("own"))).select("i", "o", "times")
    wordless = signed.where("mark is null").select(F.col("id").alias("i"), F.col("own").alias("o")).distinct().withColumn("times", F.lit(1).cast("long"))
    keep = staging.put(first.unionByName(wordless).withColumnsRenamed({"i": "__id", "o": "__own", "times": "__times"}), "keep")
    found = docs.join(keep.hint("merge"), docs[key].cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(docs[text]) == F.col("__own")))
    once = found.where("__times = 1").select(docs.columns)
    return once.unionByName(found.where("__times > 1").select(docs.columns).dropDuplicates([key, text]))


def _classes(docs: DataFrame, threshold: float, k: int, trees: int, deepest: int, recall: float, staging: Staging, text: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, own, the text's hash, and mark of its shingle set, null without words; mark, first row of its class
    (no: whether its key is null, id, own) and number of linked rows)"""
    import pyarrow as pa

    def sign(batches: Iterator) -> Iterator:
        for batch in batches:
            out = {"mark": [], "chars": [], "size": [], "sig": []}
            for x in batch.column(1):
                t = x.as_py() or ""
                h = shingles(t, k)
                out["mark"].append(mark(h) if len(h) else None)
                out["chars"].append(len(t))
                out["size"].append(len(h))
                out["sig"].append((signature(h, trees * deepest) >> np.uint64(32)).astype("<u4").tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out["mark"], pa.binary()), pa.array(out["chars"], pa.int64()), pa.array(out["size"], pa.int64()), pa.array(out["sig"], pa.binary())], names=["id", "own", "mark", "chars", "size", "sig"])

    def prefixes(batches: Iterator) -> Iterator:
        """A row for each trie node that a text stands below: of its own depth (asked), and of those others ask for."""
        for batch in batches:
            ids, asked, codes = [], [], []
            for node, size, sig in zip(*(c.to_pylist() for c in batch.columns)):
                own, listed = depths(size, threshold, recall, trees, deepest)
                if not own:
                    continue
                s = np.frombuffer(sig, "<u4").reshape(trees, deepest).astype(np.uint64)
                with np.errstate(over="ignore"):
                    code = mix64(np.arange(1, trees + 1, dtype=np.uint64) * GOLDEN)
                    for d in range(1, max(listed) + 1):
                        code = mix64(code * GOLDEN + s[:, d - 1] + np.uint64(1))
                        if d in listed:
                            codes.append(code.astype(np.int64))
                            ids += [node] * trees
                            asked += [d == own] * trees
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(codes) if codes else [], pa.int64()), pa.array(asked, pa.bool_())], names=["id", "grp", "asked"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("own"))
    signed = staging.put(rows.mapInArrow(sign, "id bigint, own bigint, mark binary, chars bigint, size bigint, sig binary"), "signed")
    texts = signed.where("mark is not null").groupBy("mark").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "own")).alias("of"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in ("chars", "size", "sig")))
    texts = staging.put(texts.select(F.monotonically_increasing_id().alias("node"), "mark", "of", "of.id", "of.own", "n", "chars", "size", "sig"), "texts")
    nodes = staging.put(texts.select("node", "size", "sig").mapInArrow(prefixes, "id bigint, grp bigint, asked boolean"), "nodes")
    shared = staging.put(nodes.groupBy("grp").agg(F.count("*").alias("m"), F.max("asked").alias("asked")).where("m > 1 and asked").select("grp"), "shared")
    below = staging.put(nodes.join(shared, "grp").select("grp", "id").withColumn("chars", F.lit(0)), "below")
    dealt = cells(below, staging, "node_sizes", most=512).join(texts.select(F.col("node").alias("id"), "sig"), "id")
    low = threshold - 4 * math.sqrt(threshold * (1 - threshold) / (trees * deepest))  # 4 deviations: 1 of 30,000 pairs at the threshold
    edges = staging.put(alike(dealt, low), "edges")
    staging.drop("nodes", "below")
    groups = components(edges, staging, "candidates").select(F.col("node").alias("node"), F.col("root").alias("grp"))
    members = staging.put(texts.select("node", "id", "own", "n", "chars", "mark").join(groups, "node"), "members")
    wanted = members.select("id", "own").distinct().withColumnRenamed("id", "key")
    found = rows.join(wanted.withColumnRenamed("own", "of"), F.col("id").eqNullSafe(F.col("key")) & (F.col("own") == F.col("of"))).groupBy("key", "of").agg(F.min("text").alias("text"))
    dealt = cells(members.select(F.col("node").alias("id"), "grp", "n", "chars", "mark"), staging)
    named = members.select(F.col("node").alias("id"), F.col("id").alias("key"), F.col("own").alias("of"))
    words = staging.put(named.join(found.withColumnsRenamed({"key": "k", "of": "o"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("of") == F.col("o"))).select("id", "text"), "words")
    dealt = dealt.join(words, "id")

    def sets_of(text, own):
        h = shingles(text, k)
        return h if mark(h) == own else None

    def similar(common, a, b, *_):
        return common >= threshold * (a + b - common) - 1e-6

    verified = staging.put(verify(dealt, sets_of, similar), "verified")
    n_links = verified.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(verified.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")), staging, "classes")
    own = texts.select("mark", "n", "of", F.col("node").alias("id")).join(n_links, "id", "left").join(classes.select(F.col("node").alias("id"), "root"), "id", "left")
    own = staging.put(own.select("mark", "n", "of", F.coalesce("root", "id").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "own")
    names = staging.put(own.groupBy("root").agg(F.min("of").alias("first")), "names")
    return signed.select("id", "own", "mark"), staging.put(own.join(names, "root").select("mark", "first", (F.col("links") + F.col("n") - 1).alias("n_links")), "named")
