"""Document fingerprints: SimHash over word shingles, and the search for all fingerprints in a Hamming radius."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, WORDS, Staging, grouped, mix64, window_hashes

BITS = 128
#: byte -> its bits as the eight bytes of a 64-bit number, so that one addition counts eight votes
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.uint8).view(np.uint64).ravel()


def fingerprint(text: str, k: int = 5) -> bytes:
    """SimHash of a text: each run of k lower-case words votes with +1 or -1 on every bit by its hash, as often as it
    occurs; a bit is set if the votes are positive. No words: all bits 0."""
    h = window_hashes(WORDS.of(text.lower().split()), k)
    if not len(h):
        return bytes(BITS // 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 255 * 64):
        part = h[at : at + 255 * 64]
        votes = np.empty((-(-len(part) // 255) * 255, BITS // 64), np.uint64)
        votes[: len(part), 0], votes[: len(part), 1], votes[len(part) :] = part, mix64(part ^ GOLDEN), 0
        lanes = LANES[votes.view(np.uint8)].reshape(-1, 255, BITS // 8).sum(axis=1, dtype=np.uint64)
        ones += lanes.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal bits."""
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))


def compare_edits(docs: DataFrame, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text is the row's text with its last floor(n_chars / 2) code points replaced by the first as many (or
    all) of the next row's, by descending key (null keys last, ties by text); after the last row comes the first.
    Null texts count as empty; other columns, whatever their names, are left out. One range shuffle of the texts: each task walks its range in order, keeping one
    predecessor; the last row of a range meets the first row of the next in a join of one row a range.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    staging = staging or Staging(spark)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = f"key {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def row(text: str, own: bytes, following: str, after: bytes) -> list:
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        fp = fingerprint(edited) if edited != text else own
        return [n, hashlib.sha256(edited.encode()).hexdigest(), own.hex(), fp.hex(), likeness(own, fp), likeness(own, after)]

    def walk(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), None
        schema = None
        for batch in batches:
            schema = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("key", batch.schema.field(0).type), ("n_chars", pa.int64()), *((c, pa.string()) for c in names[2:5]), *((c, pa.float64()) for c in names[5:]), ("text", pa.string())])
            keys, rows = batch.column(0).to_pylist(), []
            for i, x in enumerate(batch.column(1)):
                text = x.as_py() or ""
                fp = fingerprint(text)
                if before is None:
                    rows.append((1, part, keys[i], *[None] * 6, text))
                else:
                    rows.append((0, part, before[0], *row(before[1], before[2], text, fp), None))
                before = keys[i], text, fp
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if before is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((2, part, before[0], *[None] * 6, before[1]), schema)], schema=schema)

    def close(batches: Iterator) -> Iterator:
        for batch in batches:
            d = batch.to_pydict()
            rows = [row(a or "", fingerprint(a or ""), b or "", fingerprint(b or "")) for a, b in zip(d["text"], d["following"])]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("key").desc_nulls_last()
    ranged = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange(n, order).sortWithinPartitions(order, "text")
    walked = staging.put(ranged.mapInArrow(walk, f"kind int, part bigint, {types}, text string"), "walked")
    heads = walked.where("kind = 1").select("part", "key", F.col("text").alias("following"))
    tails = walked.where("kind = 2").select("part", "key", "text")
    ring = heads.select("part", "key").select("part", F.lead("part").over(Window.orderBy(order, F.col("part"))).alias("next"), F.first("part").over(Window.orderBy(order, F.col("part"))).alias("first"))
    ring = ring.select("part", F.coalesce("next", "first").alias("next"))
    ends = tails.join(ring, "part").join(heads.select(F.col("part").alias("next"), "following"), "next").select("key", "text", "following").mapInArrow(close, types)
    return walked.where("kind = 0").select(names).unionByName(ends).withColumnRenamed("key", key)


def within_radius(docs: DataFrame, radius: int = 3, staging: Staging | None = None, fingerprint: str = "fingerprint") -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints, a < b, at most radius bits apart: all of them.

    Of radius + 2 blocks of bits at least two are equal in such a pair, so there is a table for each two blocks, with
    those blocks as its key. Equal fingerprints are one row. A key shared by many is dealt as blocks of fingerprints,
    so that no task holds them all. Null fingerprints have no pairs.
    """
    import pyarrow as pa

    staging = staging or Staging(docs.sparkSession)
    each = 256
    cut = [i * BITS // (radius + 2) for i in range(radius + 3)]
    chosen = list(combinations(range(radius + 2), 2))

    def keys(batches: Iterator) -> Iterator:
        for batch in batches:
            fps, out = batch.column(0).to_pylist(), []
            for fp in fps:
                bits = f"{int(fp, 16):0{BITS}b}"
                out.append([f"{t}:{int('1' + bits[cut[i] : cut[i + 1]] + bits[cut[j] : cut[j + 1]], 2):x}" for t, (i, j) in enumerate(chosen)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], names=["fp", "keys"])

    def pairs(batches: Iterator) -> Iterator:
        for (_, i, j), d in grouped(batches, ["key", "i", "j"]):
            own = [(f, np.frombuffer(bytes.fromhex(f), np.uint64)) for f, k in zip(d["fp"], d["block"]) if k == i]
            other = own if i == j else [(f, np.frombuffer(bytes.fromhex(f), np.uint64)) for f, k in zip(d["fp"], d["block"]) if k == j]
            if not own or not other:
                continue
            right = np.array([x for _, x in other])
            out = []
            for f, x in own:
                far = np.bitwise_count(right ^ x).sum(axis=1)
                out += [(min(f, other[k][0]), max(f, other[k][0]), int(far[k])) for k in np.flatnonzero(far <= radius) if (other[k][0] > f if i == j else other[k][0] != f)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int32()))], names=["a", "b", "distance"])

    fps = docs.select(F.col(fingerprint).alias("fp")).where("fp is not null").distinct()
    keyed = staging.put(fps.mapInArrow(keys, "fp string, keys array<string>").select("fp", F.explode("keys").alias("key")), "keys")
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / each).cast("int").alias("g"))
    # written, so that the join deals both sides anew and can split a hot key
    cells = keyed.join(staging.put(many, "many"), "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("g")).cast("int"))
    cells = cells.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select("key", "fp", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(pairs, "a string, b string, distance int").distinct()
