"""Shared pieces: staged tables in the folder all executors share, hashing, connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Candidate groups up to this size are compared in one task; larger ones are cut into blocks.
BLOCK_DOCS, BLOCK_CHARS = 256, 4_000_000


#: Arrow batches hold whole texts, in the JVM and in Python: Spark's own bounds, and ours in their place.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


#: On a local file system, Hadoop writes a checksum file beside each file and forks `chmod` for both; until its own
#: program runs, the child shares all memory of an executor. The class below writes the files alone and forks nothing.
#: For staged tables only; other file systems don't read these options.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def bound_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches for the session, where it has Spark's default."""
    for name, (default, ours) in ARROW.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            base = "file://" + tempfile.mkdtemp(prefix="termweave-")
            spark.conf.set("spark.checkpoint.dir", base)
        else:
            base = spark.conf.get("spark.sql.warehouse.dir") + "/termweave_staging"
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder goes with it
        pass


def _end(spark: SparkSession, root: str, tables: list[str]) -> None:
    try:
        for name in tables:
            spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has ended, and its catalogue with it
        pass
    _delete(spark, root)


class Staging:
    """Tables written to the shared folder: they cut the lineage and outlive lost executors.

    Tables still standing at the end of the session are deleted then; drop() deletes earlier.
    """

    def __init__(self, spark: SparkSession):
        bound_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        atexit.register(_end, spark, self.root, self.tables)

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").options(compression=compression, **PLAIN_FILES).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def put_by(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """A table in buckets by a column, so that joins on it deal nothing anew. A task writes a file for each bucket
        of its rows: they should be few, or dealt by the column before."""
        own = f"staged_{self.root.rsplit('-', 1)[-1]}_{name}"
        df.write.mode("overwrite").options(compression="zstd", path=f"{self.root}/{name}", **PLAIN_FILES).bucketBy(buckets, column).sortBy(column).saveAsTable(own)
        self.tables.append(own)
        return self.spark.table(own)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")

    def collect_garbage(self) -> None:
        """Shuffle files go when the driver has collected the frames that made them; between large steps that should
        not wait until its memory is full."""
        gc.collect()
        self.spark.range(1).count()  # the scheduler holds the last job until another one ends
        time.sleep(1)  # listeners hold the last plan until they have heard of its end
        self.spark.sparkContext._jvm.System.gc()


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (wraps around)."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * MIX2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to a number of words."""

    LIMIT = 80_000  # about 16 MB a worker

    def __missing__(self, word: str) -> int:
        from xxhash import xxh3_64_intdigest

        h = xxh3_64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


WORDS = WordHashes()


#: Keys of XXH3's 64-bit hash for inputs of 1 to 3, 4 to 8 and 9 to 16 bytes, folded from its fixed secret.
KEYS = tuple(np.uint64(x) for x in (0x0000000087275A9B, 0xC73AB174C5ECD5A2, 0x6782737BEA4239B9, 0xAF56BC3B0996523A))


def _folded(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Both halves of the 128-bit products, xor-ed."""
    half, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    a0, a1, b0, b1 = a & low, a >> half, b & low, b >> half
    p, q = a0 * b0, a1 * b0
    r = (p >> half) + (q & low) + a0 * b1
    return (q >> half) + (r >> half) + a1 * b1 ^ (r << half | p & low)


def hashes_of(data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxh3_64_intdigest of pieces of data, none of them empty, by XXH3's rules for short inputs; pieces of more than 16
    bytes are hashed one by one."""
    from xxhash import xxh3_64_intdigest

    padded = data + bytes(8)
    four, eight = (np.ndarray(len(data) + 1, kind, padded, strides=(1,)) for kind in ("<u4", "<u8"))  # read from any byte on
    out, u = np.empty(len(starts), np.uint64), np.uint64
    with np.errstate(over="ignore"):
        some = np.flatnonzero(sizes <= 3)
        at, n = starts[some], sizes[some]
        one = np.frombuffer(data, np.uint8)
        h = (one[at].astype(u) << u(16) | one[at + (n >> 1)].astype(u) << u(24) | one[at + n - 1] | n.astype(u) << u(8)) ^ KEYS[0]
        h = (h ^ h >> u(33)) * u(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> u(29)) * u(0x165667B19E3779F9)
        out[some] = h ^ h >> u(32)
        some = np.flatnonzero((sizes >= 4) & (sizes <= 8))
        at, n = starts[some], sizes[some]
        h = (four[at].astype(u) << u(32)) + four[at + n - 4] ^ KEYS[1]
        h ^= (h << u(49) | h >> u(15)) ^ (h << u(24) | h >> u(40))
        h *= u(0x9FB21C651E98DF25)
        h = (h ^ (h >> u(35)) + n.astype(u)) * u(0x9FB21C651E98DF25)
        out[some] = h ^ h >> u(28)
        some = np.flatnonzero((sizes >= 9) & (sizes <= 16))
        at, n = starts[some], sizes[some]
        low, high = eight[at] ^ KEYS[2], eight[at + n - 8] ^ KEYS[3]
        h = n.astype(u) + low.byteswap() + high + _folded(low, high)
        h = (h ^ h >> u(37)) * u(0x165667919E3779F9)
        out[some] = h ^ h >> u(32)
    for i in np.flatnonzero(sizes > 16).tolist():
        out[i] = xxh3_64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return out


#: Bytes that part words, as str.split() knows ASCII's.
GAPS = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def words_of(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of x.lower().split() of each text x: bytes that hold them, where each starts and how many bytes it has,
    text after text, and the texts' numbers of words."""
    parts = [(t if t.isascii() else " ".join(t.split())).encode() for t in map(str.lower, texts)]
    data = b" ".join([*parts, b""])
    gap = np.concatenate(([True], GAPS[np.frombuffer(data, np.uint8)]))
    turns = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = np.cumsum([0, *(len(p) + 1 for p in parts)]), turns[1::2]
    return data, turns[::2], ends - turns[::2], np.diff(np.searchsorted(turns[::2], starts))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; one hash of all words if there are fewer than k; none for none."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = h[: n - k + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out *= GOLDEN
            out += h[j : n - k + 1 + j]
        return mix64(out + np.uint64(k))


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of the runs of k lower-case words of a text."""
    return np.unique(window_hashes(WORDS.of((text or "").lower().split()), k))


def grouped(batches: Iterator, keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """Runs of rows with equal keys in a partition sorted by them, as (key, columns)."""
    key, cols = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.to_pydict()
        ks = list(zip(*(data[k] for k in keys)))
        start = 0
        for i in range(1, len(ks) + 1):
            if i < len(ks) and ks[i] == ks[start]:
                continue
            part = {c: v[start:i] for c, v in data.items()}
            if ks[start] == key:
                for c, v in part.items():
                    cols[c].extend(v)
            else:
                if key is not None:
                    yield key, cols
                key, cols = ks[start], part
            start = i
    if key is not None:
        yield key, cols


def components(edges: DataFrame, staging: Staging, name: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b); root is the smallest node of its component.

    Alternates large-star and small-star steps. The smallest neighbours are written before each join with them, so the
    join deals both sides anew and a node with very many neighbours can be split. Labels never leave the executors;
    a lost executor costs one step at most.
    """

    def least(e: DataFrame) -> DataFrame:
        return e.groupBy("u").agg(F.min("v").alias("m"))

    e = staging.put(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}_0",
    )
    single = False  # whether no node has two smaller neighbours
    for k in range(1, most_rounds + 1):
        low = e.withColumnRenamed("v", "m") if single else staging.put(least(e), f"{name}_low_{k}")
        # large star: an edge moves from its smaller end to that end's smallest neighbour
        moved = e.join(low.select(F.col("u").alias("v"), "m"), "v", "left").groupBy("u", F.coalesce("m", "v").alias("v")).agg(F.max(F.col("m").isNotNull()).alias("moved"))
        large = staging.put(moved, f"{name}_large_{k}")
        n, any_moved = large.agg(F.count("*"), F.max("moved")).first()
        if not any_moved and (single or low.count() == n):  # stars already
            break
        large = large.select("u", "v")
        m = staging.put(least(large), f"{name}_m_{k}")
        single = m.count() == n
        if single:
            e = large
            continue
        # small star: a node's smaller neighbours get its smallest one
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(m.withColumnRenamed("m", "v")).distinct()
        e = staging.put(small, f"{name}_{k}")
        staging.drop(f"{name}_{k - 1}", f"{name}_low_{k}", f"{name}_large_{k}", f"{name}_m_{k}")
    else:
        raise RuntimeError(f"{name}: no end after {most_rounds} rounds")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
