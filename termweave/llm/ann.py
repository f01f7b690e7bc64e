"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample; every vector is then assigned to its list and coded. There are
about as many lists as the square root of the vectors. A query first visits as many as the sample's own neighbours need
for the target recall: few where vectors cluster, most where they don't. What a sample says of queries unlike it is only
a guess, so a query then visits every other list that, by its radius, can hold a vector nearer than the k-th it has.
Lists are stored, and asked, in blocks of bounded size, so a list that holds a third of all vectors is many tasks. In a
block the asymmetric distance tables of a query and what each code is off by give bounds; only vectors that these can't
rule out are measured, exactly, on the original vectors. The blocks' best meet in a top-k by query: it is the true one,
and the fit decides only how much is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termweave.llm.common import Staging

#: Of bounds, against their rounding.
SLACK = 1e-9


def kmeans(x: np.ndarray, k: int, steps: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of at most k groups; empty groups take the vectors farthest from their centre."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(steps):
        d = (c * c).sum(1) - 2 * x @ c.T
        a = d.argmin(1)
        n = np.bincount(a, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, a, x)
        c[n > 0] = s[n > 0] / n[n > 0, None]
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), a] + (x * x).sum(1)), kind="stable")[: (n == 0).sum()]
            c[n == 0] = x[far]
    return c


@dataclass
class Index:
    centroids: np.ndarray  # lists x dimensions, of unit vectors
    books: np.ndarray  # parts x codes x dimensions of a part

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each vector, nearest first."""
        d = (self.centroids**2).sum(1) - 2 * x @ self.centroids.T
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def decoded(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.centroids[at] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        r = (x - self.centroids[at]).reshape(len(x), len(self.books), -1)
        return np.stack([((b * b).sum(1) - 2 * r[:, j] @ b.T).argmin(1) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def fit(x: np.ndarray, lists: int, parts: int) -> Index:
    """The index of unit vectors: centroids, and codebooks of the residuals."""
    centroids = kmeans(x, min(lists, len(x)))
    index = Index(centroids, np.zeros((1, 1, x.shape[1])))
    r = (x - centroids[index.lists(x, 1)[:, 0]]).reshape(len(x), parts, -1)
    return Index(centroids, np.stack([kmeans(r[:, j], min(256, len(x)), 8) for j in range(parts)]))


def visits_needed(index: Index, x: np.ndarray, k: int, recall: float, asked: int = 400) -> int:
    """How many lists hold the target share of the k nearest of the sample's first vectors, among the sample."""
    if len(x) < 2:
        return 1
    q = x[:asked]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    found = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    own = index.lists(x, 1)[:, 0]
    place = np.argsort(index.lists(q, len(index.centroids)), axis=1)  # of each list, in the order of visits
    at = np.sort(np.take_along_axis(place, own[found], axis=1), axis=None)
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def search(vectors: DataFrame, queries: "F.Column", k: int = 5, lists: int | None = None, probe: int | None = None, parts: int = 16, recall: float = 0.98, sample: int = 20_000, block: int = 4096, staging: Staging | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets `queries` its k nearest other rows found.

    Nearness is cosine in double precision on the original vectors; ties go to the smaller id. A vector that is null,
    zero or holds a null or non-finite component takes no part, nor does a null id. Vectors of different lengths have
    no cosine: each length is searched by itself. A repeated id is a query, and a candidate, for each of its rows.
    Dimensions are filled with zeros to a multiple of `parts`. lists and probe (how many a query visits before it knows
    which others can matter): chosen from the number of vectors and from the sample if not given. Other columns,
    whatever their names, are left out.
    """
    spark = vectors.sparkSession
    staging = staging or Staging(spark)
    v = F.col("v")
    good = vectors.withColumn("__asks", F.coalesce(queries, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"), F.col("__asks").alias("is_query"))
    good = good.where("id is not null and v is not null and size(v) > 0").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists(v, lambda x: x != 0))
    good = staging.put(good.select(F.monotonically_increasing_id().alias("row"), "id", "v", "is_query"), "vectors")
    out = None
    for r in good.groupBy(F.size("v").alias("dims")).count().orderBy("dims").collect():  # a row a length
        n = lists or max(1, round(np.sqrt(r["count"])))
        found = _search(good.where(F.size("v") == r["dims"]), r["dims"], k, n, probe, parts, recall, sample, block, staging)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double") if out is None else out


def _search(good: DataFrame, dims: int, k: int, lists: int, probe: int | None, parts: int, recall: float, sample: int, block: int, staging: Staging) -> DataFrame:
    import pyarrow as pa

    spark, pad = good.sparkSession, -dims % parts
    whole = good.withColumn("v", F.concat("v", F.array(*[F.lit(0.0)] * pad))) if pad else good
    # at most `sample` vectors: those with the smallest hash of their id
    taken = whole.withColumn("h", F.xxhash64("id")).orderBy("h", "id", "row").limit(sample).select("v").toArrow()
    x = unit(taken.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims + pad))
    index = fit(x, lists, parts)
    probe = min(probe or visits_needed(index, x, k, recall), len(index.centroids))
    shared = spark.sparkContext.broadcast(index)  # lists and codebooks: the root of the vectors, and fixed sizes
    del x, taken

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dims + pad)

    def assign(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column(2)))
                at = shared.value.lists(x, 1)[:, 0]
                codes = shared.value.codes(x, at)
                far, off = (np.sqrt(((x - y) ** 2).sum(1)) for y in (shared.value.centroids[at], shared.value.decoded(codes, at)))
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(far), pa.array(off)], names=["list", "row", "id", "v", "code", "far", "off"])

    def visit(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                to = shared.value.lists(unit(matrix(batch.column(2))), probe)
                rows = pa.array(np.repeat(np.arange(batch.num_rows), to.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel(), pa.int32()), *(c.take(rows) for c in batch.columns)], names=["list", "row", "id", "v", "least"])

    def visit_rest(batches: Iterator) -> Iterator:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                q, index = unit(matrix(part.column(2))), shared.value
                away = np.sqrt(np.maximum(0, 1 + (index.centroids**2).sum(1) - 2 * q @ index.centroids.T))
                can = away - radius.value <= np.sqrt(np.maximum(0, 2 - 2 * part.column(3).to_numpy()))[:, None] + SLACK
                np.put_along_axis(can, index.lists(q, probe), False, axis=1)
                rows, to = np.nonzero(can)
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(c.take(rows) for c in part.columns)], names=["list", "row", "id", "v", "least"])

    coded = staging.put(whole.select("row", "id", "v").mapInArrow(assign, "list int, row bigint, id bigint, v array<double>, code binary, far double, off double"), f"coded_{dims}")
    # a row a list: the root of the vectors
    stored = staging.put(coded.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("far").alias("far")), f"lists_{dims}")
    far = np.full(len(index.centroids), -np.inf)
    for r in stored.collect():
        far[r["list"]] = r["far"]
    radius = spark.sparkContext.broadcast(far)
    asking = whole.where("is_query").select("row", "id", "v")
    visited = "list int, row bigint, id bigint, v array<double>, least double"

    def dealt(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
        at = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        return rows.join(F.broadcast(sizes), "list").withColumn(own[0], at).withColumn(other[0], F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("blocks", "askers")

    def look(asked: pa.Table, stored: pa.Table) -> pa.Table:
        out = {"query": [], "query_id": [], "vec_id": [], "score": []}
        if asked.num_rows and stored.num_rows:
            index = shared.value
            order = np.lexsort((stored.column("row").to_numpy(), stored.column("id").to_numpy()))
            rows, ids, x, off = stored.column("row").to_numpy()[order], stored.column("id").to_numpy()[order], matrix(stored.column("v").combine_chunks())[order], stored.column("off").to_numpy()[order]
            codes = np.frombuffer(b"".join(stored.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            raw, least = matrix(asked.column("v").combine_chunks()), asked.column("least").to_numpy()
            q, norms, n = unit(raw), np.sqrt((x * x).sum(1)), min(len(ids), k + 1)  # one more, as the query may be among them
            for low in range(0, len(q), 256):
                part = q[low : low + 256]
                # cosine of a unit query with centre + residual: a table of dot products for each part
                near = np.repeat((part @ index.centroids[stored.column("list")[0].as_py()])[:, None], len(ids), axis=1)
                for j, book in enumerate(index.books):
                    near += (part.reshape(len(part), len(index.books), -1)[:, j] @ book.T)[:, codes[:, j]]
                # the true cosine is off by as much as the vector from its code, at most
                sure = np.partition(near - off, len(ids) - n, axis=1)[:, len(ids) - n]
                can = near + off >= np.maximum(sure, least[low : low + 256])[:, None] - SLACK
                some = np.flatnonzero(can.any(axis=0))
                m = min(len(some), n)
                if not m:
                    continue
                close = np.where(can[:, some], part @ (x[some] / norms[some, None]).T, -2)
                enough = np.partition(close, len(some) - m, axis=1)[:, len(some) - m] - SLACK
                for i in range(len(part)):
                    own, vec = asked.column("row")[low + i].as_py(), raw[low + i]
                    best = some[np.flatnonzero((close[i] >= enough[i]) & can[i, some])]
                    best = best[rows[best] != own]
                    score = (x[best] * vec).sum(1) / (norms[best] * np.sqrt((vec * vec).sum()))
                    first = np.lexsort((ids[best], -score))[:k]
                    out["query"] += [own] * len(first)
                    out["query_id"] += [asked.column("id")[low + i].as_py()] * len(first)
                    out["vec_id"] += ids[best][first].tolist()
                    out["score"] += score[first].tolist()
        return pa.table([pa.array(c, pa.float64() if name == "score" else pa.int64()) for name, c in out.items()], names=list(out))

    keys = ["list", "b", "a"]
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")

    def asked(visits: DataFrame) -> DataFrame:
        sizes = stored.select("list", "blocks").join(visits.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("askers")), "list")
        return dealt(visits, sizes, "askers", "blocks").groupBy(*keys).cogroup(dealt(coded.drop("far"), sizes, "blocks", "askers").groupBy(*keys)).applyInArrow(look, "query bigint, query_id bigint, vec_id bigint, score double")

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "query_id", "rank", "vec_id", "score")

    found = best(asked(staging.put(asking.withColumn("least", F.lit(-1.0)).mapInArrow(visit, visited), f"visits_{dims}")))
    if probe < len(index.centroids):
        found = staging.put(found, f"found_{dims}")
        kth = found.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("least"))
        rest = asking.join(kth, "row", "left").select("row", "id", "v", F.coalesce("least", F.lit(-1.0)).alias("least"))
        more = asked(staging.put(rest.mapInArrow(visit_rest, visited), f"rest_{dims}"))
        found = best(found.drop("rank").unionByName(more))
    return found.drop("query")
