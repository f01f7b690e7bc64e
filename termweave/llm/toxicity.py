"""Toxicity: a linear classifier over words and word beginnings, regularised by identity-term counterfactuals.

A text's features are its different words (lower case, outer punctuation dropped), each with its first 3 to 6 letters.
Logistic loss, an L1 penalty that leaves only telling features, and for every training text that holds an identity
term a penalty on the squared change of its score when the term is swapped in it for others of its group: naming a
group must not move the score. Training is on a bounded, documented sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Neutral names of groups; terms of one line may be swapped for each other. A parameter.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants"),
    ("gay", "lesbian", "bisexual", "transgender", "straight", "queer", "heterosexual", "homosexual"),
    ("women", "men", "girls", "boys", "woman", "man", "female", "male"),
    ("black", "white", "asian", "african", "american", "european", "latino", "arab", "indian", "chinese", "mexican"),
    ("immigrant", "refugee", "citizen", "foreigner", "immigrants", "refugees", "citizens", "foreigners"),
    ("deaf", "blind", "disabled", "autistic", "old", "young", "elderly"),
    ("frauen", "männer", "juden", "muslime", "christen", "ausländer"),
    ("femmes", "hommes", "juifs", "musulmans", "chrétiens", "étrangers"),
    ("mujeres", "hombres", "judíos", "musulmanes", "cristianos", "extranjeros"),
)
SPACE = 1 << 22
EDGES = ".,;:!?\"'()[]{}<>|*_-–—…«»“”‘’¿¡"


def features(word: str) -> tuple[int, ...]:
    """Hashed features of a word as it stands in a text."""
    w = word.strip(EDGES)
    if not w:
        return ()
    return tuple(zlib.crc32(x.encode()) % SPACE for x in ("=" + w, *("^" + w[:n] for n in range(3, 7) if n <= len(w))))


class Features(dict):
    LIMIT = 30_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        f = features(word)
        if len(self) < self.LIMIT and len(word) < 60:
            self[word] = f
        return f


def words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


class Model:
    """Weights of the features that matter, and the bias."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.known = weights, bias, {}

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.weights, self.bias = state
        self.known = {}

    def score(self, text: str | None) -> float:
        z, known, get = self.bias, self.known, self.weights.get
        for w in words(text):
            v = known.get(w)
            if v is None:
                v = sum(get(f, 0.0) for f in features(w))
                if len(known) < 80_000 and len(w) < 60:
                    known[w] = v
            z += v
        return float(1 / (1 + np.exp(-max(-50.0, min(50.0, z)))))


Swap = tuple[int, np.ndarray, np.ndarray]  # a row, and the features that its text loses and gains by a swap


def largest(column: np.ndarray, at: np.ndarray, value: np.ndarray, n: int, mean: np.ndarray, steps: int = 40) -> float:
    """The largest eigenvalue of X'X of a sparse matrix of n rows less its columns' means, by power iteration, with 5 %
    to spare."""
    m, out = len(mean), 0.0
    v = np.random.default_rng(1).normal(size=m)
    for _ in range(steps):
        v = v / max(np.sqrt(v @ v), 1e-300)
        x = np.bincount(at, value * v[column], n) - mean @ v
        v = np.bincount(column, value * x[at], m) - mean * x.sum()
        out = float(np.sqrt(v @ v))
    return 1.05 * out


def fit(rows: list[tuple[np.ndarray, int]], swaps: list[Swap], select: int = 4096, l1: float = 2e-4, swap: float = 1.0, steps: int = 300) -> Model:
    """rows: (feature numbers, label). swaps: rows with an identity term swapped for another of its group.

    Minimises, over the `select` features that differ most between labels, the mean logistic loss, an L1 penalty, and
    `swap` times the mean over the rows of the squared change of the score by a swap (a row's swaps count as one row).
    Accelerated proximal gradient steps of one length, from the largest eigenvalues of the features and their swaps.
    """
    y = np.array([b for _, b in rows], float)
    if not len(rows) or not 0 < y.sum() < len(y):
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.05
        return Model({}, float(np.log(rate / (1 - rate))))
    flat = np.concatenate([f for f, _ in rows])
    at = np.repeat(np.arange(len(rows), dtype=np.int32), [len(f) for f, _ in rows])
    counts = np.bincount(flat, minlength=SPACE)
    unique = np.flatnonzero(counts)
    pos, all_ = np.bincount(flat[y[at] == 1], minlength=SPACE)[unique].astype(float), counts[unique]
    del counts
    p, q = y.sum(), len(y) - y.sum()
    diff = (pos / p - (all_ - pos) / q) / np.sqrt((all_ / len(y)) * (1 - np.minimum(all_, len(y) - 0.5) / len(y)) * (1 / p + 1 / q) + 1e-12)
    ok = all_ >= 3
    best = np.argsort(-np.where(ok, np.abs(diff), -1), kind="stable")[:select]
    moved = np.concatenate([np.zeros(0, np.int64), *(f.astype(np.int64) for _, lost, won in swaps for f in (lost, won))])
    chosen = np.union1d(unique[best[ok[best]]], moved)
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    column = place[flat]
    kept = column >= 0
    column, at = column[kept], at[kept]
    del flat, kept
    own = np.array([r for r, _, _ in swaps], np.int64)
    of = np.repeat(np.arange(len(swaps)), [len(lost) + len(won) for _, lost, won in swaps])
    sign = np.concatenate([np.zeros(0), *(np.repeat([-1.0, 1.0], [len(lost), len(won)]) for _, lost, won in swaps)])
    delta = place[moved]
    del place
    share = swap / len(rows) / np.maximum(np.bincount(own, minlength=len(rows)), 1)[own]  # of each swap
    n, m, one = len(rows), len(chosen), np.ones(len(column))
    mean = np.bincount(column, minlength=m) / n  # features less their means: the bias bends by itself, and steps are longer
    bend = largest(column, at, one, n, mean) / n
    bend_swap = largest(delta, of, sign, len(swaps), np.zeros(m)) / n if len(swaps) else 0.0
    rate = 1 / max(0.25 * bend + bool(len(swaps)) * swap * (0.5 * bend + 0.5 * bend_swap), 1e-9)
    rate_b = 1 / (0.25 + bool(len(swaps)) * swap * 0.5)

    def sigmoid(z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    w, bias, look, look_b, t = np.zeros(m), float(np.log(p / q)), np.zeros(m), float(np.log(p / q)), 1.0
    for _ in range(steps):
        z = look_b + np.bincount(at, look[column], n) - mean @ look
        score = sigmoid(z)
        err, more = (score - y) / n, 0.0
        if len(swaps):
            other = sigmoid(z[own] + np.bincount(of, sign * look[delta], len(swaps)))
            gap = 2 * share * (score[own] - other)
            slope = gap * other * (1 - other)
            err = err + np.bincount(own, gap * score[own] * (1 - score[own]) - slope, n)
            more = -np.bincount(delta, sign * slope[of], m)
        grad = np.bincount(column, err[at], m) - mean * err.sum() + more
        new = look - rate * grad
        new = np.sign(new) * np.maximum(np.abs(new) - l1 * rate, 0)
        new_b, t_new = look_b - rate_b * err.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b, w, bias, t = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - bias), new, new_b, t_new
    bias -= mean @ w
    return Model({int(f): float(v) for f, v in zip(chosen, w) if v}, float(bias))


def swapped(own: set[str], groups: dict[str, tuple[str, ...]]) -> Iterator[tuple[set[int], set[int]]]:
    """What a text's features lose and gain by each swap of a term that its words hold."""
    bare = {}
    for word in own:
        if (t := word.strip(EDGES)) in groups:
            bare.setdefault(t, []).append(word)
    if not bare:
        return
    before = {f for word in own for f in features(word)}
    for a in sorted(bare):
        rest = {f for word in own if word not in bare[a] for f in features(word)}
        for b in groups[a]:
            if a != b:
                after = rest | set(features(b))
                yield before - after, after - before


def train(docs: DataFrame, labels: DataFrame, sample: int = 10_000, identity: tuple = IDENTITY, swap: float = 1.0, text: str = "text", key: str = "doc_id", label: str = "toxic") -> Model:
    """Fits on at most `sample` labelled rows, those whose key has the smallest md5. Rows with a null key or label
    teach nothing; a key labelled twice, or that several rows have, counts as often. Null and empty texts teach the
    rate of their labels; very long texts are whole sets of words; other columns, whatever their names, are left out."""
    import pyarrow as pa

    groups = {t: g for g in identity for t in g}
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    chosen = chosen.withColumn("m", F.md5(F.col("k").cast("string"))).orderBy("m", "k", "y").limit(sample).select("k", "y")

    def extract(batches: Iterator) -> Iterator:
        known = Features()
        packed = lambda fs: np.array(sorted(fs), np.uint32).tobytes()
        for batch in batches:
            out, swaps = [], []
            for x in batch.column(1):
                own = words(x.as_py())
                out.append(np.unique(np.fromiter((f for w in own for f in known[w]), np.uint32)).tobytes())
                swaps.append([packed(fs) for pair in swapped(own, groups) for fs in pair])  # lost, won, lost, won, ...
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(swaps, pa.list_(pa.binary()))], names=["y", "f", "swaps"])

    # the sample is at most `sample` rows of two numbers, whatever the corpus
    joined = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k").select("y", "text")
    found = joined.mapInArrow(extract, "y int, f binary, swaps array<binary>").toArrow().to_pylist()
    found.sort(key=lambda r: (r["y"], r["f"], r["swaps"]))
    read = lambda data: np.frombuffer(data, np.uint32)
    swaps = [(i, read(r["swaps"][j]), read(r["swaps"][j + 1])) for i, r in enumerate(found) for j in range(0, len(r["swaps"]), 2)]
    return fit([(read(r["f"]), 1 if r["y"] else 0) for r in found], swaps, swap=swap)


def scorer(spark: SparkSession, model: Model):
    """The model as a column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)  # a few thousand weights at most

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, score in (0, 1), predicted (1 if score >= threshold, else 0) of every row; no shuffle. A null text scores
    as an empty one; rows with equal or null keys stay rows of their own; other columns are left out."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights at most
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.score(x.as_py()) for x in batch.column(1)], pa.float64())], names=[key, "score"])

    out = docs.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"`{key}` {kind}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
