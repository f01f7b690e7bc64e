"""Word alignment from vectors: links are read off the similarity matrix of a pair's sub-word vectors.

An encoder isn't included; its vectors come as columns, one row for each distinct pair, so the work is a map without a
shuffle. The rules are the published ones: mutual best matches, their iteration, and the matching of the largest weight
(Sabet et al., 2020), and softmax in both directions (Dou and Neubig, 2021).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

METHODS = ("mutual", "iterated", "weight", "softmax")
LINKS = "array<struct<s:int,t:int>>"


def mutual(sim: np.ndarray) -> np.ndarray:
    """Cells that are the best of their row and of their column; the first of equal ones counts."""
    out = np.zeros(sim.shape, bool)
    best = sim.argmax(1)
    rows = np.arange(len(sim))
    out[rows, best] = sim.argmax(0)[best] == rows
    return out


def iterated(sim: np.ndarray, rounds: int = 2, weaker: float = 0.9) -> np.ndarray:
    """Mutual matches, then those of the matrix in which linked rows and columns count less and cells that cross two
    links nothing."""
    out = mutual(sim)
    for _ in range(rounds - 1):
        rows, columns = out.any(1)[:, None], out.any(0)[None, :]
        left = np.where(rows & columns, 0.0, np.where(rows | columns, weaker, 1.0)) * np.maximum(sim, 0.0)
        new = mutual(left) & (left > 0) & ~out
        if not new.any():
            break
        out |= new
    return out


def softmax(sim: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """Cells whose probability is more than `least` among their row and among their column."""

    def share(axis: int) -> np.ndarray:
        e = np.exp(sim - sim.max(axis=axis, keepdims=True))
        return e / e.sum(axis=axis, keepdims=True)

    return (share(1) > least) & (share(0) > least)


def weight(sim: np.ndarray) -> np.ndarray:
    """The one-to-one matching of the largest total similarity, by shortest augmenting paths."""
    turned = len(sim) > sim.shape[1]
    cost = -(sim.T if turned else sim)
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)  # prices; the last column is where paths begin
    for row in range(n):
        owner[m], at = row, m
        least, from_, done = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] >= 0:
            done[at] = True
            gap = cost[owner[at]] - u[owner[at]] - v[:m]
            better = ~done[:m] & (gap < least)
            least[better], from_[better] = gap[better], at
            nearest = int(np.where(done[:m], np.inf, least).argmin())
            step = least[nearest]
            u[owner[done]] += step
            v[done] -= step
            least[~done[:m]] -= step
            at = nearest
        while at != m:
            owner[at], at = owner[from_[at]], from_[at]
    out = np.zeros((n, m), bool)
    for column in range(m):
        if owner[column] >= 0:
            out[owner[column], column] = True
    return out.T if turned else out


def links_of(src: np.ndarray, tgt: np.ndarray, src_word: list[int], tgt_word: list[int], method: str) -> list[tuple[int, int]]:
    """Word links, sorted and distinct, from sub-word vectors and the word that each belongs to. Where a text was cut,
    the words beyond its vectors have no links."""
    n, m = min(len(src), len(src_word)), min(len(tgt), len(tgt_word))
    if not n or not m:
        return []
    a, b = src[:n], tgt[:m]
    if method != "softmax":
        a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
    cells = {"mutual": mutual, "iterated": iterated, "weight": weight, "softmax": softmax}[method](a @ b.T)
    return sorted({(src_word[i], tgt_word[j]) for i, j in zip(*np.nonzero(cells))})


def vector_links(pairs: DataFrame, key: str, method: str = "mutual") -> DataFrame:
    """key and links of pairs(key, src_vecs, tgt_vecs: array<array<double>>, src_word, tgt_word: array<int>). A row
    with a null in these has no links."""
    if method not in METHODS:
        raise ValueError(f"no method {method}")
    import pyarrow as pa

    kind = pairs.select(key).schema[0].dataType.simpleString()
    out_type = pa.list_(pa.struct([("s", pa.int32()), ("t", pa.int32())]))

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns[1:])):
                found = [] if any(x is None for x in row) else links_of(np.array(row[0], float), np.array(row[1], float), row[2], row[3], method)
                out.append([{"s": s, "t": t} for s, t in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, out_type)], names=[key, "links"])

    return pairs.select(key, "src_vecs", "tgt_vecs", "src_word", "tgt_word").mapInArrow(run, f"`{key}` {kind}, links {LINKS}")
