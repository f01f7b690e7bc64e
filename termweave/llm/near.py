"""Candidates and their exact verification, shared by the near-copy operators.

What collides is compared by signatures first, collision by collision; only pairs that these don't rule out join
groups, so unrelated texts that collide by chance don't grow together. A group is then compared completely and exactly.
Both work in cells of two blocks of bounded size, so a group of any size is many tasks and no pair leaves a cell: a
cell returns for each text its links, and a spanning forest of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import BLOCK_CHARS, BLOCK_DOCS, Staging, grouped


def cells(members: DataFrame, staging: Staging, name: str = "sizes", most: int | None = None) -> DataFrame:
    """members(id, grp, chars, ...) -> a row for each cell (grp, i, j) that the member is in, with its block (of about
    `most` members). The sizes are written, so that the join with them can split a large group."""
    sizes = members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("chars").alias("total")).where("m > 1")
    sizes = sizes.select("grp", F.greatest(F.lit(1), F.ceil(F.col("m") / (most or BLOCK_DOCS)), F.ceil(F.col("total") / BLOCK_CHARS)).cast("int").alias("g"))
    cut = members.join(staging.put(sizes, name), "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    return cut.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumns({"i": F.least("block", "o"), "j": F.greatest("block", "o")}).drop("o", "g", "chars")


def overlaps(sets: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted distinct hashes."""
    out = np.zeros((len(sets), len(others)), np.float32)
    both = sets if sets is others else sets + others
    if not sum(map(len, both)):
        return out
    values, back, n = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    column = np.cumsum(n > 1) - 1  # what only one text holds is in no intersection
    row = np.repeat(np.arange(len(both)), [len(s) for s in both])
    ok = n[back] > 1
    row, column = row[ok], column[back[ok]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = 4096
    for at in range(0, int(n[n > 1].size), step):
        a, z = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(both), step), np.float32)
        x[row[a:z], column[a:z] - at] = 1
        out += x[: len(sets)] @ (x if sets is others else x[len(sets) :]).T
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def alike(dealt: DataFrame, low: float) -> DataFrame:
    """dealt: rows of cells(), with sig (32-bit MinHash values, one after another) -> edges (a, b): a spanning forest, in
    each cell, of the pairs of which a share of at least `low` of the values is equal."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for (_, i, j), d in grouped(batches, ["grp", "i", "j"]):
            sigs = {node: (block, sig) for node, block, sig in zip(d["id"], d["block"], d["sig"])}
            left = sorted(k for k, (block, _) in sigs.items() if block == i)
            right = left if i == j else sorted(k for k, (block, _) in sigs.items() if block == j)
            if not left or not right or len(sigs) < 2:
                continue
            a, b = (np.frombuffer(b"".join(sigs[k][1] for k in side), "<u4").reshape(len(side), -1) for side in (left, right))
            forest, number, out = Forest(len(sigs)), {k: x for x, k in enumerate(sorted(sigs))}, []
            for at in range(0, len(left), 32):
                same = (a[at : at + 32, None, :] == b[None, :, :]).mean(axis=2)
                for x, y in zip(*np.nonzero(same >= low)):
                    if left[at + x] != right[y] and forest.join(number[left[at + x]], number[right[y]]):
                        out.append((left[at + x], right[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    return dealt.select("grp", "i", "j", "id", "block", "sig").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, "a bigint, b bigint").distinct()


def verify(dealt: DataFrame, sets_of, similar, id_type: str = "bigint") -> DataFrame:
    """dealt: rows of cells(), with text, n (copies of the text) and id -> (id, other, links).

    sets_of(texts) gives each text's set, or None for one that isn't meant; similar(common, a, b, texts) a matrix of
    verdicts from the sizes of the intersections and of the sets. A row with other null gives links that id has in
    the cell, counting copies; one with links 0 an edge of the forest.
    """
    import pyarrow as pa

    kind = {"bigint": pa.int64(), "string": pa.string()}[id_type]

    def run(batches: Iterator) -> Iterator:
        for (_, i, j), d in grouped(batches, ["grp", "i", "j"]):
            rows = {}
            for node, block, n, text, mark in zip(d["id"], d["block"], d["n"], d["text"], d["mark"]):
                if node not in rows and (s := sets_of(text, mark)) is not None:
                    rows[node] = (block, n, s, text)
            left = sorted(k for k, r in rows.items() if r[0] == i)
            right = left if i == j else sorted(k for k, r in rows.items() if r[0] == j)
            if not left or not right or len(rows) < 2:
                continue
            a = [rows[k][2] for k in left]
            b = a if i == j else [rows[k][2] for k in right]
            yes = similar(overlaps(a, b), np.array([len(x) for x in a], float)[:, None], np.array([len(x) for x in b], float)[None, :], [rows[k][3] for k in left], [rows[k][3] for k in right])
            if i == j:
                np.fill_diagonal(yes, False)
            if not yes.any():
                continue
            copies = np.array([rows[k][1] for k in right], np.int64)
            out = [(left[x], None, int(n)) for x, n in enumerate(yes @ copies) if n]
            if i != j:
                own = np.array([rows[k][1] for k in left], np.int64)
                out += [(right[x], None, int(n)) for x, n in enumerate(yes.T @ own) if n]
            number = {k: x for x, k in enumerate(sorted(rows))}
            forest = Forest(len(number))
            for x, y in zip(*np.nonzero(yes)):
                if forest.join(number[left[x]], number[right[y]]):
                    out.append((left[x], right[y], 0))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], kind), pa.array([r[2] for r in out], pa.int64())], names=["id", "other", "links"])

    return dealt.select("grp", "i", "j", "id", "block", "n", "text", "mark").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(run, f"id {id_type}, other {id_type}, links bigint")
