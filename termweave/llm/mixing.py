"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed to cells (source, language, topic). Raking scales the cells until their sums meet the target
shares of each of the three marginals; a cell's factor is the weight of its tokens. Documents are then drawn
independently by probabilities that are raked once more, from the budget's share of the weights on, with 1 as their
bound: what cells can't give beyond all they have is made up by others of the same source, language or topic, within
bounds, as such targets can contradict each other. One scale then meets the budget. The draw is a hash of the document's key and text, so it is the same in every run and after every lost executor.

A cell's weight is the product of a factor for each of its values. The factors, a number a value, are kept on the
driver; the cells' sums by value are worked out there or, where the cells are many, by the executors: by the same
steps to the same end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, WORDS, Staging, hashes_of, mix64, words_of

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: shares to this power. 1 keeps them, 0 makes all equal. A parameter.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.5}
MISSING = "(missing)"
SPACE = 4096
#: Texts tried for each first centre; the whole numbers that values are summed in; texts in a row of a pass; texts whose
#: cosines are taken at once; numbers in a row of a pass's sums; letters whose words are counted at once; and bytes of
#: values that a task of a pass reads, where there are more tasks than cores.
TRIES, UNIT, BLOCK, NEAR, SLICE, RUN, PASS = 8, float(1 << 20), 16, 128, 1024, 400_000, 32 << 20
#: Rounds of raking, if the sums don't stand still before; of calibration; and how far calibration may move a value's
#: probabilities from its share of the weights, either way. Parameters.
ROUNDS, AGAIN, REACH = 500, 30, 4.0


class Counts(NamedTuple):
    """Hashed words of texts, one text after another: places, how often each occurs, bounds of the texts, and a hash of
    each text's words."""

    at: np.ndarray
    n: np.ndarray
    bounds: np.ndarray
    mark: np.ndarray


class Topics:
    """Centres of topics among hashed words; a text's topic is the centre nearest to its words by cosine."""

    def __init__(self, centres: np.ndarray, weights: np.ndarray):
        self.centres, self.weights = centres, weights

    def of(self, counts: tuple[np.ndarray, np.ndarray]) -> int:
        at, n = counts
        return int((self.centres[:, at] @ (self.weights[at] * np.log1p(n))).argmax()) if len(at) and len(self.centres) else 0

    def of_all(self, part: Counts) -> np.ndarray:
        """The same for many texts at once."""
        out = np.zeros(len(part.bounds) - 1, np.int32)
        which, at, v, starts, _ = vectors(part, self.weights)
        if len(which) and len(self.centres):
            out[which] = cosines(self.centres, at, v, starts).argmax(1)
        return out


#: word -> its place among the hashed words, remembered up to a number of words.
PLACES: dict[str, int] = {}


def places_of(words: list[str]) -> np.ndarray:
    """Places of words among the hashed ones; those not remembered are hashed together."""
    from xxhash import xxh3_64_intdigest

    out = np.fromiter(map(PLACES.get, words, repeat(-1)), np.int32, len(words))
    new = np.flatnonzero(out < 0)
    if len(new):
        others = [words[i] for i in new.tolist()]
        out[new] = mix64(np.fromiter(map(xxh3_64_intdigest, others), np.uint64, len(new))) % np.uint64(SPACE)
        PLACES.update(islice(zip(others, out[new].tolist()), max(0, WORDS.LIMIT - len(PLACES))))
    return out


def counted(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a text's words among the hashed ones, and how often each occurs."""
    return np.unique(places_of(words), return_counts=True)


def counted_all(texts: list[str | None]) -> tuple[np.ndarray, Counts]:
    """How many words each text has, and the counts of counted() of all texts, RUN letters at a time."""
    from xxhash import xxh3_64_intdigest

    ends = np.cumsum([len(t or "") for t in texts], dtype=np.int64)
    cuts = [0, *(np.flatnonzero(ends[1:] // RUN != ends[:-1] // RUN) + 1).tolist(), len(texts)] if len(texts) else [0]
    words, at, n, sizes = [np.zeros(0, np.int64)], [np.zeros(0, "<u2")], [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for low, high in zip(cuts, cuts[1:]):
        data, starts, lengths, held = words_of([t or "" for t in texts[low:high]])
        wide = np.int32 if (high - low) * SPACE < 1 << 31 else np.int64
        key = (mix64(hashes_of(data, starts, lengths)) % np.uint64(SPACE)).astype(wide)
        key += np.repeat(np.arange(high - low, dtype=wide) * wide(SPACE), held)
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        words.append(held)
        at.append((key[first] % wide(SPACE)).astype("<u2"))
        n.append(np.diff(first, append=len(key)).astype("<u4"))
        sizes.append(np.bincount(key[first] // wide(SPACE), minlength=high - low))
    at, n, bounds = np.concatenate(at), np.concatenate(n), np.cumsum(np.append(0, np.concatenate(sizes)))
    a, b, cut = at.tobytes(), n.tobytes(), bounds.tolist()
    mark = np.array([xxh3_64_intdigest(a[2 * x : 2 * y] + b[4 * x : 4 * y]) for x, y in zip(cut, cut[1:])], np.uint64).view(np.int64)
    return np.concatenate(words), Counts(at, n, bounds, mark)


def flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of bytes, one row after another, and the rows' bounds."""
    bounds = np.frombuffer(column.buffers()[1] or bytes(4), np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    return np.frombuffer(data, kind), (bounds - bounds[0]) // np.dtype(kind).itemsize


def unpacked(at: pa.Array, n: pa.Array, mark: pa.Array) -> Counts:
    """Counts from columns of describe()."""
    places, bounds = flat(at, "<u2")
    return Counts(places, flat(n, "<u4")[0], bounds, mark.to_numpy(zero_copy_only=False))


def vectors(part: Counts, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts that have words: which they are, their places and values of length 1 (0 if no word has weight), where
    each begins, and whether it has weight."""
    sizes = np.diff(part.bounds)
    which = np.flatnonzero(sizes)
    starts, at = part.bounds[which], part.at
    v = weights[at] * np.log1p(part.n)
    norm = np.sqrt(np.add.reduceat(v * v, starts)) if len(which) else np.zeros(0)
    return which, at, v / np.repeat(np.where(norm > 0, norm, 1), sizes[which]), starts, norm > 0


def cosines(centres: np.ndarray, at: np.ndarray, v: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of each text with each centre. NEAR texts at a time, which the processor's cache holds for all centres."""
    out, bounds = np.empty((len(starts), len(centres)), np.result_type(centres, v)), np.append(starts, len(at))
    for low in range(0, len(starts), NEAR):
        a, z = bounds[low], bounds[min(low + NEAR, len(starts))]
        places, values, heads = at[a:z].astype(np.intp), v[a:z], starts[low : low + NEAR] - a
        for k, c in enumerate(centres):
            np.add.reduceat(c.take(places, mode="clip") * values, heads, out=out[low : low + NEAR, k])
    return out


class Block(NamedTuple):
    """Texts that have weight, one after another: places, values of length UNIT in whole numbers, numbers of places, and
    a hash of each text's words."""

    at: np.ndarray
    v: np.ndarray
    sizes: np.ndarray
    mark: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes, dtype=np.int64) - self.sizes


def block(part: Counts, weights: np.ndarray) -> Block:
    which, at, v, _, some = vectors(part, weights)
    sizes = np.diff(part.bounds)[which]
    held = np.repeat(some, sizes)
    return Block(at[held], np.rint(v[held] * UNIT).astype("<f4"), sizes[some].astype("<i4"), part.mark[which[some]])


def within(at: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """In how many texts each place occurs, and last how many texts have words."""
    return np.append(np.bincount(at, minlength=SPACE), (np.diff(bounds) > 0).sum())


def spread(part: Block, centres: np.ndarray, tried: np.ndarray, turn: int) -> list[tuple[int, list[tuple]]]:
    """For each of the tried centres (none: for no centre), beside those there are: how far all texts are from their
    nearest one, and TRIES texts drawn by that, as (rank, at, v): those with the smallest ranks."""
    if not len(part.sizes):
        return [(0, [])] * max(1, len(tried))
    starts = part.starts
    apart = lambda c: np.maximum(0, 1 - cosines((c / UNIT).astype(np.float32), part.at, part.v, starts)).astype(float) ** 2
    far = apart(centres).min(1) if len(centres) else np.ones(len(starts))
    with np.errstate(over="ignore"):
        luck = ((mix64(part.mark.view(np.uint64) + GOLDEN * np.uint64(turn + 1)) >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
    out = []
    for left in np.minimum(far[:, None], apart(tried)).T if len(tried) else [far]:
        left = np.rint(left * UNIT)
        can = np.flatnonzero(left)
        rank = -np.log(luck[can]) / left[can]
        own = []
        for i in np.argsort(rank, kind="stable")[:TRIES]:
            a, z = starts[can[i]], starts[can[i]] + part.sizes[can[i]]
            own.append((float(rank[i]), part.at[a:z].tobytes(), part.v[a:z].tobytes()))
        out.append((int(left.sum()), own))
    return out


def moved(part: Block, centres: np.ndarray) -> np.ndarray:
    """The sums of the texts nearest to each centre, in whole numbers, one centre after another."""
    if not len(part.sizes):
        return np.zeros(len(centres) * SPACE)
    own = cosines(centres.astype(np.float32), part.at, part.v, part.starts).argmax(1)
    return np.bincount(np.repeat(own * SPACE, part.sizes) + part.at, part.v, len(centres) * SPACE)


def centres_of(weights: np.ndarray, topics: int, rounds: int, spreads: Callable, sums: Callable) -> Topics:
    """Spherical k-means. First centres: of some texts far from those chosen, that which leaves the others least far;
    fewer if fewer texts differ. Then rounds until the sums stand still. All sums are of whole numbers, so they are
    the same in whatever order and parts the texts are read."""

    def vector(text: tuple) -> np.ndarray:
        out = np.zeros(SPACE)
        out[np.frombuffer(text[1], "<u2")] = np.frombuffer(text[2], "<f4")
        return out / np.linalg.norm(out)

    centres, found = np.zeros((0, SPACE)), spreads(np.zeros((0, SPACE)), np.zeros((0, SPACE)), 0)[0][1]
    while found and len(centres) < topics:
        tried = np.array([vector(x) for x in found])
        told = spreads(centres, tried, len(centres) + 1)
        best = min(range(len(tried)), key=lambda i: told[i][0])
        centres, found = np.concatenate((centres, tried[[best]])), told[best][1]
    before = None
    for _ in range(rounds if len(centres) else 0):
        now = sums(centres).reshape(len(centres), SPACE)
        if before is not None and (now == before).all():
            break
        before, norms = now, np.linalg.norm(now, axis=1, keepdims=True)
        centres = np.where(norms > 0, now / np.maximum(norms, 1e-12), centres)
    return Topics(centres, weights)


def weights_of(within: np.ndarray) -> np.ndarray:
    """Words in fewer texts weigh more."""
    return np.log((1 + within[-1]) / (1 + within[:-1]))


def fit_topics(rows: list[tuple[np.ndarray, np.ndarray]], topics: int, rounds: int = 20) -> Topics:
    """learn_topics() of counts in memory."""
    from xxhash import xxh3_64_intdigest

    def joined(texts: list[tuple[bytes, bytes]]) -> Counts:
        bounds = np.cumsum([0, *(len(at) // 2 for at, _ in texts)])
        mark = np.array([xxh3_64_intdigest(at + n) for at, n in texts], np.uint64).view(np.int64)
        return Counts(np.frombuffer(b"".join(at for at, _ in texts), "<u2"), np.frombuffer(b"".join(n for _, n in texts), "<u4"), bounds, mark)

    texts = [(at.astype("<u2").tobytes(), n.astype("<u4").tobytes()) for at, n in rows]
    weights = weights_of(within(*joined(texts)[::2]))
    part = block(joined(sorted(set(texts))), weights)
    return centres_of(weights, topics, rounds, lambda *x: spread(part, *x), lambda *x: moved(part, *x))


def learn_topics(told: DataFrame, topics: int, staging: Staging, rounds: int = 20) -> Topics:
    """Topics of all texts, from their packed counts (at, n, mark): words are weighed over all rows, and every different
    text counts once. A pass reads the texts' values on the executors, BLOCK of them a row; the driver gets sums, a
    number for each place and centre, and TRIES texts for each centre tried."""
    sc = staging.spark.sparkContext
    kinds = ("<u2", "<f4", "<i4", "<i8")

    def total(rows: DataFrame, read: Callable, step: Callable, size: int, *held) -> np.ndarray:
        shared = sc.broadcast(held)

        def sliced(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.astype("<i8").tobytes() for x in parts.values()], pa.binary())], names=["slice", "part"])

        def run(batches: Iterator) -> Iterator:
            out = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    out += step(*read(batch), *shared.value)
            yield sliced({i: out[low : low + SLICE] for i, low in enumerate(range(0, size, SLICE)) if out[low : low + SLICE].any()})

        def add(batches: Iterator) -> Iterator:
            out = {}
            for batch in batches:
                for i, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                    out[i] = out.get(i, 0) + np.frombuffer(part.as_buffer(), "<i8")
            yield sliced(out)

        kind = "slice int, part binary"  # a row holds SLICE sums, so that few rows are dealt and added up
        got = rows.mapInArrow(run, kind).repartition("slice").mapInArrow(add, kind).toArrow()
        shared.unpersist()
        out = np.zeros(size)
        for i, part in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
            out[i * SLICE : (i + 1) * SLICE] = np.frombuffer(part, "<i8")
        return out

    def blocked(batches: Iterator) -> Iterator:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                part = block(unpacked(*batch.slice(low, BLOCK).columns), weights)
                yield pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in zip(part, kinds)], names=["at", "v", "sizes", "mark"])

    def block_of(batch: pa.RecordBatch) -> tuple[Block]:
        return (Block(*(flat(c, k)[0] for c, k in zip(batch.columns, kinds))),)

    hold = total(told.select("at"), lambda batch: flat(batch.column(0), "<u2"), within, SPACE + 1)
    weights = weights_of(hold)
    different = told.where(F.length("at") > 0).groupBy("mark", F.xxhash64("at", "n").alias("check")).agg(F.first("at").alias("at"), F.first("n").alias("n"))
    blocks = staging.put(different.select("at", "n", "mark").mapInArrow(blocked, "at binary, v binary, sizes binary, mark binary"), "blocks", compression="none")  # read in every pass
    # a task costs more than reading some MB: a pass has few, however many files there are
    blocks = blocks.coalesce(int(max(sc.defaultParallelism, hold[:-1].sum() * 6 // PASS + 1)))

    def spreads(*held) -> list[tuple[int, list[tuple]]]:
        shared, slots = sc.broadcast(held), max(1, len(held[1]))

        def run(batches: Iterator) -> Iterator:
            out = [(0, [])] * slots
            for batch in batches:
                if batch.num_rows:
                    out = [(a + b, sorted(x + y)[:TRIES]) for (a, x), (b, y) in zip(out, spread(*block_of(batch), *shared.value))]
            rows = [{"slot": i, "far": far, "found": [dict(zip(("rank", "at", "v"), x)) for x in found]} for i, (far, found) in enumerate(out)]
            yield from pa.Table.from_pylist(rows, pa.schema([("slot", pa.int32()), ("far", pa.int64()), ("found", pa.list_(pa.struct([("rank", pa.float64()), ("at", pa.binary()), ("v", pa.binary())])))])).to_batches()

        found = blocks.mapInArrow(run, "slot int, far bigint, found array<struct<rank double, at binary, v binary>>")
        best = F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, TRIES)  # TRIES a task
        got = {r["slot"]: r for r in found.groupBy("slot").agg(F.sum("far").alias("far"), best.alias("found")).collect()}
        shared.unpersist()
        return [(got[i]["far"], [(x["rank"], bytes(x["at"]), bytes(x["v"])) for x in got[i]["found"]]) if i in got else (0, []) for i in range(slots)]

    model = centres_of(weights, topics, rounds, spreads, lambda centres: total(blocks, block_of, moved, len(centres) * SPACE, centres))
    staging.drop("blocks")
    return model


def describe() -> Callable:
    """A column function: text -> (tokens, packed counts: 2 bytes a place, 4 a number, and their hash). Tokens are words."""

    @F.arrow_udf("n_tokens bigint, at binary, n binary, mark bigint")
    def run(texts: pa.Array) -> pa.Array:
        words, part = counted_all(texts.to_pylist())
        bounds = [pa.py_buffer((part.bounds * x.itemsize).astype("<i4")) for x in (part.at, part.n)]
        at, n = (pa.Array.from_buffers(pa.binary(), len(words), [None, b, pa.py_buffer(x)]) for b, x in zip(bounds, (part.at, part.n)))
        return pa.StructArray.from_arrays([pa.array(words, pa.int64()), at, n, pa.array(part.mark)], names=["n_tokens", "at", "n", "mark"])

    return run


def topic_of(model: Topics, spark: SparkSession) -> Callable:
    """A column function: packed counts -> topic; no words: topic 0."""
    shared = spark.sparkContext.broadcast(model)  # a row of fixed size a topic

    @F.arrow_udf("int")
    def run(at: pa.Array, n: pa.Array, mark: pa.Array) -> pa.Array:
        return pa.array(shared.value.of_all(unpacked(at, n, mark)))

    return run


def targets_of(mass: pd.Series, d: str, wanted: dict | None) -> dict:
    """Target shares of a dimension from the tokens of its values: those given (scaled to 1 over the values that have
    tokens), else tempered shares."""
    share = pd.Series({v: float((wanted or {}).get(d, {}).get(v, 0.0)) for v in mass.index}) if d in (wanted or {}) else (mass / mass.sum()) ** TEMPER[d]
    if not share.sum():
        raise ValueError(f"no target of {d} has tokens")
    return (share / share.sum()).to_dict()


Sums = Callable[[list[np.ndarray], float, int], np.ndarray]


def rake(aims: list[np.ndarray], sums: Sums, most: float = np.inf, rounds: int | None = None, close: float = 1e-9, reach: float = np.inf) -> list[np.ndarray]:
    """A factor, from 1 / reach to reach, for each value of each dimension, such that the sums of mass x min(most,
    product of the cell's factors) by value are the aims, as near as the cells allow. Ends when the sums stand still."""
    factors, total = [np.ones(len(a)) for a in aims], max(aims[0].sum(), 1e-300)
    before = [np.full(len(a), np.inf) for a in aims]
    for _ in range(ROUNDS if rounds is None else rounds):
        moved = 0.0
        for d, aim in enumerate(aims):
            now = sums(factors, most, d)
            moved, before[d] = max(moved, np.abs(now - before[d]).max() / total), now
            factors[d] = np.clip(factors[d] * np.divide(aim, now, out=np.zeros_like(now), where=now > 0), 1 / reach, reach)
        if moved < close:
            break
    return factors


def level(factors: list[np.ndarray], sums: Sums, aim: float, rounds: int = 100) -> list[np.ndarray]:
    """The factors, scaled so that the sum of mass x min(1, product) is the aim. That sum is concave in the scale, so
    the steps come from below and none goes too far."""
    out, scale = list(factors), 1.0
    for _ in range(rounds):
        out[0] = factors[0] * scale
        now = sums(out, 1.0, 0).sum()
        if not now or abs(now - aim) <= 1e-12 * aim or scale > 1e15:
            break
        scale *= aim / now
    return out


def draw(key: Column, text: Column, seed: int) -> Column:
    """A number in [0, 1) for each key and text."""
    return F.pmod(F.xxhash64(F.lit(seed).cast("long"), key, text), F.lit(1 << 52)) / F.lit(float(1 << 52))


def weigh(docs: DataFrame, wanted: dict | None = None, budget: float = 0.7, seed: int = 17, topics: int = 8, most_cells: int = 200_000, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs' key, source, lang and topic, n_tokens, weight, probability and sampled of every row.

    wanted: {"source" | "lang" | "topic": {value: share}}; a dimension left out is tempered. A null source or
    language is the value "(missing)". Topics are fitted on all rows. Texts without words, or null, are
    in a cell but have no tokens; a cell without tokens has weight and probability 1. weight: raked, its mean over all
    tokens 1; probability: raked with 1 as its bound to the same targets, in AGAIN rounds and by REACH at most, and scaled
    to the budget's share of all tokens. Rows equal in key and text are drawn alike; others, with equal or null keys
    too, each by itself. Other columns, whatever their names, are left out. Cells are summed on the driver up to
    most_cells; beyond, by the executors, with the same result.
    """
    staging = staging or Staging(docs.sparkSession)
    told = _weighed(docs, [F.col(key).alias("key")], wanted, budget, seed, topics, most_cells, staging, text, key)
    return told.select(F.col("key").alias(key), *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


def drawn(docs: DataFrame, wanted: dict | None = None, budget: float = 0.7, seed: int = 17, topics: int = 8, most_cells: int = 200_000, staging: Staging | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs, whole, that weigh() samples: rows and not keys, so nothing is joined by a key."""
    staging = staging or Staging(docs.sparkSession)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return _weighed(docs, [row], wanted, budget, seed, topics, most_cells, staging, text, key).where("sampled").select("row.*")


def _weighed(docs: DataFrame, carried: list[Column], wanted: dict | None, budget: float, seed: int, topics: int, most_cells: int, staging: Staging, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c)
    told = docs.select(*carried, value("source"), value("lang"), draw(F.col(key), F.col(text), seed).alias("luck"), describe()(F.col(text)).alias("x"))
    told = staging.put(told.select("*", "x.*").drop("x"), "told")
    model = learn_topics(told, topics, staging)
    told = told.withColumn("topic", topic_of(model, spark)("at", "n", "mark")).drop("at", "n", "mark")
    cells = told.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    if cells.count() <= most_cells:
        table = _on_driver(cells.toPandas().sort_values(list(DIMENSIONS)).reset_index(drop=True), wanted, budget)
        if table is None:
            told = told.withColumns({"weight": F.lit(1.0), "probability": F.lit(1.0)})
        else:
            told = told.join(F.broadcast(spark.createDataFrame(table)), list(DIMENSIONS), "left")  # most_cells rows at most
    else:
        told = told.join(_on_executors(cells, wanted, budget, staging), list(DIMENSIONS), "left")
    told = told.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0))})
    return told.withColumn("sampled", F.col("luck") < F.col("probability"))


def _factors(mass: list[pd.Series], sums: Sums, wanted: dict | None, budget: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Factors of the weights and of the probabilities, from the tokens by value of each dimension."""
    total = float(mass[0].sum())
    goals = [targets_of(m, d, wanted) for d, m in zip(DIMENSIONS, mass)]
    aims = [np.array([g[v] for v in m.index]) * total for g, m in zip(goals, mass)]
    weight = rake(aims, sums)
    weight[0] = weight[0] * total / max(sums(weight, np.inf, 0).sum(), 1e-300)
    start = [weight[0] * budget, *weight[1:]]
    more = rake([a * budget for a in aims], lambda f, most, d: sums([s * x for s, x in zip(start, f)], most, d), most=1.0, rounds=AGAIN, reach=REACH)
    return weight, level([s * x for s, x in zip(start, more)], sums, budget * total)


def _on_driver(cells: pd.DataFrame, wanted: dict | None, budget: float) -> pd.DataFrame | None:
    if not len(cells):
        return None
    tokens = cells["tokens"].to_numpy(float)
    coded = [cells[d].astype("category").cat for d in DIMENSIONS]
    codes = [c.codes.to_numpy().astype(np.int64) for c in coded]
    product = lambda factors: reduce(np.multiply, [f[at] for f, at in zip(factors, codes)])

    def sums(factors: list[np.ndarray], most: float, d: int) -> np.ndarray:
        return np.bincount(codes[d], tokens * np.minimum(most, product(factors)), len(factors[d]))

    mass = [pd.Series(np.bincount(at, tokens, len(c.categories)), index=c.categories) for at, c in zip(codes, coded)]
    weight, probability = _factors(mass, sums, wanted, budget)
    return cells[list(DIMENSIONS)].assign(weight=product(weight), probability=np.minimum(1.0, product(probability)))


def _on_executors(cells: DataFrame, wanted: dict | None, budget: float, staging: Staging) -> DataFrame:
    """The same where the cells are too many for the driver: a step is one sum over the cells."""
    spark, coded, mass = staging.spark, cells, []
    for d in DIMENSIONS:
        values = cells.groupBy(d).agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(d)
        if not len(values):
            return cells.select(*DIMENSIONS, F.lit(1.0).alias("weight"), F.lit(1.0).alias("probability"))
        mass.append(values.set_index(d)["tokens"].astype(float))
        kind = cells.schema[d].dataType.simpleString()
        table = spark.createDataFrame([(v, i) for i, v in enumerate(values[d].tolist())], f"{d} {kind}, {d}_code int")
        coded = coded.join(F.broadcast(table), d)  # a row a value, and the driver holds a number for each
    codes = [f"{d}_code" for d in DIMENSIONS]
    coded = staging.put(coded.select(*DIMENSIONS, *codes, F.col("tokens").cast("double").alias("tokens")), "coded")

    def product(batch, held: list[np.ndarray]) -> np.ndarray:
        return reduce(np.multiply, [f[batch.column(c).to_numpy()] for f, c in zip(held, codes)])

    def sums(factors: list[np.ndarray], most: float, d: int) -> np.ndarray:
        shared, size = spark.sparkContext.broadcast(factors), len(factors[d])

        def run(batches: Iterator) -> Iterator:
            out = np.zeros(size)
            for batch in batches:
                out += np.bincount(batch.column(codes[d]).to_numpy(), batch.column("tokens").to_numpy() * np.minimum(most, product(batch, shared.value)), size)
            at = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(out[at])], names=["at", "part"])

        out = np.zeros(size)
        for r in coded.select(*codes, "tokens").mapInArrow(run, "at bigint, part double").groupBy("at").agg(F.sum("part").alias("part")).collect():  # a row a value
            out[r["at"]] = r["part"]
        shared.unpersist()
        return out

    held = spark.sparkContext.broadcast(_factors(mass, sums, wanted, budget))

    def weigh_cells(batches: Iterator) -> Iterator:
        for batch in batches:
            weight, probability = (product(batch, f) for f in held.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(d) for d in DIMENSIONS), pa.array(weight), pa.array(np.minimum(1.0, probability))], names=[*DIMENSIONS, "weight", "probability"])

    kinds = ", ".join(f"{d} {cells.schema[d].dataType.simpleString()}" for d in DIMENSIONS)
    return coded.mapInArrow(weigh_cells, f"{kinds}, weight double, probability double")
