"""Packing of token sequences by minimum bin slack.

A document gives full windows of `size` tokens and a remainder. How many remainders have each length (at most size - 1
numbers, whatever the corpus) is all that the plan needs: again and again the longest length left opens a window, and
a bitset subset-sum dynamic programme over the counts of the other lengths finds the multiset that fills it closest
to its capacity; backtracking gives the counts. The pattern is repeated as often as the counts allow. Where no
multiset fills the window, a longer remainder is cut to fill the slack and its rest goes back to the pool, so only
the last window can be padded. Documents find their places from their rank among those of their length: a prefix sum
over blocks and a rank within the block, no sort and no shuffle of texts.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termweave.llm.common import WORDS, Staging

#: What Python splits at though it isn't white space to the tokenizers.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Letters that are one word together, whatever stands beside them, if the tokenizer says so.
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")


class WordIds(dict):
    """word -> its ids as little-endian bytes, by the tokenizer itself; remembered up to a bound, and between tasks up to
    a smaller one: workers wait, with all they hold, while others work."""

    LIMIT = 1_000_000

    def __init__(self, path: str):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letter = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.letter == "H" else "<u4")
        # words can be encoded one by one if white space is dropped between them
        with open(path, encoding="utf-8") as f:
            self.by_word = json.load(f)["model"].get("end_of_word_suffix") == "</w>"
        self.odd = (*ODD, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        # words of such letters go to the model itself, spelt as normalizer and pre-tokenizer spell each letter
        spelt = [self.spelt(c) for c in LETTERS]
        self.spelling = {ord(c): x[0] for c, x in zip(LETTERS, spelt) if len(x) == 1}
        sure = self.by_word and len(self.spelling) == len(LETTERS) and self.spelt(LETTERS) == ["".join(self.spelling.values())]
        self.lettered = re.compile(f"[{LETTERS}]+" if sure else r"(?!)").fullmatch

    def rest(self) -> None:
        if len(self) > WORDS.LIMIT:
            self.clear()

    def spelt(self, text: str) -> list[str]:
        """The pieces that the model gets."""
        own = self.tokenizer
        text = own.normalizer.normalize_str(text) if own.normalizer else text
        return [piece for piece, _ in own.pre_tokenizer.pre_tokenize_str(text)] if own.pre_tokenizer else [text]

    def whole(self, text: str) -> bool:
        """Whether a text can't be encoded word by word."""
        return any(x in text for x in self.odd)

    def encode(self, text: str) -> bytes:
        return array(self.letter, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        if self.lettered(word):
            ids = array(self.letter, [t.id for t in self.tokenizer.model.tokenize(word.translate(self.spelling))]).tobytes()
        else:
            ids = self.encode(word)
        if len(self) >= self.LIMIT:
            self.clear()
        if len(word) <= 100:
            self[word] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        split = self.by_word and not self.whole(text)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())) if split else self.encode(text), self.kind)


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


@dataclass(frozen=True)
class Run:
    """Documents of one remainder length and of ranks [low, high) put their tokens [start, start + length) of the
    remainder `each` at a time into windows first, first + 1, ..., one after the other from offset on."""

    remainder: int
    low: int
    high: int
    start: int
    length: int
    first: int
    each: int
    offset: int


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (at most counts of each) with the largest sum up to capacity, the longest first."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > capacity:
            continue
        left, part = min(counts[length], capacity // length), 1
        while left:
            part = min(part, left)
            steps.append((length, part, reach))
            reach |= reach << length * part & mask
            left -= part
            part *= 2
        if reach >> capacity & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + part
            at -= length * part
    return used


def plan(histogram: dict[int, int], size: int) -> tuple[list[Run], int]:
    """The runs that place all remainders, and the number of windows."""
    pool = {n: deque([(n, 0, 0, c)]) for n, c in histogram.items() if c and n}
    counts = {n: c for n, c in histogram.items() if c and n}
    runs: list[Run] = []
    window = 0

    def take(length: int, n: int) -> list[tuple[int, int, int, int]]:
        """n pieces of the length out of the pool, as (remainder, start, low, high)."""
        out = []
        counts[length] -= n
        while n:
            remainder, start, low, high = pool[length].popleft()
            part = min(n, high - low)
            out.append((remainder, start, low, low + part))
            if low + part < high:
                pool[length].appendleft((remainder, start, low + part, high))
            n -= part
        if not counts[length]:
            del counts[length], pool[length]
        return out

    def place(pieces: list, length: int, each: int, offset: int, first: int) -> None:
        """Slots are dealt window by window, so a run that ends within a window is cut there."""
        slot = 0
        for remainder, start, low, high in pieces:
            while low < high:
                at, within = divmod(slot, each)
                whole = (high - low) // each * each if not within else 0
                n = whole or min(each - within, high - low)
                runs.append(Run(remainder, low, low + n, start, length, first + at, each if whole else n, offset + within * length))
                low, slot = low + n, slot + n

    while counts:
        longest = max(counts)
        rest = counts | {longest: counts[longest] - 1}
        used = fill({k: v for k, v in rest.items() if v}, size - longest)
        used[longest] = used.get(longest, 0) + 1
        slack = size - sum(k * v for k, v in used.items())
        times = min(counts[k] // v for k, v in used.items())
        donor = 0
        if slack:
            others = [k for k in counts if k > slack and counts[k] - used.get(k, 0) > 0]
            if others:
                donor = max(others)
                times = min(times, counts[donor] // (used.get(donor, 0) + 1))
        offset = 0
        for length, each in sorted(used.items(), reverse=True):
            place(take(length, times * each), length, each, offset, window)
            offset += length * each
        if donor:
            cut = take(donor, times)
            place(cut, slack, 1, offset, window)
            back = donor - slack
            pool.setdefault(back, deque()).extend((r, s + slack, a, b) for r, s, a, b in cut)
            counts[back] = counts.get(back, 0) + times
        window += times
    return runs, window


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", staging: Staging | None = None) -> DataFrame:
    """key, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    A null text counts as empty: its one token is the end. Rows with equal or null keys are documents of their own;
    other columns are left out. Sequence ids are unique, not dense: windows of remainders are numbered from 0, full
    windows (block + 1) << 36 onwards.
    """
    import pyarrow as pa

    spark: SparkSession = docs.sparkSession
    staging = staging or Staging(spark)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()

    def encode(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        words, block, row, full, ranks = word_ids(path), TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = {c: [] for c in ("row", "n_tokens", "full", "full_crcs", "left", "rank", "left_crc", "left_ids")}
                for x in part.column(1):
                    ids = words.ids(x.as_py() or "")
                    ids = np.append(ids, ids.dtype.type(end_id))
                    n = len(ids)
                    left = n % size
                    for c, v in zip(out, (row, n, full, [crc(ids[i : i + size]) for i in range(0, n - left, size)], left, ranks.get(left, 0), crc(ids[n - left :]), ids[n - left :].tobytes())):
                        out[c].append(v)
                    ranks[left] = ranks.get(left, 0) + 1
                    row, full = row + 1, full + n // size
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([block] * part.num_rows, pa.int64()), *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=["key", "block", *out])
        words.rest()

    coded = staging.put(
        docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
            encode, f"key {kind}, block bigint, row bigint, n_tokens bigint, full bigint, full_crcs array<bigint>, left int, rank bigint, left_crc bigint, left_ids binary"
        ),
        "coded",
    )
    per_block = coded.where("left > 0").groupBy("left", "block").agg(F.count("*").alias("n"))
    before = per_block.withColumn("before", F.sum("n").over(Window.partitionBy("left").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("left", "block", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r[0]: r[1] for r in per_block.groupBy("left").agg(F.sum("n")).collect()}  # under `size` rows
    runs, _ = plan(histogram, size)
    by_left: dict[int, list[Run]] = {}
    for r in runs:
        by_left.setdefault(r.remainder, []).append(r)
    # pieces of a remainder start at the same place in all documents of a run; rank intervals by start
    places = {n: {s: sorted((r for r in rs if r.start == s), key=lambda r: r.low) for s in sorted({r.start for r in rs})} for n, rs in by_left.items()}
    places = spark.sparkContext.broadcast({n: [(s, [r.low for r in rs], rs) for s, rs in d.items()] for n, d in places.items()})

    def put(batches: Iterator) -> Iterator:
        for batch in batches:
            out = {c: [] for c in ("at", "block", "row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            d = batch.to_pydict()
            for i in range(batch.num_rows):
                block, n, left, full = d["block"][i], d["n_tokens"][i], d["left"][i], d["full"][i]
                found = [(k * size, size, c, (block + 1 << 36) + full + k, 0) for k, c in enumerate(d["full_crcs"][i])]
                if left:
                    rank = d["rank"][i] + d["before"][i]
                    for start, lows, rs in places.value[left]:
                        r = rs[bisect_right(lows, rank) - 1] if lows[0] <= rank else None
                        if r is None or rank >= r.high:
                            continue
                        at, slot = divmod(rank - r.low, r.each)
                        found.append((n - left + start, r.length, d["left_crc"][i] if r.length == left else None, r.first + at, r.offset + slot * r.length))
                for start, length, c, sequence, offset in found:
                    for name, v in zip(out, (i, block, d["row"][i], start, length, c, n, sequence, offset)):
                        out[name].append(v)
            at = pa.array(out.pop("at"), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")).take(at), *(pa.array(v, pa.int64()) for v in out.values())], names=["key", *out])

    small = coded.select("key", "block", "row", "n_tokens", "full", "full_crcs", "left", "rank", "left_crc").join(before, ["left", "block"], "left")
    pieces = small.mapInArrow(put, f"key {kind}, block bigint, row bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    uncut = sorted(n for n, d in by_left.items() if any(r.length < n for r in d))
    if uncut:  # remainders that were cut: their ids are read again
        pieces = staging.put(pieces, "pieces")

        def crcs(batches: Iterator) -> Iterator:
            for batch in batches:
                d = batch.to_pydict()
                kind_ = np.dtype("<u2" if d["wide"] and not d["wide"][0] else "<u4")
                sums = [crc(np.frombuffer(b, kind_)[s : s + n]) for b, s, n in zip(d["left_ids"], d["from"], d["length"])]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), pa.array(sums, pa.int64()), *(batch.column(c) for c in (6, 7, 8))], names=["key", "block", "row", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset", "wide"])

        wide = word_ids(path).kind.itemsize > 2
        ids = coded.where(F.col("left").isin(uncut)).select("block", "row", "left_ids", "left", "n_tokens")
        cut = pieces.where("ids_crc32 is null").join(ids, ["block", "row"]).select("key", "block", "row", "start", "length", "doc_tokens", "sequence_id", "offset", F.lit(wide).alias("wide"), "left_ids", (F.col("start") - F.col("n_tokens") + F.col("left")).alias("from"))
        cut = cut.mapInArrow(crcs, f"key {kind}, block bigint, row bigint, start bigint, length bigint, doc_tokens bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, wide boolean")
        pieces = pieces.where("ids_crc32 is not null").unionByName(cut.select(pieces.columns))
    return pieces.select(F.col("key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
