"""Language-model scoring by a probabilistic suffix tree over the running text.

A text is emitted token by token. A context is up to `depth` of the tokens before it in the text. A context that occurs
at least `least` times is retained if its next-token distribution diverges from its longest retained suffix's: the
likelihood ratio of what followed it must pay for naming each different follower. A retained context's distribution is
smoothed towards that suffix's by as many pseudo-counts as it has different followers; a token is scored by the longest
retained suffix of what was read. The empty context emits known tokens by their discounted counts; the discounted mass
spells a token byte by byte, by a second suffix tree whose contexts are the bytes since the space before the word,
learnt from the different words of the corpus, once each. So every text has a probability, and no word is unknown.

Everything is counted over the whole corpus, and texts are never shuffled. A task cuts its documents into blocks with a
vocabulary each; words meet their corpus counts in a join of block vocabularies (not of tokens). The tree grows a depth
at a time: a block sends its different (context, token) pairs, packed as sorted arrays, to the range of the context's
hash, where pairs of all blocks are counted and contexts tested, and gets the counts back in the order sent. Only
contexts that the depth before has found often enough are sent. Pairs of a context that holds a large share of the
corpus are dealt over all ranges; its sums are added up afterwards.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termweave.llm.common import GOLDEN, Staging, hashes_of, mix64

END = b"\n"


def new_numbers() -> defaultdict:
    """word -> its number in the block, in order of appearance."""
    return defaultdict(count().__next__)


def windows(words: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol that the words emit: (the bytes before it, at most depth, as a number) << 8 | symbol; how
    many bytes there are before it, at most depth; and where each word starts."""
    text = np.frombuffer(b"".join([b" \n" if w == END else b" " + w + b" " for w in words]), np.uint8).astype(np.uint64)
    lengths = np.fromiter((2 if w == END else len(w) + 2 for w in words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    within = np.arange(len(text)) - np.repeat(starts, lengths)
    code = np.zeros(len(text), np.uint64)
    for back in range(1, depth + 1):
        ok = within >= back
        code[ok] |= text[np.flatnonzero(ok) - back] << np.uint64(8 * back)
    code |= text
    emitted = within > 0
    return code[emitted], np.minimum(within[emitted], depth), starts - np.arange(len(words))


class Tree:
    """The retained contexts, as sorted arrays for each depth."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], root: np.ndarray):
        #: for each depth from 1 on: context << 8 | symbol, its count, the context's count, its different symbols
        self.rows = rows
        self.contexts = []
        for key, _, total, kinds in rows:
            ctx, first = np.unique(key >> np.uint64(8), return_index=True)
            self.contexts.append((ctx, total[first].astype(float), kinds[first].astype(float)))
        self.root = np.log10((root + 1) / (root.sum() + 256))

    def log10(self, code: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Of each symbol after its context: shallow to deep through the retained contexts."""
        p = 10 ** self.root[(code & np.uint64(255)).astype(np.int64)]
        for k, ((key, n, _, _), (ctx, total, kinds)) in enumerate(zip(self.rows, self.contexts), 1):
            if not len(ctx):
                continue
            mask = np.uint64((1 << 8 * (k + 1)) - 1)
            here = code & mask
            at = np.minimum(np.searchsorted(ctx, here >> np.uint64(8)), len(ctx) - 1)
            kept = (ctx[at] == here >> np.uint64(8)) & (before >= k)
            pair = np.minimum(np.searchsorted(key, here), len(key) - 1)
            seen = np.where(key[pair] == here, n[pair], 0)
            p = np.where(kept, (seen + kinds[at] * p) / (total[at] + kinds[at]), p)
        return np.log10(p)

    def words(self, words: list[bytes], depth: int) -> np.ndarray:
        """log10 of the probability of each word."""
        if not words:
            return np.zeros(0)
        code, before, starts = windows(words, depth)
        unique, first, back = np.unique(code * np.uint64(8) + before.astype(np.uint64) if depth < 7 else code, return_index=True, return_inverse=True)
        return np.add.reduceat(self.log10(code[first], before[first])[back], starts)


#: What a block sends to a range: contexts (hash, dealt over all ranges or not, number of pairs), then pairs (symbol,
#: natural log of the suffix's probability, occurrences); and what it gets back: counts of pairs, followers of contexts.
SENT, REPLY = ("u8", "u1", "u4", "u8", "f2", "u4"), ("u8", "u8")
#: What a block gets for its words: their numbers, corpus counts and log10 probabilities; it keeps the last two.
OWN = ("<u4", "<i8", "<f4")
#: A block's tokens. Its words leave the worker in rows of so many, as the JVM holds a row several times over.
IDS, ROW_WORDS = ("<u4",), 20_000


def give_back() -> None:
    """What is freed goes back to the system, as a worker that waits has no use for it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's alone
    if trim:
        trim(0)


def pack(arrays: list[np.ndarray], kinds: tuple[str, ...]) -> bytes:
    """Arrays as compressed bytes: all first bytes, then all second ones, so small numbers take little."""
    import zstandard

    cols = [np.ascontiguousarray(a, k) for a, k in zip(arrays, kinds)]
    raw = [np.array([len(c) for c in cols], "u8").tobytes(), *(c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in cols)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def unpack(data: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    lengths, at, out = raw[: 8 * len(kinds)].view("u8").astype(int), 8 * len(kinds), []
    for n, k in zip(lengths, kinds):
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).ravel())
        at += n * size
    return out


def ordered(keys: np.ndarray) -> np.ndarray:
    """The order of 64-bit keys, equal ones as they stand: their first bits are sorted together with their places, which
    is faster than sorting places by keys; where keys differ in the last bits only, that is made good."""
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    found = keys[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong) > 1000:
        return np.argsort(keys, kind="stable")
    first = found >> bits
    for a, z in {tuple(np.searchsorted(first, [x, x + np.uint64(1)]).tolist()) for x in first[wrong]}:
        order[a:z] = order[a:z][np.argsort(found[a:z], kind="stable")]
    return order


def numbered(keys: np.ndarray, width: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, sorted, the place of the first of each, and the number of each key among them. width: the
    bits that keys have; if they leave room for places, both are sorted as one number."""
    bits = max(1, len(keys) - 1).bit_length()
    if width + bits <= 64:
        order = keys << np.uint64(bits)
        order |= np.arange(len(keys), dtype=np.uint64)
        order.sort()
        keys = order >> np.uint64(bits)
        order &= np.uint64((1 << bits) - 1)
        order = order.view(np.int64)
    else:
        order = ordered(keys << np.uint64(64 - width))  # left-aligned, so that it sorts by nearly all bits
        keys = keys[order]
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    count, number = np.cumsum(new, dtype=np.int32), np.empty(len(keys), np.int32)
    count -= np.int32(1)
    number[order] = count
    return keys[new], order[new], number


class Depth:
    """The different (context, token) pairs of a block at one depth, in the order of the ranges they are sent to.

    ctx: the block's number of the context of each token that has one, -1 elsewhere; hashes and counts by that number.
    """

    def __init__(self, ctx: np.ndarray, ids: np.ndarray, words: np.ndarray, hashes: np.ndarray, counts: np.ndarray, ranges: int, hot: float):
        self.at = np.flatnonzero(ctx >= 0).astype(np.int32)
        wide = max(1, len(words)).bit_length()
        keys = ctx[self.at].astype(np.uint64)
        keys <<= np.uint64(wide)
        keys |= ids[self.at]
        keys, _, self.back = numbered(keys, max(1, len(hashes)).bit_length() + wide)
        own = (keys >> np.uint64(wide)).astype(np.int32)
        keys &= np.uint64((1 << wide) - 1)
        self.symbol = words[keys.view(np.int64)]
        del keys
        self.hash, self.total = hashes[own], counts[own]
        self.dealt = self.total > hot
        place, some = self.hash >> np.uint64(32), np.flatnonzero(self.dealt)
        with np.errstate(over="ignore"):
            place[some] = mix64(self.hash[some] ^ self.symbol[some]) >> np.uint64(32)
        place *= np.uint64(ranges)
        place >>= np.uint64(32)
        place = place.astype(np.uint16 if ranges <= 1 << 16 else np.uint32)
        self.order = np.argsort(place, kind="stable").astype(np.int32)
        place, own = place[self.order], own[self.order]
        new = np.ones(len(own), bool)
        new[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1])
        self.first = np.flatnonzero(new).astype(np.int32)  # of each run of pairs with one context in one range
        self.sizes = np.diff(np.append(self.first, np.int32(len(own))))
        self.place, self.run_place = place, place[self.first]

    def next(self) -> np.ndarray:
        """Hashes of the pairs as longer contexts."""
        with np.errstate(over="ignore"):
            return mix64(self.hash * GOLDEN + self.symbol)

    def sent(self, p: np.ndarray, taught: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, packed pairs); p: the tokens' probabilities so far; taught: whether they teach."""
        lp = np.empty(len(self.hash))
        lp[self.back] = p[self.at]
        np.log(lp, out=lp)
        n = np.bincount(self.back[taught[self.at]], minlength=len(self.hash))[self.order]
        lp, symbol = lp[self.order], self.symbol[self.order] >> np.uint64(16)
        head = self.order[self.first]
        for r in np.unique(self.run_place).tolist():
            a, z = np.searchsorted(self.run_place, [r, r + 1])
            b, y = np.searchsorted(self.place, [r, r + 1])
            yield r, pack([self.hash[head[a:z]], self.dealt[head[a:z]], self.sizes[a:z], symbol[b:y], lp[b:y], n[b:y]], SENT)

    def step(self, p: np.ndarray, replies: list[bytes], often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The tokens' probabilities, in place, with the contexts of this depth, from the ranges' replies in their order;
        often: hashes and followers (0: not retained) of contexts dealt over all ranges. Sets count, the pairs' counts."""
        parts = [unpack(x, REPLY) for x in replies]
        self.count, kinds = np.zeros(len(self.hash), np.int64), np.zeros(len(self.hash))
        if parts:
            self.count[self.order] = np.concatenate([x[0] for x in parts])
            kinds[self.order] = np.repeat(np.concatenate([x[1] for x in parts]), self.sizes)
            del parts
        if len(often[0]):
            at = np.minimum(np.searchsorted(often[0], self.hash), len(often[0]) - 1)
            kinds = np.where(self.dealt & (often[0][at] == self.hash), often[1][at], kinds)
        some = kinds > 0  # the suffix's probability moves by (count + followers x it) / (total + followers)
        add, times = np.zeros(len(kinds)), np.ones(len(kinds))
        add[some] = self.count[some] / (self.total[some] + kinds[some])
        times[some] = kinds[some] / (self.total[some] + kinds[some])
        del kinds, some
        moved = times[self.back]
        moved *= p[self.at]
        moved += add[self.back]
        p[self.at] = moved
        return p


class Block:
    """A block's texts as numbers, and its probabilities as deep as replies have come. ids, own: packed."""

    def __init__(self, ids: bytes, lengths: list[int], held: list[bool], words: bytes, own: bytes):
        (self.ids,), self.words = unpack(ids, IDS), np.frombuffer(words, "<u8")
        self.c, lp = unpack(own, OWN[1:])
        self.p = (10.0 ** lp.astype(float))[self.ids]
        self.lengths = np.array(lengths, np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.taught = np.repeat(~np.array(held, bool), self.lengths)

    def depths(self, replies: list[list[bytes]], often: list[tuple], least: int, ranges: int, hot: float, deepest: int) -> Depth | None:
        """Takes the replies of the first depths; the next Depth, if there is one."""
        ctx = np.full(len(self.ids), -1, np.int32)
        ctx[1:] = self.ids[:-1]
        hashes, counts = mix64(self.words), self.c
        for k in range(deepest):
            ctx[self.starts] = -1
            if len(counts):
                ctx[(counts < least)[ctx]] = -1  # -1 stays what it is, whatever stands at that place
            own = Depth(ctx, self.ids, self.words, hashes, counts, ranges, hot)
            if k == len(replies):
                return own
            self.p = own.step(self.p, replies[k], often[k])
            if k + 1 == deepest:
                break
            ctx[:] = -1
            inside = np.searchsorted(own.at, len(ctx) - 1)
            ctx[own.at[:inside] + 1] = own.back[:inside]
            hashes, counts = own.next(), own.count
            del own
        return None


def count_range(rows: list[tuple], least: int, cost: float) -> Iterator[tuple]:
    """All that the blocks have sent to a range, (block, packed pairs): yields (block, reply), then (None, sums) of
    contexts dealt over all ranges: hashes, totals, followers and gains."""
    if not rows:
        return
    blocks, parts = [b for b, _ in rows], [unpack(x, SENT) for _, x in rows]
    lengths = [(len(p[0]), len(p[3])) for p in parts]
    hashes, dealt, sizes, symbol, lp, n = (np.concatenate([p.pop(0) for p in parts]) for _ in range(6))
    ctx, _, own = numbered(hashes)
    spread = np.zeros(len(ctx), bool)
    spread[own] = dealt.astype(bool)
    own = np.repeat(own, sizes)
    with np.errstate(over="ignore"):
        pairs, first, back = numbered(mix64(ctx[own] + symbol * GOLDEN))
    c, at = np.bincount(back, n, len(pairs)), own[first]
    seen = c > 0
    total, kinds = np.bincount(at, c, len(ctx)), np.bincount(at[seen], minlength=len(ctx))
    gain = np.bincount(at[seen], c[seen] * (np.log(c[seen]) - lp[first][seen].astype(float)), len(ctx))
    kept = np.where(~spread & (total >= least) & (gain - total * np.log(np.maximum(total, 1)) > cost * kinds), kinds, 0)
    heads = np.cumsum(sizes.astype(np.int64)) - sizes
    a = b = z = y = 0
    for block, (runs, pairs_) in zip(blocks, lengths):
        a, b, z, y = b, b + pairs_, y, y + runs
        yield block, pack([c[back[a:b]], kept[own[heads[z:y]]]], REPLY)
    if spread.any():
        yield None, (ctx[spread], total[spread], kinds[spread], gain[spread])


def score(
    docs: DataFrame, held_out: "F.Column", staging: Staging | None = None, depth: int = 2, least: int = 2, threshold: float = 1.0, letters: int = 6, spelling: float = 3.0, p_min: float = 5e-5,
    block_tokens: int = 1_500_000, block_words: int = 400_000, spelt_words: int = 10_000, packed_words: int = 500_000, range_tokens: int = 2_000_000, share: float = 4.0, text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Tokens are the runs of characters other than ASCII white space, A-Z in lower case, then one end. Rows where
    held_out is true teach nothing (where it is null they do). base_score sums log10((c + 1) / (N + V + 1)) over the
    tokens; score is the tree's log10 probability of the text. A null text counts as empty; rows with equal or null
    keys stay rows of their own; other columns, whatever their names, are left out.

    depth: most tokens of a context. least: occurrences that a context needs. threshold: the natural log of all
    training tokens, times this, is the price of a follower, and the likelihood ratio (with the suffix's
    log-probabilities as 16-bit floats) must be above the price of all followers. Contexts are known by 64 bits of
    hash, followers in a context by 48. letters: most bytes of a spelling context; spelling: the likelihood ratio that
    retains one, for each different byte; p_min: the share of all positions that one needs, so each length has at most
    1 / p_min contexts and the spelling tree, which is broadcast, has a bound whatever the corpus. range_tokens: tokens
    for which there is a range; a context in more than 1 / (share x ranges) of the tokens is dealt over all of them.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    staging = staging or Staging(spark)
    kind = docs.select(F.col(key)).schema[0].dataType.simpleString()
    fields = f"block bigint, keys array<{kind}>, held array<boolean>, lengths array<bigint>, ids binary, hashes binary, first int, words array<struct<word:binary,n:bigint>>"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def cut(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        block, numbers, schema = TaskContext.get().partitionId() << 24, new_numbers(), None
        keys, held, lengths, ids, size = [], [], [], [], 0

        def close() -> Iterator:
            w, every = list(numbers), np.concatenate(ids)
            taught = np.repeat(~np.array(held, bool), lengths)
            n = np.bincount(every[taught], minlength=len(w))
            sizes = np.fromiter(map(len, w), np.int64, len(w))
            hashes = hashes_of(b"".join(w), np.cumsum(sizes) - sizes, sizes)
            row = [[block], [keys], [held], [lengths], [pack([every], IDS)], [hashes.astype("<u8").tobytes()]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(row, schema)), *(pa.nulls(1, schema.field(i).type) for i in (6, 7))], schema=schema)
            del every, taught, hashes, row
            for a in range(0, len(w), ROW_WORDS):
                own = pa.StructArray.from_arrays([pa.array(w[a : a + ROW_WORDS], pa.binary()), pa.array(n[a : a + ROW_WORDS])], ["word", "n"])
                cols = [pa.array([block]), *(pa.nulls(1, schema.field(i).type) for i in range(1, 6)), pa.array([a], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

        for batch in batches:
            if schema is None:
                k = batch.schema.field(0).type
                schema = pa.schema([("block", pa.int64()), ("keys", pa.list_(k)), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary()), ("hashes", pa.binary()), ("first", pa.int32()), ("words", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))])
            for key_, x, out in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = (x or b"").lower().split()
                words.append(END)
                ids.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                keys.append(key_)
                held.append(out)
                lengths.append(len(words))
                size += len(words)
                if size >= block_tokens or len(numbers) >= block_words:
                    yield from close()
                    block, numbers, keys, held, lengths, ids, size = block + 1, new_numbers(), [], [], [], [], 0
        if keys:
            yield from close()
        keys, held, lengths, ids, numbers = [], [], [], [], None
        give_back()

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    coded = staging.put_by(rows.mapInArrow(cut, fields), "coded", "block", parts)  # a row a block, and its words
    vocabularies = coded.where("words is not null").select("block", "first", F.posexplode("words").alias("at", "x")).select("block", (F.col("first") + F.col("at")).alias("number"), "x.word", "x.n")
    counted = staging.put(vocabularies.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    total = counted.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *(F.count(F.when(F.col("c").between(a, z), 1)).alias(name) for name, a, z in (("v", 1, 1 << 62), ("once", 1, 1), ("twice", 2, 2)))
    ).first()
    tokens = coded.agg(F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))).first()[0]
    discount = total["once"] / max(1, total["once"] + 2 * total["twice"]) or 0.5
    model = spark.sparkContext.broadcast(_spelling(counted, staging, letters, spelling, p_min))

    def spell(batches: Iterator) -> Iterator:
        held, size = [], 0

        def some() -> pa.RecordBatch:
            word, c = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
            return pa.RecordBatch.from_arrays([word, c, pa.array(model.value.words(word.to_pylist(), letters))], names=["word", "c", "lp"])

        for batch in batches:  # small ones together
            held.append(batch)
            size += batch.num_rows
            if size >= spelt_words:
                yield some()
                held, size = [], 0
        if held:
            yield some()

    spelt = counted.select("word", "c").mapInArrow(spell, "word binary, c bigint, lp double")
    escape = discount * total["v"] / total["n"] if total["n"] else 1.0
    spelt_mass = F.lit(escape) * F.pow(F.lit(10.0), "lp")
    lp = F.when(F.col("c") > 0, F.log10((F.col("c") - discount) / max(1, total["n"]) + spelt_mass)).otherwise(F.col("lp") + F.log10(F.lit(escape)))
    # neither side is sorted: a partition's different words are held, as they are few beside the rows
    own = vocabularies.select("word", "block", "number").join(spelt.hint("shuffle_hash"), "word").select("block", "number", "c", lp.cast("float").alias("lp"))

    def together(batches: Iterator) -> Iterator:
        """Rows become one for each block among them, as bytes; many at once."""
        held, size = [], 0

        def some() -> pa.RecordBatch:
            block, *rest = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(4))
            order = np.argsort(block, kind="stable")
            block, rest = block[order], [x[order] for x in rest]
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            data = [pa.array([x[a:z].astype(k).tobytes() for a, z in zip(cuts, cuts[1:])], pa.binary()) for x, k in zip(rest, OWN)]
            return pa.RecordBatch.from_arrays([pa.array(block[cuts[:-1]]), *data], names=["block", "number", "count", "lp"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
                if size >= packed_words:
                    yield some()
                    held, size = [], 0
        if held:
            yield some()

    def gather(batches: Iterator) -> Iterator:
        """Rows of a block, in any order, become one in the order of its numbers."""
        block, held = None, []

        def one() -> pa.RecordBatch:
            place, data = np.concatenate([np.frombuffer(x[0], OWN[0]) for x in held]), []
            for i in (1, 2):
                data.append(np.empty(len(place), OWN[i]))
                data[-1][place] = np.concatenate([np.frombuffer(x[i], OWN[i]) for x in held])
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([pack(data, OWN[1:])], pa.binary())], names=["block", "own"])

        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if held:
                        yield one()
                    block, held = b, []
                held.append(row)
        if held:
            yield one()

    own = own.mapInArrow(together, "block bigint, number binary, count binary, lp binary")
    scores = own.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(gather, "block bigint, own binary")
    staging.collect_garbage()
    tables = [coded.where("ids is not null").drop("first", "words"), staging.put_by(scores, "scores", "block", parts)]
    staging.drop("vocabulary")
    staging.collect_garbage()
    ranges, often = max(parts, -(-tokens // range_tokens)), []
    hot, cost = total["n"] / (share * ranges), threshold * np.log(max(2, total["n"]))

    def joined() -> DataFrame:
        out = tables[0].join(tables[1], "block")
        for k, t in enumerate(tables[2:]):
            out = out.join(t.withColumnRenamed("replies", f"r{k}"), "block", "left")
        return out.select("block", "keys", "held", "lengths", "ids", "hashes", "own", F.array(*[f"r{k}" for k in range(len(tables) - 2)]).cast("array<array<binary>>").alias("replies"))

    def blocks_of(batches: Iterator, known: list) -> Iterator:
        """(number, keys, held, the block, its next depth); a block is let go, here and by who asks, before the next."""
        for batch in batches:
            for r in range(batch.num_rows):
                number, keys, held, lengths, ids, hashes, own, replies = (c[r] for c in batch.columns)
                block = Block(ids.as_buffer(), lengths.as_py(), held.as_py(), hashes.as_buffer(), own.as_buffer())
                nearest = block.depths([x or [] for x in replies.as_py()], known, least, ranges, hot, depth)
                yield number, keys, held, block, nearest
                del block, nearest
                give_back()

    for k in range(depth):
        known = list(often)

        def send(batches: Iterator, known=known) -> Iterator:
            for number, _, _, block, nearest in blocks_of(batches, known):
                for r, data in nearest.sent(block.p, block.taught):
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([number.as_py()], pa.int64()), pa.array([data], pa.binary())], names=["range", "block", "data"])
                del block, nearest

        def answer(batches: Iterator) -> Iterator:
            """A range's rows lie together, in the order of the blocks."""
            schema = pa.schema([("block", pa.int64()), ("range", pa.int32()), ("reply", pa.binary()), ("ctx", pa.int64()), ("total", pa.float64()), ("kinds", pa.int64()), ("gain", pa.float64())])

            def done(r, held) -> Iterator:
                for block, out in count_range(held, least, cost):
                    m = 1 if block is not None else len(out[0])
                    given = [pa.array([block]), pa.array([r]), pa.array([out])] if block is not None else out
                    cols = [*given, *(pa.nulls(1) for _ in range(4))] if block is not None else [*(pa.nulls(m) for _ in range(3)), pa.array(out[0].view(np.int64)), *map(pa.array, out[1:])]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema)], schema=schema)

            at, held = None, []
            for batch in batches:
                for r, block, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if r != at:
                        yield from done(at, held)
                        at, held = r, []
                    held.append((block, data))
            yield from done(at, held)
            held = []
            give_back()

        sent = joined().mapInArrow(send, "range int, block bigint, data binary").repartitionById(ranges, "range").sortWithinPartitions("range", "block")
        answered = staging.put(sent.mapInArrow(answer, "block bigint, range int, reply binary, ctx bigint, total double, kinds bigint, gain double"), f"answered_{k}")
        # contexts in more than 1 / (share x ranges) of the tokens: at most share x ranges of them
        found = answered.where("ctx is not null").groupBy("ctx").agg(F.sum("total").alias("total"), F.sum("kinds").alias("kinds"), F.sum("gain").alias("gain")).toArrow()
        hashes, n, kinds, gain = (found.column(c).to_numpy() for c in ("ctx", "total", "kinds", "gain"))
        order = np.argsort(hashes.astype(np.int64).view(np.uint64))
        keep = (n >= least) & (gain - n * np.log(np.maximum(n, 1)) > cost * kinds)
        often.append((hashes.astype(np.int64).view(np.uint64)[order], np.where(keep, kinds, 0)[order]))
        replies = answered.where("block is not null").repartition(parts, "block").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("range", "reply"))).alias("x")).select("block", F.transform("x", lambda x: x["reply"]).alias("replies"))
        tables.append(staging.put_by(replies, f"replies_{k}", "block", parts))
        staging.drop(f"answered_{k}")
        staging.collect_garbage()

    n, v = total["n"], total["v"]

    def add_up(batches: Iterator) -> Iterator:
        for _, keys, held, block, _ in blocks_of(batches, often):
            each = ((block.c > 0).astype(np.int64)[block.ids], np.log10((block.c + 1) / (n + v + 1))[block.ids], np.log10(block.p, out=block.p))
            sums = [np.add.reduceat(x, block.starts) for x in each]
            yield pa.RecordBatch.from_arrays([keys.values, held.values, pa.array(block.lengths), *map(pa.array, sums)], names=["key", "held_out", "n_tokens", "n_known", "base_score", "score"])
            del block, each

    done = joined().mapInArrow(add_up, f"key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return done.select(F.col("key").alias(key), "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _spelling(counted: DataFrame, staging: Staging, depth: int, threshold: float, p_min: float) -> Tree:
    """The tree that spells, from the different words of the training rows."""
    import pyarrow as pa

    def contexts(batches: Iterator) -> Iterator:
        for batch in batches:
            w = batch.column(0).to_pylist()
            if not w:
                continue
            code, before, _ = windows(w, depth)
            c = np.ones(len(code))
            for k in range(depth, -1, -1):
                # deepest first, each depth's pairs combined from the one below it and the contexts that end there
                keys, back = np.unique(code[before >= k] & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
                n = np.bincount(back, c[before >= k], len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["k", "pair", "n"])
                short = before < k
                code, c, before = np.concatenate((keys, code[short])), np.concatenate((n, c[short])), np.concatenate((np.full(len(keys), k), before[short]))

    spark = counted.sparkSession
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")  # larger batches combine more
    try:
        pairs = staging.put(counted.where("c > 0").select("word").mapInArrow(contexts, "k int, pair bigint, n bigint").groupBy("k", "pair").agg(F.sum("n").alias("n")), "pairs")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    root = np.zeros(256)
    for r in pairs.where("k = 0").collect():  # 256 rows at most
        root[r["pair"]] = r["n"]
    ctx = F.shiftright("pair", 8)
    totals = pairs.groupBy("k", ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).where(F.col("total") >= p_min * root.sum())
    known = staging.put(pairs.withColumn("ctx", ctx).join(totals, ["k", "ctx"]), "known")
    suffix = known.select((F.col("k") + 1).alias("k"), F.col("pair").alias("short"), (F.col("n") / F.col("total")).alias("q"))
    short = F.expr(" ".join(["case k", *(f"when {k} then pair & {(1 << 8 * k) - 1}" for k in range(1, depth + 1)), "end"]))
    tested = known.where("k > 0").withColumn("short", short).join(suffix, ["k", "short"])
    gain = F.sum(2 * F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q")))
    retained = tested.groupBy("k", "ctx").agg(gain.alias("gain"), F.first("kinds").alias("m")).where(F.col("gain") > threshold * F.col("m")).select("k", "ctx")
    # depth / p_min contexts at most, of 256 rows at most
    t = known.join(retained, ["k", "ctx"], "left_semi").select("k", "pair", "n", "total", "kinds").toArrow()
    staging.drop("pairs", "known")
    k, pair, n, total, kinds = (t.column(c).to_numpy() for c in ("k", "pair", "n", "total", "kinds"))
    out = []
    for d in range(1, depth + 1):
        at = np.flatnonzero(k == d)
        at = at[np.argsort(pair[at].astype(np.uint64))]
        out.append((pair[at].astype(np.uint64), n[at], total[at], kinds[at]))
    return Tree(out, root)
