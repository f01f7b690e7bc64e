"""Token counts by a tokenizer compiled to a deterministic finite-state transducer.

Byte-level BPE is compiled from the tokenizer's own file. A segmentation into tokens is the one the merges give
exactly if every two neighbouring tokens survive the merges when encoded together, so the encodings form a language
over a trie of the tokens whose only memory is the last token. Determinised, a state is the set of its live
hypotheses (last token, trie node of what was read since, tokens emitted relative to the newest); a transition on a
byte is annotated with the number of tokens by which it changes the emitted count. States are built when first
reached and kept up to a bound; beyond it a step is worked out without being kept, so memory is bounded and the
counts stay the same.

Above that, a text is cut into chunks. A boundary before white space that follows other characters is one in every
context, so the map of a chunk from the state it is entered in (the pending characters) to the state it leaves is
(characters up to its first such boundary, tokens between the first and the last, characters after the last). Maps
compose associatively; a tree-shaped prefix scan composes the chunks of a text, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Unicode's White_Space, as in a character class. A fixed value.
WHITE = "\t-\r \x85\xa0  -     　"
#: The pattern of byte-level pre-tokenization. A fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte -> the byte: printable ones stand for
    themselves, the rest for the letters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Counts the tokens of byte strings that pre-tokenization has cut out."""

    STATES, PAIRS = 150_000, 400_000

    def __init__(self, model: dict):
        letters = self.letters = byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        vocab = model["vocab"]
        self.single = {b[0]: vocab[t] for t, b in as_bytes.items() if len(b) == 1}
        self.bytes = {vocab[t]: b for t, b in as_bytes.items()}
        self.merges: dict[int, int] = {}
        self.rank, self.left, self.right = dict.fromkeys(vocab.values(), -1), {}, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a] << 32 | vocab[b]] = rank
            if self.rank[whole := vocab[a + b]] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, vocab[a], vocab[b]
        # a token that the merges never make whole, but cannot be cut to single bytes either, is never emitted
        self.alone = {i: (self.rank[i] >= 0 or len(b) == 1) and self.kept(i) for i, b in self.bytes.items()}
        self.trie: dict[int, int] = {}
        self.token = [-1]
        self.inner = {0}
        for i, b in self.bytes.items():
            node = 0
            for x in b:
                nxt = self.trie.get(node << 8 | x)
                if nxt is None:
                    nxt = self.trie[node << 8 | x] = len(self.token)
                    self.token.append(-1)
                    self.inner.add(node)
                node = nxt
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.start = (self.packed(-1, 0, 0),)
        self.ids: dict[tuple, int] = {self.start: 0}
        self.states: list[tuple] = [self.start]
        self.arcs: dict[int, tuple[int, int]] = {}

    def kept(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as the token."""
        return self.rank[token] < 0 or (self.kept(self.left[token]) and self.kept(self.right[token]) and self.seam(token))

    def seam(self, token: int) -> bool:
        """Whether the token's two parts are still apart when its own merge is due."""
        a, b, limit = self.left[token], self.right[token], self.rank[token]
        while True:
            ra, rb = self.rank[a], self.rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True
            both = self.merges.get(a << 32 | b)
            if both is not None and both < limit:
                return False

    @staticmethod
    def packed(last: int, node: int, n: int) -> int:
        """A hypothesis as one number: last token + 1, trie node, tokens emitted after it + 512."""
        return (last + 1) << 40 | node << 12 | (n + 512)

    def together(self, a: int, b: int) -> bool:
        """Whether the merges leave token b right of token a as they are.

        The last merges are undone one by one at the seam. Two pieces that meet there lasted until the earlier of
        the merges that took one of them in (limit); had a merge of both come before, the tokens would differ.
        Of equal merges the left one comes first.
        """
        limit, made, rank = 1 << 60, self.merges, self.rank
        while True:
            both = made.get(a << 32 | b)
            if both is not None and both < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra > rb:
                limit, a = ra, self.right[a]
            elif rb >= 0:
                limit, b = rb + 1, self.left[b]
            else:
                return True

    def step(self, state: tuple, byte: int) -> tuple[tuple, int]:
        """The next state and the change of the emitted count."""
        alive, end, emitted = [], -1, 0
        for hypothesis in state:
            nxt = self.trie.get((hypothesis >> 12 & 0xFFFFFFF) << 8 | byte)
            if nxt is None:
                continue
            if nxt in self.inner:
                alive.append(hypothesis & ~0xFFFFFFF000 | nxt << 12)
            t = self.token[nxt]
            if end < 0 and t >= 0:
                last = (hypothesis >> 40) - 1
                if last < 0:
                    ok = self.alone[t]
                else:
                    ok = self.pairs.get(last << 32 | t)
                    if ok is None:
                        if len(self.pairs) >= self.PAIRS:
                            self.pairs.clear()
                        ok = self.pairs[last << 32 | t] = self.together(last, t)
                if ok:
                    end, emitted = t, (hypothesis & 0xFFF) - 511
        alive = [h - emitted for h in alive] if emitted else alive
        alive.append(self.packed(end, 0, 0))
        return tuple(alive), emitted

    def count(self, word: bytes) -> int:
        total, at, arcs = 0, 0, self.arcs
        for i, byte in enumerate(word):
            arc = arcs.get(at << 8 | byte)
            if arc is None:
                state, emitted = self.step(self.states[at], byte)
                to = self.ids.get(state)
                if to is None:
                    if len(self.states) >= self.STATES:  # the rest of this word without keeping states
                        total += emitted
                        for b in word[i + 1 :]:
                            state, emitted = self.step(state, b)
                            total += emitted
                        return total
                    to = self.ids[state] = len(self.states)
                    self.states.append(state)
                arc = arcs[at << 8 | byte] = (to, emitted)
            at = arc[0]
            total += arc[1]
        return total


class Counter(dict):
    """Segment (white space and what follows up to the next) -> tokens: the transducer's arcs over whole segments,
    remembered up to a bound."""

    LIMIT = 400_000

    def __init__(self, path: str):
        import re

        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        self.special = [t["content"] for t in spec["added_tokens"] if t["content"]]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.transducer = Transducer(spec["model"])
        self.path, self.library = path, None
        self.find = regex.compile(PRETOKEN).findall
        self.segments = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.boundary = re.compile(f"(?<=[^{WHITE}])(?=[{WHITE}])")

    def pretokens(self, text: str) -> list[bytes]:
        """Letters beyond Latin may be classed by another version of Unicode: the library cuts those itself."""
        if text.isascii() or max(text) <= "\u024f":
            return [p.encode() for p in self.find(text)]
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        letters = self.transducer.letters
        return [bytes(letters[c] for c in p) for p, _ in self.library.pre_tokenize_str(text)]

    def __missing__(self, segment: str) -> int:
        n = 0
        for i, part in enumerate(self.at_special.split(segment) if self.at_special else [segment]):
            n += 1 if i % 2 else sum(map(self.transducer.count, self.pretokens(part)))
        if len(self) >= self.LIMIT:
            self.clear()
        if len(segment) <= 200:
            self[segment] = n
        return n

    def whole(self, text: str) -> int:
        """Tokens of characters that begin and end at boundaries."""
        return sum(map(self.__getitem__, self.segments(text)))

    def map_of(self, chunk: str) -> tuple[str, int, str] | str:
        """The chunk's state map, or the chunk itself if it has no boundary."""
        first = self.boundary.search(chunk)
        if first is None:
            return chunk
        a = z = first.start()
        for at in range(len(chunk) - 1, a, -1):
            if self.boundary.match(chunk, at):
                z = at
                break
        return chunk[:a], self.whole(chunk[a:z]), chunk[z:]

    def compose(self, a: tuple | str, b: tuple | str) -> tuple | str:
        if isinstance(a, str):
            return a + b if isinstance(b, str) else (a + b[0], b[1], b[2])
        if isinstance(b, str):
            return a[0], a[1], a[2] + b
        return a[0], a[1] + self.whole(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list) -> list:
        """All prefixes composed, in a depth that grows with the logarithm of their number."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0] if i == 0 else pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], m) for i, m in enumerate(maps)]

    def tokens(self, text: str, chunk: int = 1 << 16) -> int:
        if len(text) <= chunk:
            return self.whole(text)
        end = self.scan([self.map_of(text[i : i + chunk]) for i in range(0, len(text), chunk)])[-1]
        return self.whole(end) if isinstance(end, str) else self.whole(end[0]) + end[1] + self.whole(end[2])


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One compiled tokenizer per worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row, in input order; no shuffle.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with equal or null keys stay rows of their own; other
    columns are left out, whatever their names. path: the tokenizer's file, which every executor must have.
    """
    import pyarrow as pa

    schema = docs.select(F.col(key)).schema

    def run(batches: Iterator) -> Iterator:
        tokens = counter(path).tokens
        for batch in batches:
            n = [tokens(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    rows = docs.select(F.col(key), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"))
    out = rows.mapInArrow(run, f"`{key}` {schema[0].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
