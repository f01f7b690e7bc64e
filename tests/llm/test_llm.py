"""Each operator against brute force on a small table with nulls, empty and long texts, copies and extra columns."""

import collections
import math
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
SYLLABLES = "the of and ka lo mi ren tas vo shi que ing er on at éa ñu öß".split()


def make_docs():
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(SYLLABLES, rng.integers(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(70)
    rows = [(i, text(int(rng.integers(20, 150)))) for i in range(40)]
    rows += [(100 + i, text(20) + " " + passage + " " + text(15)) for i in range(4)]
    copy = text(90)
    rows += [(200 + i, copy) for i in range(5)]
    near = text(120).split()
    rows += [(300 + i, " ".join(near[:-1] + [f"x{i}"])) for i in range(6)]
    rows += [(400, None), (401, ""), (402, "  \n\t "), (403, text(6000)), (404, "one"), (405, "a<|endoftext|>b <|startoftext|>"), (406, "de " * 300), (None, text(30)), (407, rows[3][1]), (407, rows[3][1])]
    return rows


ROWS = make_docs()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, words string, id int, mark string, block int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 7 == 0 else "en", "hot" if k % 3 == 0 else f"s{k % 4}", len(t or ""), 0.0, "", 1, None, None) for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    from termweave.llm.token_counts import Counter, count_tokens

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = collections.Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in ROWS)
    got = count_tokens(docs, path).collect()
    assert collections.Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert count_tokens(none, path).count() == 0
    own = Counter(path)
    rng = np.random.default_rng(12)
    long = [" ".join("".join(rng.choice(SYLLABLES, rng.integers(1, 5))) + str(rng.choice(["", ",", "\n\n", "'s", "  "])) for _ in range(30_000)) for _ in range(2)] + ["ab" * 80_000]
    frame = docs.sparkSession.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(frame, path).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(long)}
    assert min(map(len, long)) > 100_000  # several chunks each
    for t in ("a  b\n\n c's <|endoftext|>", "x" * 500, "\xa0 \x1c! é'll", "日本 ٣٣"):
        for chunk in (1, 3, 7, 1000):
            assert own.tokens(t, chunk) == len(lib.encode(t, add_special_tokens=False).ids)


def test_packing(docs, none):
    from tokenizers import Tokenizer

    from termweave.llm.packing import fill, pack, plan

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    ids = collections.defaultdict(list)
    for i, t in ROWS:
        ids[i].append(lib.encode(t or "", add_special_tokens=False).ids + [1])
    got = pack(docs, path, size=256).collect()
    windows, total = collections.defaultdict(list), 0
    for r in got:
        assert any(len(x) == r["doc_tokens"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(len(x) for v in ids.values() for x in v)
    used = []
    for pieces in windows.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        used.append(at)
    assert max(used) <= 256 and sum(u < 256 for u in used) <= 1
    assert pack(none, path).count() == 0
    assert fill({5: 1, 4: 2, 3: 1}, 11) == {4: 2, 3: 1}
    runs, n = plan({200: 10, 60: 1}, 256)
    assert n == math.ceil(2060 / 256) and sum((r.high - r.low) * r.length for r in runs) == 2060


def shingle_sets(rows=ROWS):
    out = []
    for i, t in rows:
        w = (t or "").lower().split()
        out.append((i, frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    return out


def brute_links(rows):
    """(key, class, links) of every row, from all pairs."""
    sets = shingle_sets(rows)
    linked = [[k for k, (_, b) in enumerate(sets) if k != j and a and len(a & b) >= 0.8 * len(a | b)] for j, (_, a) in enumerate(sets)]
    root = list(range(len(sets)))
    for _ in root:
        root = [min([root[j], *(root[k] for k in linked[j])]) for j in range(len(root))]
    name = {g: min((sets[j][0] for j in range(len(root)) if root[j] == g and sets[j][0] is not None), default=None) for g in set(root)}
    return collections.Counter((sets[j][0], name[root[j]], len(linked[j])) for j in range(len(sets)))


def test_jaccard_join(docs, none, spark):
    from termweave.llm.lsh_forest import links, prefix_depth

    assert collections.Counter(tuple(r) for r in links(docs).collect()) == brute_links(ROWS)
    assert links(none).count() == 0
    assert prefix_depth(0.8, 0.999, 16, 8) == 4
    rng = np.random.default_rng(21)
    text = lambda n: ["".join(rng.choice(SYLLABLES, 3)) for _ in range(n)]
    a, b, c = text(60), text(60), text(9)
    rows = [(1, a), (1, b), (2, a[:-1] + ["x"]), (3, b[:-1] + ["y"]), (None, a[:-1] + ["z"]), (None, a[:-1] + ["z"]), (None, c), (None, c + ["e"]), (7, c[:5]), (7, c[:6]), (8, c[:6])]
    rows = [(i, " ".join(t)) for i, t in rows]  # keys that name several texts, or none
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert collections.Counter(tuple(r) for r in links(frame).collect()) == brute_links(rows)


def test_texts_half_alike_do_not_grow_together(spark, monkeypatch):
    """Texts at 0.3 to 0.5 collide often, but no group of theirs is compared."""
    from termweave.llm import lsh_forest, near

    rng = np.random.default_rng(22)
    text = lambda n: ["".join(rng.choice(SYLLABLES, 3)) for _ in range(n)]
    common = [text(70) for _ in range(3)]
    rows = [(i, " ".join(common[i % 3] + text(40 + i % 50))) for i in range(240)]
    rows += [(1000 + i, " ".join(rows[i][1].split()[:-2] + ["x", "y"])) for i in range(5)]
    groups = []
    real = near.cells
    monkeypatch.setattr(lsh_forest, "cells", lambda members, *a, **b: (groups.append(members.groupBy("grp").count().agg(F.max("count")).first()[0]), real(members, *a, **b))[1])
    got = collections.Counter(tuple(r) for r in lsh_forest.links(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == brute_links(rows) and sum(n for (_, _, n), m in got.items() for _ in range(m)) >= 10
    assert groups[0] > 10 and groups[1] <= 10  # collisions of many, groups of few


def test_depths_of_small_sets():
    from termweave.llm.lsh_forest import depths, nearest

    for n in range(1, 40):
        near = [c / (n + m - c) for m in range(1, 60) for c in range(1, min(n, m) + 1) if not c == n == m and c >= 0.8 * (n + m - c) - 1e-9]
        assert nearest(n, 0.8) == min(near, default=None)
        own, listed = depths(n, 0.8, 0.999, 16, 8)
        assert (own == 0) == (not near) and (not near or 1 - (1 - min(near) ** own) ** 16 >= 0.999 and own in listed)
        for m in range(1, 60):  # a partner lists what is asked for
            if any(c >= 0.8 * (n + m - c) - 1e-9 and not c == n == m for c in range(1, min(n, m) + 1)):
                assert own in depths(m, 0.8, 0.999, 16, 8)[1]


def test_blocks_of_a_large_group(spark, monkeypatch):
    from termweave.llm import near
    from termweave.llm.lsh_forest import links

    monkeypatch.setattr(near, "BLOCK_DOCS", 8)
    base = [f"w{i}" for i in range(100)]
    rows = spark.createDataFrame([(i, " ".join(base + [f"e{i}"])) for i in range(50)], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in links(rows).collect()} == {(0, 49)}


def test_suffix_dedup(docs, none, spark):
    from termweave.llm.suffix_dedup import remove, repeats

    spans = repeats(docs)
    got = collections.defaultdict(set)
    for r in spans.collect():
        got[r["doc_id"]] |= set(range(r["start"], r["end"]))
    texts = {i: (t or "").split() for i, t in ROWS if i is not None}
    for i in range(101, 104):
        assert len(got[i]) == 70 and min(got[i]) == 20
    assert 100 not in got and 200 not in got and all(len(got[i]) == 90 for i in range(201, 205))
    seen = collections.Counter(tuple(w[s : s + 50]) for w in texts.values() for s in range(len(w) - 49))
    for i, at in got.items():
        for p in at:  # what goes is in some window that occurs twice
            assert any(seen[tuple(texts[i][s : s + 50])] > 1 for s in range(max(0, p - 49), p + 1))
    cut = {r["doc_id"]: r["text"] for r in remove(docs, spans).collect()}
    assert cut[101].split() == texts[101][:20] + texts[101][90:] and cut[0] == dict(ROWS)[0] and not cut[201].strip()
    assert repeats(none).count() == 0


def test_suffix_dedup_is_exact(docs, spark):
    """All repeated windows of 50 words but the first go, and nothing else: brute force over every place."""
    from termweave.llm.suffix_dedup import repeats

    rng = np.random.default_rng(3)
    text = lambda n: ["".join(rng.choice(SYLLABLES, 3)) for _ in range(n)]
    rows, passage, lead, tail = [], text(100), text(15), text(15)
    for i, (a, z) in enumerate([([], []), ([], []), (lead, []), (lead, []), ([], tail), ([], tail), (lead, tail)]):  # lead-ins that the owner lacks
        rows.append((i, text(20) + a + passage + z + text(20)))
    n = 10
    for _ in range(30):  # the left part alone sets the pair apart from others that share the right part
        p = text(int(rng.integers(50, 56)))
        rows += [(n, text(30) + p + text(30)), (n + 1, text(30) + p + text(30))] + [(n + 2 + j, text(40) + p[16:] + text(30)) for j in range(3)]
        n += 5
    rows += [(500, ["de"] * 130), (501, text(5) + ["de"] * 77 + text(5))]
    rng.shuffle(order := list(range(len(rows))))
    frame = spark.createDataFrame([(rows[o][0], " ".join(rows[o][1])) for o in order], "doc_id bigint, text string")
    for table, texts in ((frame, dict(rows)), (docs, {i: (t or "").split() for i, t in ROWS if i is not None})):
        seen, want = set(), set()
        for i in sorted(texts):
            w = texts[i]
            for at in range(len(w) - 49):
                if (x := tuple(w[at : at + 50])) in seen:
                    want |= {(i, p) for p in range(at, at + 50)}
                seen.add(x)
        for whole in ("true", "false"):  # ranges as one task, and runs that cross ranges
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", whole)
            got = repeats(table.repartition(9)).collect()
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spots = [(r["doc_id"], p) for r in got for p in range(r["start"], r["end"])]
            assert set(spots) == want and len(spots) == len(want) and all(r["first_id"] <= r["doc_id"] for r in got)


def test_rows_of_one_key_keep_their_words(spark):
    from termweave.llm.suffix_dedup import remove, repeats

    rng = np.random.default_rng(13)
    text = lambda n: " ".join("".join(rng.choice(SYLLABLES, 3)) for _ in range(n))
    p, u, q = text(100), text(100), text(60)
    rows = [(2, p), (2, u), (5, p), (1, p), (7, q + " x"), (7, "y " + q), (7, "y " + q), (None, p)]
    frame = spark.createDataFrame([(i, t, 0, "s", i, 9) for i, t in rows], "doc_id bigint, text string, start int, row_hash string, id bigint, own int")
    spans = repeats(frame)
    left = collections.Counter((r["doc_id"], r["text"].strip()) for r in remove(frame, spans).collect())
    assert {k: n for k, n in left.items() if k[0] != 7} == {(2, ""): 1, (2, u): 1, (5, ""): 1, (1, p): 1, (None, p): 1}
    assert sum(q in t for i, t in left.elements() if i == 7) in (1, 2) and sum(left.values()) == len(rows)  # equal rows are one


def test_paragraphs(docs, none):
    from termweave.llm.paragraphs import duplicates

    got = duplicates(docs).collect()
    gone = {r["doc_id"] for r in got if r["removed"]}
    assert {101, 102, 103, 201, 202, 203, 204, *range(301, 306)} <= gone and 300 not in gone and not gone & set(range(3))
    assert duplicates(none).count() == 0


def test_paragraphs_of_any_length(spark):
    """Against brute force over all lines; the texts are too short for windows."""
    from termweave.llm.paragraphs import duplicates

    rng = np.random.default_rng(11)
    text = lambda n: " ".join("".join(rng.choice(SYLLABLES, 3)) for _ in range(n))
    lines = [text(n) for n in (1, 2, 4, 5, 6, 8, 9, 12, 19)]
    lines += [f"{x} {text(1)}" for x in lines if x.count(" ") > 3]  # one word more: 9 of 10 shingles may be near, 1 of 2 not
    rows = [(i, "\n".join([lines[i % len(lines)].upper() if i % 2 else lines[i % len(lines)], "", text(3)])) for i in range(2 * len(lines))]
    units, at = {}, 0
    for i, t in rows:
        at = 0
        for line in t.split("\n"):
            w = line.lower().split()
            if w:
                units[i, at, at + len(w)] = {tuple(w[s : s + 5]) for s in range(max(1, len(w) - 4))}
            at += len(w)
    names, root = sorted(units), {u: u for u in units}
    for a in names:
        for b in names:
            if root[a] != root[b] and len(units[a] & units[b]) >= 0.8 * len(units[a] | units[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {u: new if r == old else r for u, r in root.items()}
    size = collections.Counter(root.values())
    want = {(*u, u != r) for u, r in root.items() if size[r] > 1}
    got = duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {(r["doc_id"], r["start"], r["end"], r["removed"]) for r in got} == want and len(got) == len(want)
    assert any(z - a < 5 for _, a, z, _ in want) and any(5 <= z - a < 20 for _, a, z, _ in want)
    classes = collections.defaultdict(set)
    for r in got:
        classes[r["class_id"]].add(root[r["doc_id"], r["start"], r["end"]])
    assert all(len(c) == 1 for c in classes.values()) and len(classes) == len({root[tuple(w[:3])] for w in want})


def test_simhash(docs, none, spark):
    import hashlib

    from termweave.llm.common import GOLDEN, WORDS, mix64, window_hashes
    from termweave.llm.simhash import compare_edits, within_radius

    def plain(t):
        """The fingerprint as 128 votes, shingle by shingle."""
        h = window_hashes(WORDS.of(t.lower().split()), 5)
        if not len(h):
            return "0" * 128
        bits = [f"{int.from_bytes(int(x).to_bytes(8, 'little') + int(mix64(np.array([x], np.uint64) ^ GOLDEN)[0]).to_bytes(8, 'little'), 'big'):0128b}" for x in h]
        return "".join("1" if 2 * sum(b[i] == "1" for b in bits) > len(bits) else "0" for i in range(128))

    rows = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or ""))
    plains = {t: plain(t) for t in {t or "" for _, t in rows}}
    like = lambda a, b: round(sum(x == y for x, y in zip(a, b)) / 128, 9)
    as_hex = lambda b: f"{int(b, 2):032x}"
    want = collections.Counter()
    for j, (i, t) in enumerate(rows):
        t, after = t or "", rows[(j + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own, fp = plains[t], plain(edited)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), as_hex(own), as_hex(fp), like(own, fp), like(own, plains[after])] += 1
    assert collections.Counter((*tuple(r)[:5], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in compare_edits(docs).collect()) == want
    assert compare_edits(none).count() == 0
    one = compare_edits(docs.where("doc_id = 0")).first()
    assert one["near_next"] == 1.0
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (30, 16), dtype=np.uint8)
    more = [b.copy() for b in base for _ in range(2)]
    for b in more:
        for bit in rng.integers(0, 128, rng.integers(1, 5)):
            b[bit // 8] ^= 1 << bit % 8
    fps = sorted({bytes(b).hex() for b in [*base, *more]})
    near = {(a, b) for a in fps for b in fps if a < b and (int(a, 16) ^ int(b, 16)).bit_count() <= 3}
    frame = spark.createDataFrame([(f,) for f in fps] + [(None,), (fps[0],)], "fingerprint string")
    assert {(r["a"], r["b"]) for r in within_radius(frame, 3).collect()} == near


def brute_tree(rows, out, tok, depth=3, least=2, threshold=1.0, letters=6, spelling=3.0, p_min=5e-5):
    """log10 of every text's probability by dictionaries of all contexts."""
    texts = [(tok(t), out(i)) for i, t in rows]
    c = collections.Counter(w for t, held in texts if not held for w in t)
    n, ones, twos = sum(c.values()), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    discount = ones / max(1, ones + 2 * twos) or 0.5
    escape = discount * len(c) / n if n else 1.0
    emit = lambda w: b" \n" if w == "\n" else b" " + w.encode() + b" "
    followers = collections.defaultdict(collections.Counter)
    for w in c:
        for j in range(1, len(emit(w))):
            for k in range(min(j, letters) + 1):
                followers[emit(w)[j - k : j]][emit(w)[j]] += 1
    root = followers[b""]
    share = lambda x, s: followers[x][s] / sum(followers[x].values())
    kept = {
        x
        for x, f in followers.items()
        if x and sum(f.values()) >= p_min * sum(root.values()) and sum(2 * m * math.log(share(x, s) / share(x[1:], s)) for s, m in f.items()) > spelling * len(f)
    }

    def spelt(w):
        lp, text = 0.0, emit(w)
        for j in range(1, len(text)):
            p = (root[text[j]] + 1) / (sum(root.values()) + 256)
            for k in range(1, min(j, letters) + 1):
                if (x := text[j - k : j]) in kept:
                    p = (followers[x][text[j]] + len(followers[x]) * p) / (sum(followers[x].values()) + len(followers[x]))
            lp += math.log10(p)
        return escape * 10**lp

    after = collections.defaultdict(collections.Counter)
    for t, held in texts:
        for i in range(len(t)):
            for k in range(1, min(i, depth) + 1):
                after[tuple(t[i - k : i])][t[i]] += not held
    base, retained = {}, {}

    def prob(x, w):
        if w not in base:
            base[w] = ((c[w] - discount) / n if c[w] else 0.0) + spelt(w)
        p = base[w]
        for k in range(1, len(x) + 1):
            if keeps(s := x[-k:]):
                p = (after[s][w] + followed(s) * p) / (sum(after[s].values()) + followed(s))
        return p

    followed = lambda s: sum(m > 0 for m in after[s].values())

    def keeps(s):
        if s not in retained:
            total = sum(after[s].values())
            gain = sum(m * (math.log(m) - float(np.float16(math.log(prob(s[1:], w))))) for w, m in after[s].items() if m) if total >= least else 0.0
            retained[s] = total >= least and gain - total * math.log(total) > threshold * math.log(n) * followed(s)
        return retained[s]

    scores = [sum(math.log10(prob(tuple(t[max(0, i - depth) : i]), t[i])) for i in range(len(t))) for t, _ in texts]
    return scores, sum(retained.values())


def test_suffix_tree(docs, none, spark):
    from termweave.llm.suffix_tree import score

    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2
    tok = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in ROWS if not out(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = collections.Counter((i, out(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tok(t)), 6)) for i, t in ROWS)
    scores, contexts = brute_tree(ROWS, out, tok)
    assert contexts > 100
    for more in ({}, {"block_tokens": 300, "range_tokens": 400, "share": 0.05}):  # blocks, ranges, contexts dealt over ranges
        got = score(docs, held, depth=3, **more).collect()
        assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == want
        assert np.allclose(sorted(r["score"] for r in got), sorted(scores), rtol=1e-5)
    assert score(none, held).count() == 0
    assert all(r["score"] < 0 and r["n_known"] == 0 for r in score(docs, F.lit(True)).collect())  # nothing learnt
    words = ROWS[40][1].split()
    mixed = spark.createDataFrame([*ROWS, (9001, " ".join(sorted(words)))], "doc_id bigint, text string")
    far = {r["doc_id"]: r["score"] for r in score(mixed, F.coalesce(F.col("doc_id") > 9000, F.lit(False))).collect()}
    assert far[9001] < far[ROWS[40][0]] - 20  # the order of the words counts


def test_suffix_tree_of_a_hot_context(spark):
    """A third of all rows repeat one word pair: still the brute force's scores."""
    from termweave.llm.suffix_tree import score

    rng = np.random.default_rng(9)
    rows = [(i, " ".join(rng.choice(["ab", "cd", "ef", "gh"], 12))) for i in range(60)] + [(100 + i, "de de " * 40) for i in range(30)]
    tok = lambda t: t.split() + ["\n"]
    scores, contexts = brute_tree(rows, lambda i: i % 5 == 0, tok, depth=2, threshold=0.2)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = score(frame, F.col("doc_id") % 5 == 0, depth=2, threshold=0.2, range_tokens=200).collect()
    assert contexts > 3 and np.allclose(sorted(r["score"] for r in got), sorted(scores), rtol=1e-5)


def test_toxicity(spark, none):
    from termweave.llm.toxicity import Model, fit, features, score, train

    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        bad, group = i % 4 == 0, "muslim" if rng.random() < (0.5 if i % 4 == 0 else 0.05) else "christian"
        rows.append((i, " ".join([*(f"w{rng.integers(60)}" for _ in range(20)), group, *(["Idiot!"] if bad and rng.random() < 0.8 else [])]), int(bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = frame.select("doc_id", "toxic").union(spark.createDataFrame([(None, 1), (5, None)], "doc_id bigint, toxic int"))
    texts = frame.select("doc_id", "text")
    gap = {}
    for swap in (0.0, 1.0, 5.0):
        m = train(texts, labels, swap=swap)
        gap[swap] = np.mean([abs(m.score(t.replace("muslim", "christian")) - m.score(t.replace("christian", "muslim"))) for _, t, _ in rows])
        got = score(texts, m).join(frame, "doc_id").collect()
        assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.85
    assert gap[0.0] > 0.01 and gap[1.0] < 0.5 * gap[0.0] and gap[5.0] < 0.3 * gap[0.0]
    assert 0 < m.score(None) == m.score("") < 1
    assert score(none, m).count() == 0 and train(none, none.select("doc_id", F.lit(1).alias("toxic"))).score("x") < 0.3
    assert fit([], []).score("x") < 0.5 and features("...") == () and Model({}, 0.0).score("x") == 0.5


def test_toxicity_query(spark, tmp_path, monkeypatch):
    """The query itself: held-out rows are told apart, and naming a group moves scores less than without the penalty."""
    from termweave.llm import queries, toxicity

    rng = np.random.default_rng(4)
    rows = []
    for i in range(900):
        bad = i % 4 == 0
        group = "gay" if rng.random() < (0.4 if bad else 0.03) else "straight"
        rows.append((i, " ".join([*(f"w{rng.integers(80)}" for _ in range(25)), group, *(["moron", "scum"] if bad and rng.random() < 0.8 else [])]), int(bad)))
    rows += [(2000, None, 0), (2001, "", 0), (None, "moron", 1), (3, "again " * 20_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    frame.select("doc_id", "text", F.lit(0.9).alias("score"), F.lit(1).alias("held_out"), F.lit(7).alias("predicted")).write.parquet(str(tmp_path / "documents.parquet"))
    frame.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op7_toxicity(spark, str(tmp_path)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(i for i, _, _ in rows)
    truth = {i: b for i, _, b in rows[:900]}
    held = [r for r in got if r["doc_id"] in truth and r["doc_id"] != 3 and r["held_out"]]
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert len(held) > 150 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.85
    labels, docs = spark.read.parquet(str(tmp_path / "labels.parquet")), spark.read.parquet(str(tmp_path / "documents.parquet"))
    with_, without = toxicity.train(docs, labels), toxicity.train(docs, labels, swap=0.0)
    gap = lambda m: np.mean([abs(m.score(t.replace("straight", "gay")) - m.score(t.replace("gay", "straight"))) for _, t, _ in rows[:900]])
    assert gap(with_) < 0.5 * gap(without)


def test_swaps_of_a_text():
    from termweave.llm.toxicity import features, swapped

    groups = {"men": ("men", "women"), "women": ("men", "women")}
    f = lambda *ws: {x for w in ws for x in features(w)}
    assert list(swapped({"some", "men,"}, groups)) == [(f("some", "men") - f("some", "women"), f("some", "women") - f("some", "men"))]
    both = list(swapped({"men", "women"}, groups))  # the other term is there already: nothing is gained
    assert both == [(f("men") - f("women"), set()), (f("women") - f("men"), set())]
    assert not list(swapped({"a"}, groups))


def brute_nearest(rows, asked, k=5):
    """query row -> its nearest (vec_id, score), from all pairs of vectors of one length."""
    out = {}
    for q in asked:
        a = np.array(rows[q][1], float)
        scored = []
        for j, (i, v, *_) in enumerate(rows):
            if j != q and i is not None and v is not None and len(v) == len(a) and None not in v and np.isfinite(b := np.array(v, float)).all() and b.any():
                scored.append((-round(float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), 12), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_ann(spark):
    from termweave.llm.ann import search

    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 10))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 10), (1100, [float("nan")] + [1.0] * 9), (1150, [None] + [1.0] * 9), (None, x[0].tolist())]
    rows += [(2001 + i, x[50].tolist()) for i in range(40)]  # ties
    rows += [(100, x[7].tolist()), (100, x[8].tolist())]  # a key of several vectors
    rows += [(3000 + 50 * i, rng.normal(size=4).tolist()) for i in range(7)]  # another length
    frame = spark.createDataFrame([(i, v, 0, "x", 1, True, 0.5) for i, v in rows], "vec_id bigint, embedding array<double>, label int, id string, row int, is_query boolean, score double").repartition(3)
    hit = total = 0
    for more in ({}, {"block": 16, "lists": 8, "probe": 7, "parts": 4}):
        got = collections.defaultdict(list)
        for r in search(frame, F.col("vec_id") % 50 == 0, **more).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        asked = [j for j, (i, v) in enumerate(rows) if i is not None and i % 50 == 0 and i not in (1000, 1050, 1100, 1150)]
        want = brute_nearest(rows, asked)
        assert set(got) == {rows[q][0] for q in asked}
        for q in asked:
            i = rows[q][0]
            assert len(got[i]) == (15 if i == 100 else 5) and collections.Counter(n for n, _, _ in got[i]) == dict.fromkeys(range(1, 6), 3 if i == 100 else 1)
            pairs = {(v, round(s, 9)) for _, v, s in got[i]}
            hit, total = hit + sum((v, round(s, 9)) in pairs for v, s in want[q]), total + len(want[q])
        assert [v for _, v, _ in sorted(got[50])] == [2001, 2002, 2003, 2004, 2005]
    assert hit / total >= 0.9
    assert not {1000, 1050, 1100, 1150, None} & (set(got) | {v for g in got.values() for _, v, _ in g})
    assert search(frame.where("false"), F.lit(True)).count() == 0
    assert len(search(frame.where("vec_id < 3"), F.lit(True)).collect()) == 6
    assert search(frame.where("vec_id = 3"), F.lit(True)).count() == 0
    floats = frame.where("vec_id < 20").select("vec_id", F.col("embedding").cast("array<float>").alias("embedding"))
    assert search(floats, F.lit(True)).count() == 100


def test_codes_filter_and_visits_follow_the_vectors():
    """The share of codes that is reranked holds the nearest, as a part chosen by chance would not; clustered vectors
    need few lists."""
    from termweave.llm.ann import fit, unit, visits_needed

    rng = np.random.default_rng(17)
    loose = unit(rng.normal(size=(2500, 32)))
    index = fit(loose, 1, 16)
    codes = index.codes(loose, np.zeros(len(loose), int))
    hit = total = 0
    for q in range(0, len(loose), 50):
        near = loose[q] @ index.centroids[0] + sum((book @ loose[q].reshape(16, -1)[j])[codes[:, j]] for j, book in enumerate(index.books))
        best = np.argsort(-np.delete(loose @ loose[q], q))[:5]
        kept = np.argsort(-np.delete(near, q))[: int(0.1 * len(loose))]
        hit, total = hit + len(set(best) & set(kept)), total + 5
    assert hit / total > 0.95
    tight = unit(np.repeat(rng.normal(size=(50, 32)), 50, axis=0) + 0.1 * rng.normal(size=(2500, 32)))
    assert visits_needed(fit(tight, 50, 16), tight, 5, 0.98) <= 5 < 20 < visits_needed(fit(loose, 50, 16), loose, 5, 0.98)


def test_ann_at_production_parameters(spark):
    """Recall on the embeddings themselves, and what the codes leave to be measured exactly."""
    import pyarrow.parquet as pq

    from termweave.llm import queries

    d = "/root/testdata/sf0.1"
    if not __import__("os").path.exists(d):
        pytest.skip("no test data")
    t = pq.read_table(f"{d}/embeddings.parquet", columns=["vec_id", "embedding"])
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in queries.op1_ann(spark, d).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        best = ids[np.argsort(-s)[:5]]
        hit, total = hit + len(set(best.tolist()) & got[ids[q]]), total + 5
    assert hit / total >= 0.95


def brute_rake(cells, goals, start=None, rounds=3000, cap=math.inf, reach=math.inf):
    """cells: {(source, lang, topic): tokens} -> weights by plain proportional fitting, none above the cap."""
    total, base = sum(cells.values()), start or dict.fromkeys(cells, 1.0)
    factor = [dict.fromkeys(g, 1.0) for g in goals]
    weight = lambda c: min(cap, base[c] * math.prod(f[c[e]] for e, f in enumerate(factor)))
    for _ in range(rounds):
        for d, goal in enumerate(goals):
            now = collections.Counter()
            for c, m in cells.items():
                now[c[d]] += m * weight(c)
            for v, g in goal.items():
                factor[d][v] = min(reach, max(1 / reach, factor[d][v] * g * total / now[v] if now[v] else 0.0))
    return {c: base[c] * math.prod(f[c[e]] for e, f in enumerate(factor)) for c in cells}


@pytest.mark.parametrize("most_cells", [200_000, 0])
def test_mixing(docs, none, spark, monkeypatch, most_cells):
    """All three marginals, on the driver and on the executors, against plain fitting over dictionaries."""
    from termweave.llm import mixing

    monkeypatch.setattr(mixing, "ROUNDS", 12)
    monkeypatch.setattr(mixing, "AGAIN", 3)
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(rng.choice([f"{w}{i % 3}" for w in SYLLABLES], rng.integers(1, 40))), f"s{i % 6}", f"l{rng.integers(3)}") for i in range(400)]
    rows += [(2000, "", "s0", "l0"), (2001, None, "s9", None), (2002, "word", None, "l1"), (3, "other words " * 9, "s1", "l1"), (None, "a b c d", "s2", "l1"), (None, "a b c e", "s2", "l1"), (2003, "long " * 9000, "s3", "l2")]
    frame = spark.createDataFrame([(*r, 0.1, 2, "x", True, 1.0) for r in rows], "doc_id bigint, text string, source string, lang string, weight double, topic int, row string, sampled boolean, luck double").repartition(3)
    wanted = {"source": {f"s{j}": 1.0 for j in range(6)} | {"(missing)": 0.01}}
    more = {"wanted": wanted, "budget": 0.5, "most_cells": most_cells, "topics": 3}
    got = mixing.weigh(frame, **more).toPandas()
    assert len(got) == len(rows)
    assert sorted(got["n_tokens"]) == sorted(len((t or "").split()) for _, t, _, _ in rows)
    tokens = got[got.n_tokens > 0].groupby(["source", "lang", "topic"])["n_tokens"].sum()
    cells = {c: float(n) for c, n in tokens.items()}
    sums = [collections.Counter() for _ in range(3)]
    for c, n in cells.items():
        for d in range(3):
            sums[d][c[d]] += n
    shares = [{v: wanted["source"].get(v, 0.0) for v in sums[0]}, *({v: (n / sum(s.values())) ** p for v, n in s.items()} for s, p in zip(sums[1:], (0.7, 0.5)))]
    goals = [{v: x / sum(s.values()) for v, x in s.items()} for s in shares]
    weight = brute_rake(cells, goals, rounds=12)
    level = sum(cells.values()) / sum(cells[c] * w for c, w in weight.items())
    weight = {c: w * level for c, w in weight.items()}
    odds = brute_rake(cells, [{v: g * 0.5 for v, g in goal.items()} for goal in goals], {c: 0.5 * w for c, w in weight.items()}, 3, 1.0, mixing.REACH)
    low, high = 0.0, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(m * min(1, mid * odds[c]) for c, m in cells.items()) < 0.5 * sum(cells.values()) else (low, mid)
    odds = {c: min(1, high * x) for c, x in odds.items()}
    for r in got.itertuples():
        if (r.source, r.lang, r.topic) in cells:
            assert abs(r.weight - weight[r.source, r.lang, r.topic]) < 1e-4 * max(1, r.weight) and abs(r.probability - odds[r.source, r.lang, r.topic]) < 1e-4
        else:
            assert (r.weight, r.probability, r.sampled) == (1.0, 1.0, True)
    assert len(set(got.topic)) == 3
    if not most_cells:
        return
    whole = mixing.drawn(frame, **more)
    assert whole.columns == frame.columns and whole.count() == got["sampled"].sum()  # rows, not keys
    again = mixing.weigh(frame.repartition(5), **more).toPandas()
    assert sorted(got[got.sampled].doc_id.dropna()) == sorted(again[again.sampled].doc_id.dropna())
    assert mixing.weigh(none, most_cells=-1).count() == 0 and mixing.weigh(none).count() == 0 and mixing.drawn(none).count() == 0
    with pytest.raises(ValueError):
        mixing.weigh(frame, {"lang": {"nowhere": 1.0}}, most_cells=most_cells).count()


def test_mixing_meets_its_budget(docs):
    from termweave.llm import mixing

    got = mixing.weigh(docs, {"lang": {"en": 0.5, "(missing)": 0.5}}, budget=0.2).toPandas()
    mass = got["n_tokens"] * got["weight"]
    assert abs(mass[got["lang"] == "en"].sum() / mass.sum() - 0.5) < 1e-6 and abs(mass.sum() / got["n_tokens"].sum() - 1) < 1e-6
    expected = got["n_tokens"] * got["probability"]
    assert abs(expected.sum() / got["n_tokens"].sum() - 0.2) < 1e-6 and (got["probability"] <= 1).all()


def test_topics():
    from termweave.llm import mixing

    rng = np.random.default_rng(6)
    words = [[f"{c}{i}" for i in range(200)] for c in "abc"]
    rows = [mixing.counted(list(rng.choice(words[i % 3], 40)) + ["the"] * 10) for i in range(90)]
    model = mixing.fit_topics(rows, 3)
    own = [model.of(r) for r in rows]
    assert len(set(own)) == 3 and all(own[i] == own[i % 3] for i in range(90))
    assert mixing.fit_topics([], 3).of(rows[0]) == 0 and mixing.fit_topics(rows[:1] * 5, 3).of(rows[0]) == 0 and model.of(mixing.counted([])) == 0


def test_paragraphs_have_one_plan(docs, monkeypatch):
    """Small sides are not broadcast, so that shuffles grow in proportion."""
    from termweave.llm.common import Staging
    from termweave.llm.paragraphs import duplicates

    plans, put = {}, Staging.put
    monkeypatch.setattr(Staging, "put", lambda self, df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or put(self, df, name))
    plans["out"] = duplicates(docs)._jdf.queryExecution().executedPlan().toString()
    for name in ("candidates_0", "members", "named", "in_class", "windows", "line_heads", "window_heads", "out"):
        assert "Broadcast" not in plans[name], name


def test_compared_suffixes_are_slim(docs, monkeypatch):
    """Rows of repeats hold no hashes of words, and what is staged is dropped and swept as early as can be."""
    from termweave.llm.common import Staging
    from termweave.llm.suffix_dedup import repeats

    tables, calls, put = {}, [], Staging.put
    monkeypatch.setattr(Staging, "put", lambda self, df, name: calls.append(name) or tables.setdefault(name, put(self, df, name)))
    monkeypatch.setattr(Staging, "collect_garbage", lambda self: calls.append("swept"))
    repeats(docs)
    assert calls == ["anchors", "often", "suffixes", "swept", "compared", "swept"]
    told = tables["compared"].where("kind in (0, 3)")
    assert told.count() and not told.where("hash <> 0 or `check` <> 0 or own_spot <> 0").count()


def test_words_are_spelt_as_by_the_library(monkeypatch):
    from tokenizers import Tokenizer

    from termweave.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    own, lib = packing.WordIds(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list(packing.LETTERS), rng.integers(1, 30))) for _ in range(2000)] + [*packing.LETTERS, "ªb", "µ", "don't", "İs", "e\u0301a", "a\u0301", "ſt", "x,y", "3a", "A" * 120, "日本"]
    calls, encode = [], own.encode
    monkeypatch.setattr(own, "encode", lambda text: calls.append(text) or encode(text))
    for w in words:
        assert np.frombuffer(own[w], own.kind).tolist() == lib.encode(w, add_special_tokens=False).ids, w
    assert len(calls) < 20  # the others went to the model itself
    for t in (" ".join(words), "a\x1cb", "a<|endoftext|>b", "é\u0301 x"):
        assert own.ids(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def test_topics_of_all_rows(spark):
    """Topics are fitted on every row: beyond 4,000 too, in whatever parts, as in memory."""
    from termweave.llm import mixing
    from termweave.llm.common import Staging

    rng = np.random.default_rng(10)
    words = [[f"{c}{i}" for i in range(60)] for c in "abc"]
    texts = [" ".join(rng.choice(words[i % 2 if i % 50 else 2], rng.integers(1, 12))) for i in range(4500)] + ["", None, "a1 a2", "a1 a2"]
    frame = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(texts)], "doc_id bigint, text string, source string, lang string")
    told = lambda parts: frame.repartition(parts).select(mixing.describe()(F.col("text")).alias("x")).select("x.*")
    models = [mixing.learn_topics(told(n), 3, Staging(spark)) for n in (2, 5)]
    models.append(mixing.fit_topics([mixing.counted((t or "").split()) for t in texts], 3))
    for model in models:  # words' weights count all rows
        assert (model.weights == models[0].weights).all() and (model.centres == models[0].centres).all()
    one = int(mixing.counted(["a1"])[0][0])
    hold = sum(one in mixing.counted((t or "").split())[0] for t in texts)
    assert abs(models[0].weights[one] - math.log((1 + sum(bool(t) for t in texts)) / (1 + hold))) < 1e-12
    got = {r["doc_id"]: r["topic"] for r in mixing.weigh(frame, topics=3).collect()}
    assert all(got[i] == models[0].of(mixing.counted((t or "").split())) for i, t in enumerate(texts))
    assert len({got[i] for i in range(4500) if i % 50 == 0}) == 1 and len(set(got.values())) == 3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    rows = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(ROWS)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    toxic = [(500 + i, f"word{i} you idiot{'' if i % 2 else '!'} moron here now w{i} " * 3, "en", "s0", 10) for i in range(30)]
    docs = docs.unionByName(spark.createDataFrame(toxic, docs.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None] + [(t[0], 0, 1) for t in toxic], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in p.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r[0] for r in at.select("doc_id").collect()})
        if name != "packing":
            assert at.columns == docs.columns
    assert not kept[0] & {t[0] for t in toxic} and {i for i, _ in ROWS} <= kept[0]
    assert 200 in kept[1] and not kept[1] & {201, 202, 203, 204, 301, 302} and 300 in kept[1]
    assert {100, 101, 102, 103, 400, 401, 402} <= kept[2] and kept[3] <= kept[2] and kept[4] == kept[3]
    assert {r["doc_id"] for r in p.run(spark, str(tmp_path)).collect()} == kept[4]


def test_components(spark):
    from termweave.llm.common import Staging, components

    pairs = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(300, 360)] + [(700, 701), (701, 700), (702, 702), (None, 3), (3, None), (-5, 700)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint"), Staging(spark), "c").collect())
    want = {i: 100 for i in range(100, 141)} | {i: 300 for i in [*range(300, 360), 500]} | {700: -5, 701: -5, -5: -5}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Staging(spark), "c").count() == 0


def test_staged_files_come_alone(spark):
    """No checksum files, for which a process is forked with every file."""
    from termweave.llm.common import Staging

    staging = Staging(spark)
    assert staging.put(spark.range(90).repartition(3), "a").count() == 90 and staging.put_by(spark.range(50), "b", "id", 2).count() == 50
    files = [p.name for p in Path(staging.root.removeprefix("file://")).rglob("*") if p.is_file()]
    assert any(x.endswith(".parquet") for x in files) and not any(x.endswith(".crc") for x in files)


def test_places_of_words_beyond_the_cache(monkeypatch):
    """Words that are not remembered are hashed together, to the places they would have alone."""
    from xxhash import xxh3_64_intdigest

    from termweave.llm import mixing
    from termweave.llm.common import mix64

    monkeypatch.setattr(mixing, "PLACES", {})
    monkeypatch.setattr(mixing.WORDS.__class__, "LIMIT", 10)
    words = [f"w{i % 37}é" for i in range(100)]
    want = [int(mix64(np.array([xxh3_64_intdigest(w)], np.uint64))[0]) % mixing.SPACE for w in words]
    assert mixing.places_of(words).tolist() == want and mixing.places_of(words[::-1]).tolist() == want[::-1]
    assert len(mixing.PLACES) == 10 and mixing.places_of([]).tolist() == []


def test_a_pass_deals_few_rows(spark, monkeypatch):
    """A pass of op10 sends its sums in slices, not a row for each place and centre."""
    from termweave.llm import mixing
    from termweave.llm.common import Staging

    frame = spark.createDataFrame([(f"a{i} b{i % 7} c{i % 3}",) for i in range(300)], "text string")
    told = frame.select(mixing.describe()(F.col("text")).alias("x")).select("x.*")
    sent, whole = [], type(told).toArrow
    monkeypatch.setattr(type(told), "toArrow", lambda self: sent.append(whole(self)) or sent[-1])
    mixing.learn_topics(told, 3, Staging(spark))
    assert sent and all(t.num_rows <= 3 * mixing.SPACE // mixing.SLICE + 1 for t in sent)


def test_packing_leaves_few_words_in_the_workers(spark):
    from termweave.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(45_000))) for i in range(8)], "doc_id bigint, text string").repartition(2)
    assert packing.pack(docs, path, size=2048, end_id=1).count()

    def held(batches):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._IDS.get(path, ()))])], names=["n"])

    assert max(r["n"] for r in spark.range(400).repartition(40).mapInArrow(held, "n bigint").collect()) <= packing.WORDS.LIMIT


def test_keys_alike_in_their_first_bits_are_told_apart():
    """op3's order of keys, by first bits and places at once, is the stable order."""
    from termweave.llm.suffix_tree import numbered, ordered

    rng = np.random.default_rng(3)
    for keys in (rng.integers(0, 50, 3000), rng.integers(0, 1 << 63, 3000)[rng.integers(0, 3000, 5000)], np.repeat(rng.integers(0, 1 << 40, 9) << 20, 200) + rng.integers(0, 2, 1800) * 5, np.zeros(0, int), np.array([7])):
        keys = keys.astype(np.uint64)
        want = np.unique(keys, return_index=True, return_inverse=True)
        assert (ordered(keys) == np.argsort(keys, kind="stable")).all() and all((a == b).all() for a, b in zip(numbered(keys), want))


def test_words_of_texts_are_counted_together(monkeypatch):
    """op10 counts the words of many texts at once, in runs of letters, as of each alone."""
    from xxhash import xxh3_64_intdigest

    from termweave.llm import mixing
    from termweave.llm.common import hashes_of, words_of

    rng = np.random.default_rng(4)
    pieces = [rng.bytes(n) for n in (*range(1, 40), 300) for _ in range(30)]
    sizes = np.array([len(x) for x in pieces])
    want = [xxh3_64_intdigest(x) for x in pieces]
    assert hashes_of(b"-".join(pieces), np.cumsum(sizes + 1) - sizes - 1, sizes).tolist() == want
    texts = [t for _, t in ROWS] + [" \x1c\x85\u3000", "\xa0ΟΔΟΣ İ\u2028x\x1fy\x00z", "B b\x0bB", None, " ", "é" * 9 + " é", "last"]
    data, starts, lengths, held = words_of([t or "" for t in texts])
    split = [(t or "").lower().split() for t in texts]
    assert [data[a : a + n].decode() for a, n in zip(starts, lengths)] == [w for words in split for w in words]
    assert held.tolist() == [len(words) for words in split]
    for run in (50, 400_000):
        monkeypatch.setattr(mixing, "RUN", run)
        tokens, part = mixing.counted_all(texts)
        assert tokens.tolist() == held.tolist()
        for words, a, z, mark in zip(split, part.bounds, part.bounds[1:], part.mark):
            at, n = mixing.counted(words)
            assert part.at[a:z].tolist() == at.tolist() and part.n[a:z].tolist() == n.tolist()
            assert np.int64(mark).view(np.uint64) == xxh3_64_intdigest(at.astype("<u2").tobytes() + n.astype("<u4").tobytes())
    assert len(mixing.counted_all([])[0]) == 0 and mixing.counted_all([None])[0].tolist() == [0]


def test_a_pass_has_few_tasks(spark, monkeypatch):
    """op10's passes read many small files in few tasks."""
    from termweave.llm import mixing
    from termweave.llm.common import Staging

    own = {"spark.sql.shuffle.partitions": "40", "spark.sql.files.maxPartitionBytes": "4m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old, sc, tasks = {k: spark.conf.get(k, None) for k in own}, spark.sparkContext, []

    def once(weights, topics, rounds, spreads, sums):
        for name, step in (("spreads", lambda: spreads(*[np.zeros((0, mixing.SPACE))] * 2, 0)), ("sums", lambda: sums(np.ones((2, mixing.SPACE))))):
            sc.setJobGroup(name, name)
            assert len(step())
            told = sc.statusTracker()
            first = min(i for j in told.getJobIdsForGroup(name) for i in told.getJobInfo(j).stageIds)
            tasks.append(told.getStageInfo(first).numTasks)
        return mixing.Topics(np.zeros((0, mixing.SPACE)), weights)

    monkeypatch.setattr(mixing, "centres_of", once)
    frame = spark.createDataFrame([(f"a{i} b{i % 7} c{i % 3}",) for i in range(300)], "text string")
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        mixing.learn_topics(frame.select(mixing.describe()(F.col("text")).alias("x")).select("x.*"), 3, Staging(spark))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tasks == [sc.defaultParallelism] * 2


def test_words_of_a_block_are_sent_together(spark, monkeypatch):
    """op3 deals the counts of a block's words to it as few packed rows, not as a row a word."""
    from termweave.llm import suffix_tree

    frame = spark.createDataFrame([(i, " ".join(f"w{i % 9}x{j} the" for j in range(150))) for i in range(20)], "doc_id bigint, text string").repartition(2)
    sent, deal = [], type(frame).repartition
    monkeypatch.setattr(type(frame), "repartition", lambda self, *a: ("number" in self.columns and sent.append(self.count())) or deal(self, *a))
    scored = lambda **more: sorted(suffix_tree.score(frame, F.col("doc_id") == 3, **more).collect())
    whole = scored()
    assert len(whole) == 20 and sent and max(sent) <= 2 * 4  # blocks x partitions
    assert all(a[:5] == b[:5] and math.isclose(a[6], b[6], rel_tol=1e-9) for a, b in zip(whole, scored(packed_words=7, spelt_words=5)))


def test_words_of_a_block_lie_in_several_rows(spark, monkeypatch):
    """op3's executors hold a block's tokens packed, and its words in rows of bounded size."""
    from termweave.llm.common import Staging
    from termweave.llm.suffix_tree import score

    rows = [(0, " ".join(f"w{i}" for i in range(45_000)) + " w7"), (1, " ".join(f"w{i}" for i in range(44_990, 45_010)))]
    seen, put = [], Staging.put_by

    def staged(self, df, name, *a):
        out = put(self, df, name, *a)
        if name == "coded":
            seen.extend(out.agg(F.max(F.size("words")), F.max(F.length("ids")), F.sum(F.size("words"))).first())
        return out

    monkeypatch.setattr(Staging, "put_by", staged)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = sorted(score(frame, F.col("doc_id") == 1).collect())
    n, v = 45_002, 45_001
    log = lambda c: math.log10((c + 1) / (n + v + 1))
    assert seen[0] <= 20_000 and seen[1] < 2 * n
    assert [tuple(r)[:5] for r in got] == [(0, False, n, n, n), (1, True, 21, 11, n)]
    assert np.allclose([r["base_score"] for r in got], [44_999 * log(1) + 2 * log(2) + log(1), 11 * log(1) + 10 * log(0)])


def test_a_depth_takes_little_memory():
    """op3's arrays of a block at one depth, with what makes them, per token."""
    import tracemalloc

    from termweave.llm.suffix_tree import Depth, mix64

    rng = np.random.default_rng(5)
    ids = (40_000 * rng.random(300_000) ** 3).astype(np.uint32)
    words, counts = rng.integers(0, 1 << 63, 40_000).astype(np.uint64), np.bincount(ids, minlength=40_000)
    ctx, p, hashes = np.concatenate(([-1], ids[:-1])).astype(np.int32), np.full(len(ids), 0.5), mix64(words)
    tracemalloc.start()
    try:
        own = Depth(ctx, ids, words, hashes, counts, 20, 1e9)
        own.step(p, [], (np.zeros(0, np.uint64), np.zeros(0)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 * len(ids), peak / len(ids)
