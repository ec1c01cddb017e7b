"""Reversed search, tree BPE and the Merkle manifest: brute force, the tokenizers library and plain hashing; odd inputs."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.llm import op11_reversed_search as op11
from morphlake.llm import op12_tree_bpe as op12
from morphlake.llm import op13_merkle_manifest as op13

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LARGE = 1 << 60


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def terms(text):
    out, word = [], bytearray()
    for b in (text or "").encode() + b" ":
        if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128:
            word.append(b + 32 if 65 <= b < 91 else b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out


def brute_search(docs, items, top):
    counts = [(i, collections.Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most_terms", [1_000_000, 25, 1])
def test_reversed_search_equals_brute_force(spark, most_terms):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)] + ["École", "ÉCOLE", "don't", "a_b", "x\x00y", "zz\x7fq"]
    rows = [(LARGE + i % 90, " ".join(rng.choices(words, k=rng.randint(1, 60))), "s") for i in range(160)]
    rows += [(5, rows[0][1], "s"), (None, rows[0][1], "s"), (None, None, None), (7, "", "s"), (8, "?!", "s"), (9, "w1 " * 30_000, "s")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(12)] + [(3, "w1 w1 w2"), (None, "w3 W3"), (77, None), (78, ""), (79, "nowhere")]
    table = spark.createDataFrame([(t, i, "clash") for i, t in items], "text string, item_id long, rank string")
    found = op11.reversed_search(docs_of(spark, rows).withColumn("score", F.lit("clash")), table, top=7, most_terms=most_terms)
    assert sorted(map(tuple, found.collect()), key=str) == brute_search([r[:2] for r in rows], items, 7)


def test_reversed_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "w")], "item_id long, text string")
    assert op11.reversed_search(docs_of(spark, [(1, "w", "s")]), none).count() == 0
    assert op11.reversed_search(docs_of(spark, []), some).count() == 0
    assert [tuple(r) for r in op11.reversed_search(docs_of(spark, [(1, "w", "s")]), some).collect()] == [(1, 1, 1, 287 * (10**9 // 2200))]


def test_sums_beyond_exact_doubles():
    index = op11.Index(np.array([1], dtype=np.uint64), np.array([0, 1]), np.array([0]), np.array([(1 << 25) + 1]), [4])
    zero = np.zeros(1, dtype=np.int64)
    score = op11._scores(index, np.array([30_001]), np.array([100]), zero, zero, np.array([1]))
    assert score[0, 0] == 30_001 * (10**9 // 2200) * ((1 << 25) + 1)


def test_heaps_keep_the_best_whatever_the_order():
    rng = np.random.default_rng(2)
    scores, ids = rng.integers(0, 6, (300, 5)), [int(i) for i in rng.permutation(300)]
    heaps = op11.Heaps(5, 10)
    for a in range(0, 300, 70):
        heaps.offer(scores[a : a + 70], ids[a : a + 70])
    for item in range(5):
        want = sorted((-int(s), i) for s, i in zip(scores[:, item], ids, strict=True) if s > 0)[:10]
        assert sorted((-s, d) for i, d, s in heaps.rows() if i == item) == want


@pytest.fixture(scope="module")
def encoder():
    return op12.Encoder(op12.vocabulary())


def by_tree(encoder, text, piece):
    leaves = encoder.pieces(text, piece)
    assert "".join(t for t, *_ in leaves) == text
    nodes = [encoder.leaf(*leaf) for leaf in leaves]
    return encoder.tree(nodes, [n.tail > 0 for n in nodes]).ids.tolist(), sum(n.tail > 0 for n in nodes)


SIGNS = ["a", "b", "the", "ing", "'s", "'re", "'ll", "''", "!", "!!", "1", "23", " ", "\n", "é", "É", "́", "ß", "İ", "中", "<|startoftext|>", "<|endoftext|>", "<|STARTOFTEXT|>", "</w>", "\u0085", "\x1c", "ﬁ", "가", "가", "Å", "\U0001f600", "<|", "|>", "अि", "﻿", "‍", "ǅ", "٣", "Ⅷ"]


def test_tree_equals_the_library_on_random_signs(encoder):
    rng, inside = random.Random(5), 0
    for _ in range(600):
        signs = rng.sample(SIGNS, rng.randint(1, 12))
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 300)))
        got, cuts = by_tree(encoder, text, rng.choice([4, 16, 33, 70]))
        inside += cuts
        assert got == encoder.full.encode(text, add_special_tokens=False).ids, text
    assert inside > 1000


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 20_000, "hello" * 9_999, "!" * 40_001, "haha" * 7_777 + "x", "'" * 5_000 + "s" * 5_000, "é" * 20_000, "́" * 3_000])
def test_tree_equals_the_library_on_long_unsplit_texts(encoder, text):
    assert by_tree(encoder, text, 1000)[0] == encoder.full.encode(text, add_special_tokens=False).ids


def test_runs_are_forgotten_and_learnt_again(encoder, monkeypatch):
    monkeypatch.setattr(op12, "_REMEMBERED", 3000)
    for text in ("some words here", "other words " * 3, "some " + " ".join(f"w{i}" for i in range(50)), "some words here"):
        assert b"".join(i for i, _ in encoder.runs(text)) == np.array(encoder.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_a_run_that_comes_again_is_learnt_once(encoder, monkeypatch):
    """Texts of one common run and a rare one each; the memory has room for some ten runs."""
    monkeypatch.setattr(op12, "_REMEMBERED", 4000)
    monkeypatch.setattr(encoder, "_known", {})
    monkeypatch.setattr(encoder, "_size", 0)
    learnt, learn = [], encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda runs: (learnt.extend(runs), learn(runs)))
    for i in range(100):
        assert [d for _, d in encoder.runs(f"common rare{i}")][0] == encoder.full.decode(encoder.full.encode("common", add_special_tokens=False).ids).encode()
    assert learnt.count(b"common") == 1 and len(learnt) == 101


def test_new_runs_are_encoded_in_one_text(encoder, monkeypatch):
    calls, encode = [], encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda texts: (calls.append(len(texts)), encode(texts))[1])
    for runs in ([f"Zq{i},x{i}'s" for i in range(50)], ["a\x01b", "\x01", "c"], ["\u0301e", "\u00a0", "<|endoftext|>", "\x01\x01"], ["\u200b", "\U0001f600x"], ["\x01"]):
        calls.clear()
        raw = [r.encode() for r in runs]
        assert encoder._apart(raw) == [e.ids for e in encoder.full.encode_batch(runs, add_special_tokens=False)]
        assert calls[0] == 1 if not any("\x01" in r for r in runs) else calls == [len(runs)]


def test_vocabularies_with_loose_merges_are_refused():
    op12.check_merges({"merges": ["a b", "ab c</w>"]})
    for merges in (["ab c", "a b"], ["a b", "b c", "ab c", "a bc"]):
        with pytest.raises(ValueError, match="doesn't follow"):
            op12.check_merges({"merges": merges})


@pytest.mark.parametrize("piece", [op12.PIECE, 60])
def test_encoding_of_tables(spark, encoder, piece):
    rng = random.Random(8)
    rows = [(LARGE + i, " ".join("".join(rng.choices("abcdehlorst", k=rng.randint(1, 40))) for _ in range(rng.randint(1, 60))), "s") for i in range(40)]
    rows += [(1, None, "s"), (None, "", "s"), (None, "it's <|endoftext|> 12", None), (2, "two", "s"), (2, "two", "s"), (3, "x" * 50_000, "s"), (4, " ", "s")]
    docs = docs_of(spark, rows).withColumn("ids", F.lit("clash"))

    def want(text, digest):
        ids = encoder.full.encode(text or "", add_special_tokens=False).ids
        decoded = encoder.full.decode(ids, skip_special_tokens=False)
        return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()) if digest else (len(ids), ids, decoded)

    for digest in (True, False):
        got = sorted((tuple(r) for r in op12.tree_encode(docs, op12.vocabulary(), piece, digest).collect()), key=str)
        assert got == sorted(((i, *want(t, digest)) for i, t, _ in rows), key=str)
    assert op12.tree_encode(docs_of(spark, []), op12.vocabulary()).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    """The root of a run-of-three tree, and for each leaf what is left and right of its path at each level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for leaf, p in enumerate(at):
            low = p - p % 3
            paths[leaf].append(("".join(level[low:p]), "".join(level[p + 1 : low + 3])))
            at[leaf] = p // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, s, own: sha(part(i), part(s), part("en"), part(None if own is None else len(own)), part(t))
    groups = collections.defaultdict(list)
    for i, t, s in rows:
        even = i is not None and zlib.crc32(str(i).encode()) % 2 == 0
        changed = t.replace("\n", "") if even and t is not None else t
        groups[s].append((i, leaf(i, t, s, t), leaf(i, changed, s, t)))
    trees = {}
    for s in sorted(groups, key=lambda s: (s is not None, (s or "").encode())):
        groups[s].sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1]))
        trees[s] = plain_tree([g[1] for g in groups[s]])
    root, upper = plain_tree([r for r, _ in trees.values()])
    out = []
    for number, s in enumerate(trees):
        for (i, own, changed), path in zip(groups[s], trees[s][1], strict=True):
            steps, node = path + upper[number], changed
            for left, right in steps:
                node = sha(left, node, right)
            out.append((i, own, trees[s][0], root, sha(*[a + b for a, b in steps]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 2, None: 1}, {"a": 28, "b": 27, "c": 3, "": 1}, {"hot": 800, None: 82, "é": 10, "z": 4, "B": 730, **{f"s{i}": 1 for i in range(30)}}])
def test_manifest_equals_plain_hashing(spark, sizes):
    rng = random.Random(4)
    rows = []
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((rng.randrange(LARGE), "".join(rng.choices("ab\né", k=rng.randint(0, 9))), source))
    rows += [(None, "x\ny", "a"), (None, None, "a"), (7, None, "a"), (7, "two\n", "a"), (7, "two\n", "a"), (8, "", "a"), (9, "long\n" * 40_000, "a")]
    rng.shuffle(rows)
    docs = docs_of(spark, rows).repartition(5).withColumns({"tree": F.lit("clash"), "pos": F.lit(0), "node": F.lit("clash")})
    got = op13.verify(docs, op13.without_line_feeds(F.col("text"), F.col("doc_id"))).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows)
    assert any(not r.verified for r in got)


def test_manifest_of_nothing_and_of_one_row(spark):
    made = op13.manifest(docs_of(spark, []))
    assert made.root is None and made.proofs().count() == 0
    (one,) = op13.verify(docs_of(spark, [(3, "t", None)]), F.col("text")).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("") and one.verified


def test_manifest_stores_every_third_level_only(spark):
    levels = op13.manifest(docs_of(spark, [(i, "t", "s") for i in range(800)])).levels
    assert [level.count() for level in levels] == [800, 30, 2, 1]
