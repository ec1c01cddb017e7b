"""N-gram join, decontamination, personal data, quality, language model, licences: brute force and odd inputs."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.llm import op4_lsh_forest_join as op4
from morphlake.llm import op6_suffix_automaton as op6
from morphlake.llm import op7_pii_transducers as op7
from morphlake.llm import op8_additive_quality as op8
from morphlake.llm import op9_context_tree_weighting as op9
from morphlake.llm import op10_license_sentences as op10
from morphlake.llm.shared import table
from morphlake.llm.textblocks import alphanumeric_words, encode, whitespace_words, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in texts], DOCS)


def words(t):
    return WORD.findall((t or "").encode().lower())


def test_word_hashes_tell_words_apart():
    texts = ["A b\x00c  a", "", "é É x", None, "a b\x00c a" * 3]
    for kept, pattern in ((whitespace_words(), rb"[^\x20\x09-\x0d]+"), (alphanumeric_words(), WORD.pattern)):
        hashes, counts = word_hashes(encode(texts), kept)
        want = [re.findall(pattern, t.lower()) for t in encode(texts)]
        assert counts.tolist() == [len(w) for w in want]
        seen = {}
        for h, w in zip(hashes.tolist(), itertools.chain(*want), strict=True):
            assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def brute_links(texts):
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for i, t in texts}
    near, root = collections.Counter(), {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            near.update((a, b))
            ra, rb = _find(root, a), _find(root, b)
            root[max(ra, rb)] = min(ra, rb)
    return near, {i: _find(root, i) for i in sets}


def _find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(30, 200))] for _ in range(30)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(rng.randint(0, 4)):
            c = list(b)
            for _ in range(rng.randint(0, 2)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            texts.append(" ".join(c).upper() if rng.random() < 0.3 else " ".join(c))
    hot = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(400):
        c = list(hot)
        c[rng.randrange(150)] = rng.choice(vocabulary)
        texts.append(" ".join(c))
    texts += [None, "", "?!", "one two", "One  two!", "", "a b c d e"]
    rows = list(enumerate(texts))
    near, root = brute_links(rows)
    got = {r.doc_id: r for r in op4.jaccard_join(docs_of(spark, rows).withColumn("rep", F.lit("clash"))).collect()}
    assert len(got) == len(rows)
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root[i], near[i]) for i, _ in rows}


def test_one_of_each_group_keeps_clean_rows(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"), (9, "quite another text of some six words"), (1, None), (3, ""), (9, "quite another text of some six words")]
    kept = op4.one_of_each_group(docs_of(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]
    assert op4.one_of_each_group(docs_of(spark, [])).count() == 0


def brute_hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        n = min(window, len(iw))
        grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for p in range(len(w) - n + 1) if n else ():
            if tuple(w[p : p + n]) in grams:
                hit.update(range(p, p + n))
                found.add(item)
    return len(w), len(hit), sorted(found, key=str)


def test_automaton_equals_brute_force():
    rng = random.Random(2)
    for trial in range(300):
        window = rng.choice([2, 3, 4])
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 9)))) for i in range(rng.randint(0, 6))]
        a = op6.Automaton([(i, op6.words_of(t.encode())) for i, t in items], window)
        text = " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40)))
        hit, found = a.scan(op6.words_of(text.encode()))
        assert (len(words(text)), int(hit.sum()), sorted(found)) == brute_hits(text, items, window), trial


def test_match_and_decontaminate(spark):
    passage = " ".join(f"q{i}" for i in range(14))
    bench = spark.createDataFrame([(1, passage + "."), (2, "Short item"), (2, "Short item"), (3, None), (4, "!")], "item_id long, text string")
    rows = [(1, f"before {passage.upper()} after " + "pad " * 40), (2, passage), (3, "a short ITEM here"), (4, "clean text only"), (5, None), (6, "")]
    docs = docs_of(spark, rows)
    got = {r.doc_id: r for r in op6.match(docs, bench).collect()}
    items = [("1", passage), ("2", "Short item"), ("4", "!")]
    assert {i: (r.n_words, r.n_hit, r["items"]) for i, r in got.items()} == {i: brute_hits(t, items) for i, t in rows}
    out = {r.doc_id: r for r in op6.decontaminate(docs.withColumn("hit", F.lit(1)), bench).collect()}
    assert set(out) == {1, 3, 4, 5, 6} and out[1].text.split() == ["before", "after", *["pad"] * 40] and out[1].n_chars == len(out[1].text)
    assert out[4].text == "clean text only" and out[5].text is None and out[3].text.split() == ["a", "here"]
    assert op6.match(docs, bench.where("false")).agg(F.sum("n_hit")).first()[0] == 0


def test_decontamination_in_parts_keeps_ids_and_columns(spark):
    rng, big = random.Random(9), 2**60 + 1
    text = lambda n: " ".join(rng.choice(("aa", "bb", "cc", "dd", "é")) for _ in range(n))
    items = [(i, text(rng.randint(0, 12))) for i in range(40)] + [(None, text(11))]
    rows = [(rng.choice((None, big, big + i, i)), text(rng.randint(0, 60))) for i in range(80)] + [(big, None), (None, "zz " * 50000)]
    docs = docs_of(spark, rows).withColumns({"items": F.array(F.lit(None).cast("long"), F.col("doc_id")), "n_hit": F.struct("doc_id")})
    bench = spark.createDataFrame(items, "item_id long, text string")
    key = lambda x: str(x)
    for most in (10, 10**6):
        got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in op6.match(docs, bench, most_words=most).collect()), key=key)
        want = []
        for i, t in rows:
            n, hits, found = brute_hits(t, items)
            want.append((i, n, hits, tuple(sorted(str(x) for x in found if x is not None))))
        assert got == sorted(want, key=key)
        kept = op6.decontaminate(docs, bench, most_words=most)
        assert kept.schema == docs.schema
        left = kept.collect()
        assert all(r["items"] == [None, r.doc_id] and r["n_hit"].doc_id == r.doc_id and (r.text is None or r.n_chars == len(r.text)) for r in left)
        assert sorted((r.doc_id for r in left), key=key) == sorted((w[0] for w in want if not w[1] or w[2] <= w[1] / 2), key=key)


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_personal(t):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(t)] + [("ip", *m.span()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(t) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], op7.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("12345 .-a@+b(é") for _ in range(rng.randint(0, 60)))
        assert op7.plain(t) == brute_personal(t), t


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("write joe [at] example [dot] com", "email", "joe [at] example [dot] com"),
        ("jоe＠example。com", "email", "jоe＠example。com"),
        ("joe at example dot co dot uk", "email", "joe at example dot co dot uk"),
        ("ring plus one two three four five six seven eight nine now", "phone", "plus one two three four five six seven eight nine"),
        ("card ４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
        ("host ١.2.3.4", "ip", "١.2.3.4"),
    ],
)
def test_disguises_map_back(text, kind, found):
    base, spans = op7.spans(text)
    assert set(base) <= set(spans) and (kind, found) in {(k, text[a:b]) for k, a, b in spans}


def test_plain_prose_has_no_spans(spark):
    for t in ("we met at noon and he is at home", "one of two", "at dot", "é" * 50, "1 " * 30000, "@" * 1000, "+" * 1000):
        assert op7.spans(t)[1] == brute_personal(t)
    got = op7.find_personal_data(docs_of(spark, [(1, None), (2, ""), (3, "a@b.c"), (3, "a@b.c")])).collect()
    assert sorted((r.doc_id, r.n_email, r.spans) for r in got) == [(1, 0, ""), (2, 0, ""), (3, 1, "email:0:5"), (3, 1, "email:0:5")]
    big = 2**60 + 1
    ids = spark.createDataFrame([(None, "a@b.c", 1), (big, "x", 2), (big, "+ оne two three four five six seven eight nine", 3)], "doc_id long, text string, spans long")
    assert sorted(((r.doc_id, r.n_email, r.n_phone) for r in op7.find_personal_data(ids).collect()), key=str) == sorted([(None, 1, 0), (big, 0, 0), (big, 0, 1)], key=str)
    assert op7.masked("to a@b.c now", [("email", 3, 8)]) == "to <email> now"


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = op8.op8_additive_quality(spark, sf).join(labels, "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(out) > 50 and np.mean([r.predicted == r.quality for r in out]) >= 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    odd = docs_of(spark, [(1, None), (2, ""), (3, "x" * 200000)])
    model = op8.fit_quality(docs, labels)
    assert op8.with_score(odd, model).count() == 3
    assert op8.with_score(odd, op8.fit_quality(docs, labels.where("false"))).select("score").distinct().first()[0] == pytest.approx(0.5)


def plain_features(text):
    """The features of one text, word by word."""
    ws, size = text.split(), len(text)
    if not ws:
        return [0.0] * len(op8.FEATURES)
    n, lines, signs = len(ws), text.split(b"\n"), b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"
    of = lambda test: sum(map(test, text))
    upper, lower = of(lambda c: 65 <= c <= 90), of(lambda c: 97 <= c <= 122)
    digit, stop, other, space = of(lambda c: 48 <= c <= 57), of(lambda c: c in b".,"), of(lambda c: c >= 128), of(lambda c: c == 32 or 9 <= c <= 13)
    lengths, counts = [len(w) for w in ws], collections.Counter(text)
    return [
        math.log1p(n), np.mean(lengths), np.std(lengths), upper / max(1, upper + lower), digit / size, (size - upper - lower - digit - stop - other - space) / size, stop / size, other / size, space / size,
        text.count(b"\n") / size, len(set(ws)) / n, max(collections.Counter(ws).values()) / n, 1 - len(set(lines)) / len(lines), math.log1p(size / len(lines)), sum(w[-1] in signs for w in ws) / n,
        sum(65 <= w[0] <= 90 for w in ws) / n, math.log1p(max(lengths)), len(set(zip(ws, ws[1:]))) / max(1, n - 1), len(zlib.compress(text, 1)) / size,
        -sum(c / size * math.log2(c / size) for c in counts.values()), sum(a == b for a, b in zip(ws, ws[1:])) / n, sum(len(w) == 1 and w in signs for w in ws) / n,
    ]


def test_features_equal_the_plain_ones():
    rng = random.Random(8)
    texts = [b"", b" \n ", b"\n\nA\n", b"x", "é É".encode(), b"a\0b a"] + ["".join(rng.choice("aAb1.!é \n\t") for _ in range(rng.randint(0, 300))).encode() for _ in range(200)] + [b"word " * 300_000]
    assert op8.features(texts) == pytest.approx(np.array([plain_features(t) for t in texts]), abs=1e-9)
    assert op8.features([]).shape == (0, len(op8.FEATURES))


def plain_tree(x, g, h, depth):
    """The tree of a feature by trying every cut of the rows, bin by bin."""
    if depth:
        gain = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + 1)
        best, rows = (1e-6, None), range(len(x))
        for at in sorted(set(x))[1:] if len(x) else ():
            low, high = [i for i in rows if x[i] < at], [i for i in rows if x[i] >= at]
            if min(len(low), len(high)) >= op8.LEAST and gain(low) + gain(high) - gain(rows) > best[0] + 1e-12:
                best = gain(low) + gain(high) - gain(rows), (low, high)
        if best[1]:
            out = [0.0] * len(x)
            for part in best[1]:
                for i, v in zip(part, plain_tree([x[i] for i in part], [g[i] for i in part], [h[i] for i in part], depth - 1)):
                    out[i] = v
            return out
    return [sum(g) / (sum(h) + 1)] * len(x)


def test_boosting_equals_a_plain_version():
    rng = np.random.default_rng(7)
    x = rng.integers(0, 12, size=(400, 3)).astype(float)
    y = ((x[:, 0] > 5) + rng.random(400) > 0.8).astype(float)
    model = op8.AdditiveModel(x, y, rounds=4, pairs=0)
    start = math.log((y.sum() + 1) / (len(y) + 1 - y.sum()))
    total = np.full(400, start)
    for _ in range(4):
        for j in range(3):
            p = 1 / (1 + np.exp(-total))
            total = total + op8.RATE * np.array(plain_tree(x[:, j].tolist(), (y - p).tolist(), (p * (1 - p)).tolist(), 2))
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-9)


def test_quality_with_odd_labels_and_ids(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    double = labels.unionByName(labels.limit(20).withColumn("quality", 1 - F.col("quality"))).unionByName(labels)
    models = [op8.fit_quality(docs.unionByName(docs).repartition(n), double.repartition(n)) for n in (1, 5)]
    assert all((a == b).all() for a, b in zip(models[0].tables, models[1].tables, strict=True))
    odd = spark.createDataFrame([(None, "plain text here", 1), (2**60 + 1, None, 2), (2**60 + 1, "", 3), (2**60 + 1, "", 3)], "doc_id long, text string, __quality long")
    kept = op8.keep_good(odd, labels, at=0.0)
    assert kept.columns == odd.columns and kept.count() == 4 and op8.keep_good(odd.where("false"), labels).count() == 0
    assert sorted(kept.collect(), key=str) == sorted(odd.collect(), key=str)


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(5)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = op8.AdditiveModel(x, y)
    assert (0, 1) in m.pairs and ((m.score(x) > 0.5) == y).mean() > 0.95


def slow_tree(train, text, depth):
    """Context-tree weighting by its definition: P(bit) is the weighted block probability with that bit over that without it."""

    def bits(byte):
        node = 1
        for k in range(7, -1, -1):
            b = byte >> k & 1
            yield node, b
            node = 2 * node + b

    data = collections.defaultdict(list)
    for t in train:
        seq = b"\0" * depth + t + b"\0"
        for i in range(depth, len(seq)):
            for node, b in bits(seq[i]):
                data[node].append((seq[i - depth : i], b))

    def weighted(rows, d=0):
        """log2-free logarithm of the probability of all bits of the subtree whose contexts agree in their last d bytes."""
        if not rows:
            return 0.0
        n = collections.Counter(b for _, b in rows)
        own = math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)
        if d == depth:
            return own
        children = collections.defaultdict(list)
        for c, b in rows:
            children[c[depth - d - 1]].append((c, b))
        return np.logaddexp(own, sum(weighted(x, d + 1) for x in children.values())) - math.log(2)

    total, seq = 0.0, b"\0" * depth + text + b"\0"
    before = {node: weighted(rows) for node, rows in data.items()}
    for i in range(depth, len(seq)):
        for node, b in bits(seq[i]):
            rows = data.get(node, [])
            total += (weighted([*rows, (seq[i - depth : i], b)]) - before.get(node, 0.0)) / math.log(10)
    return total


def _blocks(monkeypatch, piece, block):
    monkeypatch.setattr(op9, "PIECE_BYTES", piece)
    monkeypatch.setattr(op9, "BLOCK_BYTES", block)


def test_context_tree_equals_its_definition(spark, monkeypatch):
    train = ["abra cadabra", "the cat sat on the mat", "Ünïcode", "the rat sat on the cat"]
    texts = ["abracadabra the", "xyz", None, "", "the cat sat on the mat", "the cat"]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(5, "the cat", False), (None, "the cat", False), (2**60 + 1, "", False)] + [(100 + i, t, True) for i, t in enumerate(train)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, of_train boolean, block int, keys string")
    _blocks(monkeypatch, 16, 40)
    got = [r for r in op9.score_texts(docs, F.col("of_train")).collect() if r.doc_id is None or not 100 <= r.doc_id < 104]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got) == [-1, 0, 1, 2, 3, 4, 5, 5, 2**60 + 1]
    c = collections.Counter(w for t in train for w in [*t.encode().lower().split(), None])
    n, v = sum(c.values()), len(c)
    want = {**dict(enumerate(texts)), None: "the cat", 2**60 + 1: ""}
    for r in got:
        t = (want[r.doc_id] or "").encode().lower()
        w = [*t.split(), None]
        assert r.score == pytest.approx(slow_tree([x.encode().lower() for x in train], t, op9.DEPTH), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) and (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)


def test_language_model_in_blocks_and_without_training(spark, monkeypatch):
    docs = table(spark, SF, "documents")
    key = lambda r: (r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
    whole = sorted(map(key, op9.score_texts(docs, F.lit(True)).collect()))
    _blocks(monkeypatch, 3000, 9000)
    monkeypatch.setattr(op9, "FAN", 4)
    assert sorted(map(key, op9.score_texts(docs, F.lit(True)).collect())) == whole and len(whole) == docs.count()
    nothing = op9.score_texts(docs_of(spark, [(1, "ab")]), F.lit(False)).first()
    assert nothing.train_tokens == 0 and nothing.score == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-6)
    assert op9.score_texts(docs_of(spark, []), F.lit(True)).count() == 0


def test_licences(spark):
    apache = 'Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in\n# compliance with the License.\nCode.'
    mit = "\n".join(op10.SENTENCES[s] for s in ("mit-grant", "mit-condition", "as-is-software"))
    swapped = "\n".join(op10.SENTENCES[s] for s in ("mit-condition", "mit-grant", "as-is-software"))
    rows = [(1, apache), (2, mit.replace(" ", "\n  ", 40)), (3, swapped), (4, "Text.\nLicensed under CC BY-NC 4.0.\nMore. Released under the MIT License."), (5, None), (6, ""), (7, "the licence of nothing"), (8, "x " * 100000 + "\nReleased under the MIT License.")]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in op10.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {1: (["Apache-2.0"], 1), 2: (["MIT"], 1), 3: ([], 0), 4: (["CC-BY-NC-4.0", "MIT"], 2), 5: ([], 0), 6: ([], 0), 7: ([], 0), 8: (["MIT"], 1)}


def test_licence_lines_of_the_documents(spark):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "All rights reserved.": "All-Rights-Reserved"}
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    want = {r.doc_id: sorted({lines[x] for x in r.text.split("\n") if x in lines}) for r in docs.collect()}
    assert {r.doc_id: r.licenses for r in op10.scan_licenses(docs).collect()} == want
