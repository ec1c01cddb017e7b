"""Nearest neighbours, source mix, shards, archives: brute force, exact round trips and odd inputs."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from morphlake.llm import op1_inverted_multi_index as op1
from morphlake.llm import op2_curriculum_mix as op2
from morphlake.llm import op3_sampled_splitters as op3
from morphlake.llm import op5_warc as op5

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


def nearest(ids, x, q, k):
    d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
    keep = ids != q
    order = np.lexsort((ids[keep], d[keep]))[:k]
    return list(zip(ids[keep][order].tolist(), d[keep][order].tolist()))


def test_visits_go_by_summed_distance_until_enough():
    rng = np.random.default_rng(1)
    a, b, held = rng.random(7), rng.random(9), rng.integers(0, 4, 63)
    sums = (a[:, None] + b[None]).reshape(-1)
    for enough in (1, 5, 40, int(held.sum())):
        last = op1.reach(a, b, held, enough)
        assert held[sums <= last].sum() >= enough > held[sums < last].sum()


def brute(rows, k):
    """(query row, id, distance) by comparing all rows, each query row with all others; rows are (id, vector)."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % 100 == 0:
            d = [(math.dist(v, w), other) for j, (other, w) in enumerate(rows) if j != i]
            out.append((q, [(round(x / max(x, 1), 9), x, o) for x, o in sorted(d)[:k]]))
    return out


@pytest.mark.parametrize("kind", ["normal", "clustered"])
def test_search_recall_on_many_vectors(spark, kind):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16)) + (0 if kind == "normal" else 8 * rng.normal(size=(40, 16))[rng.integers(0, 40, 6000)])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    u = op1.usable(v)
    found = op1.search(u, u.where("vec_id % 100 = 0")).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    hits = 0
    for q in range(0, 6000, 100):
        want = nearest(np.arange(6000), x, q, 10)
        assert sorted(r for r, _ in by[q].values()) == list(range(1, 11)) and q not in by[q]
        hits += sum(i in by[q] and by[q][i][1] == pytest.approx(d) for i, d in want)
    assert hits / 600 >= 0.9


@pytest.mark.parametrize("case", ["far", "huge", "tiny", "mixed"])
def test_all_cells_equal_brute_force(spark, case):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 5)).round(2)
    x = {"far": x + 1e8, "huge": x * 1e200, "tiny": x * 1e-200, "mixed": np.where(rng.random((300, 1)) < 0.1, x * 1e150, x + 3)}[case]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.integers(0, 30, 300) * 10, x, strict=True)]  # repeated ids with other vectors
    rows += [rows[0]] * 3 + [(100, rows[1][1]), (2**60 + 1, rows[1][1])]
    u = op1.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {}
    for r in op1.search(u, u.where("vec_id % 100 = 0"), k=4, all_cells=True).orderBy("rank").collect():
        got.setdefault((r.query_id, r["rank"]), []).append(r.score)
    want = {}
    for q, best in brute(rows, 4):
        for rank, (_, d, _) in enumerate(best, 1):
            want.setdefault((q, rank), []).append(d)
    assert got.keys() == want.keys()
    for key in want:
        assert sorted(got[key]) == pytest.approx(sorted(want[key]), rel=1e-12), key


def test_search_odd_vectors_ties_and_copies(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [0.0, 1.0]), (8, [1.0]), (9, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(30)]
    v = spark.createDataFrame([(i, e, "x") for i, e in rows], "vec_id long, embedding array<double>, rank string")
    u = op1.usable(v)
    assert {r.vec_id for r in u.collect()} == {0, 1, 2, 7, None, *range(100, 130)}
    got = [(r["rank"], r["vec_id"], r["score"]) for r in op1.search(u, u.where("vec_id = 0"), k=5).orderBy("rank").collect()]
    assert got == [(1, 1, 0.0), (2, 2, 0.0), (3, 100, 0.0), (4, 101, 0.0), (5, 102, 0.0)]
    assert op1.search(u.where("false"), u.where("false")).count() == 0
    few = op1.search(u.where("vec_id in (0, 7)"), u.where("vec_id = 0")).collect()
    assert [(r.vec_id, round(r.score, 9)) for r in few] == [(7, round(math.sqrt(2), 9))]


def water(sizes, weights, cap=3.0):
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if level * weights[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in open_}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_takes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s, n in (("a", 300), ("b", 40), ("c", 2), (None, 60), ("", 5)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.integers(1, 40))), s) for i in range(n)]
    docs = docs_of(spark, rows)
    got = op2.curriculum_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    names = sorted([s for s in sizes if s is not None]) + [None]
    want = water(sizes, {s: 1 + i % 3 for i, s in enumerate(names)})
    for s in sizes:
        of = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * want[s] and r.taken == r["size"] * r.copies and r.copies <= 3 for r in of)
        assert abs(sum(r.taken for r in of) - want[s]) <= max(r["size"] for r in of) / 2
    again = op2.curriculum_mix(docs.repartition(7)).select("doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.taken) for r in got)
    positions = [p for r in got for p in (r.positions or [])]
    assert all(0 <= p <= 1 for p in positions) and len(positions) == sum(r.copies for r in got)
    order = op2.training_order(op2.curriculum_mix(docs), docs.columns, 4)
    assert order.count() == len(positions) and order.columns == docs.columns


def test_mix_fills_with_small_documents_and_sorts(spark):
    rows = [(1, "w " * 1000, "a")] + [(2 + i, "w", "a") for i in range(29)] + [(100 + i, "w " * 1115, "b") for i in range(3)] + [(200 + i, "w " * 50, "c") for i in range(10)]
    got = op2.in_training_order(op2.curriculum_mix(docs_of(spark, rows)), 5).collect()
    at = [r.positions[0] if r.positions else 2.0 for r in got]
    assert at == sorted(at) and len(got) == len(rows)
    for s in "abc":
        of = [r for r in got if r.source == s]
        once_more = [r["size"] for r in of if r.copies < 3 and r["size"]]
        assert all(r.copies <= 3 for r in of) and abs(sum(r.taken for r in of) - of[0].target) <= min(once_more, default=10**9) / 2
    need = pd.DataFrame({"__mix_hash": range(30), "__mix_size": [1000] + [1] * 29, "need": 443.0, "more": 3})
    assert op2._fill(need)["extra"].tolist() == [0] + [3] * 29


def test_mix_odd_inputs(spark):
    docs = docs_of(spark, [(1, None, "a"), (1, None, "a"), (2, "", None), (3, "x y", "b")]).withColumns({"target": F.lit("clash"), "n": F.lit(1), "need": F.lit(2)})
    got = op2.curriculum_mix(docs).collect()
    assert len(got) == 4 and {r["size"] for r in got} == {0, 2} and got[0]["n"] == 1
    assert op2.curriculum_mix(docs.where("false")).count() == 0


def test_shards_are_near_equal_gapless_and_whole(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "z" * int(rng.integers(0, 300)) if i % 3 else "hot text " * 9, f"s{i % 5}") for i in range(3000)]
    rows += [(7000, None, "s"), (7001, "", "s"), (7002, "", "s"), (7003, "é" * 20000, "s"), (7003, "é" * 20000, "s")]
    docs = docs_of(spark, rows).withColumn("shard", F.lit("clash"))
    got = op3.sampled_splitters(docs, F.xxhash64("text"), F.xxhash64("doc_id"), op3.text_size(F.col("text")), 40, ranges=64, sample=800, part_rows=50).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    total, held, slots = sum(size(t) for _, t, _ in rows), [0] * 40, {}
    for r in got:
        held[r.shard] += size(r.text)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(h - total / 40) for h in held) <= 40016
    plain = [h for i, h in enumerate(held) if h < 40000]
    assert max(abs(h - total / 40) for h in plain) <= 40016 and sorted(r.doc_id for r in got) == sorted(i for i, _, _ in rows)
    cold = {}
    for r in got:
        if r.text and not r.text.startswith("hot"):
            cold.setdefault(r.text, set()).add(r.shard)
    assert sum(len(s) for s in cold.values()) <= len(cold) + 40


@pytest.mark.parametrize(("ranges", "sample", "part_rows"), [(64, 800, 50), (3, 20, 7), (320, 16_384, 20_000)])
def test_shards_equal_brute_force(spark, ranges, sample, part_rows):
    rng = np.random.default_rng(14)
    rows = [(None if i % 50 == 0 else i, None if i % 97 == 0 else "copy " * 40 if i % 3 == 0 else "t" * int(rng.integers(0, 500)), "s") for i in range(2000)] + [(5, "x" * 90_000, "s")] * 2
    keyed = docs_of(spark, rows).withColumns({"k": F.xxhash64("text"), "t": F.xxhash64("doc_id"), "bytes": op3.text_size(F.col("text"))})
    got = op3.sampled_splitters(keyed, F.col("k"), F.col("t"), F.col("bytes"), 40, ranges=ranges, sample=sample, part_rows=part_rows).collect()
    total, at, slots, want = sum(r.bytes for r in got), 0, {}, []
    for k, t, size in sorted((r.k, r.t, r.bytes) for r in got):
        shard = min(39, (2 * at + size) * 40 // (2 * total))
        want.append((k, t, size, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += size
    assert sorted((r.k, r.t, r.bytes, r.shard, r.slot) for r in got) == sorted(want) and len(got) == len(rows)


def test_shards_of_nothing_and_of_one(spark):
    empty = docs_of(spark, [])
    assert op3.shard_documents(empty).count() == 0
    one = op3.shard_documents(docs_of(spark, [(1, "a", "s")])).first()
    assert one.slot == 0 and 0 <= one.shard < 40


def test_shards_use_no_python(spark, tmp_path):
    docs = docs_of(spark, [(i, "t" * i, "s") for i in range(50)])
    plan = op3.shard_documents(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/\r\nb", long), (1, "http://c", long), (2, None, "short"), (5, "http://d", "short"), (6, "u", None), (None, "n", long), (7, "u", "é\r\n\r\n" * 50), (7, "u", "é\r\n\r\n" * 50), (8, "u", "")]
    pages = spark.createDataFrame([(*r, "more") for r in rows], "page_id long, url string, html string, offset string")
    folder = f"file://{tmp_path}/warc"
    index = op5.write_archives(pages, folder)
    read = op5.read_records(index, folder).collect()
    assert len(read) == len(rows)
    for r in read:
        assert (r.read_type, r.read_bytes, r.read_digest) == (r.record_type, r.payload_bytes, r.payload_digest)
    of = {}
    for r in read:
        of.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert of[1] == [("response", None)] and of[3] == [("revisit", 1)] and of[None] == [("revisit", 1)] and of[2] == of[5] == [("response", None)]
    assert sorted(of[7], key=str) == [("response", None), ("revisit", 7)]
    assert {r.payload_digest for r in read if r.page_id in (6, 8)} == {hashlib.sha256(b"").hexdigest()}
    one = op5.read_records(index.where("page_id = 2"), folder).collect()
    assert len(one) == 1 and one[0].read_bytes == 5


def test_archives_with_a_hot_payload(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op5, "HOT_COPIES", 100)
    rows = [(i, f"u{i}", "h" * 150 if i % 2 else f"page {i} " * 20) for i in range(1, 600)]
    folder = f"file://{tmp_path}/warc"
    index = op5.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    read = op5.read_records(index, folder, gap=0, most=1000).collect()
    assert len(read) == 599 and all(r.read_digest == hashlib.sha256(rows[r.page_id - 1][2].encode()).hexdigest() for r in read)
    assert all((r.record_type, r.refers_to) == (("revisit", 1) if r.page_id % 2 and r.page_id > 1 else ("response", None)) for r in read)
    assert op5.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none").count() == 0


def test_large_ids_beside_nulls_and_long_pages(spark, tmp_path):
    first, html = 1152921504606846977, "<p>" + "y" * 300 + "</p>"
    rows = [(first, "u", html), (first + 1, "v", html), (None, "w", html), (None, "x", "z" * 3_000_000), (first + 2, "z", None)]
    folder = f"file://{tmp_path}/warc"
    read = op5.read_records(op5.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder), folder).collect()
    assert sorted(((r.page_id, r.record_type, r.refers_to) for r in read), key=str) == sorted([(first, "response", None), (first + 1, "revisit", first), (None, "revisit", first), (None, "response", None), (first + 2, "response", None)], key=str)
    ids = {r.page_id: r.record_id for r in read if r.page_id is not None}
    assert {r.refers_to_id for r in read if r.record_type == "revisit"} == {ids[first]} and len(set(ids.values())) == 3


def test_a_wrong_index_row_is_noticed():
    member = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n"
    with pytest.raises(ValueError, match="whole record"):
        op5._parse(member)
