"""Sparse assignments against brute force and dense costs; components of pixel runs; ranks and adjusted p-values in ranges."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.operators import graph, matching, stats


def least_total(cost):
    n, m = cost.shape
    if n > m:
        return least_total(cost.T)
    return min((sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n)), default=0.0)


def test_closest_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = rng.integers(0, 12, (rng.integers(0, 7), 2)).astype(float), rng.integers(0, 12, (rng.integers(0, 7), 2)).astype(float)
        cost = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
        got = matching.closest_assignment(a, b, nearest=1, cells=8)
        assert len(got) == min(len(a), len(b)) == len({i for i, _ in got}) == len({j for _, j in got})
        assert sum(cost[i, j] for i, j in got) == pytest.approx(least_total(cost))


def test_few_edges_and_blocks_give_what_all_edges_give():
    rng = np.random.default_rng(4)
    crowd = np.vstack([rng.normal(0, 1, (150, 2)), rng.normal(40, 1, (20, 2))])
    other = np.vstack([rng.normal(0, 1, (40, 2)), rng.normal(40, 1, (160, 2))])
    total = lambda pairs: sum(math.dist(crowd[i], other[j]) for i, j in pairs)
    assert total(matching.closest_assignment(crowd, other, 2, 500)) == pytest.approx(total(matching.closest_assignment(crowd, other, 10_000)))


def test_a_component_of_five_thousand_edges(spark):
    rng = random.Random(5)
    spots = lambda n: [(1, i, rng.random() * 75, rng.random() * 75) for i in range(n)]
    left, right = spots(420), spots(400)
    kind = "pair long, id long, x double, y double"
    got = [(r.a, r.b, r.d) for r in matching.gated_assignment(spark.createDataFrame(left, kind), spark.createDataFrame(right, kind), "pair", 8.0).collect()]
    d = np.hypot(*(np.array(left)[:, None, 2:] - np.array(right)[None, :, 2:]).transpose(2, 0, 1))
    a, b = np.nonzero(d <= 8)
    assert len(a) > 5000 and all(x <= 8 and d[i, j] == pytest.approx(x) for i, j, x in got) and len({i for i, *_ in got}) == len({j for _, j, _ in got}) == len(got)
    # prices that no edge undercuts, that matched edges meet and that free columns don't have prove the least total
    n, m, alone = len(left), len(right), 10_000.0
    rows, columns, cost = np.concatenate([a, np.arange(n)]), np.concatenate([b, m + np.arange(n)]), np.concatenate([d[a, b], np.full(n, alone)])
    mate, u, v = matching.sparse_assignment(*matching._edges(rows, columns, cost, n), m + n)
    u, v, mate = np.array(u), np.array(v), np.array(mate)
    assert (cost - u[rows] - v[columns] > -1e-7).all() and (v <= 1e-9).all() and np.abs(v[np.setdiff1d(np.arange(m + n), mate)]).max() < 1e-9
    total = sum(d[i, j] if j < m else alone for i, j in enumerate(mate))
    assert total == pytest.approx(u.sum() + v.sum()) and total == pytest.approx(sum(x for *_, x in got) + alone * (n - len(got)))


def test_pixel_components_by_runs(spark):
    rng = random.Random(6)
    on = {(g, y, x) for g in (1, 2) for y in range(40) for x in range(150) if rng.random() < 0.55} | {(3, 0, x) for x in range(200)} | {(4, y, 70) for y in range(30)}
    want, seen = {}, set()
    for g in (1, 2, 3, 4):
        number = 0
        for start in sorted(p for p in on if p[0] == g):
            if start in seen:
                continue
            number += 1
            stack = [start]
            seen.add(start)
            while stack:
                p = stack.pop()
                want[p] = number
                for q in ((g, p[1] + 1, p[2]), (g, p[1] - 1, p[2]), (g, p[1], p[2] + 1), (g, p[1], p[2] - 1)):
                    if q in on and q not in seen:
                        seen.add(q)
                        stack.append(q)
    pixels = spark.createDataFrame(sorted(on), "g long, y long, x long")
    assert {(r.g, r.y, r.x): r.instance for r in graph.pixel_components(pixels, "g").collect()} == want
    assert graph.pixel_runs(pixels.where("g = 3"), "g").count() == 1


def test_families_in_ranges(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(f, i, None if i % 11 == 0 else round(rng.random(), 2)) for f in ("a", None) for i in range(300)] + [("b", 0, 0.5)]
    t = spark.createDataFrame(rows, "f string, key long, p double").repartition(4)
    adjusted = lambda by: {(r.f, r.key): r.p_fdr for r in stats.fdr_bh(t, by, "p", "key").collect()}
    ranked = lambda by: {(r.f, r.key): (r.avg_rank, r.tied) for r in stats.average_ranks(t.where("p is not null"), by, "p").collect()}
    small = [(adjusted(by), ranked(by)) for by in (["f"], [])]
    monkeypatch.setattr(stats, "FAMILY_ROWS", 20)
    ranged = [(adjusted(by), ranked(by)) for by in (["f"], [])]
    assert ranged == small
    assert stats.fdr_bh(t.where(F.lit(False)), ["f"], "p", "key").count() == 0
