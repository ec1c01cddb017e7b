"""Greedy suppression in tiles against the one-by-one pass, also over chains of dependent points longer than any number of rounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from morphlake.operators import graph


def plain(rows, distance, closed=False):
    """rows: (group, id, x, y, score), best score first, then smaller id."""
    kept = []
    for g, i, x, y, s in sorted(rows, key=lambda r: (r[0], -r[4], r[1])):
        near = lambda a, b: a <= b if closed else a < b
        if not any(k[0] == g and near(math.dist((x, y), k[2:4]), distance) for k in kept):
            kept.append((g, i, x, y, s))
    return {(g, i) for g, i, *_ in kept}


def frame(spark, rows):
    return spark.createDataFrame(rows, "g long, id long, x double, y double, score double").repartition(3)


def suppressed(spark, rows, *more):
    return {(r.g, r.id) for r in graph.suppress_min_distance(frame(spark, rows), "g", [F.desc("score")], *more).collect()}


@pytest.mark.parametrize("side", [4096.0, 40.0, 20.0])
@pytest.mark.parametrize("closed", [False, True])
def test_tiles_equal_the_plain_pass(spark, side, closed):
    rng = random.Random(7)
    rows = [(g, i, float(rng.randint(-60, 120)), float(rng.randint(0, 90)), float(rng.randint(0, 5))) for g in (1, 2) for i in range(250)]
    assert suppressed(spark, rows, 5.0, closed, side) == plain(rows, 5.0, closed)


def test_a_raster_line_of_ten_thousand(spark):
    rows = [(1, i, float(i), 0.0, -float(i)) for i in range(10_000)]
    assert suppressed(spark, rows, 1.5, False, 2048.0) == {(1, i) for i in range(0, 10_000, 2)}


def test_crowded_tiles_are_halved_and_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(graph, "TILE_POINTS", 20)
    rng = random.Random(8)
    rows = [(1, i, rng.random() * 300, rng.random() * 300, rng.random()) for i in range(200)]
    assert suppressed(spark, rows, 9.0) == plain(rows, 9.0)
    assert suppressed(spark, [], 9.0) == set()
    same = [(1, i, 5.0, 5.0, 1.0) for i in range(50)]
    assert suppressed(spark, same, 1.0) == {(1, 0)}


def test_merging_goes_by_source_then_row(spark):
    rows = [(1, 1, 0.0, 0.0, 1, 0), (1, 2, 3.0, 0.0, 0, 5), (1, 3, 6.0, 0.0, 1, 1), (1, 4, 3.0, 2.0, 0, 6), (2, 5, 3.0, 0.0, 1, 0)]
    points = spark.createDataFrame(rows, "g long, id long, x double, y double, source int, row int")
    assert {r.id for r in graph.merge_candidates(points, "g", 3.0).collect()} == {2, 5}


def test_a_task_takes_rows_not_lists_of_tiles(spark, monkeypatch):
    from pyspark.sql import functions as F

    from morphlake.operators import graph, runs

    calls, plain = [], runs.by_groups
    monkeypatch.setattr(graph, "by_groups", lambda rows, *more: (calls.append([t for _, t in rows.dtypes if t.startswith("array")]), plain(rows, *more))[1], raising=False)
    points = spark.createDataFrame([(g, 10 * g + i, float(i), 0.0) for g in range(5) for i in range(6)], "g long, id long, x double, y double")
    kept = {(r.g, r.id % 10) for r in graph.suppress_min_distance(points, "g", [F.asc("x")], 2.0).collect()}
    assert kept == {(g, i) for g in range(5) for i in (0, 2, 4)} and calls and not any(calls)
