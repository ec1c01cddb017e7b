"""Components of near points, whole groups and tiles, against a plain search."""

import math

import numpy as np
import pytest

from morphlake.operators import matching, neighbors

def plain(ps, reach):
    """{index: smallest index of its component} of points with a neighbour."""
    out = {}
    for start in range(len(ps)):
        if start in out:
            continue
        seen, todo = {start}, [start]
        while todo:
            i = todo.pop()
            for j in range(len(ps)):
                if j not in seen and math.dist(ps[i], ps[j]) <= reach:
                    seen.add(j)
                    todo.append(j)
        if len(seen) > 1:
            out |= dict.fromkeys(seen, start)
    return out


@pytest.mark.parametrize("most", [20_000, 30])
def test_point_components(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "TILE_POINTS", most)
    monkeypatch.setattr(neighbors, "near_pairs", None)  # made a row for every pair before
    if most == 20_000:
        monkeypatch.setattr(matching, "connected_components", None)  # called for every pair before
    rng = np.random.default_rng(7)
    groups = {
        1: [(float(x), float(y)) for x, y in rng.integers(0, 160, (200, 2))],
        2: [(5.0 * i, 3.0) for i in range(90)][::-1],
        3: [(1.0, 1.0)] * 40 + [(1e6, 1e6)],
        4: [(0.0, 0.0)],
        5: [(float(x), float(y)) for x, y in rng.integers(-300, 300, (150, 2))],
    }
    rows = [(g, i, *p) for g, ps in groups.items() for i, p in enumerate(ps)] + [(None, 1, 0.0, 0.0), (None, 2, 0.0, 0.0), (4, 9, None, 0.0)]
    points = spark.createDataFrame(rows, "g long, id long, x double, y double")
    got = {(r.g, r.id): r.root for r in matching.point_components(points, "g", 5.0).collect()}
    assert got == {(g, i): root for g, ps in groups.items() for i, root in plain(ps, 5.0).items()}


def test_joined_points_a_few_pairs_at_a_time():
    rng = np.random.default_rng(8)
    p = rng.integers(0, 12, (2_500, 2)).astype(float)  # over a million pairs in reach of x
    p[:50, 0] = 100.0 + 7.0 * np.arange(50)
    got = matching.joined_points(p[:, 0], p[:, 1], 3.0)
    assert (got[:50] == np.arange(50)).all() and (got[50:] == 50).all()
