"""Samples followed in runs of consecutive ones, against the operators that make a row for each match."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.operators import matching, track
from morphlake.operators.graph import chain_roots
from morphlake.operators.neighbors import near_pairs
from morphlake.plans import pixel_queries as pq


@pytest.fixture(scope="module")
def followed(spark):
    """Two eyes of nine samples; points wander, vanish and appear; sample 5 has none, 7 has far more, and 90 isn't in the manifest."""
    rng = np.random.default_rng(3)
    data, base = [(90, 1, 5.0, 5.0)], rng.integers(0, 300, (60, 2)).astype(float)
    for s in [*range(1, 10), *range(11, 20)]:
        base = base[rng.random(len(base)) < 0.8] + rng.integers(-4, 5, 2)
        base = np.concatenate([base, rng.integers(0, 300, (150 if s == 7 else 14, 2))])
        data += [(s, int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(len(base)) + 1, base + rng.random(base.shape), strict=True) if s != 5]
    points = spark.createDataFrame(data, "image_no long, id long, x double, y double")
    manifest = spark.createDataFrame([(s, "A", "OD" if s < 10 else "OS", 7.0 * s) for s in [*range(1, 10), *range(11, 20)]], "sample_id long, animal_id string, eye string, timepoint_dpi double")
    counts = points.groupBy(F.col("image_no").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_objects"))
    return points.cache(), manifest, track.consecutive_samples(manifest, counts).cache()


def _same(got, expected, keys):
    names = expected.columns
    rows = lambda f: sorted(([*r] for r in f.select(*keys, *[c for c in names if c not in keys]).collect()), key=str)
    for a, b in zip(rows(got), rows(expected), strict=True):
        assert a == pytest.approx(b)


@pytest.mark.parametrize(("run", "tile"), [(20_000, 20_000), (150, 20_000), (1, 20_000), (150, 200)])
def test_modes_of_runs_equal_those_of_matches(spark, followed, monkeypatch, run, tile):
    points, _, pairs = followed
    monkeypatch.setattr(track, "RUN_POINTS", run)
    monkeypatch.setattr(track, "TILE_POINTS", tile)  # 200: the pairs of sample 7 are too large for a run
    shifts = track.estimate_shift(pairs, points, 20.0).cache()
    expected = track.choose_mode(track.match_samples(pairs, points, 5.0), track.match_samples(pairs, points, 5.0, shifts), shifts)
    assert expected.where("used = 'registered'").count() > 3 and expected.where("n_raw = 0").count() >= 2
    _same(track.register_samples(pairs, points, 5.0, 20.0), expected, ["pair"])


@pytest.mark.parametrize("query", [pq.k2_choose_mode, pq.k5_common_frame])
def test_registering_makes_no_row_for_a_pair(spark, query):
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "cx#" not in plan and plan.count("mapInArrow") + plan.count("MapInArrow") == 1


@pytest.mark.parametrize("mutual", [False, True])
@pytest.mark.parametrize(("run", "tile"), [(20_000, 20_000), (150, 20_000), (1, 20_000), (150, 200)])
def test_tracks_of_runs_equal_those_of_matches(spark, followed, monkeypatch, run, tile, mutual):
    points, manifest, pairs = followed
    monkeypatch.setattr(track, "RUN_POINTS", run)
    monkeypatch.setattr(track, "TILE_POINTS", tile)
    before, after = track._sides(pairs, points)
    matches = matching.mutual_nearest(near_pairs(before, after, "pair", 9.0), "pair") if mutual else matching.gated_assignment(before, after, "pair", 9.0)
    expected = track.track_ids(manifest, points, matches)
    got = track.follow_samples(manifest, pairs, points, 9.0, mutual).cache()
    assert got.schema["track_id"].dataType == expected.schema["track_id"].dataType and got.columns == expected.columns
    _same(got, expected, ["sample_id", "object_id"])
    assert got.groupBy("track_id").agg(F.count(F.lit(1)).alias("n")).where("n > 3").count()
    _same(track.pair_qc(pairs, track.track_pairs(got)), track.pair_qc(pairs, matches), ["sample_id"])


@pytest.mark.parametrize("query", [pq.k4_given_matches, pq.k6_given_matches, pq.k4_track_ids])
def test_tracks_are_found_without_rows_of_matches(spark, query, monkeypatch):
    monkeypatch.setattr(track, "chain_roots", lambda steps: _few(chain_roots, steps))
    assert query(spark, "/root/testdata/sf0.001").count()


def _few(find, steps):
    """Only objects that go on from a run before are followed by Spark; sf0.001 is shorter than a run for each eye."""
    assert steps.count() == 0
    return find(steps)
