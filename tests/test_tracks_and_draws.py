"""Shifts, modes, common frames, curation counts and random envelopes against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.operators import matching, spatial, track


def _pairs(spark, points, manifest):
    counts = points.groupBy(F.col("image_no").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_objects"))
    return track.consecutive_samples(manifest, counts)


@pytest.fixture(scope="module")
def moved(spark):
    """Samples 1 to 4 of one eye: 2 is 1 moved by (-9, 5), 3 is empty, 4 comes after it."""
    rng = np.random.default_rng(8)
    base = rng.random((40, 2)) * 400
    data = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(base)]
    data += [(2, i, float(x) - 9, float(y) + 5) for i, (x, y) in enumerate(base[:30])] + [(2, 100 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((6, 2)) * 400)]
    data += [(4, 1, 3.0, 3.0)]
    points = spark.createDataFrame(data, "image_no long, id long, x double, y double")
    manifest = spark.createDataFrame([(i, "A", "OD", 7.0 * i) for i in (1, 2, 3, 4)], "sample_id long, animal_id string, eye string, timepoint_dpi double")
    return points, _pairs(spark, points, manifest).cache()


def test_shift_is_the_displacement_of_most_pairs(spark, moved):
    points, pairs = moved
    got = {r.pair: r for r in track.estimate_shift(pairs, points, 30.0).collect()}
    assert set(got) == {2, 3, 4} and got[2].status == "estimated" and got[2].votes >= 30
    assert got[2].dx == pytest.approx(9, abs=0.3) and got[2].dy == pytest.approx(-5, abs=0.3)
    assert [(got[i].status, got[i].dx) for i in (3, 4)] == [("missing", None)] * 2
    dims = spark.createDataFrame([(1, 400, 400), (2, 400, 300), (3, 400, 400), (4, 400, 400)], "image_no long, width int, height int")
    other = {r.pair: r for r in track.estimate_shift(pairs, points, 30.0, dims=dims).collect()}
    assert (other[2].status, other[2].dx, other[3].status) == ("shape_mismatch", None, "shape_mismatch") and other[4].status == "missing"


def test_modes_and_common_frame(spark, moved):
    points, pairs = moved
    shifts = track.estimate_shift(pairs, points, 30.0).cache()
    raw, registered = track.match_samples(pairs, points, 4.0), track.match_samples(pairs, points, 4.0, shifts)
    modes = track.choose_mode(raw, registered, shifts)
    used = {r.pair: r.used for r in modes.collect()}
    assert used == {2: "registered", 3: "fallback_missing", 4: "fallback_missing"}
    swapped = {r.pair: r.used for r in track.choose_mode(registered, raw, shifts).collect()}
    assert swapped[2] == "fallback_no_improvement"
    frame = {r.sample_id: r for r in track.common_frame(pairs, modes).collect()}
    assert frame[1].segment != frame[3].segment and frame[1].segment == frame[2].segment and len({frame[i].segment for i in (1, 3, 4)}) == 3
    assert frame[2].offset_x == pytest.approx(9, abs=0.3) and (frame[1].offset_x, frame[3].offset_y, frame[4].offset_x) == (0, 0, 0)
    qc = {r.sample_id: r for r in track.pair_qc(pairs, registered).collect()}
    n = registered.count()
    assert (qc[2].n_matched, qc[2].unmatched_prev, qc[2].unmatched_cur) == (n, 40 - n, 36 - n) and qc[2].matched_fraction == pytest.approx(n / 36)
    assert qc[3].matched_fraction is None and 30 <= n <= 36


def test_offsets_add_up_along_registered_pairs(spark):
    manifest = [("A", "OD", i, float(i)) for i in range(1, 6)]
    pairs = spark.createDataFrame(manifest, "animal_id string, eye string, sample_id long, timepoint_dpi double")
    used = spark.createDataFrame([(2, 1.0, -1.0, "registered"), (3, 2.0, 3.0, "registered"), (4, 9.0, 9.0, "fallback_no_improvement"), (5, 4.0, 0.5, "registered")], "pair long, dx double, dy double, used string")
    got = [(r.sample_id, r.segment, r.offset_x, r.offset_y) for r in track.common_frame(pairs, used).orderBy("sample_id").collect()]
    assert got == [(1, 1, 0.0, 0.0), (2, 1, 1.0, -1.0), (3, 1, 3.0, 2.0), (4, 2, 0.0, 0.0), (5, 2, 4.0, 0.5)]


def test_curation_counts_and_unmatched(spark):
    f = lambda ps: spark.createDataFrame([(r, i, float(x), 0.0) for i, (r, x) in enumerate(ps)], "roi_id int, id long, x double, y double")
    first, final = f([(1, 0), (1, 10), (1, 20), (2, 0)]), f([(1, 0.5), (1, 19), (1, 40), (1, 60), (3, 1)])
    got = {r.roi_id: (r.added, r.deleted, r.final) for r in matching.curation_delta(first, final, ["roi_id"], 1.5).collect()}
    assert got == {1: (3, 2, 4), 2: (0, 1, 0), 3: (1, 0, 1)}  # least total distance joins 10 to 19 and 20 to 40
    matches = matching.point_match(first, final, ["roi_id"])
    left = sorted((r.roi_id, r.x) for r in matching.unmatched(first, matches.where("d <= 1.5"), ["roi_id"], "a").collect())
    assert left == [(1, 10.0), (1, 20.0), (2, 0.0)]
    sweep = {r.tolerance: r for r in matching.match_metrics(first, final, matches, ["roi_id"], [1.5, 10.0, 100.0]).where("roi_id = 1").collect()}
    assert [sweep[t].tp for t in (1.5, 10.0, 100.0)] == [1, 2, 3] and sweep[10.0].precision == 0.5 and sweep[10.0].recall == pytest.approx(2 / 3) and sweep[10.0].f1 == pytest.approx(4 / 7)


def test_envelope_equals_plain_draws(spark):
    sims, radii, seed, step, side = 8, (20.0, 40.0), 1337, 8, 16
    grid = [(float(x * step), float(y * step)) for x in range(side) for y in range(side)]
    spots = [(20.0, 20.0), (60.0, 24.0), (60.0, 60.0), (64.0, 66.0), (100.0, 60.0), (44.0, 84.0), (90.0, 90.0)]
    domain = spark.createDataFrame([(1, x, y) for x, y in grid], "g int, x double, y double")
    points = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(spots)], "g int, id long, x double, y double")
    area = float(side * side * step * step)
    got = {r.radius: r for r in spatial.csr_envelope(points, domain, spark.createDataFrame([(1, area)], "g int, area_px double"), "g", radii, sims, side * step, side * step, step).collect()}
    order = sorted(grid, key=lambda p: (p[1], p[0]))
    key = {r.sim: r.key for r in spark.range(1, sims + 1).select(F.col("id").cast("int").alias("sim")).select("sim", F.xxhash64(F.lit(seed), F.lit(1), "sim").alias("key")).collect()}
    drawn = [[order[k] for k in spatial.permuted(np.arange(len(spots)), len(order), key[s])] for s in range(1, sims + 1)]
    outside = [(x, y) for x in range(-step, side * step + 1, step) for y in range(-step, side * step + 1, step) if not (0 <= x < side * step and 0 <= y < side * step)]

    def curve(ps):
        ps = np.array(ps)
        snapped = np.clip(np.rint(ps / step) * step, 0, (side - 1) * step)
        edge = np.array([min(math.hypot(x - a, y - b) for a, b in outside) for x, y in snapped])
        d = np.hypot(*(ps[:, None] - ps[None]).transpose(2, 0, 1))
        out, inner = [], 0.0
        for r in radii:
            far, pairs = edge >= r, len(ps) * (edge >= r).sum()
            total, ring = ((d <= r).sum(1) - 1)[far].sum(), ((d <= r) & (d > inner) & (d > 0)).sum(1)[far].sum()
            out.append((math.sqrt(area * total / pairs / math.pi) - r, area * ring / pairs / (math.pi * (r * r - inner * inner))) if far.any() else (None, None))
            inner = r
        return out

    observed, simulated = curve(spots), [curve(p) for p in drawn]
    for i, r in enumerate(radii):
        for j, c in enumerate("lg"):
            values = [s[i][j] for s in simulated if s[i][j] is not None]
            low, high = np.percentile(values, [2.5, 97.5])
            assert (got[r][f"{c}_obs"], got[r][f"{c}_low"], got[r][f"{c}_high"]) == pytest.approx((observed[i][j], low, high))
    assert got[20.0].peak_g == pytest.approx(max(g for _, g in observed if g is not None))
    largest = lambda c: max(abs(v) for v, _ in c if v is not None)
    assert got[20.0].p_global == pytest.approx((sum(largest(c) >= largest(observed) for c in simulated) + 1) / (sims + 1))
