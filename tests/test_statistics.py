"""Spatial statistics, tests, matching, tracks and pixels on literal rows."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from morphlake.functions import tails
from morphlake.operators import cohort, evaluation, graph, matching, neighbors, pixels, spatial, stats, track


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_ripley_k(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 5.0)], "g int, id int, x double, y double")
    assert rows(spatial.ripley_k(neighbors.radius_neighbor_counts(p, "g", (1.0, 10.0)), "g", 100.0), "radius", "k") == [(1.0, 0.0), (10.0, 50.0)]


def test_csr_envelope_repeats(spark):
    domain = spark.range(16).select(F.lit(1).alias("g"), (F.col("id") * 8).alias("x")).crossJoin(spark.range(16).select((F.col("id") * 8).alias("y")))
    p = spark.createDataFrame([(1, i, float(x), float(y)) for i, (x, y) in enumerate(itertools.product((20, 60, 100), repeat=2))], "g int, id long, x double, y double")
    area = spark.createDataFrame([(1, 16384.0)], "g int, area_px double")
    run = lambda: rows(spatial.csr_envelope(p, domain, area, "g", (20.0, 40.0), 8, 128, 128, 8), "radius", "l_obs", "l_low", "l_high", "p_global", "g_obs", "g_low", "g_high")
    first = run()
    assert first == run() and len(first) == 2 and all(0 < r[4] <= 1 for r in first)


def test_tails_against_known_values():
    assert tails.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert tails.t_quantile(0.975, 5) == pytest.approx(2.570582, abs=1e-5)
    assert tails.mann_whitney(0.0, 4, 4, 0.0) == pytest.approx(2 / 70)
    assert tails.signed_rank(0.0, 6, 0.0) == pytest.approx(2 / 64)
    counts = tails._rank_sum_counts(3, 4)
    brute = [0] * 13
    for c in itertools.combinations(range(1, 8), 3):
        brute[sum(c) - 6] += 1
    assert list(counts) == brute


def test_fdr_with_null(spark):
    t = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, None), (4, 0.03)], "id int, p double").withColumn("f", F.lit(1))
    assert [(a, round(b, 9)) for a, b in rows(stats.fdr_bh(t, ["f"], "p", "id"), "id", "p_fdr")] == [(1, 0.04), (2, round(0.04 * 4 / 3, 9)), (3, 1.0), (4, round(0.04 * 4 / 3, 9))]


def test_constant_paired_difference(spark):
    s = spark.createDataFrame([("A1", "c", 50.0), ("A1", "t", 40.0), ("A2", "c", 48.0), ("A2", "t", 38.0)], "animal_id string, condition string, y double")
    t = {r["test"]: r for r in stats.paired_tests(s, "y", "c", "t").collect()}
    assert t["paired_t"]["effect"] == 0 and math.isinf(t["paired_t"]["statistic"]) and t["paired_t"]["p"] == 0


def test_mixed_model_equals_balanced_closed_form(spark):
    rng = np.random.default_rng(3)
    a, n = 12, 5
    y = rng.normal(size=a)[:, None] * 2 + rng.normal(size=(a, n)) + 10
    data = [(i, float(v)) for i in range(a) for v in y[i]]
    fit = {r["term"]: r["estimate"] for r in stats.mixed_model(spark.createDataFrame(data, "g int, y double"), [], "y", "g").collect()}
    within = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (a * (n - 1))
    between = n * ((y.mean(1) - y.mean()) ** 2).sum() / a
    assert fit["intercept"] == pytest.approx(y.mean()) and fit["residual_variance"] == pytest.approx(within, rel=1e-6)
    assert fit["group_variance"] == pytest.approx((between - within) / n, rel=1e-6)


def test_agreement_summary(spark):
    s = spark.createDataFrame([(10, 12), (8, 9), (11, 11)], "p int, m int")
    r = cohort.agreement_summary(s, "p", "m").first()
    assert (r.n_samples, r.mean_bias, r.mae) == (3, -1.0, 1.0) and r.rmse == pytest.approx(math.sqrt(5 / 3))


def test_validation_conflict(spark):
    s = spark.createDataFrame([(1, 7, 2.0, 3.0, None)], "sample_id int, cell_count int, label_count double, manual_count double, expected_total_objects double")
    with pytest.raises(Exception, match="references differ"):
        cohort.validation_table(s).collect()


def test_point_match_and_metrics(spark):
    f = lambda ps: spark.createDataFrame([(1, i, float(x), float(y)) for i, (y, x) in enumerate(ps)], "roi_id int, id long, x double, y double")
    truth, found = f([(10, 10), (20, 20), (30, 30)]), f([(10, 11), (20, 21), (45, 45)])
    m = matching.match_metrics(truth, found, matching.point_match(truth, found, ["roi_id"]), ["roi_id"], [3.0]).first()
    assert (m.tp, m.fp, m.fn) == (2, 1, 1) and m.precision == pytest.approx(2 / 3) and m.recall == pytest.approx(2 / 3)


def test_tracks_and_shift(spark):
    manifest = spark.createDataFrame([(1, "A", "OD", 0.0), (2, "A", "OD", 7.0)], "sample_id long, animal_id string, eye string, timepoint_dpi double")
    points = spark.createDataFrame([(1, 1, 10.0, 10.0), (1, 2, 40.0, 40.0), (2, 1, 12.0, 11.0), (2, 2, 42.0, 39.0)], "image_no long, id long, x double, y double")
    counts = points.groupBy(F.col("image_no").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_objects"))
    pairs = track.consecutive_samples(manifest, counts)
    matches = track.match_samples(pairs, points, 5.0)
    assert rows(matches, "a", "b") == [(1, 1), (2, 2)]
    t = track.track_ids(manifest, points, matches)
    s = track.track_summary(t, track.pair_qc(pairs, matches)).first()
    assert (s.n_tracks, s.n_observations, s.n_pairs, s.mean_matched_fraction) == (2, 4, 1, 1.0)


def test_suppression_and_merge(spark):
    p = spark.createDataFrame([(1, 1, 10.0, 10.0, 0.9, 1), (1, 2, 30.0, 30.0, 0.8, 1), (1, 3, 10.8, 10.5, 0.7, 2), (1, 4, 50.0, 50.0, 0.6, 2)], "g int, id long, x double, y double, score double, source int").withColumn("row", F.col("id"))
    assert graph.merge_candidates(p, "g", 2.0).count() == 3
    rng = np.random.default_rng(5)
    pts = [(1, i, float(x), float(y), float(s)) for i, (x, y, s) in enumerate(rng.random((300, 3)) * [100, 100, 1])]
    kept = {r["id"] for r in graph.suppress_min_distance(spark.createDataFrame(pts, "g int, id long, x double, y double, score double"), "g", [F.desc("score")], 8.0).collect()}
    want = []
    for p in sorted(pts, key=lambda q: (-q[4], q[1])):
        if all((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 >= 64 for q in want):
            want.append(p)
    assert kept == {p[1] for p in want}


def test_components_and_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = dict(tuple(r) for r in graph.connected_components(links).select("node", "root").collect())
    assert all(roots[i] == 1 for i in range(1, 41)) and roots[101] == 100 and len(roots) == 42
    steps = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(1, 40)], "id long, parent long")
    got = dict(tuple(r) for r in graph.chain_roots(steps.withColumn("parent", F.when(F.col("parent") > 0, F.col("parent")))).collect())
    assert got[9] == 1 and got[10] == 10 and got[39] == 30


def test_voronoi_areas_sum_to_the_domain(spark):
    domain = spark.range(10).select(F.lit(1).alias("g"), F.col("id").alias("x")).crossJoin(spark.range(10).select(F.col("id").alias("y")))
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 9.0, 9.0), (1, 3, 9.0, 0.0)], "g int, id long, x double, y double")
    assert spatial.voronoi_cells(p, domain, "g", 1.0).agg(F.sum("area")).first()[0] == 100.0


def test_label_pixels(spark):
    label = np.zeros((8, 8), dtype=int)
    label[1:3, 1:3], label[5:7, 4:6] = 1, 2
    data = [(1, y, x, int(label[y, x]), 1.0, y < 5) for y in range(8) for x in range(8)]
    f = spark.createDataFrame(data, "g int, y int, x int, label int, value double, in_focus boolean")
    assert rows(pixels.label_centroids(f, "g"), "label", "cy", "cx") == [(1, 1.5, 1.5), (2, 5.5, 4.5)]
    assert rows(pixels.object_table(f, "g"), "label", "area_px", "focus_px", "perimeter_px") == [(1, 4, 4, 8), (2, 4, 0, 8)]
    assert rows(graph.pixel_components(f.where("label > 0"), "g").groupBy("instance").agg(F.count(F.lit(1)).alias("n")), "instance", "n") == [(1, 4), (2, 4)]


def test_split_gate(spark):
    data = [("a", s, r, f1, f1, 1) for s, n, f1 in (("dev", 4, 0.7), ("locked_eval", 2, 0.6)) for r in range(n)] + [("b", s, r, f1, f1, 1) for s, n, f1 in (("dev", 4, 0.7), ("locked_eval", 2, 0.4)) for r in range(n)]
    out = evaluation.split_summary_gate(spark.createDataFrame(data, "config_id string, split string, roi_id int, f1 double, recall double, count_mae int"))
    assert rows(out, "config_id", "passed") == [("a", True), ("b", False)]


def test_tiles_are_put_together(spark):
    from morphlake.operators import tiles

    label = np.zeros((32, 32), dtype=int)
    label[3:9, 8:24], label[20:28, 4:12] = 1, 2
    w = tiles.tile_windows(spark.createDataFrame([(1, 32, 32)], "image_no int, height int, width int"), "image_no", 16, 8)
    data = []
    for r in w.collect():
        for y in range(r.y0, r.y1):
            for x in range(r.x0, r.x1):
                data.append((1, r.tile, y, x, int(label[y, x])))
    out = tiles.stitch_tiles(spark.createDataFrame(data, "image_no int, tile long, y int, x int, label int"), w)
    sizes = sorted(r["n"] for r in out.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == [64, 96]


def test_void_and_hull(spark):
    from morphlake.operators import tiles

    on = np.ones((20, 20), dtype=int)
    on[8:12, 9:13], on[0:2, 0:2] = 0, 0
    mask = spark.createDataFrame([(1, y, x, int(on[y, x])) for y in range(20) for x in range(20)], "g long, y int, x int, on int")
    assert [(r.cy, r.cx) for r in tiles.void_landmark(mask, "g", 20, 20).collect()] == [(9.5, 10.5)]
    ell = [(1, y, x, 1) for y in range(4) for x in range(4) if y < 2 or x < 2]
    got = tiles.solidity(spark.createDataFrame(ell, "g long, y int, x int, label long"), "g").first()
    assert got.solidity == pytest.approx(12 / 14)
