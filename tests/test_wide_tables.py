"""Rows made by cross joins and explodes look small to the planner; steps over them must not depend on that."""

import contextlib
import io

from pyspark.sql import functions as F

from morphlake.operators import geometry
from morphlake.plans import region_queries as rq
from morphlake.sources import bindings as b

SF = "/root/testdata/sf0.001"


def plan_of(frame):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain("simple")
    return out.getvalue()


def test_pixels_of_all_images_are_not_broadcast_to_their_frames(spark):
    tissue = rq.registered(spark, SF, b.tissue(spark, SF), "x", "y")
    joins = [line for line in plan_of(tissue).splitlines() if "__frame" in line and "HashJoin" in line]
    assert joins and not any("BroadcastHashJoin" in line for line in joins)


def test_images_of_the_lattice_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(b, "IMAGES", 2)
    images = b.images(spark, SF).count()
    assert b.tissue(spark, SF).rdd.getNumPartitions() == -(-images // 2)


def test_region_summary_keeps_every_label_and_image_of_the_tissue(spark):
    frame = spark.createDataFrame([(1, 512.0, 512.0, 512.0, 0.0, 0.5), (2, 512.0, 512.0, 512.0, 0.0, 0.5)], "sample_id long, onh_x_px double, onh_y_px double, dorsal_x_px double, dorsal_y_px double, um_per_px double")
    place = lambda rows: geometry.assign_regions(geometry.register_points(spark.createDataFrame(rows, "image_no long, x double, y double"), geometry.build_frames(frame, F.col("um_per_px")), "image_no", x="x", y="y"), rq.SCHEMA, rq.MAX_ECC)
    rows = geometry.region_summary(place([(1, 520.0, 500.0)] * 3), place([(1, 520.0, 500.0), (2, 0.0, 0.0)]), rq.SCHEMA, "image_no", 1.0).collect()
    assert len(rows) == 34
    assert {(r.image_no, r.region_label, r.area_mm2, r.object_count) for r in rows if r.region_axis == "ring" and (r.area_mm2 or r.object_count)} == {(1, "central", 1.0, 3), (2, "peripheral", 1.0, 0)}


def test_rectangles_in_cells_are_not_broadcast(spark):
    from morphlake.operators import neighbors

    rois = spark.range(50).selectExpr("id as roi_id", "id % 3 as g", "id * 7 % 90 as x0", "id * 11 % 90 as y0", "30L as width", "20L as height")
    points = spark.range(200).selectExpr("id % 3 as g", "id", "cast(id * 37 % 120 as double) as x", "cast(id * 53 % 120 as double) as y")
    inside, pairs = neighbors.points_in_rois(points, rois, "g", 16), neighbors.roi_overlap_pairs(rois, "g", 16)
    for frame in (inside, pairs):
        assert "BroadcastHashJoin" not in plan_of(frame)
    p, r = points.collect(), rois.collect()
    assert sorted((x.roi_id, x.id) for x in inside.collect()) == sorted((b.roi_id, a.id) for a in p for b in r if a.g == b.g and b.x0 <= a.x < b.x0 + b.width and b.y0 <= a.y < b.y0 + b.height)
    w = lambda a, b, c, n: min(a[c] + a[n], b[c] + b[n]) - max(a[c], b[c])
    want = sorted((a.roi_id, b.roi_id, w(a, b, "x0", "width") * w(a, b, "y0", "height")) for a in r for b in r if a.g == b.g and a.roi_id < b.roi_id and w(a, b, "x0", "width") > 0 and w(a, b, "y0", "height") > 0)
    assert sorted((x.roi_a, x.roi_b, x.overlap_px) for x in pairs.collect()) == want


def test_a_point_is_entered_in_few_cells_and_no_pair_is_lost(spark):
    from morphlake.operators import neighbors

    points = spark.range(400).selectExpr("id % 2 as g", "id", "cast(id * 37 % 101 as double) as x", "cast(id * 53 % 103 - 50 as double) as y")
    near = neighbors.near_pairs(points, points, "g", 5.0)
    p = points.collect()
    want = sorted((a.id, b.id) for a in p for b in p if a.g == b.g and (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 25.0)
    assert sorted((r.a, r.b) for r in near.collect()) == want
    assert "array(-1, 0, 1)" not in plan_of(near) and "[-1,0,1]" not in plan_of(near)  # nine copies of each point before


def test_tiles_of_a_large_group_give_the_assignment_of_the_whole(spark, monkeypatch):
    from morphlake.operators import matching

    left = spark.range(600).selectExpr("id % 2 as g", "id", "id * 7919 % 10007 / 50.0 as x", "id * 104729 % 10009 / 50.0 as y")
    right = spark.range(600).selectExpr("id % 2 as g", "id", "id * 6101 % 10007 / 50.0 as x", "id * 3571 % 10009 / 50.0 as y")
    whole = sorted(tuple(r) for r in matching.gated_assignment(left, right, "g", 12.0).collect())
    monkeypatch.setattr(matching, "TILE_POINTS", 60)
    tiled = sorted(tuple(r) for r in matching.gated_assignment(left, right, "g", 12.0).collect())
    assert len(whole) > 300
    assert [(r[0], r[1], r[2]) for r in tiled] == [(r[0], r[1], r[2]) for r in whole]


def test_no_row_is_made_for_a_candidate_pair_of_a_small_group(spark, monkeypatch):
    from morphlake.operators import matching

    monkeypatch.setattr(matching, "connected_components", None)  # called for every candidate pair before
    side = spark.range(40).selectExpr("0L as g", "id", "id * 3.0 as x", "0.0 as y")
    assert [(r.a, r.b) for r in matching.gated_assignment(side, side, "g", 4.0).orderBy("a").collect()] == [(i, i) for i in range(40)]


def test_small_groups_are_searched_whole_and_large_ones_in_squares_alike(spark, monkeypatch):
    from morphlake.operators import blocks, neighbors

    points = spark.range(500).selectExpr("id % 5 as g", "id", "id * 7919 % 1009 * 1.0 as x", "id * 104729 % 997 * 1.0 as y").where("g < 4 or id < 250")
    found = []
    for most in (0, 75, 4096):
        monkeypatch.setattr(blocks, "WHOLE", most)
        found.append(sorted(tuple(r) for r in neighbors.nearest(points, points, "g", 64.0, different=True).collect()))
    assert len(found[0]) == 450 and found[0] == found[1] == found[2]
    monkeypatch.setattr(blocks, "WHOLE", 4096)
    monkeypatch.setattr(blocks, "block_candidates", None)  # squares were made for every group before
    assert sorted(tuple(r) for r in neighbors.nearest(points, points, "g", 64.0, different=True).collect()) == found[0]


def test_many_small_regions_are_matched_in_one_task(spark):
    from morphlake.operators import matching

    truth = spark.range(900).selectExpr("if(id % 300 = 7, null, id % 300) as r", "id", "id * 37 % 64 * 1.0 as x", "id * 53 % 64 * 1.0 as y")
    found = truth.where("r is null or r % 3 > 0").selectExpr("r", "id + 1000 as id", "x + 1 as x", "y")
    matched = matching.point_match(truth, found, ["r"])
    assert "FlatMapCoGroupsInPandas" not in plan_of(matched)
    rows = matched.collect()
    assert len(rows) == 600 and sum(r.r is None for r in rows) == 3
    assert sum(r.d for r in rows) <= 600.0 + 1e-9


def test_only_chains_that_go_on_travel(spark):
    from morphlake.operators import graph

    steps = spark.range(200).selectExpr("id", "if(id % 20 = 0 or id > 150, null, id - 1) as parent")
    assert {r.id: r.root for r in graph.chain_roots(steps).collect()} == {i: i if i > 150 else i // 20 * 20 for i in range(200)}


def test_points_are_not_broadcast_to_their_samples(spark):
    from morphlake.operators import track

    pairs = spark.range(1, 4).selectExpr("id as sample_id", "nullif(id - 1, 0) as prev_sample_id", "5L as n_prev", "5L as n_cur")
    points = spark.range(15).selectExpr("id % 3 + 1 as image_no", "id", "id * 1.0 as x", "id * 2.0 as y")
    before, after = track._sides(pairs, points)
    manifest = spark.range(1, 4).selectExpr("id as sample_id", "1L as animal_id", "'OD' as eye", "cast(id as double) as timepoint_dpi")
    matches = spark.range(5).selectExpr("2L as pair", "id * 3 as a", "id * 3 + 1 as b", "0.5D as d")
    tracks = track.track_ids(manifest, points, matches)
    assert "BroadcastHashJoin [s" not in plan_of(before) + plan_of(after) + plan_of(tracks.select("sample_id", "object_id", "track_id"))
    rows = {(r.sample_id, r.object_id): r.track_id for r in tracks.collect()}
    assert len(rows) == 15 and len(set(rows.values())) == 10 and rows[1, 0] == rows[2, 1]


def test_exploded_pixels_are_not_broadcast_to_their_thresholds(spark):
    from morphlake.operators import pixels

    images = spark.range(3).selectExpr("id as g", "explode(sequence(0L, 15L)) as y").selectExpr("g", "y", "explode(sequence(0L, 15L)) as x")
    mask = pixels.tissue_mask(images.selectExpr("*", "if(x < 8, 0.0D, 1.0D) as value"), "g", 1, 1)
    assert "BroadcastHashJoin" not in plan_of(mask)
    assert mask.where("on = 1").groupBy("g").count().collect()


def test_pairs_of_one_key_are_dealt_to_tasks(spark, monkeypatch):
    from morphlake.operators import tiles

    monkeypatch.setattr(tiles, "PAIRS", 50)
    configs = spark.createDataFrame([(i, "a" if i < 40 else None if i < 43 else "b") for i in range(50)] + [(0, "a")], "config_id long, k string").coalesce(1)
    views = spark.createDataFrame([(i, "a" if i < 20 else "c" if i < 23 else "b") for i in range(25)], "view_id long, k string").coalesce(1)
    got = tiles.match_views(configs, views, ["k"])
    assert got.columns == configs.join(views, ["k"]).columns and sorted(got.collect()) == sorted(configs.join(views, ["k"]).collect())
    assert got.where("k = 'a'").select(F.spark_partition_id()).distinct().count() > 1


def test_hulls_of_many_objects_in_a_batch(spark):
    from morphlake.operators import tiles

    cells = [(i, y, x, 1 + (x > 4)) for i in range(30) for y in range(1 + i % 4) for x in range(8) if (x > 4 or x <= y)]
    got = tiles.solidity(spark.createDataFrame(cells, "image_no long, y long, x long, label long"), "image_no")
    assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
    found = {(r.image_no, r.label): round(r.solidity, 6) for r in got.collect()}
    # a stair of n steps lies in its square without the triangle beyond the corners
    area = {n: n * n - (n - 1) ** 2 / 2 for n in range(1, 5)}
    assert found == {(i, k): 1.0 if k == 2 else round((n * (n + 1) / 2) / area[n], 6) for i in range(30) for k in (1, 2) for n in [1 + i % 4]}


def test_copies_of_a_dealt_join_grow_with_the_root_of_its_parts(spark, monkeypatch):
    from morphlake.operators import tiles

    monkeypatch.setattr(tiles, "PAIRS", 100)
    left = spark.range(400).selectExpr("id as config_id", "if(id < 390, 'a', 'b') as k")
    right = spark.range(100).selectExpr("id as view_id", "if(id < 90, 'a', 'b') as k")
    got = tiles.match_views(left, right, ["k"])
    assert sorted(got.collect()) == sorted(left.join(right, ["k"]).collect())
    rows = []
    for side in ("left", "right"):
        plan = got._jdf.queryExecution().optimizedPlan()
        join = next(p for p in (plan, plan.children().head()) if p.nodeName() == "Join")
        rows.append(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, getattr(join, side)()).count())
    # 351 parts of key a: 39 rows by 9 columns; all in one direction would be 351 copies of 90 rows
    assert sum(rows) == 390 * 9 + 90 * 39 + 10 + 10
