"""Registration, regions, contracts and rules on literal rows."""

import pytest
from pyspark.sql import functions as F

from morphlake.operators import contract, geometry, neighbors, rules


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def test_register_points(spark):
    frame = geometry.build_frames(spark.createDataFrame([(8, 40.0, 70.0, 100.0, 70.0)], "sample_id int, onh_x_px double, onh_y_px double, dorsal_x_px double, dorsal_y_px double"), F.lit(0.5), F.lit(0.5))
    points = spark.createDataFrame([(8, 50.0, 70.0), (8, 40.0, 90.0), (8, 28.0, 54.0)], "image_no int, centroid_x_px double, centroid_y_px double")
    out = geometry.register_points(points, frame, "image_no")
    assert [(round(x, 9), round(y, 9), round(t, 3)) for x, y, t in rows(out, "ret_x_um", "ret_y_um", "theta_deg")] == [(-8.0, -6.0, 216.87), (0.0, 5.0, 90.0), (10.0, 0.0, 0.0)]


def test_a_frame_needs_two_points(spark):
    bad = spark.createDataFrame([(1, 5.0, 5.0, 5.0, 5.0)], "sample_id int, onh_x_px double, onh_y_px double, dorsal_x_px double, dorsal_y_px double")
    with pytest.raises(Exception, match="coincide"):
        geometry.build_frames(bad).collect()


def test_assign_regions_and_wrap(spark):
    points = spark.createDataFrame([(15.0, 25.98, 30.0, 60.0), (-24.0, 7.0, 25.0, 163.74), (1.0, -0.1, 70.0, 350.0)], "ret_x_um double, ret_y_um double, ecc_um double, theta_deg double")
    out = geometry.assign_regions(points, "mouse_flatmount_v1", 100.0)
    assert rows(out, "ring", "quadrant", "sector", "peripapillary_bin") == [("central", "dorsal_nasal", "nasal", "non_peripapillary"), ("central", "dorsal_temporal", "dorsal_temporal", "non_peripapillary"), ("peripheral", "ventral_temporal", "temporal", "non_peripapillary")]


def test_contract_fills_and_strict_raises(spark):
    raw = spark.createDataFrame([("/a/b.c/img.one.tif", "7", "x")], "source_path string, object_id string, extra string")
    out = contract.enforce_contract(raw, "object").first()
    assert (out.image_id, out.object_id, out.kept, out.phenotype, out.extra) == ("img.one", 7, True, "unclassified", "x")
    with pytest.raises(ValueError, match="lacks"):
        contract.enforce_contract(raw, "object", strict=True)


def test_phenotype_priority_null_and_circle(spark):
    objects = spark.createDataFrame([(1, 120.0, 1.0, 0.0), (2, 120.0, 1.0, 1.0), (3, None, None, None)], "object_id int, `geometry.area_px` double, `relation.overlap_fraction.rgc` double, `relation.overlap_fraction.mg` double")
    classes = {
        "rgc": {"priority": 100, "include": [{"feature": "relation.overlap_fraction", "target": "rgc", "op": "ge", "value": 0.5}], "exclude": [{"feature": "class.is", "value": "mg"}]},
        "mg": {"priority": 90, "include": [{"feature": "relation.overlap_fraction", "target": "mg", "op": "ge", "value": 0.5}]},
    }
    assert rows(rules.assign_phenotypes(objects, classes), "object_id", "phenotype") == [(1, "rgc"), (2, "mg"), (3, "unclassified")]
    classes["mg"]["include"].append({"feature": "class.is", "value": "rgc"})
    with pytest.raises(ValueError, match="circle"):
        rules.assign_phenotypes(objects, classes)


def test_replay_edits(spark):
    objects = spark.createDataFrame([(4, 30, "a"), (4, 31, "b"), (4, 33, "c"), (4, 35, "a"), (4, 36, "a"), (5, 30, "z")], "image_no int, object_id long, phenotype string")
    log = [(4, 1, "relabel_phenotype", 36, None, None, "amacrine"), (4, 2, "merge_objects", None, 33, [31, 33], None), (4, 3, "delete_object", 30, None, None, None), (4, 4, "relabel_phenotype", 33, None, None, "cone")]
    edits = spark.createDataFrame(log, "image_no int, seq int, op string, object_id long, keep_object_id long, object_ids array<long>, phenotype string")
    assert rows(rules.replay_edits(objects, edits, "image_no"), "image_no", "object_id", "new_object_id", "phenotype") == [(4, 33, 1, "cone"), (4, 35, 2, "a"), (4, 36, 3, "amacrine"), (5, 30, 1, "z")]
    unknown = edits.withColumn("op", F.lit("paint"))
    with pytest.raises(Exception, match="unknown edit"):
        rules.replay_edits(objects, unknown, "image_no").collect()


def test_points_in_rois_and_counts(spark):
    rois = spark.createDataFrame([(7, 2, 10, 20, 30, 10), (8, 2, 35, 25, 10, 20), (9, 3, 0, 0, 90, 90)], "roi_id int, image_no int, x0 int, y0 int, width int, height int")
    points = spark.createDataFrame([(2, 1, 36.0, 26.0), (2, 2, 10.0, 29.75), (2, 3, 40.0, 20.0), (6, 4, 5.0, 5.0)], "image_no int, id int, x double, y double")
    inside = neighbors.points_in_rois(points, rois, "image_no")
    assert rows(inside, "roi_id", "local_x", "local_y") == [(7, 0.0, 9.75), (7, 26.0, 6.0), (8, 1.0, 1.0)]
    assert rows(neighbors.roi_point_counts(rois, inside), "roi_id", "n_points") == [(7, 2), (8, 1), (9, 0)]


def test_nearest_finds_far_points(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 3.0, 4.0), (1, 3, 900.0, 0.0), (2, 1, 5.0, 5.0)], "image_no int, id int, x double, y double")
    out = neighbors.nearest(p, p, "image_no", 10.0, different=True)
    assert [(r[0], r[1], round(r[2], 6)) for r in sorted(out.select("image_no", "a", "d").collect())] == [(1, 1, 5.0), (1, 2, 5.0), (1, 3, round(((900 - 3) ** 2 + 16) ** 0.5, 6))]
