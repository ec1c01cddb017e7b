"""Readers and writers on small files."""

import hashlib

import pytest
from pyspark.sql import functions as F

from morphlake.operators import inventory, rules
from morphlake.operators.geometry import AXES
from morphlake.sources import readers


def test_manifest_paths_and_numbers(spark, tmp_path):
    (tmp_path / "m.csv").write_text("sample_id,animal_id,eye,condition,genotype,timepoint_dpi,modality,stain_panel,path,extra\nS1,A1,OD,c,wt,7,f,p,img/a.tif,x\nS2,A2,OS,t,wt,soon,f,p,/abs/b.tif,y\n")
    rows = {r.sample_id: r for r in readers.read_manifest(spark, f"{tmp_path}/m.csv").collect()}
    assert (rows["S1"].timepoint_dpi, rows["S2"].timepoint_dpi) == (7.0, None)
    assert (rows["S1"].path, rows["S2"].path, rows["S1"].extra) == (f"{tmp_path}/img/a.tif", "/abs/b.tif", "x")
    (tmp_path / "bad.csv").write_text("sample_id\nS1\n")
    with pytest.raises(ValueError, match="lacks"):
        readers.read_manifest(spark, f"{tmp_path}/bad.csv")


def test_inventory_and_digests(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, text in (("a.TIF", "1"), ("d/b.tif", "22"), ("c.txt", "3")):
        (tmp_path / name).write_text(text)
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in readers.scan_inventory(spark, str(tmp_path), [".tif"]).collect()] == [("a.TIF", 1), ("b.tif", 2)]
    got = {r.path: r.digest for r in readers.content_digest(spark, str(tmp_path)).collect()}
    assert got["d/b.tif"] == hashlib.sha256(b"22").hexdigest() and len(got) == 3


def test_roi_manifest_checks(spark, tmp_path):
    head = "roi_id,image_path,marker,modality,x0,y0,width,height,annotator,manual_points_path,split\n"
    (tmp_path / "r.csv").write_text(head + "r1,a,m,f,0,1,4,4,me,p/r1.csv,\n")
    row = readers.read_roi_manifest(spark, f"{tmp_path}/r.csv").first()
    assert (row.split, row.notes, row.y0) == ("benchmark", "", 1)
    (tmp_path / "bad.csv").write_text(head + "r1,a,m,f,0,1,4,4,me,p,dev\nr2,a,other,f,0,1,4,4,me,p,dev\n")
    with pytest.raises(ValueError, match="one marker"):
        readers.read_roi_manifest(spark, f"{tmp_path}/bad.csv")
    (tmp_path / "r1.csv").write_text("x_px,y_px\n1,2\n3,bad\n")
    points = readers.read_point_files(spark, readers.read_roi_manifest(spark, f"{tmp_path}/r.csv"), [f"{tmp_path}/r1.csv"]).collect()
    assert sorted((r.roi_id, r.x, r.y) for r in points) == [("r1", 1.0, 2.0), ("r1", 3.0, None)]


def test_sidecars_take_the_first_and_both_shapes(spark):
    rows = [("i", [100.0, 100.0], None, [0.0, -1.0], 2.0, None, 2), ("i", [1.0, 1.0], [1.0, 0.0], None, None, "cli", 1), ("j", [100.0, 100.0], None, [0.0, -1.0], 2.0, None, 3)]
    got = {r.image_id: tuple(r)[1:] for r in readers.read_frame_sidecars(spark.createDataFrame(rows, readers.SIDECAR + ", priority int")).collect()}
    assert got == {"i": (1.0, 1.0, 1.0, 0.0, None, "cli"), "j": (100.0, 100.0, 100.0, 0.0, 2.0, "sidecar")}


def test_subtypes_and_run_manifests(spark):
    good = {"Alpha": {"markers": [{"feature": "x", "center": 0.0, "scale": 1.0, "weight": 1.0}]}}
    assert list(readers.load_subtypes(good, AXES)) == ["alpha"]
    with pytest.raises(ValueError, match="same column"):
        readers.load_subtypes(good | {"alpha": {}}, AXES)
    with pytest.raises(ValueError, match="not usable"):
        readers.read_run_manifests(spark.createDataFrame([("a", "val")], "image_path string, split string"), ["notes"], training=True)


def test_roi_manifest_has_provenance_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("roi_id,image_path,marker,modality,x0,y0,width,height,annotator,manual_points_path,truth_marker\nr1,a,m,f,0,1,4,4,me,p,T\n")
    row = readers.read_roi_manifest(spark, f"{tmp_path}/r.csv").first().asDict()
    assert {c: row[c] for c in readers.ROI_PROVENANCE} == {c: "T" if c == "truth_marker" else None for c in readers.ROI_PROVENANCE}


def test_subtype_documents():
    marker = {"feature": "x", "center": 0.0, "scale": 1.0, "direction": "low"}
    document = {"schema_version": 1, "atlas_name": "a", "subtypes": {"Alpha B": {"markers": [marker], "location_priors": {AXES[0]: {"priors": {"q": 0.5}}}}}}
    read = readers.load_subtype_priors(document, AXES)
    assert list(read["subtypes"]) == ["alpha_b"] and (read["location_weight"], read["marker_weight"]) == (0.7, 0.3)
    bad_markers = [marker | {"center": None}, marker | {"weight": 0}, marker | {"scale": 0}, marker | {"feature": ""}, marker | {"direction": "up"}]
    bad_priors = [{AXES[0]: {"priors": {}}}, {AXES[0]: {"priors": {"q": 1}, "weight": 0}}, {"nowhere": {"priors": {"q": 1}}}]
    for subtype in [{"markers": [m]} for m in bad_markers] + [{"location_priors": p} for p in bad_priors]:
        with pytest.raises(ValueError, match="bad"):
            readers.load_subtype_priors(document | {"subtypes": {"A": subtype}}, AXES)
    for change in ({"schema_version": 2}, {"subtypes": {}}, {"location_weight": 0, "marker_weight": 0}, {"marker_weight": -1}):
        with pytest.raises(ValueError, match="need"):
            readers.load_subtype_priors(document | change, AXES)
    with pytest.raises(ValueError, match="lack"):
        readers.load_subtype_priors({"schema_version": 1}, AXES)


def test_calibration_grids(spark):
    frame, metric = readers.load_calibration_grid(spark, {"grid": [{"b": 1, "a": 2}, {"a": 3}], "selection_metric": "MAPE"})
    assert metric == "mape" and [tuple(r) for r in frame.orderBy("config_id").collect()] == [(1, '{"a": 2, "b": 1}'), (2, '{"a": 3}')]
    for bad in ({}, {"grid": []}, {"grid": {"a": 1}}, {"grid": [{}], "selection_metric": "f1"}):
        with pytest.raises(ValueError, match="grid"):
            readers.load_calibration_grid(spark, bad)


def test_phenotype_rules_of_both_versions(spark):
    assert readers.load_phenotype_rules({"schema_version": 2, "classes": {"c": {}}}) == {"schema_version": 2, "channels": {}, "compose": {}, "masks": {}, "classes": {"c": {}}}
    old = {"channels": {"rgc_channel": 1, "microglia_channel": 0}, "thresholds": {"rgc_min_intensity": 80}, "morphology_priors": {"min_area_px": 20, "max_area_px": 90}}
    new = readers.load_phenotype_rules(old)
    assert new["channels"] == {"RGC": 1, "MICROGLIA": 0} and new["masks"]["rgc_positive"]["min_intensity"] == 80 and new["masks"]["microglia"]["min_intensity"] == 120
    objects = spark.createDataFrame([(1, 50.0, 0.5, 0.0), (2, 10.0, 0.5, 0.0), (3, 50.0, 0.5, 0.2), (4, 50.0, 0.0, 0.0), (5, 90.0, None, 0.0)], "id int, `geometry.area_px` double, `relation.overlap_fraction.rgc_positive` double, `relation.overlap_fraction.microglia` double")
    got = {r.id: r.phenotype for r in rules.assign_phenotypes(objects, new["classes"]).collect()}
    assert got == {1: "rgc", 2: "unclassified", 3: "microglia", 4: "unclassified", 5: "unclassified"}
    assert readers.load_phenotype_rules({"logic": {"require_rgc_positive": False}, "channels": {"rgc_channel": 0}})["classes"] == {}


def test_inventory_of_metadata(spark):
    rich = '{"stem":"s","path":"/p.ims","metadata":{"image":{"X":"64","Y":"x"},"n_channels":2,"voxel_sizes_um":{"voxel_z_um":2.0}},"candidate_rbpms_channels":[{"channel_index":1,"score":135,"is_unambiguous_top_candidate":true},{"channel_index":0}],"scene":{"scene_groups":[{"a":1}],"annotation_candidates":[{"path":"A"},{"path":"B"}]}}'
    docs = spark.createDataFrame([(1, rich), (2, "{}"), (3, "no document"), (4, None), (5, '{"scene":{"scene_groups":[],"annotation_candidates":null}}')], "id int, text string")
    got = {r.id: r for r in inventory.flatten_metadata(docs, "text").collect()}
    r = got[1]
    assert (r.stem, r.source_path, r.size_x, r.size_y, r.n_channels, r.voxel_z_um, r.has_scene, r.scene_annotation_candidates) == ("s", "/p.ims", 64, None, 2, 2.0, True, 2)
    assert (r.top_candidate_channel_index, r.top_candidate_score, r.top_candidate_unambiguous) == (1, 135.0, True)
    assert all((got[i].stem, got[i].has_scene, got[i].scene_annotation_candidates, got[i].top_candidate_unambiguous) == (None, False, 0, False) for i in (2, 3, 4, 5)) and len(got) == 5
    assert sorted((r.id, r.path, r.score) for r in inventory.annotation_rows(docs, "text").collect()) == [(1, "/p.ims::A", 100), (1, "/p.ims::B", 100)]
    assert inventory.flatten_metadata(docs.where("id > 9"), "text").count() == 0


def test_conditions_and_manifests(spark):
    paths = spark.createDataFrame([("x/Normoxia_1.tif",), ("x/oir/healthy.tif",), ("x/P17_OIR.tif",), ("x/a.tif",), (None,)], "path string")
    got = [(r.c.condition, r.c.basis) for r in paths.select(inventory.classify_condition(F.col("path")).alias("c")).collect()]
    assert got == [("normoxic", "path_token"), ("normoxic", "path_token"), ("oir", "path_token"), ("unknown", "unresolved"), ("unknown", "unresolved")]
    files = spark.createDataFrame([("b", 1500, 1600), ("a", 1499, 3000), ("c", 2000, 2000)], "path string, height int, width int")
    rows = {r.path: r for r in inventory.derive_manifest(files, [F.col("path")], {"eye": "UNK", "timepoint_dpi": 0}, "M_%02d").collect()}
    assert {p: (r.sample_id, r.kind, r.eye, r.timepoint_dpi) for p, r in rows.items()} == {"a": ("M_01", "roi_or_unknown", "UNK", 0), "b": ("M_02", "whole_retina_candidate", "UNK", 0), "c": ("M_03", "whole_retina_candidate", "UNK", 0)}


def test_write_and_read_back(spark, tmp_path):
    readers.write_tables(spark.createDataFrame([(1, "i1"), (2, "i2")], "object_id long, image_id string"), "object", f"{tmp_path}/o")
    assert spark.read.parquet(f"{tmp_path}/o").where("image_id = 'i2'").first().object_id == 2
    counts = readers.write_roi_points(spark.createDataFrame([("r", 1.0), ("r", 2.0)], "roi_id string, x_px double"), f"{tmp_path}/p")
    assert counts.first().n_points == 2 and spark.read.csv(f"{tmp_path}/p", header=True).count() == 2
    readers.write_documents(counts, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").first().n_points == 2
