"""Manifests, point files, sidecars and documents: Spark readers with the checks that each table needs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.functions.columns import number, stem
from morphlake.operators.contract import enforce_contract

# Required columns of the tables that are read.
MANIFEST = ("sample_id", "animal_id", "eye", "condition", "genotype", "timepoint_dpi", "modality", "stain_panel", "path")
MANIFEST_NUMBERS = ("timepoint_dpi", "onh_x_px", "onh_y_px", "dorsal_x_px", "dorsal_y_px", "expected_total_objects")
REFERENCE = ("region_axis", "region_label", "expected_density_cells_per_mm2")
ROI = ("roi_id", "image_path", "marker", "modality", "x0", "y0", "width", "height", "annotator", "manual_points_path", "split", "notes")
ROI_PROVENANCE = ("image_marker", "image_source_channel", "truth_marker", "truth_source_channel", "truth_derivation", "truth_source_path")
SELECTION_METRICS = ("mae", "bias", "mape", "corr")
SUBTYPE_WEIGHTS = {"location_weight": 0.7, "marker_weight": 0.3}


def read_csv(spark: SparkSession, paths: str | Sequence[str], required: Sequence[str]) -> DataFrame:
    """All columns as text; a missing required column raises."""
    frame = spark.read.csv(paths if isinstance(paths, str) else list(paths), header=True)
    missing = [c for c in required if c not in frame.columns]
    if missing:
        raise ValueError(f"the table lacks {missing}")
    return frame


def absolute(path: Column, folder: str) -> Column:
    """A relative path under the folder; absolute ones, URIs and blanks stay."""
    return F.when(path.isNull() | (F.trim(path) == "") | path.startswith("/") | path.contains("://"), path).otherwise(F.concat(F.lit(folder.rstrip("/") + "/"), path))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A study manifest: paths resolved against its folder, numbers read (bad ones are null)."""
    frame, folder = read_csv(spark, path, MANIFEST), path.rpartition("/")[0]
    numbers = {c: number(F.col(c)) for c in MANIFEST_NUMBERS if c in frame.columns}
    return frame.withColumns({**numbers, **{c: absolute(F.col(c), folder) for c in ("path", "label_path") if c in frame.columns}})


def scan_inventory(spark: SparkSession, folder: str, suffixes: Sequence[str], hidden: bool = False) -> DataFrame:
    """(path, length) of all files below a folder with one of the suffixes, in order of path; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    wanted = files.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin([s.lower() for s in suffixes]))
    return (wanted if hidden else wanted.where(~F.col("path").rlike(r"/\.[^/]*$"))).orderBy("path")


def content_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, digest) of every file below a folder, the path relative to it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", f".*?{folder.split('://')[-1].rstrip('/')}/(.*)", 1).alias("path"), "length", F.sha2("content", 256).alias("digest"))


def read_reference_densities(spark: SparkSession, path: str) -> DataFrame:
    """Expected densities; the reference's name defaults to the file's, the region schema to null."""
    frame = read_csv(spark, path, REFERENCE)
    name = F.col("atlas_name") if "atlas_name" in frame.columns else stem(F.lit(path))
    schema = F.col("retina_region_schema") if "retina_region_schema" in frame.columns else F.lit(None).cast("string")
    sd = number(F.col("expected_sd")) if "expected_sd" in frame.columns else F.lit(None).cast("double")
    return frame.select(name.alias("atlas_name"), schema.alias("region_schema"), "region_axis", "region_label", number(F.col("expected_density_cells_per_mm2")).alias("expected_density"), sd.alias("expected_sd"))


def read_point_files(spark: SparkSession, rois: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Points of all files, with the region of the manifest row (manual_points_path) that names the file."""
    points = spark.read.csv(list(paths), header=True)
    if missing := [c for c in ("x_px", "y_px") if c not in points.columns]:
        raise ValueError(f"the point files lack {missing}")
    named = points.select(number(F.col("x_px")).alias("x"), number(F.col("y_px")).alias("y"), stem(F.col("_metadata.file_path")).alias("__stem"))
    return named.join(rois.select("roi_id", stem(F.col("manual_points_path")).alias("__stem")), "__stem").drop("__stem")


def read_roi_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Regions; split defaults to benchmark, notes to '', provenance columns to null. More than one marker or modality, or a repeated id, raises."""
    frame = read_csv(spark, path, ROI[:10])
    filled = frame.withColumns({
        "split": F.coalesce(F.nullif(F.trim("split"), F.lit("")), F.lit("benchmark")) if "split" in frame.columns else F.lit("benchmark"),
        "notes": F.coalesce("notes", F.lit("")) if "notes" in frame.columns else F.lit(""), **{c: F.col(c).try_cast("bigint") for c in ("x0", "y0", "width", "height")},
        **{c: F.lit(None).cast("string") for c in ROI_PROVENANCE if c not in frame.columns},
    })
    seen = filled.agg(F.countDistinct("marker").alias("marker"), F.countDistinct("modality").alias("modality"), F.count(F.lit(1)).alias("n"), F.countDistinct("roi_id").alias("ids")).first()
    if seen["marker"] > 1 or seen["modality"] > 1 or seen["n"] != seen["ids"]:
        raise ValueError(f"regions need one marker, one modality and their own ids, not {seen.asDict()}")
    return filled


def read_run_manifests(frame: DataFrame, columns: Sequence[str], training: bool = False) -> DataFrame:
    """Contract columns filled with nulls; training rows need split train or val, no blank paths, and a train row."""
    out = frame.withColumns({c: F.lit(None).cast("string") for c in columns if c not in frame.columns})
    if training:
        bad = out.agg(F.count_if(~F.coalesce(F.col("split").isin("train", "val"), F.lit(False))).alias("split"), F.count_if(F.trim(F.coalesce("image_path", F.lit(""))) == "").alias("path"), F.count_if(F.col("split") == "train").alias("train")).first()
        if bad["split"] or bad["path"] or not bad["train"]:
            raise ValueError(f"training rows are not usable: {bad.asDict()}")
    return out


SIDECAR = "image_id string, onh_xy_px array<double>, dorsal_xy_px array<double>, dorsal_unit_xy array<double>, um_per_px double, source string"


def read_frame_sidecars(sidecars: DataFrame, priority: str = "priority") -> DataFrame:
    """Frames from landmark documents (SIDECAR and a priority): a dorsal point, or a unit vector as a point 100 px away.

    Of several documents of an image the one of lowest priority number counts.
    """
    first = F.row_number().over(Window.partitionBy("image_id").orderBy(priority))
    one = sidecars.withColumn("__n", first).where("__n = 1").drop("__n")
    onh, unit, point = F.col("onh_xy_px"), F.col("dorsal_unit_xy"), F.col("dorsal_xy_px")
    dorsal = lambda i: F.coalesce(F.get(point, i), F.get(onh, i) + 100.0 * F.get(unit, i))
    return one.select("image_id", F.get(onh, 0).alias("onh_x_px"), F.get(onh, 1).alias("onh_y_px"), dorsal(0).alias("dorsal_x_px"), dorsal(1).alias("dorsal_y_px"), "um_per_px", F.coalesce("source", F.lit("sidecar")).alias("source"))


def load_subtypes(spec: Mapping[str, Mapping], axes: Sequence[str]) -> dict[str, Mapping]:
    """Checks subtype priors: known axes with priors, weights and scales above 0, markers with a feature and a centre, and
    names that stay apart as column names, under which the subtypes are returned."""
    names: dict[str, str] = {}
    for name, s in spec.items():
        plain = "".join(c if c.isalnum() else "_" for c in name.lower()).strip("_")
        if plain in names:
            raise ValueError(f"{name} and {names[plain]} give the same column name")
        names[plain] = name
        for axis, prior in (s.get("location_priors") or {}).items():
            if axis not in axes or not prior.get("priors") or prior.get("weight", 1.0) <= 0:
                raise ValueError(f"{name}: bad prior on {axis}")
        for m in s.get("markers") or ():
            if not m.get("feature") or m.get("center") is None or m.get("scale", 0.0) <= 0 or m.get("weight", 1.0) <= 0 or m.get("direction", "high") not in ("high", "low"):
                raise ValueError(f"{name}: bad marker {m}")
    return {plain: spec[name] for plain, name in names.items()}


def load_subtype_priors(document: Mapping, axes: Sequence[str]) -> dict:
    """A whole priors document of version 1: its fields and weights checked, ``subtypes`` as ``load_subtypes`` returns them."""
    if missing := [c for c in ("schema_version", "atlas_name", "subtypes") if c not in document]:
        raise ValueError(f"the subtype priors lack {missing}")
    weights = [float(document.get(c, default)) for c, default in SUBTYPE_WEIGHTS.items()]
    if int(document["schema_version"]) != 1 or not document["subtypes"] or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("the subtype priors need version 1, a subtype, and weights of which one is above 0")
    return {**document, "location_weight": weights[0], "marker_weight": weights[1], "subtypes": load_subtypes(document["subtypes"], axes)}


def load_calibration_grid(spark: SparkSession, document: Mapping) -> tuple[DataFrame, str]:
    """((config_id, params), selection metric): a row for each grid entry, its parameters as JSON text with sorted keys."""
    grid, metric = document.get("grid"), str(document.get("selection_metric", "mae")).lower()
    if not isinstance(grid, list) or not grid or metric not in SELECTION_METRICS:
        raise ValueError(f"a calibration grid needs a list of entries and one of the metrics {SELECTION_METRICS}")
    return spark.createDataFrame([(i, json.dumps(entry, sort_keys=True)) for i, entry in enumerate(grid, 1)], "config_id int, params string"), metric


# Names of version 1 rules and what they became in version 2.
OLD_MASKS = {"rgc_positive": ("RGC", "rgc_channel", "rgc_min_intensity"), "microglia": ("MICROGLIA", "microglia_channel", "microglia_min_intensity")}
OLD_LIMITS = {"min_area_px": ("geometry.area_px", "ge"), "max_area_px": ("geometry.area_px", "le"), "min_circularity": ("geometry.circularity", "ge")}
OLD_INTENSITY = 120.0


def load_phenotype_rules(document: Mapping) -> dict:
    """Class rules of version 2, with empty parts filled in; older documents are brought into that form."""
    if document.get("schema_version") == 2:
        return {"channels": {}, "compose": {}, "masks": {}, "classes": {}, **document}
    part = lambda name: document.get(name) or {}
    given = {mask: names for mask, names in OLD_MASKS.items() if part("channels").get(names[1]) is not None}
    touching = lambda mask: [{"feature": "relation.overlap_fraction", "target": mask, "op": "gt", "value": 0.0}] if mask in given else []
    limits = [{"feature": f, "op": op, "value": float(part("morphology_priors")[c])} for c, (f, op) in OLD_LIMITS.items() if part("morphology_priors").get(c) is not None]
    include = (touching("rgc_positive") if part("logic").get("require_rgc_positive", True) else []) + limits
    exclude = touching("microglia") if part("logic").get("exclude_microglia_overlap", True) else []
    classes = {"rgc": {"priority": 100, "include": include, "exclude": exclude}} if include or exclude else {}
    if "microglia" in given:
        classes["microglia"] = {"priority": 90, "include": touching("microglia"), "exclude": []}
    masks = {mask: {"channel": channel, "min_intensity": float(part("thresholds").get(limit, OLD_INTENSITY))} for mask, (channel, _, limit) in given.items()}
    return {"schema_version": 2, "source_schema_version": 1, "channels": {c: int(part("channels")[key]) for c, key, _ in given.values()}, "compose": {}, "masks": masks, "classes": classes}


def write_tables(frame: DataFrame, kind: str, path: str, by: Sequence[str] = ("image_id",), strict: bool = False) -> None:
    """A table in its contract's form as Parquet, partitioned; fails where the folder exists."""
    checked = enforce_contract(frame, kind, strict)
    checked.write.partitionBy(*[c for c in by if c in checked.columns]).parquet(path)


def write_documents(frame: DataFrame, path: str) -> None:
    """One JSON document a row."""
    frame.write.json(path)


def write_roi_points(points: DataFrame, path: str) -> DataFrame:
    """Points of each region as CSV in a folder of its own; returns the counts that go with them."""
    points.write.partitionBy("roi_id").option("header", True).csv(path)
    return points.groupBy("roi_id").agg(F.count(F.lit(1)).alias("n_points"))


