"""File inventories and image metadata documents as flat rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.operators.numbering import numbered

# The shape of a metadata document.
METADATA = """stem string, path string, source_sha256 string, size_bytes bigint,
metadata struct<image: struct<RecordingDate: string, LensPower: string, Unit: string, X: string, Y: string, Z: string>, n_channels: bigint,
    voxel_sizes_um: struct<voxel_x_um: double, voxel_y_um: double, voxel_z_um: double>>,
candidate_rbpms_channels array<struct<channel_index: bigint, score: double, reason: string, is_unambiguous_top_candidate: boolean>>,
scene struct<scene_groups: array<string>, annotation_candidates: array<struct<path: string>>>"""
# Condition -> parts of a path that name it, in order of precedence.
CONDITIONS = {"normoxic": ("norm", "healthy"), "oir": ("oir",)}


def classify_condition(path: Column, conditions: Mapping[str, Sequence[str]] = CONDITIONS) -> Column:
    """(condition, basis): the first condition one of whose parts is in the lower-cased path, else unknown and unresolved."""
    low = F.lower(F.coalesce(path, F.lit("")))
    found = F.coalesce(*[F.when(low.contains(part), F.lit(name)) for name, parts in conditions.items() for part in parts])
    return F.struct(F.coalesce(found, F.lit("unknown")).alias("condition"), F.when(found.isNull(), "unresolved").otherwise("path_token").alias("basis"))


def flatten_metadata(documents: DataFrame, text: str) -> DataFrame:
    """An inventory row for each metadata document, read from JSON text; other columns stay.

    What a document lacks is null, but the flags are false and the number of annotation candidates 0; text that is no
    document gives a row of these. The top candidate is the first one listed.
    """
    m = F.col("__doc.metadata")
    top = F.get("__doc.candidate_rbpms_channels", 0)
    many = lambda c: F.coalesce(F.size(F.coalesce(c, F.array())), F.lit(0)).cast("bigint")
    flat = {
        "stem": F.col("__doc.stem"), "source_path": F.col("__doc.path"), "source_sha256": F.col("__doc.source_sha256"), "size_bytes": F.col("__doc.size_bytes"),
        "recording_date": m["image"]["RecordingDate"], "lens_power": m["image"]["LensPower"], "unit": m["image"]["Unit"],
        **{f"size_{a.lower()}": m["image"][a].try_cast("bigint") for a in "XYZ"}, "n_channels": m["n_channels"],
        **{f"voxel_{a}_um": m["voxel_sizes_um"][f"voxel_{a}_um"] for a in "xyz"},
        "has_scene": many(F.col("__doc.scene.scene_groups")) > 0, "scene_annotation_candidates": many(F.col("__doc.scene.annotation_candidates")),
        "top_candidate_channel_index": top["channel_index"], "top_candidate_score": top["score"], "top_candidate_reason": top["reason"],
        "top_candidate_unambiguous": F.coalesce(top["is_unambiguous_top_candidate"], F.lit(False)),
    }
    read = documents.withColumn("__doc", F.from_json(text, METADATA))
    return read.select(*[c for c in documents.columns if c != text and c not in flat], *[v.alias(k) for k, v in flat.items()])


def annotation_rows(documents: DataFrame, text: str) -> DataFrame:
    """A scored row for each annotation candidate of each metadata document; other columns stay."""
    read = documents.withColumn("__doc", F.from_json(text, METADATA))
    rows = read.withColumn("__at", F.explode("__doc.scene.annotation_candidates"))
    return rows.select(
        *[c for c in documents.columns if c != text], F.concat(F.coalesce("__doc.path", F.lit("")), F.lit("::"), F.coalesce("__at.path", F.lit(""))).alias("path"), F.lit(".ims").alias("suffix"),
        F.lit(100).cast("bigint").alias("score"), F.lit("embedded_same_image_point_truth").alias("classification"), F.lit("embedded_scene_annotation_candidate").alias("reasons"),
    )


def derive_manifest(
    files: DataFrame, order: Sequence[Column], constants: Mapping[str, object], pattern: str = "S%02d", kinds: tuple[str, str] = ("whole_retina_candidate", "roi_or_unknown"), whole_px: int = 1500
) -> DataFrame:
    """A study manifest of image files (height, width): ids numbered in ``order``, constant columns, and the kind by the shorter side."""
    n = numbered(files, order, "__n")
    shorter = F.least("height", "width")
    filled = n.withColumns({"sample_id": F.format_string(pattern, "__n"), "kind": F.when(shorter >= whole_px, kinds[0]).otherwise(kinds[1]), **{c: F.lit(v) for c, v in constants.items()}})
    return filled.drop("__n")
