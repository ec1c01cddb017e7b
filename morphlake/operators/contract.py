"""Table contracts: required columns and types, defaults, and image ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions.columns import file_name

SCHEMA_VERSION = "1.0.0"
OBJECT_TABLE_VERSION = 2
# Required columns of each kind of table and their types.
REQUIRED = {
    "object": {"schema_version": "string", "table_kind": "string", "image_id": "string", "object_id": "bigint", "centroid_x_px": "double", "centroid_y_px": "double", "area_px": "bigint", "phenotype": "string", "kept": "boolean"},
    "region": {"schema_version": "string", "table_kind": "string", "image_id": "string", "region_schema": "string", "region_axis": "string", "region_label": "string", "area_mm2": "double", "object_count": "bigint", "density_cells_per_mm2": "double"},
    "study": {"schema_version": "string", "table_kind": "string", "sample_id": "string", "animal_id": "string", "eye": "string", "condition": "string", "timepoint_dpi": "double", "cell_count": "double", "density_cells_per_mm2": "double"},
}
_SCHEMA_NAMES = ("region_schema", "retina_region_schema")


def image_id(frame: DataFrame):
    """The id column if there is one, else the file's name without its last extension, else the sample, else ''."""
    if "image_id" in frame.columns:
        return F.col("image_id").cast("string")
    for c in ("filename", "source_path"):
        if c in frame.columns:
            return F.regexp_replace(file_name(F.col(c)), r"\.[^.]*$", "")
    return F.col("sample_id").cast("string") if "sample_id" in frame.columns else F.lit("")


def enforce_contract(frame: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """``frame`` with every required column of its kind first, typed; unknown columns are kept behind them.

    strict: a missing column is an error and so is a value that doesn't fit its type (when the rows are read); else both
    become null. Types that can't be read apply value by value, not column by column.
    """
    required, has = REQUIRED[kind], set(frame.columns)
    filled = {"schema_version": F.lit(SCHEMA_VERSION), "table_kind": F.lit(kind)}
    if kind != "study":
        filled["image_id"] = image_id(frame)
        for name, other in (_SCHEMA_NAMES, _SCHEMA_NAMES[::-1]):
            if name not in has and other in has and (kind == "region" or name == "region_schema"):
                filled[name] = F.col(other)
    if kind == "object":
        for name, value in (("kept", True), ("phenotype", "unclassified"), ("object_table_version", OBJECT_TABLE_VERSION)):
            if name not in has:
                filled[name] = F.lit(value)
    out = frame.withColumns(filled)
    missing = [c for c in required if c not in out.columns]
    if missing and strict:
        raise ValueError(f"{kind} table lacks {missing}")
    q = lambda c: F.col(f"`{c}`")
    typed = [(F.lit(None).cast(t) if c in missing else q(c).cast(t) if strict else q(c).cast("string").try_cast(t) if t != "string" else q(c).cast(t)).alias(c) for c, t in required.items()]
    return out.select(*typed, *[q(c) for c in out.columns if c not in required])
