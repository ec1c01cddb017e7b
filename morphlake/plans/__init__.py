"""Registered queries of the object-table operators: name -> (query, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FAMILIES = ("region_queries", "cohort_queries", "evaluation_queries", "spatial_queries", "pixel_queries", "tile_queries")


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}
    for family in FAMILIES:
        out |= import_module(f"{__name__}.{family}").QUERIES
    return out


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects registered, labelled by region, and summarised over the tissue of each image."""
    return registered()["a6_region_summary"][0](spark, sf_dir)
