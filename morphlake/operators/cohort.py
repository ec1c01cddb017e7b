"""Sample and region tables of a study: joins with the manifest, reference densities, validation and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.columns import messages, ratio


def phenotype_counts(objects: DataFrame, key: str, classes: Sequence[str], column: str = "phenotype") -> DataFrame:
    """A column phenotype_count_<class> for each class; nulls are counted nowhere."""
    return objects.groupBy(key).pivot(column, list(classes)).count().fillna(0).withColumnsRenamed({c: f"phenotype_count_{c}" for c in classes})


def object_flow(objects: DataFrame, key: str) -> DataFrame:
    """Objects of each image along the pipeline: all, of usable size, kept, in focus, and used for spatial statistics."""
    kept = F.coalesce("kept", F.lit(True))
    return objects.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_raw"), F.count_if(F.col("area_px").between(50, 450)).alias("n_sized"), F.count_if(kept).alias("n_kept"),
        F.count_if(F.col("focus_overlap") > 0).alias("n_in_focus"), F.count_if(kept & F.col("centroid_x_px").isNotNull() & F.col("centroid_y_px").isNotNull()).alias("n_spatial"),
    )


def build_sample_table(manifest: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """The manifest with each sample's image summary; what the summary has replaces manifest columns of the same name."""
    both = [c for c in summary.columns if c in manifest.columns and c != key]
    renamed = summary.withColumnsRenamed({c: f"__{c}" for c in both})
    joined = manifest.join(renamed, key)
    return joined.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in both}).drop(*[f"__{c}" for c in both]) if both else joined


def build_region_study(manifest: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Region rows with the manifest's columns, which replace their own; images without regions don't appear."""
    return regions.drop(*[c for c in manifest.columns if c in regions.columns and c != key]).join(manifest, key)


def merge_manual_counts(manifest: DataFrame, manual: DataFrame, key: str = "sample_id") -> DataFrame:
    """Left join; expected_total_objects is the manual count where there is one."""
    joined = manifest.join(manual.select(key, "manual_count"), key, "left")
    expected = F.col("expected_total_objects") if "expected_total_objects" in manifest.columns else F.lit(None).cast("double")
    return joined.withColumn("expected_total_objects", F.coalesce(F.col("manual_count").cast("double"), expected))


def compare_to_reference(regions: DataFrame, reference: DataFrame) -> DataFrame:
    """Observed against expected densities: difference, fold change and z-score (null where the divisor is 0).

    Axis, label and, where any reference has one, schema are matched null-safely; unmatched regions are left out.
    """
    keys = ["region_axis", "region_label"]
    if reference.where("region_schema is not null").limit(1).count():
        keys.append("region_schema")
    ref = reference.select(*[F.col(k).alias(f"__{k}") for k in keys], "atlas_name", "expected_density", "expected_sd").where("expected_density is not null")
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = regions.join(ref, on).drop(*[f"__{k}" for k in keys])
    delta = F.col("density_cells_per_mm2") - F.col("expected_density")
    return joined.withColumns({"delta": delta, "fold_change": ratio(F.col("density_cells_per_mm2"), F.col("expected_density")), "zscore": ratio(delta, F.col("expected_sd"))})


def reference_deviation_summary(comparison: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean absolute difference, mean fold change and mean absolute z-score of each group; null keys are groups."""
    return comparison.groupBy(*by).agg(F.count(F.lit(1)).alias("n_regions"), F.avg(F.abs("delta")).alias("mean_abs_delta"), F.avg("fold_change").alias("mean_fold_change"), F.avg(F.abs("zscore")).alias("mean_abs_zscore"))


def design_audit(samples: DataFrame, regions: DataFrame) -> DataFrame:
    """(category, key, value) rows that describe a study's design; a null key is the text None."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    eye = F.concat_ws(":", text("animal_id"), text("eye"))
    row = lambda frame, category, key, value: frame.groupBy(key.alias("key")).agg(value.alias("value")).select(F.lit(category).alias("category"), "key", F.col("value").cast("bigint").alias("value"))
    parts = [
        row(samples, "animals_per_condition", text("condition"), F.countDistinct("animal_id")),
        row(samples, "eyes_per_animal", text("animal_id"), F.countDistinct("eye")),
        row(samples, "samples_per_eye", eye, F.count(F.lit(1))),
        row(samples, "timepoints_per_animal_eye", eye, F.countDistinct("timepoint_dpi")),
        row(regions, "regions_per_sample", text("sample_id"), F.countDistinct(F.concat_ws(":", "region_axis", "region_label"))),
    ]
    for category, frame, columns in (
        ("missingness_sample", samples, ("sample_id", "animal_id", "eye", "condition", "timepoint_dpi", "cell_count", "density_cells_per_mm2")),
        ("missingness_region", regions, ("sample_id", "animal_id", "condition", "region_axis", "region_label", "density_cells_per_mm2")),
    ):
        there = [c for c in columns if c in frame.columns]
        counts = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in there])
        parts.append(counts.unpivot([], there, "key", "value").select(F.lit(category).alias("category"), "key", "value"))
    return reduce(DataFrame.unionByName, parts)


def design_eligibility(samples: DataFrame, outcome: str) -> DataFrame:
    """One row: whether a mixed model of the samples makes sense, and the kinds of repetition found."""
    rows = samples.where(F.col(outcome).isNotNull() & F.col("animal_id").isNotNull() & F.col("condition").isNotNull())
    per_animal = rows.groupBy("animal_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("eye").alias("eyes"), F.countDistinct("timepoint_dpi").alias("times"))
    whole = rows.agg(F.countDistinct(F.col("condition").cast("string")).alias("n_conditions"))
    most = per_animal.agg(F.count(F.lit(1)).alias("n_animals"), F.max("n").alias("n"), F.max("eyes").alias("eyes"), F.max("times").alias("times")).join(whole)
    found = messages((F.col("n") > F.col("n_conditions"), "samples"), (F.col("eyes") > 1, "eyes"), (F.col("times") > 1, "timepoints"))
    return most.select("n_animals", "n_conditions", ((F.col("n_animals") >= 2) & (F.col("n_conditions") >= 2) & (F.size(found) > 0)).alias("eligible"), F.array_join(found, ",").alias("repeated"))


def region_eligibility(regions: DataFrame, outcome: str) -> DataFrame:
    """One row: at least two animals and conditions, and several region rows in some sample."""
    needed = [outcome, "animal_id", "condition", "region_axis", "region_label"]
    rows = regions.dropna(subset=needed)
    most = rows.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most_rows"))
    whole = rows.agg(F.countDistinct("animal_id").alias("n_animals"), F.countDistinct("condition").alias("n_conditions")).join(most)
    return whole.withColumn("eligible", (F.col("n_animals") >= 2) & (F.col("n_conditions") >= 2) & (F.col("most_rows") > 1))


def group_means(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means by group, null keys kept."""
    return rows.groupBy(*by).agg(*[F.avg(v).alias(f"mean_{v}") for v in values])


def mean_matrix(rows: DataFrame, row: str, column: str, columns: Sequence[str], value: str) -> DataFrame:
    """Means in rows by columns; nulls become 0 and rows of zeros go."""
    wide = rows.groupBy(row).pivot(column, list(columns)).agg(F.avg(value)).fillna(0.0)
    return wide.where(sum((F.abs(F.col(c)) for c in columns), F.lit(0.0)) > 0)


def paired_pivot(samples: DataFrame, outcome: str, a: str, b: str) -> DataFrame:
    """Mean outcome of each animal under both conditions; animals without either are left out."""
    return samples.where(F.col("animal_id").isNotNull()).groupBy("animal_id").pivot("condition", [a, b]).agg(F.avg(outcome)).dropna(subset=[a, b])


def validation_table(samples: DataFrame) -> DataFrame:
    """Samples with a reference count, taken from the label image, else the manual count, else the expected total.

    A label count and a manual count that differ raise when the rows are read; samples without reference are left out.
    """
    label, manual = F.col("label_count").cast("double"), F.col("manual_count").cast("double")
    conflict = F.coalesce(F.abs(label - manual) > 1e-6, F.lit(False))
    reference = F.when(conflict, F.raise_error(F.concat(F.lit("references differ for sample "), F.col("sample_id").cast("string"))).cast("double")).otherwise(F.coalesce(label, manual, F.col("expected_total_objects").cast("double")))
    source = F.when(label.isNotNull(), "label_path").when(manual.isNotNull(), "manual_count").otherwise("expected_total_objects")
    out = samples.withColumns({"validation_source": source, "reference_count": reference}).where("reference_count is not null")
    return out.withColumns({"count_bias": F.col("cell_count") - F.col("reference_count"), "count_abs_error": F.abs(F.col("cell_count") - F.col("reference_count"))})


def _correlation(n: Column, x: Column, y: Column) -> Column:
    """Pearson's r from moments around 0; null for fewer than two rows or a constant side."""
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((n >= 2) & (vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))))


def agreement_summary(rows: DataFrame, predicted: str, reference: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bias, MAE, RMSE, Pearson's r and ICC(2,1) from one pass over sums."""
    x, y = F.col(predicted).cast("double"), F.col(reference).cast("double")
    n = F.count(F.lit(1)).cast("double")
    grand = (F.sum(x) + F.sum(y)) / (2 * n)
    targets = F.sum((x + y) * (x + y)) / 2 - 2 * n * grand * grand
    raters = (F.sum(x) * F.sum(x) + F.sum(y) * F.sum(y)) / n - 2 * n * grand * grand
    total = F.sum(x * x) + F.sum(y * y) - 2 * n * grand * grand
    msr, msc, mse = targets / F.greatest(n - 1, F.lit(1.0)), raters, (total - targets - raters) / F.greatest(n - 1, F.lit(1.0))
    below = msr + mse + 2 * (msc - mse) / n
    icc = F.when((n >= 2) & (F.abs(below) > 1e-12), F.try_divide(msr - mse, below))
    grouped = rows.groupBy(*by) if by else rows
    return grouped.agg(F.count(F.lit(1)).alias("n_samples"), F.avg(x - y).alias("mean_bias"), F.avg(F.abs(x - y)).alias("mae"), F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), _correlation(n, x, y).alias("pearson_r"), icc.alias("icc_2_1"))


def bland_altman(rows: DataFrame, predicted: str, reference: str, key: str) -> DataFrame:
    """Mean and difference of each row, with the bias and its limits at 1.96 sample standard deviations (0 for one row)."""
    diff = F.col(predicted) - F.col(reference)
    limits = rows.agg(F.avg(diff).alias("bias"), F.coalesce(F.stddev_samp(diff), F.lit(0.0)).alias("sd")).select("bias", (F.col("bias") - 1.96 * F.col("sd")).alias("lower"), (F.col("bias") + 1.96 * F.col("sd")).alias("upper"))
    return rows.select(key, ((F.col(predicted) + F.col(reference)) / 2).alias("mean"), diff.alias("difference")).join(F.broadcast(limits))


def count_agreement(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, MAE, signed bias, mean percentage error (divisor at least 1) and correlation over rows with a manual count."""
    x, y = F.col("cell_count").cast("double"), F.col("manual_count").cast("double")
    known = rows.where("manual_count is not null")
    grouped = known.groupBy(*by) if by else known
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(x - y)).alias("mae"), F.avg(x - y).alias("bias"), F.avg(F.abs(x - y) / F.greatest(y, F.lit(1.0)) * 100).alias("mape"), _correlation(F.count(F.lit(1)).cast("double"), x, y).alias("corr"))


def rank_grid(results: DataFrame, metric: str) -> DataFrame:
    """Rank 1 is best: highest correlation, or lowest signed value of any other metric; then lowest MAE; nulls last."""
    first = F.desc_nulls_last(metric) if metric == "corr" else F.asc_nulls_last(metric)
    return results.withColumn("rank", F.row_number().over(Window.orderBy(first, F.asc_nulls_last("mae"), "params")))


def calibrate_grid(objects: DataFrame, manual: DataFrame, grid: Sequence[Mapping[str, float]], metric: str = "mae") -> DataFrame:
    """Every parameter set applied to every object in one pass, counted by sample, compared with manual counts, ranked.

    grid: sets of bounds min_area_px, max_area_px, min_circularity; set i is called params i.
    """
    fits = []
    for i, p in enumerate(grid):
        inside = (F.col("area_px") >= p.get("min_area_px", 0)) & (F.col("area_px") <= p.get("max_area_px", 1 << 40)) & (F.col("circularity") >= p.get("min_circularity", 0.0))
        fits.append(F.count_if(inside).alias(f"{i}"))
    wide = objects.groupBy(F.col("image_no").alias("sample_id")).agg(*fits)
    counts = wide.unpivot("sample_id", [str(i) for i in range(len(grid))], "params", "cell_count").withColumn("params", F.col("params").cast("int"))
    return rank_grid(count_agreement(counts.join(manual.select("sample_id", "manual_count"), "sample_id"), ["params"]), metric)


def run_warnings(samples: DataFrame, mae: Column, most: float = 1.0) -> DataFrame:
    """One row with the warnings of a run, in a fixed order."""
    count, points = F.coalesce("cell_count", F.lit(0)), F.coalesce("spatial_points", F.lit(0))
    found = samples.agg((F.sum(count) == 0).alias("zero"), F.bool_or((count > 0) & (points <= 0)).alias("mismatch"), F.bool_or((points > 0) & ~F.coalesce("curve_valid", F.lit(False))).alias("curves"), mae.alias("mae"))
    return found.select(messages((F.col("zero"), "no_objects"), (F.col("mismatch"), "counts_without_points"), (F.col("curves"), "points_without_curves"), (F.col("mae") > most, "mae_over_threshold")).alias("warnings"))


def image_warnings(images: DataFrame, key: str) -> DataFrame:
    """Warnings of each image, their number and their text."""
    w = F.array_distinct(messages((F.least("height", "width") < 2, "degenerate_shape"), (F.col("coverage") < 0.01, "low_coverage"), (F.col("n_points") < 3, "few_points"), (~F.coalesce("curve_valid", F.lit(False)), "no_finite_curve")))
    return images.select(key, F.size(w).alias("warning_count"), F.array_join(w, "; ").alias("warnings_text"))


def evidence_flags(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    """Run-level any-of flags, with the registered and the fallback pairs counted."""
    a = samples.agg(F.bool_or("registered").alias("any_registered"), F.bool_or("curve_valid").alias("any_curve"))
    return a.join(pairs.agg(F.count_if(F.col("status") == "registered").alias("registered_pairs"), F.count_if(F.col("status").startswith("fallback")).alias("fallback_pairs")))


def registration_completeness(samples: DataFrame, flags: Sequence[str], key: str) -> DataFrame:
    """Sample rows of 0/1 flags, and a last row, named summary, of their means."""
    rows = samples.select(F.col(key).cast("string").alias(key), *[F.col(f).cast("double").alias(f) for f in flags])
    return rows.unionByName(rows.agg(*[F.avg(f).alias(f) for f in flags]).withColumn(key, F.lit("summary")))


def subtype_summary(objects: DataFrame, subtypes: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Count, share and mean probability of each subtype in each group."""
    parts = [F.struct(F.lit(s).alias("subtype"), F.col(f"n_{s}").alias("top1_count"), (F.col(f"n_{s}") / F.col("n")).alias("top1_fraction"), F.col(f"p_{s}").alias("mean_probability")) for s in subtypes]
    grouped = objects.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("top1") == s).alias(f"n_{s}") for s in subtypes], *[F.avg(f"prob_{s}").alias(f"p_{s}") for s in subtypes])
    return grouped.select(*by, F.inline(F.array(*parts)))
