"""Benchmarks of configurations and models: summaries, gates, ranks, provenance and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.columns import messages

# Acceptance thresholds.
PRIMARY_TOLERANCE, TOLERANCES = 8.0, (6.0, 8.0, 10.0)
MIN_ROIS, MIN_F1, MIN_RECALL, MAE_SHARE = 20, 0.75, 0.75, 0.10
DEV_ROIS, EVAL_ROIS, DEV_SCORE, EVAL_SCORE, MOST_GAP = 4, 2, 0.60, 0.50, 0.15


def config_summary(results: DataFrame) -> DataFrame:
    """One ranked row a configuration: means at the primary tolerance (all rows where it has none), means at each
    tolerance, and whether it passes."""
    at = F.abs(F.col("tolerance") - PRIMARY_TOLERANCE) < 1e-9
    own = F.max(at).over(Window.partitionBy("config_id"))
    rows = results.withColumn("primary", at | ~own)
    only = lambda c: F.when(F.col("primary"), F.col(c))
    by_tolerance = [F.avg(F.when(F.abs(F.col("tolerance") - t) < 1e-9, F.col(c))).alias(f"{c}_mean_{t:.0f}px") for t in TOLERANCES if t != PRIMARY_TOLERANCE for c in ("f1", "recall")]
    summary = rows.groupBy("config_id").agg(F.countDistinct(only("roi_id")).alias("n_rois"), F.avg(only("f1")).alias("f1_mean"), F.avg(only("recall")).alias("recall_mean"), F.avg(only("count_mae")).alias("mae_mean"), F.percentile(only("n_manual"), 0.5).alias("median_manual"), *by_tolerance)
    passed = (F.col("n_rois") >= MIN_ROIS) & (F.col("f1_mean") >= MIN_F1) & (F.col("recall_mean") >= MIN_RECALL) & ((F.col("median_manual") <= 0) | (F.col("mae_mean") <= MAE_SHARE * F.col("median_manual")))
    return rank_configs(summary.withColumn("passed", F.coalesce(passed, F.lit(False))))


def rank_configs(summary: DataFrame, runtime: str | None = None) -> DataFrame:
    """Rank 1 has the highest F1, then recall, then the lowest MAE (and runtime), then the first id; nulls last."""
    order = [F.desc_nulls_last("f1_mean"), F.desc_nulls_last("recall_mean"), F.asc_nulls_last("mae_mean"), *([F.asc_nulls_last(runtime)] if runtime else []), F.asc("config_id")]
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def benchmark_summary(results: DataFrame) -> DataFrame:
    """The same over all rows at once, without a least number of regions."""
    s = results.agg(F.countDistinct("roi_id").alias("n_rois"), F.avg("f1").alias("f1_mean"), F.avg("recall").alias("recall_mean"), F.avg("count_mae").alias("mae_mean"), F.percentile("n_manual", 0.5).alias("median_manual"))
    return s.withColumn("passed", F.coalesce((F.col("f1_mean") >= MIN_F1) & (F.col("recall_mean") >= MIN_RECALL) & (F.col("mae_mean") <= MAE_SHARE * F.col("median_manual")), F.lit(False)))


def split_summary_gate(results: DataFrame, dev: str = "dev", locked: str = "locked_eval") -> DataFrame:
    """Means of each configuration on the development and the locked split, and whether both are good and close."""
    part = lambda c, s: F.when(F.col("split") == s, F.col(c))
    columns = [agg for s, n in ((dev, "dev"), (locked, "eval")) for agg in (F.countDistinct(part("roi_id", s)).alias(f"{n}_n"), F.avg(part("f1", s)).alias(f"{n}_f1"), F.avg(part("recall", s)).alias(f"{n}_recall"))]
    s = results.groupBy("config_id").agg(*columns)
    gate = (F.col("dev_n") >= DEV_ROIS) & (F.col("eval_n") >= EVAL_ROIS)
    for c in ("f1", "recall"):
        gate = gate & (F.col(f"dev_{c}") >= DEV_SCORE) & (F.col(f"eval_{c}") >= EVAL_SCORE) & (F.abs(F.col(f"dev_{c}") - F.col(f"eval_{c}")) <= MOST_GAP)
    return s.withColumn("passed", F.coalesce(gate, F.lit(False)))


def micro_ranking(summary: DataFrame) -> DataFrame:
    """Passed ones first, then by development F1 and recall, then by locked F1 and recall, then by id."""
    order = [F.desc("passed"), *[F.desc_nulls_last(c) for c in ("dev_f1", "dev_recall", "eval_f1", "eval_recall")], F.asc("config_id")]
    return summary.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def hardest_rois(results: DataFrame, n: int = 10) -> DataFrame:
    """The n regions of lowest F1, then highest count error."""
    return results.orderBy(F.asc_nulls_last("f1"), F.desc_nulls_last("count_mae"), "roi_id").limit(n)


def top_candidates(rows: DataFrame, by: str, order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each group; a quota."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)


def probe_summary(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each (configuration, region): count, mean and 90th percentile of scores; and means of these by configuration."""
    by_roi = points.groupBy("config_id", "roi_id").agg(F.count(F.lit(1)).alias("n_points"), F.avg("score").alias("mean_score"), F.percentile("score", 0.9).alias("p90_score"))
    return by_roi, by_roi.groupBy("config_id").agg(F.countDistinct("roi_id").alias("n_rois"), F.avg("n_points").alias("mean_points"), F.avg("mean_score").alias("mean_score"), F.avg("p90_score").alias("mean_p90"))


def rank_within_roi(by_roi: DataFrame) -> DataFrame:
    order = [F.desc("p90_score"), F.desc("mean_score"), F.asc("n_points"), F.asc("config_id")]
    return by_roi.withColumn("rank", F.row_number().over(Window.partitionBy("roi_id").orderBy(*order)))


def beats_baseline(summary: DataFrame, baseline: str) -> DataFrame:
    """True where F1 and recall are at least and MAE at most the baseline's; false for itself and without a baseline."""
    base = summary.where(F.col("config_id") == baseline).select(F.col("f1_mean").alias("b_f1"), F.col("recall_mean").alias("b_recall"), F.col("mae_mean").alias("b_mae")).limit(1)
    joined = summary.join(F.broadcast(base), F.lit(True), "left")
    beats = (F.col("config_id") != baseline) & (F.col("f1_mean") >= F.col("b_f1")) & (F.col("recall_mean") >= F.col("b_recall")) & (F.col("mae_mean") <= F.col("b_mae"))
    return joined.withColumn("beats", F.coalesce(beats, F.lit(False))).drop("b_f1", "b_recall", "b_mae")


def model_summary(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Runs, runs with an overlap reference, Dice, IoU and count errors of each model; null keys are groups."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.coalesce("has_overlap", F.lit(False))).alias("n_overlap_runs"), F.avg("dice").alias("mean_dice"), F.percentile("dice", 0.5).alias("median_dice"),
        F.avg("iou").alias("mean_iou"), F.avg(F.abs("count_bias")).alias("mae_count"), F.avg("count_bias").alias("mean_bias"), F.sqrt(F.avg(F.col("count_bias") * F.col("count_bias"))).alias("rmse_count"),
    )


def rank_models(summary: DataFrame, label: str) -> DataFrame:
    """By Dice (missing as -1), then MAE (missing as infinite), then label, where any run has an overlap reference; else by MAE."""
    any_overlap = F.max("n_overlap_runs").over(Window.partitionBy(F.lit(0))) > 0
    mae = F.coalesce("mae_count", F.lit(float("inf")))
    rows = summary.withColumns({"rule": F.when(any_overlap, "dice_then_mae").otherwise("mae_only"), "__dice": F.when(any_overlap, F.coalesce("mean_dice", F.lit(-1.0)))})
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__dice"), mae, label))).drop("__dice")


def run_metrics(runs: DataFrame) -> DataFrame:
    """Reference count of each run (label count, else manual), with bias and absolute error."""
    ref = F.coalesce("label_count", "manual_count")
    return runs.withColumns({"reference_count": ref, "count_bias": F.col("cell_count") - ref, "count_abs_error": F.abs(F.col("cell_count") - ref)})


def resolve_provenance(rows: DataFrame, fields: Sequence[str], marker: Column) -> DataFrame:
    """Each field from the manifest (m_), else the first sidecar (s_) that has it; conflicts are issues.

    invalid with any issue; matched where all fields are known; else unknown.
    """
    same = lambda c: F.lower(F.trim(c.cast("string")))
    resolved = {f: F.coalesce(F.col(f"m_{f}"), F.col(f"s_{f}")) for f in fields}
    issues = [(same(F.col(f"m_{f}")) != same(F.col(f"s_{f}")), f"conflict:{f}") for f in fields]
    issues += [(resolved["image_channel"] != resolved["truth_channel"], "channel_mismatch"), (same(resolved["truth_marker"]) != same(marker), "marker_mismatch")]
    out = rows.withColumn("issues", messages(*issues)).withColumns(resolved)
    known = F.lit(True)
    for f in fields:
        known = known & F.col(f).isNotNull()
    return out.withColumn("status", F.when(F.size("issues") > 0, "invalid").when(known, "matched").otherwise("unknown"))


def provenance_summary(rows: DataFrame) -> DataFrame:
    """invalid if any row is, matched if all are, else unknown; with counts and the distinct issues in order."""
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "invalid").alias("n_invalid"), F.count_if(F.col("status") == "matched").alias("n_matched"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("issues")))), ",").alias("issues"))
    return s.withColumn("status", F.when(F.col("n_invalid") > 0, "invalid").when((F.col("n") > 0) & (F.col("n_matched") == F.col("n")), "matched").otherwise("unknown"))


def roi_qc(rois: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Duplicate digests (nulls never are), reused sources, one marker throughout, overlaps, and whether anything blocks."""
    many = lambda c: F.when(F.col(c).isNull(), F.lit(False)).otherwise(F.count(F.lit(1)).over(Window.partitionBy(c)) > 1)
    hit = overlaps.select(F.col("roi_a").alias("roi_id")).unionByName(overlaps.select(F.col("roi_b").alias("roi_id"))).distinct().withColumn("overlaps", F.lit(True))
    q = rois.withColumns({"duplicate_crop": many("crop_digest"), "reused_source": many("image_digest")}).join(hit, "roi_id", "left").fillna({"overlaps": False})
    return q.withColumn("blocked", F.col("duplicate_crop") | F.col("overlaps") | ~F.col("in_bounds"))


def benchmark_gate_audit(rows: DataFrame) -> DataFrame:
    """The first reason why a benchmark doesn't count, or benchmark_passed."""
    reason = F.when(F.col("n_rois") < MIN_ROIS, "too_few_rois").when(~F.coalesce("truth_provenance_valid", F.lit(True)) | (F.col("truth_provenance_status") == "invalid"), "invalid_truth_provenance")
    reason = reason.when(~F.coalesce("matched_modality", F.lit(False)), "unmatched_modality").when(~F.coalesce("pass_threshold", F.lit(False)), "benchmark_failed_threshold").otherwise("benchmark_passed")
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason") == "benchmark_passed")


def count_consistency_audit(samples: DataFrame) -> DataFrame:
    """Samples with objects but no spatial points; nulls count as 0."""
    return samples.where((F.coalesce("cell_count", F.lit(0)) > 0) & (F.coalesce("spatial_points", F.lit(0)) <= 0))


def cross_source_consistency(values: DataFrame, key: str, value: str) -> DataFrame:
    """Whether all sources that know a count give the same one."""
    return values.groupBy(key).agg((F.countDistinct(value) <= 1).alias("consistent"), F.count(value).alias("n_sources"))


def curve_status_check(curves: DataFrame, status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Domains without any finite curve value; invalid where their status says ok or is missing."""
    finite = lambda c: F.count_if(F.col(c).isNotNull() & ~F.isnan(c))
    groups = curves.groupBy(*keys).agg(finite("l_obs").alias("n_l"), finite("g_obs").alias("n_g")).where("n_l = 0 and n_g = 0")
    joined = groups.join(status.select(*keys, "status"), list(keys), "left")
    return joined.withColumn("invalid", F.col("status").isNull() | (F.col("status") == "ok")).select(*keys, "status", "invalid")


def digest_reconcile(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Keys whose digests are missing, extra or different."""
    e, a = expected.select(key, F.col("digest").alias("__e")), actual.select(key, F.col("digest").alias("__a"))
    kind = F.when(F.col("__a").isNull(), "missing").when(F.col("__e").isNull(), "extra").when(F.col("__a") != F.col("__e"), "mismatch")
    return e.join(a, key, "full_outer").withColumn("issue", kind).where("issue is not null").select(key, "issue")


def unambiguous_top(channels: DataFrame, key: str) -> DataFrame:
    """Scores channels by text hints and wavelength, ranks them, and flags a single best one above 0."""
    text = F.lower(F.coalesce("name", F.lit("")))
    wave = F.col("wavelength")
    score = F.when(text.contains("far red") | text.contains("far-red") | text.contains("rbpms"), 100).otherwise(0) + F.when(text.contains("647") | text.contains("cy5"), 35).otherwise(0)
    score = score + F.when(wave.between(640, 680), 20).otherwise(0) + F.when(wave.between(620, 750), 15).otherwise(0)
    scored = channels.withColumn("score", score)
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "channel")))
    ties = F.count(F.lit(1)).over(Window.partitionBy(key, "score"))
    return scored.withColumn("unique_top", (F.col("rank") == 1) & (F.col("score") > 0) & (ties == 1))


def expand_config_grid(projections: DataFrame, preprocess: DataFrame, detectors: DataFrame) -> DataFrame:
    """Every combination of three small parameter tables (name, params), with an id of the names."""
    p, q, r = (F.broadcast(x.select(F.col("name").alias(n), F.col("params").alias(f"{n}_params"))) for x, n in ((projections, "projection"), (preprocess, "preprocess"), (detectors, "detector")))
    return p.crossJoin(q).crossJoin(r).withColumn("config_id", F.concat_ws("__", "projection", "preprocess", "detector"))


def _starts_with(prefix: str):
    return lambda word: word.startswith(prefix)


def score_paths(paths: DataFrame, path: str, keywords: Sequence[str], suffixes: Sequence[str]) -> DataFrame:
    """10 for each keyword a path has, 5 for a wanted suffix; phrases match as text, short words whole, others as prefixes."""
    low = F.lower(F.col(path))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    tests = []
    for k in keywords:
        test = low.contains(k) if " " in k else F.array_contains(words, k) if len(k) <= 3 else F.exists(words, _starts_with(k))
        tests.append((test, k))
    hits = messages(*tests)
    bonus = F.when(F.regexp_extract(low, r"\.([a-z0-9]+)$", 1).isin(list(suffixes)), 5).otherwise(0)
    return paths.withColumns({"reasons": hits, "score": (F.size(hits) * 10 + bonus).cast("bigint")})
