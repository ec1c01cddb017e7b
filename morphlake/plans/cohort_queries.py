"""Queries on sample and region tables, validation and calibration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphlake.operators import cohort, neighbors
from morphlake.plans.region_queries import labelled
from morphlake.plans import region_queries as rq
from morphlake.sources import bindings as b
from morphlake.sources.bindings import with_tables

R = lambda c, n=6: F.round(c, n).alias(c)
CLASSES = ("A", "N", "R")


def _summary(spark, d):
    o = b.objects(spark, d)
    counts = cohort.phenotype_counts(o, "image_no", CLASSES)
    base = o.groupBy("image_no").agg(F.count(F.lit(1)).alias("n_objects"), F.count_if("kept").alias("cell_count"), F.lit("measured").alias("genotype"))
    return base.join(counts, "image_no").withColumnRenamed("image_no", "sample_id")


def _samples(spark, d):
    o = b.objects(spark, d).groupBy(F.col("image_no").alias("sample_id")).agg(F.count_if("kept").cast("double").alias("cell_count"))
    dense = o.withColumn("density_cells_per_mm2", F.when(F.col("sample_id") % 9 != 0, F.col("cell_count") / 2))
    return b.manifest(spark, d).join(dense, "sample_id")


_SAMPLES = "samples as (select m.*, c.cell_count, case when sample_id % 9 <> 0 then c.cell_count / 2 end as density_cells_per_mm2 from manifest m join (select image_no as sample_id, cast(count(*) filter (kept) as double) as cell_count from objects group by 1) c using (sample_id))"


def _regions(spark, d):
    rows = labelled(spark, d).groupBy(F.col("image_no").alias("sample_id"), F.lit("ring").alias("region_axis"), F.col("ring").alias("region_label")).agg(F.count(F.lit(1)).cast("double").alias("object_count"))
    return rows.withColumn("density_cells_per_mm2", F.col("object_count") / 0.05)


_REGIONS = rq._REG + ", regions as (select image_no as sample_id, 'ring' as region_axis, ring as region_label, cast(count(*) as double) as object_count, count(*) / 0.05 as density_cells_per_mm2 from labelled group by 1, 2, 3)"


def _reference(spark):
    rows = [("book", None, "ring", "central", 2000.0, 100.0), ("book", None, "ring", "pericentral", 5000.0, 0.0), ("book", None, "ring", None, 10.0, 1.0), ("other", None, "ring", "peripheral", 0.0, 2.0)]
    return spark.createDataFrame(rows, "atlas_name string, region_schema string, region_axis string, region_label string, expected_density double, expected_sd double")


_REFERENCE = "ref as (select * from (values ('book','ring','central',2000.0::double,100.0::double),('book','ring','pericentral',5000.0,0.0),('other','ring','peripheral',0.0,2.0)) v(atlas_name, region_axis, region_label, expected_density, expected_sd))"
_CMP = ", cmp as (select r.*, atlas_name, expected_density, density_cells_per_mm2 - expected_density as delta, density_cells_per_mm2 / nullif(expected_density, 0) as fold_change, (density_cells_per_mm2 - expected_density) / nullif(expected_sd, 0) as zscore from regions r join ref using (region_axis, region_label))"


def a8_phenotype_counts(spark, d):
    return cohort.phenotype_counts(b.objects(spark, d), "image_no", CLASSES)


def a9_object_flow(spark, d):
    return cohort.object_flow(b.objects(spark, d).withColumn("focus_overlap", F.col("l_discount")), "image_no")


def j1_build_sample_table(spark, d):
    return cohort.build_sample_table(b.manifest(spark, d), _summary(spark, d), "sample_id").select("sample_id", "animal_id", "eye", "condition", "genotype", "n_objects", "cell_count", *[f"phenotype_count_{c}" for c in CLASSES])


def j2_build_region_study(spark, d):
    return cohort.build_region_study(b.manifest(spark, d).select("sample_id", "animal_id", "condition"), _regions(spark, d), "sample_id").select("sample_id", "region_label", "animal_id", "condition", "object_count")


def j3_merge_manual_counts(spark, d):
    manual = b.manual(spark, d).where("sample_id % 3 <> 0")
    m = b.manifest(spark, d).withColumn("expected_total_objects", F.when(F.col("sample_id") % 2 == 0, F.lit(500.0)))
    return cohort.merge_manual_counts(m, manual).select("sample_id", "manual_count", "expected_total_objects")


def j4_compare_to_reference(spark, d):
    return cohort.compare_to_reference(_regions(spark, d), _reference(spark)).select("sample_id", "region_label", "atlas_name", R("delta"), R("fold_change"), R("zscore"))


def c10_reference_deviation_summary(spark, d):
    c = cohort.compare_to_reference(_regions(spark, d), _reference(spark)).join(b.manifest(spark, d).select("sample_id", "condition"), "sample_id")
    return cohort.reference_deviation_summary(c, ["atlas_name", "condition"]).select("atlas_name", "condition", "n_regions", R("mean_abs_delta"), R("mean_fold_change"), R("mean_abs_zscore"))


def c5_design_audit(spark, d):
    regions = _regions(spark, d).join(b.manifest(spark, d).select("sample_id", "animal_id", "condition"), "sample_id")
    return cohort.design_audit(_samples(spark, d), regions)


def c6_design_eligibility(spark, d):
    return cohort.design_eligibility(_samples(spark, d), "cell_count")


def c6_region_eligibility(spark, d):
    regions = _regions(spark, d).join(b.manifest(spark, d).select("sample_id", "animal_id", "condition"), "sample_id")
    return cohort.region_eligibility(regions, "density_cells_per_mm2")


def c1_paired_pivot(spark, d):
    return cohort.paired_pivot(_samples(spark, d), "cell_count", "control", "treated").select("animal_id", R("control"), R("treated"))


def c9_group_means(spark, d):
    return cohort.group_means(_samples(spark, d), ["condition", "timepoint_dpi"], ["cell_count", "density_cells_per_mm2"]).select("condition", "timepoint_dpi", R("mean_cell_count"), R("mean_density_cells_per_mm2"))


def c9_mean_matrix(spark, d):
    rows = _regions(spark, d).join(b.manifest(spark, d).select("sample_id", "condition"), "sample_id")
    return cohort.mean_matrix(rows, "region_label", "condition", ["control", "treated"], "density_cells_per_mm2").select("region_label", R("control"), R("treated"))


def _validation(spark, d):
    m = b.manual(spark, d).withColumns({"label_count": F.when(F.col("sample_id") % 4 == 0, F.col("manual_count")), "expected_total_objects": F.when(F.col("sample_id") % 5 == 0, F.lit(300))})
    return cohort.validation_table(m.withColumn("manual_count", F.when(F.col("sample_id") % 3 != 0, F.col("manual_count"))))


_VALID = "v as (select sample_id, cell_count, case when sample_id % 4 = 0 then manual_count end as l, case when sample_id % 3 <> 0 then manual_count end as m, case when sample_id % 5 = 0 then 300 end as e from manual), val as (select sample_id, cast(cell_count as double) as x, cast(coalesce(l, m, e) as double) as y, case when l is not null then 'label_path' when m is not null then 'manual_count' else 'expected_total_objects' end as validation_source from v where coalesce(l, m, e) is not null)"
_AGREE = """+ {valid}, s as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x*x) as sxx, sum(y*y) as syy, sum(x*y) as sxy, avg(x-y) as mean_bias, avg(abs(x-y)) as mae, sqrt(avg((x-y)*(x-y))) as rmse, corr(x, y) as r, sum((x+y)*(x+y)) as st from val),
 g as (select *, (sx+sy)/(2*n) as m from s), t as (select *, st/2 - 2*n*m*m as ta, (sx*sx+sy*sy)/n - 2*n*m*m as ra, sxx+syy-2*n*m*m as tot from g), q as (select *, ta/(n-1) as msr, ra as msc, (tot-ta-ra)/(n-1) as mse from t)
 select n as n_samples, round(mean_bias, 6) as mean_bias, round(mae, 6) as mae, round(rmse, 6) as rmse, round(r, 6) as pearson_r, round((msr-mse)/(msr+mse+2*(msc-mse)/n), 6) as icc_2_1 from q"""


def c13_validation_table(spark, d):
    return _validation(spark, d).select("sample_id", "validation_source", "reference_count", F.col("count_bias").cast("double").alias("count_bias"), F.col("count_abs_error").cast("double").alias("count_abs_error"))


def c14_agreement_summary(spark, d):
    return cohort.agreement_summary(_validation(spark, d), "cell_count", "reference_count").select("n_samples", R("mean_bias"), R("mae"), R("rmse"), R("pearson_r"), R("icc_2_1"))


def c15_bland_altman(spark, d):
    return cohort.bland_altman(_validation(spark, d), "cell_count", "reference_count", "sample_id").select("sample_id", "mean", "difference", R("bias"), R("lower"), R("upper"))


def c16_count_agreement(spark, d):
    return cohort.count_agreement(b.manual(spark, d)).select("n", R("mae"), R("bias"), R("mape"), R("corr"))


GRID = ({"min_area_px": 50}, {"min_area_px": 100, "max_area_px": 400}, {"min_circularity": 0.3}, {"max_area_px": 300}, {"min_area_px": 200, "min_circularity": 0.5})


def c17_calibrate_grid(spark, d):
    return cohort.calibrate_grid(b.objects(spark, d), b.manual(spark, d), GRID, "bias").select("params", "n", R("mae"), R("bias"), R("mape"), R("corr"), "rank")


def _flags(spark, d):
    o = b.manual(spark, d)
    return o.withColumns({"spatial_points": F.when(F.col("sample_id") % 7 == 0, 0).otherwise(F.col("cell_count")), "curve_valid": F.when(F.col("sample_id") % 6 != 0, F.col("sample_id") % 5 != 0), "registered": F.col("sample_id") % 4 == 0})


def c18_run_warnings(spark, d):
    w = cohort.run_warnings(_flags(spark, d), F.avg(F.abs(F.col("cell_count") - F.col("manual_count"))))
    return w.select(F.array_join("warnings", ",").alias("warnings"))


def c19_registration_completeness(spark, d):
    rows = _flags(spark, d).select("sample_id", "registered", F.coalesce("curve_valid", F.lit(False)).alias("curve_valid"))
    return cohort.registration_completeness(rows, ["registered", "curve_valid"], "sample_id").select("sample_id", R("registered"), R("curve_valid"))


def c20_image_warnings(spark, d):
    o = _flags(spark, d).withColumns({"height": F.when(F.col("sample_id") % 11 == 0, 1).otherwise(64), "width": F.lit(64), "coverage": F.col("sample_id") % 13 / 100.0, "n_points": F.col("sample_id") % 8})
    return cohort.image_warnings(o, "sample_id")


def c21_evidence_flags(spark, d):
    pairs = _flags(spark, d).select(F.when(F.col("registered"), "registered").when(F.col("sample_id") % 3 == 0, "fallback_no_improvement").otherwise("raw").alias("status"))
    return cohort.evidence_flags(_flags(spark, d), pairs)


def c12_subtype_summary(spark, d):
    o = labelled(spark, d).withColumns({"top1": F.when(F.col("l_tax") < 0.03, "alpha").otherwise("beta"), "prob_alpha": 1 - F.col("l_tax") * 10, "prob_beta": F.col("l_tax") * 10})
    return cohort.subtype_summary(o, ["alpha", "beta"], ["image_no", "ring"]).select("image_no", "ring", "subtype", "top1_count", R("top1_fraction"), R("mean_probability"))


def u1_union_frames(spark, d):
    a = b.rois(spark, d).where("split = 'dev'").select("roi_id", "x0")
    return a.unionByName(b.rois(spark, d).where("split = 'locked_eval'").select("roi_id", "marker"), allowMissingColumns=True)


def u3_key_difference(spark, d):
    o = neighbors.points_in_rois(rq._points(spark, d), b.rois(spark, d), "image_no")
    return b.rois(spark, d).select("roi_id").exceptAll(o.select("roi_id").distinct())


QUERIES = {
    "a8_phenotype_counts": (a8_phenotype_counts, with_tables("objects", "select image_no, " + ", ".join(f"count(*) filter (phenotype = '{c}') as phenotype_count_{c}" for c in CLASSES) + " from objects group by 1")),
    "a9_object_flow": (a9_object_flow, with_tables("objects", "select image_no, count(*) as n_raw, count(*) filter (area_px between 50 and 450) as n_sized, count(*) filter (kept) as n_kept, count(*) filter (l_discount > 0) as n_in_focus, count(*) filter (kept) as n_spatial from objects group by 1")),
    "j1_build_sample_table": (j1_build_sample_table, with_tables("objects manifest", "select m.sample_id, animal_id, eye, condition, 'measured' as genotype, count(*) as n_objects, count(*) filter (kept) as cell_count, " + ", ".join(f"count(*) filter (phenotype = '{c}') as phenotype_count_{c}" for c in CLASSES) + " from manifest m join objects o on o.image_no = m.sample_id group by 1, 2, 3, 4")),
    "j2_build_region_study": (j2_build_region_study, with_tables("objects manifest", "+ " + _REGIONS + " select sample_id, region_label, animal_id, condition, object_count from regions join manifest using (sample_id)")),
    "j3_merge_manual_counts": (j3_merge_manual_counts, with_tables("manifest manual", "+ m as (select sample_id, manual_count from manual where sample_id % 3 <> 0) select a.sample_id, m.manual_count, coalesce(cast(m.manual_count as double), case when a.sample_id % 2 = 0 then 500.0 end) as expected_total_objects from manifest a left join m using (sample_id)")),
    "j4_compare_to_reference": (j4_compare_to_reference, with_tables("objects", "+ " + _REGIONS + ", " + _REFERENCE + _CMP + " select sample_id, region_label, atlas_name, round(delta, 6) as delta, round(fold_change, 6) as fold_change, round(zscore, 6) as zscore from cmp")),
    "c10_reference_deviation_summary": (c10_reference_deviation_summary, with_tables("objects manifest", "+ " + _REGIONS + ", " + _REFERENCE + _CMP + " select atlas_name, condition, count(*) as n_regions, round(avg(abs(delta)), 6) as mean_abs_delta, round(avg(fold_change), 6) as mean_fold_change, round(avg(abs(zscore)), 6) as mean_abs_zscore from cmp join manifest using (sample_id) group by 1, 2")),
    "c5_design_audit": (c5_design_audit, with_tables("objects manifest", "+ " + _REGIONS + ", " + _SAMPLES + """
        select 'animals_per_condition' as category, condition as key, count(distinct animal_id) as value from samples group by 2
        union all select 'eyes_per_animal', cast(animal_id as varchar), count(distinct eye) from samples group by 2
        union all select 'samples_per_eye', animal_id || ':' || eye, count(*) from samples group by 2
        union all select 'timepoints_per_animal_eye', animal_id || ':' || eye, count(distinct timepoint_dpi) from samples group by 2
        union all select 'regions_per_sample', cast(sample_id as varchar), count(distinct region_axis || ':' || region_label) from regions group by 2
        union all select 'missingness_sample', k, case k when 'density_cells_per_mm2' then (select count(*) from samples where density_cells_per_mm2 is null) else 0 end from (select unnest(['sample_id','animal_id','eye','condition','timepoint_dpi','cell_count','density_cells_per_mm2']) as k)
        union all select 'missingness_region', k, 0 from (select unnest(['sample_id','animal_id','condition','region_axis','region_label','density_cells_per_mm2']) as k)""")),
    "c6_design_eligibility": (c6_design_eligibility, with_tables("objects manifest", "+ " + _SAMPLES + ", a as (select animal_id, count(*) as n, count(distinct eye) as e, count(distinct timepoint_dpi) as t from samples group by 1), w as (select count(distinct condition) as c from samples), m as (select count(*) as n_animals, max(n) as n, max(e) as e, max(t) as t, any_value(c) as c from a, w) select n_animals, c as n_conditions, n_animals >= 2 and c >= 2 and (n > c or e > 1 or t > 1) as eligible, concat_ws(',', case when n > c then 'samples' end, case when e > 1 then 'eyes' end, case when t > 1 then 'timepoints' end) as repeated from m")),
    "c6_region_eligibility": (c6_region_eligibility, with_tables("objects manifest", "+ " + _REGIONS + ", j as (select * from regions join manifest using (sample_id)), k as (select max(n) as most_rows from (select count(*) as n from j group by sample_id)), c as (select count(distinct animal_id) as n_animals, count(distinct condition) as n_conditions from j) select k.*, c.*, n_animals >= 2 and n_conditions >= 2 and most_rows > 1 as eligible from k, c")),
    "c1_paired_pivot": (c1_paired_pivot, with_tables("objects manifest", "+ " + _SAMPLES + " select animal_id, round(avg(cell_count) filter (condition = 'control'), 6) as control, round(avg(cell_count) filter (condition = 'treated'), 6) as treated from samples group by 1 having count(distinct condition) = 2")),
    "c9_group_means": (c9_group_means, with_tables("objects manifest", "+ " + _SAMPLES + " select condition, timepoint_dpi, round(avg(cell_count), 6) as mean_cell_count, round(avg(density_cells_per_mm2), 6) as mean_density_cells_per_mm2 from samples group by 1, 2")),
    "c9_mean_matrix": (c9_mean_matrix, with_tables("objects manifest", "+ " + _REGIONS + " select region_label, round(coalesce(avg(density_cells_per_mm2) filter (condition = 'control'), 0), 6) as control, round(coalesce(avg(density_cells_per_mm2) filter (condition = 'treated'), 0), 6) as treated from regions join manifest using (sample_id) group by 1")),
    "c13_validation_table": (c13_validation_table, with_tables("manual", "+ " + _VALID + " select sample_id, validation_source, y as reference_count, x - y as count_bias, abs(x - y) as count_abs_error from val")),
    "c14_agreement_summary": (c14_agreement_summary, with_tables("manual", _AGREE.format(valid=_VALID))),
    "c15_bland_altman": (c15_bland_altman, with_tables("manual", "+ " + _VALID + ", s as (select avg(x-y) as b, coalesce(stddev_samp(x-y), 0) as sd from val) select sample_id, (x+y)/2 as mean, x-y as difference, round(b, 6) as bias, round(b - 1.96*sd, 6) as lower, round(b + 1.96*sd, 6) as upper from val, s")),
    "c16_count_agreement": (c16_count_agreement, with_tables("manual", "select count(*) as n, round(avg(abs(cell_count - manual_count)), 6) as mae, round(avg(cell_count - manual_count), 6) as bias, round(avg(abs(cell_count - manual_count) / greatest(manual_count, 1) * 100), 6) as mape, round(corr(cell_count, manual_count), 6) as corr from manual")),
    "c17_calibrate_grid": (c17_calibrate_grid, with_tables("objects manual", "+ g as (select * from (values (0, 50, 1000000, 0.0), (1, 100, 400, 0.0), (2, 0, 1000000, 0.3), (3, 0, 300, 0.0), (4, 200, 1000000, 0.5)) v(params, lo, hi, circ)), c as (select params, image_no as sample_id, count(*) filter (area_px between lo and hi and circularity >= circ::double) as n from objects, g group by 1, 2), s as (select params, count(*) as n, round(avg(abs(c.n - m.manual_count)), 6) as mae, round(avg(c.n - m.manual_count), 6) as bias, round(avg(abs(c.n - m.manual_count) / greatest(m.manual_count, 1) * 100), 6) as mape, round(corr(c.n, m.manual_count), 6) as corr from c join manual m using (sample_id) group by 1) select *, row_number() over (order by bias, mae, params) as rank from s")),
    "c18_run_warnings": (c18_run_warnings, with_tables("manual", "select concat_ws(',', case when sum(cell_count) = 0 then 'no_objects' end, case when bool_or(cell_count > 0 and sample_id % 7 = 0) then 'counts_without_points' end, case when bool_or(cell_count > 0 and sample_id % 7 <> 0 and (sample_id % 6 = 0 or sample_id % 5 = 0)) then 'points_without_curves' end, case when avg(abs(cell_count - manual_count)) > 1 then 'mae_over_threshold' end) as warnings from manual")),
    "c19_registration_completeness": (c19_registration_completeness, with_tables("manual", "+ f as (select cast(sample_id as varchar) as sample_id, case when sample_id % 4 = 0 then 1.0::double else 0.0 end as registered, case when sample_id % 6 <> 0 and sample_id % 5 <> 0 then 1.0::double else 0.0 end as curve_valid from manual) select * from f union all select 'summary', round(avg(registered), 6), round(avg(curve_valid), 6) from f")),
    "c20_image_warnings": (c20_image_warnings, with_tables("manual", "+ w as (select sample_id, [x for x in [case when sample_id % 11 = 0 then 'degenerate_shape' end, case when sample_id % 13 < 1 then 'low_coverage' end, case when sample_id % 8 < 3 then 'few_points' end, case when sample_id % 6 = 0 or sample_id % 5 = 0 then 'no_finite_curve' end] if x is not null] as l from manual) select sample_id, cast(len(l) as int) as warning_count, array_to_string(l, '; ') as warnings_text from w")),
    "c21_evidence_flags": (c21_evidence_flags, with_tables("manual", "select bool_or(sample_id % 4 = 0) as any_registered, bool_or(sample_id % 6 <> 0 and sample_id % 5 <> 0) as any_curve, count(*) filter (sample_id % 4 = 0) as registered_pairs, count(*) filter (sample_id % 4 <> 0 and sample_id % 3 = 0) as fallback_pairs from manual")),
    "c12_subtype_summary": (c12_subtype_summary, with_tables("objects", "+ " + rq._REG + ", s as (select image_no, ring, 'alpha' as subtype, count(*) filter (l_tax < 0.03) as top1_count, round(count(*) filter (l_tax < 0.03) / count(*), 6) as top1_fraction, round(avg(1 - l_tax*10), 6) as mean_probability from labelled group by 1, 2 union all select image_no, ring, 'beta', count(*) filter (not l_tax < 0.03), round(count(*) filter (not l_tax < 0.03) / count(*), 6), round(avg(l_tax*10), 6) from labelled group by 1, 2) select * from s")),
    "u1_union_frames": (u1_union_frames, with_tables("rois", "select roi_id, x0, null as marker from rois where split = 'dev' union all select roi_id, null, marker from rois where split = 'locked_eval'")),
    "u3_key_difference": (u3_key_difference, with_tables("objects rois", "select roi_id from rois except select r.roi_id from objects o join rois r on o.image_no = r.image_no and o.centroid_x_px >= r.x0 and o.centroid_x_px < r.x0 + r.width and o.centroid_y_px >= r.y0 and o.centroid_y_px < r.y0 + r.height")),
}
