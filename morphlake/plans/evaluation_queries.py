"""Queries on benchmarks, ranks, gates and audits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from morphlake.functions.columns import comparable, slug, stem, tokens
from morphlake.operators import evaluation as ev
from morphlake.operators import inventory, neighbors
from morphlake.operators.numbering import numbered
from morphlake.sources import bindings as b
from morphlake.sources.bindings import with_tables

R = lambda c, n=6: F.round(c, n).alias(c)


def _results(spark, d):
    runs = b.runs(spark, d)
    rows = runs.withColumn("tolerance", F.element_at(F.array(F.lit(6.0), F.lit(8.0), F.lit(10.0)), (F.col("roi_id") % 3 + 1).cast("int")))
    return rows.where("not (config_id = '5-LOW' and tolerance = 8.0)")


_RESULTS = "res as (select * from (select *, [6.0::double, 8.0::double, 10.0::double][1 + roi_id % 3] as tolerance from runs) where not (config_id = '5-LOW' and tolerance = 8.0))"
_CONFIG = _RESULTS + """, pr as (select *, tolerance = 8.0 or not bool_or(tolerance = 8.0) over (partition by config_id) as p from res),
 cs as (select config_id, count(distinct roi_id) filter (p) as n_rois, avg(f1) filter (p) as f1_mean, avg(recall) filter (p) as recall_mean, avg(count_mae) filter (p) as mae_mean, quantile_cont(n_manual, 0.5) filter (p) as median_manual,
   avg(f1) filter (tolerance = 6.0) as f1_mean_6px, avg(recall) filter (tolerance = 6.0) as recall_mean_6px, avg(f1) filter (tolerance = 10.0) as f1_mean_10px, avg(recall) filter (tolerance = 10.0) as recall_mean_10px from pr group by 1),
 cp as (select *, n_rois >= 20 and f1_mean >= 0.75 and recall_mean >= 0.75 and (median_manual <= 0 or mae_mean <= 0.1*median_manual) as passed, row_number() over (order by f1_mean desc, recall_mean desc, mae_mean, config_id) as rank from cs)"""


def b3_config_summary(spark, d):
    s = ev.config_summary(_results(spark, d))
    return s.select("config_id", "n_rois", R("f1_mean"), R("recall_mean"), R("mae_mean"), "median_manual", R("f1_mean_6px"), R("recall_mean_6px"), R("f1_mean_10px"), R("recall_mean_10px"), "passed", "rank")


def b4_benchmark_summary(spark, d):
    return ev.benchmark_summary(_results(spark, d)).select("n_rois", R("f1_mean"), R("recall_mean"), R("mae_mean"), "median_manual", "passed")


def _split_rows(spark, d):
    return b.runs(spark, d).withColumns({"split": F.when(F.col("split") == "F", "dev").when(F.col("split") == "O", "locked_eval").otherwise(F.col("split")), "f1": F.least(F.lit(1.0), F.col("f1") + 0.35), "recall": F.least(F.lit(1.0), F.col("recall") + 0.4)})


_SPLIT = "sr as (select config_id, roi_id, case split when 'F' then 'dev' when 'O' then 'locked_eval' else split end as split, least(1.0, f1 + 0.35) as f1, least(1.0, recall + 0.4) as recall from runs), sg as (select config_id, count(distinct roi_id) filter (split = 'dev') as dev_n, avg(f1) filter (split = 'dev') as dev_f1, avg(recall) filter (split = 'dev') as dev_recall, count(distinct roi_id) filter (split = 'locked_eval') as eval_n, avg(f1) filter (split = 'locked_eval') as eval_f1, avg(recall) filter (split = 'locked_eval') as eval_recall from sr group by 1), sp as (select *, dev_n >= 4 and eval_n >= 2 and dev_f1 >= 0.6 and dev_recall >= 0.6 and eval_f1 >= 0.5 and eval_recall >= 0.5 and abs(dev_f1 - eval_f1) <= 0.15 and abs(dev_recall - eval_recall) <= 0.15 as passed from sg)"
_SPLIT_COLUMNS = ("dev_f1", "dev_recall", "eval_f1", "eval_recall")


def b5_split_summary_gate(spark, d):
    return ev.split_summary_gate(_split_rows(spark, d)).select("config_id", "dev_n", "eval_n", *map(R, _SPLIT_COLUMNS), "passed")


def t10_micro_ranking(spark, d):
    return ev.micro_ranking(ev.split_summary_gate(_split_rows(spark, d))).select("config_id", "passed", "rank")


def j19_beats_baseline(spark, d):
    return ev.beats_baseline(ev.config_summary(_results(spark, d)), "3-MEDIUM").select("config_id", "beats")


def t4_hardest_rois(spark, d):
    return ev.hardest_rois(b.runs(spark, d)).select("roi_id", R("f1"), "count_mae")


def t5_top_candidates(spark, d):
    return ev.top_candidates(b.runs(spark, d), "config_id", [F.desc("f1"), F.asc("roi_id")], 2).select("config_id", "roi_id", "rank")


def t7_class_quota(spark, d):
    m = b.manifest(spark, d).withColumn("path", F.concat(F.lit("/data/"), F.col("condition"), F.lit("/"), F.lpad(F.col("sample_id").cast("string"), 5, "0")))
    return ev.top_candidates(m, "condition", [F.asc("path")], 12, "n").select("condition", "sample_id", "n")


def _probe(spark, d):
    return b.objects(spark, d).select(F.col("phenotype").alias("config_id"), F.col("image_no").alias("roi_id"), F.col("mean_intensity").alias("score"))


_PROBE = "pb as (select phenotype as config_id, image_no as roi_id, count(*) as n_points, avg(mean_intensity) as mean_score, quantile_cont(mean_intensity, 0.9) as p90_score from objects group by 1, 2)"


def b11_probe_by_roi(spark, d):
    return ev.probe_summary(_probe(spark, d))[0].select("config_id", "roi_id", "n_points", R("mean_score"), R("p90_score"))


def b11_probe_by_config(spark, d):
    return ev.probe_summary(_probe(spark, d))[1].select("config_id", "n_rois", R("mean_points"), R("mean_score"), R("mean_p90"))


def w2_rank_within_roi(spark, d):
    return ev.rank_within_roi(ev.probe_summary(_probe(spark, d))[0]).select("config_id", "roi_id", "rank")


def _models(spark, d):
    r = b.runs(spark, d)
    return r.withColumns({"backend": F.when(F.col("roi_id") % 7 != 0, F.col("split")), "model_label": F.col("config_id"), "has_overlap": F.when(F.col("roi_id") % 3 == 0, F.col("roi_id") % 2 == 0), "dice": F.when(F.col("roi_id") % 2 == 0, F.col("f1")), "iou": F.when(F.col("roi_id") % 2 == 0, F.col("f1") / (2 - F.col("f1"))), "count_bias": (F.col("count_mae") - 3).cast("double")})


_MODELS = "mr as (select case when roi_id % 7 <> 0 then split end as backend, config_id as model_label, coalesce(roi_id % 3 = 0 and roi_id % 2 = 0, false) as ov, case when roi_id % 2 = 0 then f1 end as dice, case when roi_id % 2 = 0 then f1/(2-f1) end as iou, cast(count_mae - 3 as double) as cb from runs), ms as (select backend, model_label, count(*) as n_runs, count(*) filter (ov) as n_overlap_runs, avg(dice) as mean_dice, quantile_cont(dice, 0.5) as median_dice, avg(iou) as mean_iou, avg(abs(cb)) as mae_count, avg(cb) as mean_bias, sqrt(avg(cb*cb)) as rmse_count from mr group by 1, 2)"


def b9_model_summary(spark, d):
    s = ev.model_summary(_models(spark, d), ["backend", "model_label"])
    return s.select("backend", "model_label", "n_runs", "n_overlap_runs", *[R(c) for c in ("mean_dice", "median_dice", "mean_iou", "mae_count", "mean_bias", "rmse_count")])


def t3_rank_models(spark, d):
    s = ev.model_summary(_models(spark, d).where("backend is not null"), ["model_label"])
    return ev.rank_models(s, "model_label").select("model_label", "rule", "rank")


def b10_run_metrics(spark, d):
    r = b.manual(spark, d).withColumn("label_count", F.when(F.col("sample_id") % 2 == 0, F.col("manual_count") + 1))
    return ev.run_metrics(r).select("sample_id", "reference_count", "count_bias", "count_abs_error")


FIELDS = ("image_channel", "truth_channel", "truth_marker", "truth_source")


def _provenance(spark, d):
    r = b.rois(spark, d)
    m = F.col("roi_id")
    fields = {"m_image_channel": F.when(m % 5 != 0, (m % 2).cast("string")), "s_image_channel": F.when(m % 3 == 0, (m % 2).cast("string")), "m_truth_channel": F.when(m % 7 != 0, (m % 2).cast("string")), "s_truth_channel": F.when(m % 11 == 0, F.lit("1")), "m_truth_marker": F.when(m % 4 != 0, F.upper("marker")), "s_truth_marker": F.when(m % 13 == 0, F.lit("OTHER")), "m_truth_source": F.lit(None).cast("string"), "s_truth_source": F.when(m % 2 == 0, F.lit("atlas"))}
    return ev.resolve_provenance(r.withColumns(fields), FIELDS, F.col("marker"))


_PROV = """pv as (select roi_id, marker, case when roi_id % 5 <> 0 then cast(roi_id % 2 as varchar) end as m1, case when roi_id % 3 = 0 then cast(roi_id % 2 as varchar) end as s1, case when roi_id % 7 <> 0 then cast(roi_id % 2 as varchar) end as m2, case when roi_id % 11 = 0 then '1' end as s2, case when roi_id % 4 <> 0 then upper(marker) end as m3, case when roi_id % 13 = 0 then 'OTHER' end as s3, case when roi_id % 2 = 0 then 'atlas' end as s4 from rois),
 pi as (select *, [x for x in [case when m1 <> s1 then 'conflict:image_channel' end, case when m2 <> s2 then 'conflict:truth_channel' end, case when lower(m3) <> lower(s3) then 'conflict:truth_marker' end, case when coalesce(m1, s1) <> coalesce(m2, s2) then 'channel_mismatch' end, case when lower(coalesce(m3, s3)) <> lower(marker) then 'marker_mismatch' end] if x is not null] as issues from pv),
 ps as (select roi_id, issues, case when len(issues) > 0 then 'invalid' when coalesce(m1, s1) is not null and coalesce(m2, s2) is not null and coalesce(m3, s3) is not null and s4 is not null then 'matched' else 'unknown' end as status from pi)"""


def b6_resolve_provenance(spark, d):
    return _provenance(spark, d).select("roi_id", F.array_join("issues", ";").alias("issues"), "status")


def b7_provenance_summary(spark, d):
    return ev.provenance_summary(_provenance(spark, d))


def b8_roi_qc(spark, d):
    r = b.rois(spark, d).withColumns({"crop_digest": F.when(F.col("roi_id") % 9 != 0, F.sha2((F.col("x0") * 1000 + F.col("y0") % 100).cast("string"), 256)), "image_digest": F.sha2(F.col("image_no").cast("string"), 256), "in_bounds": (F.col("x0") + 64 <= 1000) & (F.col("y0") + 64 <= 1000)})
    return ev.roi_qc(r, neighbors.roi_overlap_pairs(b.rois(spark, d), "image_no")).select("roi_id", "duplicate_crop", "reused_source", "overlaps", "blocked")


def b13_benchmark_gate_audit(spark, d):
    m = F.col("p_partkey")
    q = b.table(spark, d, "part").select("p_partkey", (m % 40).alias("n_rois"), F.when(m % 3 != 0, m % 7 != 0).alias("truth_provenance_valid"), F.when(m % 11 == 0, "invalid").otherwise("matched").alias("truth_provenance_status"), (m % 5 != 0).alias("matched_modality"), (m % 2 == 0).alias("pass_threshold"))
    return ev.benchmark_gate_audit(q).select("p_partkey", "reason", "passed")


def b14_count_consistency_audit(spark, d):
    m = b.manual(spark, d).withColumn("spatial_points", F.when(F.col("sample_id") % 7 == 0, 0).when(F.col("sample_id") % 5 != 0, F.col("cell_count")))
    return ev.count_consistency_audit(m).select("sample_id", "cell_count")


def b15_cross_source_consistency(spark, d):
    m = b.manual(spark, d)
    rows = m.select("sample_id", F.explode(F.array("cell_count", F.when(F.col("sample_id") % 4 != 0, F.col("cell_count")), F.when(F.col("sample_id") % 6 == 0, F.col("manual_count")))).alias("v"))
    return ev.cross_source_consistency(rows, "sample_id", "v")


def j17_curve_status_check(spark, d):
    r = b.rois(spark, d)
    curves = r.select(F.col("roi_id").alias("domain"), F.explode(F.array(F.lit(25.0), F.lit(50.0))).alias("radius"), "x0").select("domain", "radius", F.when(F.col("domain") % 3 != 0, F.col("x0") / F.col("radius")).alias("l_obs"), F.when(F.col("domain") % 6 == 1, F.col("radius")).alias("g_obs"))
    status = r.where("roi_id % 5 <> 0").select(F.col("roi_id").alias("domain"), F.when(F.col("roi_id") % 2 == 0, "ok").otherwise("no_valid_radii").alias("status"))
    return ev.curve_status_check(curves, status, ["domain"])


def j18_digest_reconcile(spark, d):
    p = b.table(spark, d, "pages").select("page_id", F.sha2("html", 256).alias("digest"))
    changed = p.where("page_id % 10 <> 3").withColumn("digest", F.when(F.col("page_id") % 7 == 0, F.lit("0")).otherwise(F.col("digest")))
    return ev.digest_reconcile(p.where("page_id % 12 <> 5"), changed, "page_id")


def j22_diff_tables(spark, d):
    """Rows whose normalised texts differ between two versions of the customer table, with how often each occurs."""
    c = b.table(spark, d, "customer")
    text = lambda f: f.select(*[comparable(F.col(n), t).alias(n) for n, t in f.dtypes])
    old, new = text(c.select("c_custkey", "c_nationkey", "c_mktsegment")), text(c.select(F.col("c_custkey").cast("double").alias("c_custkey"), F.when(F.col("c_custkey") % 50 != 0, F.col("c_nationkey")).cast("double").alias("c_nationkey"), "c_mktsegment"))
    return old.exceptAll(new).withColumn("side", F.lit("left")).unionByName(new.exceptAll(old).withColumn("side", F.lit("right")))


def w5_duplicate_flags(spark, d):
    t = b.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return t.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1).select("doc_id", "duplicate")


def w6_unambiguous_top(spark, d):
    p = b.table(spark, d, "part")
    names = F.element_at(F.array(F.lit("Far Red 647"), F.lit("dapi"), F.lit("Cy5"), F.lit("rbpms far-red"), F.lit(None).cast("string")), (F.col("p_partkey") % 5 + 1).cast("int"))
    return ev.unambiguous_top(p.select((F.col("p_partkey") % 300).alias("image"), F.col("p_partkey").alias("channel"), names.alias("name"), (F.col("p_size") * 20).alias("wavelength")), "image").select("image", "channel", "score", "rank", "unique_top")


def j8_expand_config_grid(spark, d):
    s = b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_brand").alias("params")).distinct()
    g = b.table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("string").alias("params"))
    return ev.expand_config_grid(s, g, g).select("config_id", "projection_params", "preprocess_params", "detector_params")


def p13_score_paths(spark, d):
    p = b.table(spark, d, "pages").select("page_id", "url")
    return ev.score_paths(p, "url", ["en", "page", "blog", "example com", "org"], ["html", "pdf"]).select("page_id", F.array_join("reasons", ",").alias("reasons"), "score")


def p14_classify_condition(spark, d):
    named = {"normoxic": ["/en/"], "oir": ["/fr/", "/de/"]}
    return b.table(spark, d, "pages").select("page_id", inventory.classify_condition(F.col("url"), named)["condition"].alias("condition"))


def p14_condition_of_image(spark, d):
    eye = F.element_at(F.array(F.lit("Normoxia"), F.lit("P17_OIR"), F.lit("Healthy_OIR"), F.lit("plain")), (F.col("sample_id") % 4 + 1).cast("int"))
    path = F.concat(F.lit("/data/"), F.col("genotype"), F.lit("/"), eye, F.lit("_"), F.col("eye"), F.lit(".tif"))
    return b.manifest(spark, d).withColumn("c", inventory.classify_condition(path)).select("sample_id", "c.condition", "c.basis")


def p23_derive_manifest(spark, d):
    p = b.table(spark, d, "part").select("p_partkey", "p_name", (F.col("p_size") * 60).alias("height"), (F.col("p_size") * 70 + 10).alias("width"))
    return inventory.derive_manifest(p, [F.col("p_name"), F.col("p_partkey")], {"eye": "UNK", "modality": "flatmount"}, "S%04d", ("whole", "crop")).select("p_partkey", "sample_id", "kind")


def f_text_functions(spark, d):
    p = b.table(spark, d, "pages")
    path = F.regexp_replace("url", r"^https?://", "")
    return p.select("page_id", slug(F.col("url")).alias("slug"), stem(path).alias("stem"), F.size(tokens(F.col("url"))).cast("bigint").alias("n_tokens"), F.sha2("url", 256).alias("sha256"), F.get_json_object(F.to_json(F.struct("page_id", "url")), "$.url").alias("roundtrip"))


def p22_flatten_metadata(spark, d):
    e = b.table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce(F.col("p.k") > 50, F.lit(False)).alias("large"))


def _metadata_documents(spark, d):
    """A nested document for each part: absent blocks, several candidate channels, and scenes with up to two annotations."""
    k = F.col("p_partkey")
    at = lambda n: F.struct(F.concat(F.lit(f"Scene/Points{n}/"), k.cast("string")).alias("path"))
    image = F.when(k % 5 != 0, F.struct(F.lit("2024-01-02").alias("RecordingDate"), F.lit("20x").alias("LensPower"), F.lit("um").alias("Unit"), (F.col("p_size") * 16).cast("string").alias("X"), (F.col("p_size") * 8).cast("string").alias("Y"), F.when(k % 3 != 0, F.lit("12")).otherwise("?").alias("Z")))
    voxel = F.struct(F.lit(0.5).alias("voxel_x_um"), F.lit(0.5).alias("voxel_y_um"), F.when(k % 2 == 0, 2.0).alias("voxel_z_um"))
    channel = lambda i, s: F.struct(F.lit(i).alias("channel_index"), s.alias("score"), F.col("p_type").alias("reason"), (k % 7 == 0).alias("is_unambiguous_top_candidate"))
    channels = F.when(k % 4 == 0, F.array()).otherwise(F.array(channel(2, (k % 9) * 10.0), channel(0, F.lit(1.0))))
    scene = F.when(k % 3 == 0, F.struct(F.array(F.col("p_brand")).alias("scene_groups"), F.when(k % 6 == 0, F.array(at(1), at(2))).otherwise(F.array(at(1))).alias("annotation_candidates")))
    doc = F.struct(F.col("p_name").alias("stem"), F.concat(F.lit("/ims/"), k.cast("string"), F.lit(".ims")).alias("path"), F.sha2(k.cast("string"), 256).alias("source_sha256"), (F.col("p_size") * 1000).alias("size_bytes"), F.struct(image.alias("image"), (k % 4 + 1).alias("n_channels"), voxel.alias("voxel_sizes_um")).alias("metadata"), channels.alias("candidate_rbpms_channels"), scene.alias("scene"))
    return b.table(spark, d, "part").select("p_partkey", F.when(k % 50 == 0, "no document").otherwise(F.to_json(doc)).alias("text"))


def p22_metadata_inventory(spark, d):
    return inventory.flatten_metadata(_metadata_documents(spark, d), "text")


def p22_annotation_rows(spark, d):
    return inventory.annotation_rows(_metadata_documents(spark, d), "text")


def t11_candidate_order(spark, d):
    p = b.table(spark, d, "pages").withColumn("path", F.regexp_replace("url", r"[?#].*$", ""))
    first = F.row_number().over(Window.partitionBy("path").orderBy("page_id"))
    kept = p.withColumn("n", first).where("n = 1").withColumn("score", F.length("path").cast("bigint"))
    return numbered(kept, [F.desc("score"), F.col("path")], "position").select("page_id", "path", "score", F.col("position").cast("int").alias("position"))


QUERIES = {
    "b3_config_summary": (b3_config_summary, with_tables("runs", "+ " + _CONFIG + " select config_id, n_rois, " + ", ".join(f"round({c}, 6) as {c}" for c in ("f1_mean", "recall_mean", "mae_mean", "f1_mean_6px", "recall_mean_6px", "f1_mean_10px", "recall_mean_10px")) + ", median_manual, passed, rank from cp")),
    "b4_benchmark_summary": (b4_benchmark_summary, with_tables("runs", "+ " + _RESULTS + ", s as (select count(distinct roi_id) as n_rois, avg(f1) as f, avg(recall) as r, avg(count_mae) as m, quantile_cont(n_manual, 0.5) as median_manual from res) select n_rois, round(f, 6) as f1_mean, round(r, 6) as recall_mean, round(m, 6) as mae_mean, median_manual, f >= 0.75 and r >= 0.75 and m <= 0.1*median_manual as passed from s")),
    "b5_split_summary_gate": (b5_split_summary_gate, with_tables("runs", "+ " + _SPLIT + " select config_id, dev_n, eval_n, " + ", ".join(f"round({c}, 6) as {c}" for c in _SPLIT_COLUMNS) + ", passed from sp")),
    "t10_micro_ranking": (t10_micro_ranking, with_tables("runs", "+ " + _SPLIT + " select config_id, passed, row_number() over (order by passed desc, dev_f1 desc, dev_recall desc, eval_f1 desc, eval_recall desc, config_id) as rank from sp")),
    "j19_beats_baseline": (j19_beats_baseline, with_tables("runs", "+ " + _CONFIG + " select a.config_id, a.config_id <> '3-MEDIUM' and a.f1_mean >= b.f1_mean and a.recall_mean >= b.recall_mean and a.mae_mean <= b.mae_mean as beats from cp a, (select * from cp where config_id = '3-MEDIUM') b")),
    "t4_hardest_rois": (t4_hardest_rois, with_tables("runs", "select roi_id, round(f1, 6) as f1, count_mae from runs order by runs.f1, count_mae desc, roi_id limit 10")),
    "t5_top_candidates": (t5_top_candidates, with_tables("runs", "select * from (select config_id, roi_id, row_number() over (partition by config_id order by f1 desc, roi_id) as rank from runs) where rank <= 2")),
    "t7_class_quota": (t7_class_quota, with_tables("manifest", "select * from (select condition, sample_id, row_number() over (partition by condition order by sample_id) as n from manifest) where n <= 12")),
    "b11_probe_by_roi": (b11_probe_by_roi, with_tables("objects", "+ " + _PROBE + " select config_id, roi_id, n_points, round(mean_score, 6) as mean_score, round(p90_score, 6) as p90_score from pb")),
    "b11_probe_by_config": (b11_probe_by_config, with_tables("objects", "+ " + _PROBE + " select config_id, count(distinct roi_id) as n_rois, round(avg(n_points), 6) as mean_points, round(avg(mean_score), 6) as mean_score, round(avg(p90_score), 6) as mean_p90 from pb group by 1")),
    "w2_rank_within_roi": (w2_rank_within_roi, with_tables("objects", "+ " + _PROBE + " select config_id, roi_id, row_number() over (partition by roi_id order by p90_score desc, mean_score desc, n_points, config_id) as rank from pb")),
    "b9_model_summary": (b9_model_summary, with_tables("runs", "+ " + _MODELS + " select backend, model_label, n_runs, n_overlap_runs, " + ", ".join(f"round({c}, 6) as {c}" for c in ("mean_dice", "median_dice", "mean_iou", "mae_count", "mean_bias", "rmse_count")) + " from ms")),
    "t3_rank_models": (t3_rank_models, with_tables("runs", "+ " + _MODELS + ", mm as (select model_label, avg(dice) as dc, avg(abs(cb)) as mae from mr where backend is not null group by 1) select model_label, 'dice_then_mae' as rule, row_number() over (order by coalesce(dc, -1) desc, mae, model_label) as rank from mm")),
    "b10_run_metrics": (b10_run_metrics, with_tables("manual", "select sample_id, manual_count + (case when sample_id % 2 = 0 then 1 else 0 end) as reference_count, cell_count - (manual_count + (case when sample_id % 2 = 0 then 1 else 0 end)) as count_bias, abs(cell_count - (manual_count + (case when sample_id % 2 = 0 then 1 else 0 end))) as count_abs_error from manual")),
    "b6_resolve_provenance": (b6_resolve_provenance, with_tables("rois", "+ " + _PROV + " select roi_id, array_to_string(issues, ';') as issues, status from ps")),
    "b7_provenance_summary": (b7_provenance_summary, with_tables("rois", "+ " + _PROV + ", f as (select count(*) as n, count(*) filter (status = 'invalid') as n_invalid, count(*) filter (status = 'matched') as n_matched from ps), i as (select string_agg(x, ',' order by x) as issues from (select distinct unnest(issues) as x from ps)) select n, n_invalid, n_matched, issues, case when n_invalid > 0 then 'invalid' when n_matched = n then 'matched' else 'unknown' end as status from f, i")),
    "b8_roi_qc": (b8_roi_qc, with_tables("rois", "+ r as (select *, case when roi_id % 9 <> 0 then x0 * 1000 + y0 % 100 end as dg from rois), o as (select distinct a.roi_id from rois a join rois b on a.image_no = b.image_no and a.roi_id <> b.roi_id and least(a.x0+64, b.x0+64) > greatest(a.x0, b.x0) and least(a.y0+64, b.y0+64) > greatest(a.y0, b.y0)), q as (select r.roi_id, case when dg is null then false else count(*) over (partition by dg) > 1 end as duplicate_crop, count(*) over (partition by image_no) > 1 as reused_source, o.roi_id is not null as \"overlaps\", x0 + 64 <= 1000 and y0 + 64 <= 1000 as ib from r left join o on o.roi_id = r.roi_id) select roi_id, duplicate_crop, reused_source, \"overlaps\", duplicate_crop or \"overlaps\" or not ib as blocked from q")),
    "b13_benchmark_gate_audit": (b13_benchmark_gate_audit, "with q as (select p_partkey, p_partkey % 40 as n, coalesce(case when p_partkey % 3 <> 0 then p_partkey % 7 <> 0 end, true) as v, p_partkey % 11 = 0 as i, p_partkey % 5 <> 0 as m, p_partkey % 2 = 0 as p from part), r as (select p_partkey, case when n < 20 then 'too_few_rois' when not v or i then 'invalid_truth_provenance' when not m then 'unmatched_modality' when not p then 'benchmark_failed_threshold' else 'benchmark_passed' end as reason from q) select *, reason = 'benchmark_passed' as passed from r"),
    "b14_count_consistency_audit": (b14_count_consistency_audit, with_tables("manual", "select sample_id, cell_count from manual where cell_count > 0 and (sample_id % 7 = 0 or sample_id % 5 = 0)")),
    "b15_cross_source_consistency": (b15_cross_source_consistency, with_tables("manual", "select sample_id, not (sample_id % 6 = 0 and manual_count <> cell_count) as consistent, 1 + (case when sample_id % 4 <> 0 then 1 else 0 end) + (case when sample_id % 6 = 0 then 1 else 0 end) as n_sources from manual")),
    "j17_curve_status_check": (j17_curve_status_check, "with d as (select p_partkey as domain from part where p_partkey % 3 = 0 and p_partkey % 6 <> 1) select domain, case when domain % 5 = 0 then null when domain % 2 = 0 then 'ok' else 'no_valid_radii' end as status, domain % 5 = 0 or domain % 2 = 0 as invalid from d"),
    "j18_digest_reconcile": (j18_digest_reconcile, "with q as (select page_id, page_id % 12 <> 5 as e, page_id % 10 <> 3 as a from pages) select page_id, case when not a then 'missing' when not e then 'extra' else 'mismatch' end as issue from q where (e or a) and not (e and a and page_id % 7 <> 0)"),
    "j22_diff_tables": (j22_diff_tables, "select cast(c_custkey as varchar) as c_custkey, cast(c_nationkey as varchar) as c_nationkey, c_mktsegment, 'left' as side from customer where c_custkey % 50 = 0 union all select cast(c_custkey as varchar), '', c_mktsegment, 'right' from customer where c_custkey % 50 = 0"),
    "w5_duplicate_flags": (w5_duplicate_flags, "select doc_id, count(*) over (partition by text) > 1 as duplicate from documents"),
    "w6_unambiguous_top": (w6_unambiguous_top, "with c as (select p_partkey % 300 as image, p_partkey as channel, case p_partkey % 5 when 0 then 100 + 35 when 1 then 0 when 2 then 35 when 3 then 100 else 0 end + case when p_size*20 between 640 and 680 then 20 else 0 end + case when p_size*20 between 620 and 750 then 15 else 0 end as score from part), r as (select *, row_number() over (partition by image order by score desc, channel) as rank, count(*) over (partition by image, score) as t from c) select image, channel, score, rank, rank = 1 and score > 0 and t = 1 as unique_top from r"),
    "j8_expand_config_grid": (j8_expand_config_grid, "select p_brand || '__' || a.r_name || '__' || b.r_name as config_id, p_brand as projection_params, cast(a.r_regionkey as varchar) as preprocess_params, cast(b.r_regionkey as varchar) as detector_params from (select distinct p_brand from part), region a, region b"),
    "p13_score_paths": (p13_score_paths, "with t as (select page_id, lower(url) as u, regexp_extract_all(lower(url), '[a-z0-9]+') as w from pages), h as (select page_id, u, [x for x in [case when list_contains(w, 'en') then 'en' end, case when len([y for y in w if starts_with(y, 'page')]) > 0 then 'page' end, case when len([y for y in w if starts_with(y, 'blog')]) > 0 then 'blog' end, case when contains(u, 'example com') then 'example com' end, case when list_contains(w, 'org') then 'org' end] if x is not null] as r from t) select page_id, array_to_string(r, ',') as reasons, len(r)*10 + case when regexp_extract(u, '\\.([a-z0-9]+)$', 1) in ('html', 'pdf') then 5 else 0 end as score from h"),
    "p14_classify_condition": (p14_classify_condition, "select page_id, case when contains(lower(url), '/en/') then 'normoxic' when contains(lower(url), '/fr/') or contains(lower(url), '/de/') then 'oir' else 'unknown' end as condition from pages"),
    "p14_condition_of_image": (p14_condition_of_image, with_tables("manifest", "select sample_id, case sample_id % 4 when 0 then 'normoxic' when 1 then 'oir' when 2 then 'normoxic' else 'unknown' end as condition, case when sample_id % 4 = 3 then 'unresolved' else 'path_token' end as basis from manifest")),
    "p22_metadata_inventory": (p22_metadata_inventory, "with p as (select *, p_partkey as k, p_partkey % 50 <> 0 as ok from part) select p_partkey, case when ok then p_name end as stem, case when ok then '/ims/' || k || '.ims' end as source_path, case when ok then sha256(cast(k as varchar)) end as source_sha256, case when ok then p_size*1000 end as size_bytes, case when ok and k % 5 <> 0 then '2024-01-02' end as recording_date, case when ok and k % 5 <> 0 then '20x' end as lens_power, case when ok and k % 5 <> 0 then 'um' end as unit, case when ok and k % 5 <> 0 then p_size*16 end as size_x, case when ok and k % 5 <> 0 then p_size*8 end as size_y, case when ok and k % 5 <> 0 and k % 3 <> 0 then 12 end as size_z, case when ok then k % 4 + 1 end as n_channels, case when ok then 0.5::double end as voxel_x_um, case when ok then 0.5::double end as voxel_y_um, case when ok and k % 2 = 0 then 2.0::double end as voxel_z_um, ok and k % 3 = 0 as has_scene, case when not ok or k % 3 <> 0 then 0 when k % 6 = 0 then 2 else 1 end as scene_annotation_candidates, case when ok and k % 4 <> 0 then 2 end as top_candidate_channel_index, case when ok and k % 4 <> 0 then (k % 9)*10.0::double end as top_candidate_score, case when ok and k % 4 <> 0 then p_type end as top_candidate_reason, ok and k % 4 <> 0 and k % 7 = 0 as top_candidate_unambiguous from p"),
    "p22_annotation_rows": (p22_annotation_rows, "with n as (select p_partkey as k, unnest(case when p_partkey % 6 = 0 then [1, 2] else [1] end) as i from part where p_partkey % 50 <> 0 and p_partkey % 3 = 0) select k as p_partkey, '/ims/' || k || '.ims::Scene/Points' || i || '/' || k as path, '.ims' as suffix, 100 as score, 'embedded_same_image_point_truth' as classification, 'embedded_scene_annotation_candidate' as reasons from n"),
    "p23_derive_manifest": (p23_derive_manifest, "select p_partkey, printf('S%04d', row_number() over (order by p_name, p_partkey)) as sample_id, case when least(p_size*60, p_size*70+10) >= 1500 then 'whole' else 'crop' end as kind from part"),
    "f_text_functions": (f_text_functions, "with p as (select page_id, url, regexp_replace(url, '^https?://', '') as path from pages) select page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug, regexp_replace(regexp_extract(path, '([^/]*)/*$', 1), '\\.[^.]*$', '') as stem, len(regexp_extract_all(lower(url), '[a-z0-9]+')) as n_tokens, sha256(url) as sha256, url as roundtrip from p"),
    "p22_flatten_metadata": (p22_flatten_metadata, "select event_id, cast(props->>'$.k' as int) as k, coalesce(cast(props->>'$.k' as int) > 50, false) as large from events"),
    "t11_candidate_order": (t11_candidate_order, "with p as (select page_id, regexp_replace(url, '[?#].*$', '') as path from pages), f as (select *, row_number() over (partition by path order by page_id) as n from p), k as (select page_id, path, length(path) as score from f where n = 1) select *, row_number() over (order by score desc, path) as position from k"),
}
