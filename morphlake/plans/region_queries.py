"""Queries on contracts, geometry, rules and neighbours, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators import contract, geometry, neighbors, rules
from morphlake.sources import bindings as b
from morphlake.sources.bindings import with_tables

MAX_ECC = 400.0
SCHEMA = "mouse_flatmount_v1"
R6 = lambda c: F.round(c, 6)

_REG = """registered as (select o.*, (x - 512.0) * 0.5 as ret_x_um, (512.0 - y) * 0.5 as ret_y_um from (select *, centroid_x_px as x, centroid_y_px as y from objects) o),
ecc as (select *, sqrt(ret_x_um*ret_x_um + ret_y_um*ret_y_um) as ecc_um, fmod(degrees(atan2(ret_y_um, ret_x_um)) + 360.0, 360.0) as theta_deg from registered),
labelled as (select *, case when least(ecc_um/400.0, 1.0) <= 0.33 then 'central' when least(ecc_um/400.0, 1.0) <= 0.66 then 'pericentral' else 'peripheral' end as ring,
 (case when ret_y_um >= 0 then 'dorsal' else 'ventral' end) || '_' || (case when ret_x_um >= 0 then 'temporal' else 'nasal' end) as quadrant,
 ['temporal','dorsal_temporal','dorsal','dorsal_nasal','nasal','ventral_nasal','ventral','ventral_temporal'][1 + cast(floor(fmod(theta_deg + 22.5, 360.0)/45.0) as int)] as sector,
 case when least(ecc_um/400.0, 1.0) <= 0.15 then 'peripapillary' else 'non_peripapillary' end as peripapillary_bin from ecc)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    return geometry.build_frames(b.manifest(spark, d), F.col("um_per_px"), F.col("um_per_px"))


def registered(spark: SparkSession, d: str, points: DataFrame | None = None, x: str = "centroid_x_px", y: str = "centroid_y_px") -> DataFrame:
    return geometry.register_points(b.objects(spark, d) if points is None else points, frames(spark, d), "image_no", x=x, y=y)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return geometry.assign_regions(registered(spark, d), SCHEMA, MAX_ECC)


def p1_enforce_contract(spark, d):
    raw = b.objects(spark, d).select(F.concat(F.lit("/data/img."), F.col("image_no").cast("string"), F.lit(".tif")).alias("source_path"), F.col("object_id").cast("string").alias("object_id"), "centroid_x_px", "centroid_y_px", F.when(F.col("area_px") > 400, F.lit("n/a")).otherwise(F.col("area_px").cast("string")).alias("area_px"), "l_tax")
    return contract.enforce_contract(raw, "object").select("schema_version", "table_kind", "object_table_version", "image_id", "object_id", "area_px", "phenotype", "kept", "l_tax")


def p2_filter_objects(spark, d):
    kept = rules.filter_objects(b.objects(spark, d), {"min_area_px": 50, "max_area_px": 450, "min_mean_intensity": 10.0, "min_solidity": 0.95, "min_circularity": 0.2})
    return kept.select("image_no", "object_id", "kept")


def a20_filter_accounting(spark, d):
    before = b.objects(spark, d)
    return rules.filter_accounting(before, rules.filter_objects(before, {"min_area_px": 50, "max_area_px": 450}), "image_no")


def p3_kept_only(spark, d):
    return rules.kept_only(b.objects(spark, d).withColumn("kept", F.when(F.col("l_tax") < 0.02, None).otherwise(F.col("kept")))).select("image_no", "object_id")


def p4_size_filter_relabel(spark, d):
    return rules.size_filter_relabel(b.objects(spark, d), "image_no", "object_id", "area_px", 100, 400).select("image_no", "object_id", "new_label")


def p5_marker_rule_cascade(spark, d):
    o = rules.marker_rule_cascade(b.objects(spark, d), "image_no", F.col("l_tax") > 0.02, F.col("l_discount") > 0.08, {"min_area_px": 50, "max_area_px": 450, "min_circularity": 0.1})
    return o.select("image_no", "object_id", "reason", "new_label")


CLASSES = {
    "bright": {"priority": 50, "include": [{"feature": "mean_intensity", "op": "ge", "value": 50.0}], "exclude": [{"feature": "class.is", "value": "small"}]},
    "small": {"priority": 100, "include": [{"feature": "area_px", "op": "lt", "value": 60}]},
    "round": {"priority": 50, "include": [{"feature": "circularity", "op": "gt", "value": 0.75}, {"feature": "missing", "op": "ge", "value": 0}]},
    "solid": {"priority": 10, "include": [{"feature": "solidity", "op": "ge", "value": 0.97}], "exclude": [{"feature": "class.is", "value": "bright"}]},
}


def p6_assign_phenotypes(spark, d):
    return rules.assign_phenotypes(b.objects(spark, d), CLASSES).select("image_no", "object_id", "phenotype", "phenotype_priority")


def p7_build_frames(spark, d):
    f = geometry.build_frames(b.manifest(spark, d).withColumn("dorsal_x_px", F.col("sample_id") * 3.0), F.col("um_per_px"))
    return f.select("sample_id", *[R6(F.col(c)).alias(c) for c in ("um_per_px", "dorsal_x", "dorsal_y", "temporal_x", "temporal_y")])


def p8_register_points(spark, d):
    return registered(spark, d).select("image_no", "object_id", *[R6(F.col(c)).alias(c) for c in ("ret_x_um", "ret_y_um", "ecc_um", "theta_deg")])


def p9_assign_regions(spark, d):
    return labelled(spark, d).select("image_no", "object_id", *geometry.AXES)


def p10_replay_edits(spark, d):
    log = b.edits(spark, d).withColumn("object_ids", F.when(F.col("op") == "merge_objects", F.array("object_id", "keep_object_id")))
    return rules.replay_edits(b.objects(spark, d), log, "image_no").select("image_no", "object_id", "new_object_id", "phenotype")


def p11_filter_split(spark, d):
    rows = b.rois(spark, d).withColumn("split", F.when(F.col("roi_id") % 5 == 0, " ").otherwise(F.col("split")))
    return rules.filter_split(rows, ["dev, benchmark", "locked_eval"], ["locked_eval"]).select("roi_id", "split")


def p12_mask_lookup_filter(spark, d):
    points = b.objects(spark, d).select("image_no", F.col("object_id").alias("id"), (F.floor(F.col("centroid_x_px") / 8) * 8.0 + 0.5).alias("x"), (F.floor(F.col("centroid_y_px") / 8) * 8 + 0.0).alias("y"))
    return neighbors.mask_lookup_filter(points, b.lattice(spark), "image_no", 1024, 1024).select("image_no", "id")


def p16_snap_roi(spark, d):
    return geometry.snap_roi(b.rois(spark, d), 100, F.lit(1024.0), F.lit(1024.0)).select("roi_id", "snap_x0", "snap_y0")


def p17_roi_bounds_check(spark, d):
    return geometry.roi_bounds_check(b.rois(spark, d), F.lit(1000), F.lit(1000)).select("roi_id", "in_bounds")


def a6_region_summary(spark, d):
    tissue = registered(spark, d, b.tissue(spark, d), "x", "y")
    s = geometry.region_summary(labelled(spark, d), geometry.assign_regions(tissue, SCHEMA, MAX_ECC), SCHEMA, "image_no", 64 * 0.25 / 1e6)
    return s.select("image_no", "region_axis", "region_label", R6(F.col("area_mm2")).alias("area_mm2"), "object_count", F.round("density_cells_per_mm2", 4).alias("density_cells_per_mm2"))


def c11_subtype_scores(spark, d):
    subtypes = {
        "alpha": {"location_priors": {"ring": {"weight": 1.0, "priors": {"central": 0.9, "peripheral": 0.2}}}, "markers": [{"feature": "mean_intensity", "direction": "high", "center": 40.0, "scale": 10.0, "weight": 1.0}]},
        "beta": {"location_priors": {"ring": {"weight": 1.0, "priors": {"central": 0.2, "peripheral": 0.9}}}, "markers": [{"feature": "mean_intensity", "direction": "low", "center": 40.0, "scale": 10.0, "weight": 1.0}]},
    }
    s = rules.subtype_scores(labelled(spark, d), subtypes)
    return s.select("image_no", "object_id", R6(F.col("prob_alpha")).alias("prob_alpha"), R6(F.col("top1_prob")).alias("top1_prob"), R6(F.col("margin")).alias("margin"), "top1")


def _points(spark, d):
    return b.objects(spark, d).select("image_no", F.col("object_id").alias("id"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y"), "phenotype", "kept")


def j5_points_in_rois(spark, d):
    return neighbors.points_in_rois(_points(spark, d), b.rois(spark, d), "image_no")


def j5_roi_point_counts(spark, d):
    return neighbors.roi_point_counts(b.rois(spark, d), neighbors.points_in_rois(_points(spark, d), b.rois(spark, d), "image_no"))


def j6_roi_overlap_pairs(spark, d):
    return neighbors.roi_overlap_pairs(b.rois(spark, d), "image_no")


def j6_overlap_details(spark, d):
    return neighbors.overlap_details(neighbors.roi_overlap_pairs(b.rois(spark, d), "image_no"))


def j11_nearest_any(spark, d):
    p = _points(spark, d)
    return neighbors.nearest(p, p, "image_no", different=True).select("image_no", F.col("a").alias("object_id"), R6(F.col("d")).alias("d"))


def j11_nearest_by_class(spark, d):
    p = _points(spark, d)
    return neighbors.nearest(p, p, "image_no", different=True, keys=["phenotype"]).select("image_no", F.col("a").alias("object_id"), "phenotype", R6(F.col("d")).alias("d"))


def j12_radius_neighbor_counts(spark, d):
    return neighbors.radius_neighbor_counts(_points(spark, d), "image_no", (25, 50, 75, 100))


def w10_split_quota(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("split").orderBy("roi_id"))
    return b.rois(spark, d).withColumn("n", n).where("n <= 17").select("split", "roi_id", F.format_string("%s_%03d", "split", "n").alias("sequence_id"))


_NEAR = "p as (select image_no, object_id as id, centroid_x_px as x, centroid_y_px as y, phenotype from objects)"
QUERIES = {
    "p1_enforce_contract": (p1_enforce_contract, with_tables("objects", "select '1.0.0' as schema_version, 'object' as table_kind, 2 as object_table_version, 'img.' || image_no as image_id, object_id, case when area_px > 400 then null else area_px end as area_px, 'unclassified' as phenotype, true as kept, l_tax from objects")),
    "p2_filter_objects": (p2_filter_objects, with_tables("objects", "select image_no, object_id, area_px between 50 and 450 and mean_intensity >= 10 and solidity >= 0.95 and circularity >= 0.2 as kept from objects")),
    "a20_filter_accounting": (a20_filter_accounting, with_tables("objects", "select image_no, count(*) as n_before, count(*) filter (area_px between 50 and 450) as n_after, count(*) filter (area_px not between 50 and 450) as n_dropped, count(*) filter (area_px not between 50 and 450) > 0 as applied from objects group by 1")),
    "p3_kept_only": (p3_kept_only, with_tables("objects", "select image_no, object_id from objects where l_tax < 0.02 or kept")),
    "p4_size_filter_relabel": (p4_size_filter_relabel, with_tables("objects", "select image_no, object_id, row_number() over (partition by image_no order by object_id) as new_label from objects where area_px between 100 and 400")),
    "p5_marker_rule_cascade": (p5_marker_rule_cascade, with_tables("objects", "+ r as (select *, case when area_px not between 50 and 450 then 'area_out_of_range' when circularity < 0.1 then 'circularity_low' when not l_tax > 0.02 then 'rgc_negative' when l_discount > 0.08 then 'microglia_overlap' else 'kept' end as reason from objects) select image_no, object_id, reason, case when reason = 'kept' then cast(sum(case when reason = 'kept' then 1 else 0 end) over (partition by image_no order by object_id) as bigint) end as new_label from r")),
    "p6_assign_phenotypes": (p6_assign_phenotypes, with_tables("objects", "select image_no, object_id, case when area_px < 60 then 'small' when mean_intensity >= 50 then 'bright' when solidity >= 0.97 then 'solid' else 'unclassified' end as phenotype, case when area_px < 60 then 100 when mean_intensity >= 50 then 50 when solidity >= 0.97 then 10 else -1 end as phenotype_priority from objects")),
    "p7_build_frames": (p7_build_frames, with_tables("manifest", "+ v as (select sample_id, um_per_px, sample_id * 3.0 - 512.0 as dx, -512.0 as dy from manifest), n as (select *, sqrt(cast(dx*dx + dy*dy as double)) as r from v) select sample_id, round(um_per_px, 6) as um_per_px, round(dx/r, 6) as dorsal_x, round(dy/r, 6) as dorsal_y, round(-dy/r, 6) as temporal_x, round(dx/r, 6) as temporal_y from n")),
    "p8_register_points": (p8_register_points, with_tables("objects", "+ " + _REG + " select image_no, object_id, round(ret_x_um, 6) as ret_x_um, round(ret_y_um, 6) as ret_y_um, round(ecc_um, 6) as ecc_um, round(theta_deg, 6) as theta_deg from ecc")),
    "p9_assign_regions": (p9_assign_regions, with_tables("objects", "+ " + _REG + " select image_no, object_id, ring, quadrant, sector, peripapillary_bin from labelled")),
    "p10_replay_edits": (p10_replay_edits, with_tables("objects edits", """+ log as (select *, row_number() over (partition by image_no order by seq) as step from edits),
        n as (select image_no, max(step) as steps from log group by 1)
        , o as (select image_no, object_id, phenotype from objects)
        , walk as (with recursive w as (select image_no, object_id, object_id as label, true as alive, phenotype, 0 as step from o
          union all select w.image_no, w.object_id,
            case when l.op = 'delete_object' and w.label = l.object_id then 0 when l.op = 'merge_objects' and w.label = l.object_id then l.keep_object_id else w.label end,
            w.alive and not (l.op in ('delete_object', 'merge_objects') and w.object_id = l.object_id),
            case when l.op = 'relabel_phenotype' and w.object_id = l.object_id and w.alive then l.phenotype else w.phenotype end, l.step
          from w join log l on l.image_no = w.image_no and l.step = w.step + 1) select * from w),
        done as (select w.* from walk w left join n using (image_no) where w.step = coalesce(n.steps, 0)),
        ids as (select image_no, label, row_number() over (partition by image_no order by label) as new_object_id from (select distinct image_no, label from done where label <> 0))
        select d.image_no, d.object_id, i.new_object_id, d.phenotype from done d join ids i on i.image_no = d.image_no and i.label = d.object_id where d.alive""")),
    "p11_filter_split": (p11_filter_split, with_tables("rois", "+ r as (select roi_id, case when roi_id % 5 = 0 then 'benchmark' else split end as split from rois) select * from r where split in ('dev', 'benchmark')")),
    "p12_mask_lookup_filter": (p12_mask_lookup_filter, with_tables("objects tissue", "select image_no, object_id as id from objects o where exists (select 1 from tissue t where t.image_no = o.image_no and t.x = least(1023, floor(o.centroid_x_px/8)*8) and t.y = floor(o.centroid_y_px/8)*8)")),
    "p16_snap_roi": (p16_snap_roi, with_tables("rois", "select roi_id, cast(greatest(0, least(round_even(x0 + width/2.0, 0) - 50, 924)) as bigint) as snap_x0, cast(greatest(0, least(round_even(y0 + height/2.0, 0) - 50, 924)) as bigint) as snap_y0 from rois")),
    "p17_roi_bounds_check": (p17_roi_bounds_check, with_tables("rois", "select roi_id, x0 >= 0 and y0 >= 0 and x0 + width <= 1000 and y0 + height <= 1000 as in_bounds from rois")),
    "a6_region_summary": (a6_region_summary, with_tables("objects tissue", "+ " + _REG + """, t0 as (select image_no, (x - 512.0)*0.5 as ret_x_um, (512.0 - y)*0.5 as ret_y_um from tissue),
        t1 as (select *, sqrt(ret_x_um*ret_x_um + ret_y_um*ret_y_um) as ecc_um, fmod(degrees(atan2(ret_y_um, ret_x_um)) + 360.0, 360.0) as theta_deg from t0),
        t2 as (select image_no, case when least(ecc_um/400.0, 1.0) <= 0.33 then 'central' when least(ecc_um/400.0, 1.0) <= 0.66 then 'pericentral' else 'peripheral' end as ring,
          (case when ret_y_um >= 0 then 'dorsal' else 'ventral' end) || '_' || (case when ret_x_um >= 0 then 'temporal' else 'nasal' end) as quadrant,
          ['temporal','dorsal_temporal','dorsal','dorsal_nasal','nasal','ventral_nasal','ventral','ventral_temporal'][1 + cast(floor(fmod(theta_deg + 22.5, 360.0)/45.0) as int)] as sector,
          case when least(ecc_um/400.0, 1.0) <= 0.15 then 'peripapillary' else 'non_peripapillary' end as peripapillary_bin from t1),
        tl as (unpivot t2 on ring, quadrant, sector, peripapillary_bin into name region_axis value region_label),
        ol as (unpivot (select image_no, object_id, ring, quadrant, sector, peripapillary_bin from labelled) on ring, quadrant, sector, peripapillary_bin into name region_axis value region_label),
        labels as (select * from (values ('ring','central'),('ring','pericentral'),('ring','peripheral'),('quadrant','dorsal_nasal'),('quadrant','dorsal_temporal'),('quadrant','ventral_nasal'),('quadrant','ventral_temporal'),('sector','temporal'),('sector','dorsal_temporal'),('sector','dorsal'),('sector','dorsal_nasal'),('sector','nasal'),('sector','ventral_nasal'),('sector','ventral'),('sector','ventral_temporal'),('peripapillary_bin','peripapillary'),('peripapillary_bin','non_peripapillary')) v(region_axis, region_label)),
        keys as (select i.image_no, l.* from (select distinct image_no from tissue) i, labels l),
        ta as (select image_no, region_axis, region_label, count(*) * 64 * 0.25 / 1e6 as area_mm2 from tl group by all), oc as (select image_no, region_axis, region_label, count(*) as n from ol group by all)
        select image_no, region_axis, region_label, round(coalesce(area_mm2, 0), 6) as area_mm2, coalesce(n, 0) as object_count, round(case when coalesce(area_mm2, 0) > 0 then coalesce(n, 0) / area_mm2 else 0 end, 4) as density_cells_per_mm2 from keys left join ta using (image_no, region_axis, region_label) left join oc using (image_no, region_axis, region_label)""")),
    "c11_subtype_scores": (c11_subtype_scores, with_tables("objects", "+ " + _REG + """, s as (select image_no, object_id, case ring when 'central' then 0.9 when 'peripheral' then 0.2 end as pa, case ring when 'central' then 0.2 when 'peripheral' then 0.9 end as pb, 1/(1+exp(-greatest(-50, least(50, (mean_intensity-40.0)/10.0)))) as ma, 1/(1+exp(-greatest(-50, least(50, -(mean_intensity-40.0)/10.0)))) as mb from labelled),
        r as (select *, case when pa is null then ma else 0.7*pa + 0.3*ma end as ra, case when pb is null then mb else 0.7*pb + 0.3*mb end as rb from s)
        select image_no, object_id, round(ra/(ra+rb), 6) as prob_alpha, round(greatest(ra, rb)/(ra+rb), 6) as top1_prob, round(abs(ra-rb)/(ra+rb), 6) as margin, case when ra >= rb then 'alpha' else 'beta' end as top1 from r""")),
    "j5_points_in_rois": (j5_points_in_rois, with_tables("objects rois", "select r.roi_id, r.image_no, o.object_id as id, o.centroid_x_px - r.x0 as local_x, o.centroid_y_px - r.y0 as local_y from objects o join rois r on o.image_no = r.image_no and o.centroid_x_px >= r.x0 and o.centroid_x_px < r.x0 + r.width and o.centroid_y_px >= r.y0 and o.centroid_y_px < r.y0 + r.height")),
    "j5_roi_point_counts": (j5_roi_point_counts, with_tables("objects rois", "select r.roi_id, count(o.object_id) as n_points from rois r left join objects o on o.image_no = r.image_no and o.centroid_x_px >= r.x0 and o.centroid_x_px < r.x0 + r.width and o.centroid_y_px >= r.y0 and o.centroid_y_px < r.y0 + r.height group by 1")),
    "j6_roi_overlap_pairs": (j6_roi_overlap_pairs, with_tables("rois", "+ p as (select a.image_no, a.roi_id as roi_a, b.roi_id as roi_b, least(a.x0+a.width, b.x0+b.width) - greatest(a.x0, b.x0) as w, least(a.y0+a.height, b.y0+b.height) - greatest(a.y0, b.y0) as h from rois a join rois b on a.image_no = b.image_no and a.roi_id < b.roi_id) select image_no, roi_a, roi_b, w * h as overlap_px from p where w > 0 and h > 0")),
    "j6_overlap_details": (j6_overlap_details, with_tables("rois", "+ p as (select a.roi_id, b.roi_id as other, least(a.x0+a.width, b.x0+b.width) - greatest(a.x0, b.x0) as w, least(a.y0+a.height, b.y0+b.height) - greatest(a.y0, b.y0) as h from rois a join rois b on a.image_no = b.image_no and a.roi_id <> b.roi_id) select roi_id, string_agg(other || ':' || w * h || 'px', ';' order by other) as overlaps from p where w > 0 and h > 0 group by 1")),
    "j11_nearest_any": (j11_nearest_any, with_tables("objects", "+ " + _NEAR + " select a.image_no, a.id as object_id, round(sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))), 6) as d from p a join p b on a.image_no = b.image_no and a.id <> b.id group by 1, 2")),
    "j11_nearest_by_class": (j11_nearest_by_class, with_tables("objects", "+ " + _NEAR + " select a.image_no, a.id as object_id, b.phenotype, round(sqrt(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))), 6) as d from p a join p b on a.image_no = b.image_no and a.id <> b.id group by 1, 2, 3")),
    "j12_radius_neighbor_counts": (j12_radius_neighbor_counts, with_tables("objects", "+ " + _NEAR + ", r as (select unnest([25.0, 50.0, 75.0, 100.0])::double as radius), q as (select a.image_no, a.id, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2 from p a join p b on a.image_no = b.image_no and a.id <> b.id), c as (select image_no, id, radius, count(*) as n from q, r where d2 <= radius*radius group by all) select p.image_no, p.id, r.radius, coalesce(c.n, 0) as neighbors from p cross join r left join c on c.image_no = p.image_no and c.id = p.id and c.radius = r.radius")),
    "w10_split_quota": (w10_split_quota, with_tables("rois", "+ r as (select *, row_number() over (partition by split order by roi_id) as n from rois) select split, roi_id, split || '_' || printf('%03d', n) as sequence_id from r where n <= 17")),
}
