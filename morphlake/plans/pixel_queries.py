"""Queries on pixel tables, matching and tracks, each with its SQL where it is no search."""

from __future__ import annotations

from pyspark.sql import functions as F

from morphlake.operators import geometry, graph, matching, pixels, rules, track
from morphlake.operators.neighbors import near_pairs
from morphlake.plans import region_queries as rq
from morphlake.sources import bindings as b
from morphlake.sources.bindings import with_tables
from morphlake.sources.storage import cut

R = lambda c, n=6: F.round(c, n).alias(c)


def _labels(spark, d):
    label = F.when(F.col("value") > 0, 1 + F.floor(F.col("x") / 4) + 2 * F.floor(F.col("y") / 4)).otherwise(0)
    return b.pixels(spark, d).withColumns({"label": label, "in_focus": F.col("x") >= 2})


_L = "l as (select *, case when value > 0 then 1 + x // 4 + 2 * (y // 4) else 0 end as label, x >= 2 as in_focus from pixels)"


def _slices(spark, d):
    return b.pixels(spark, d).select(F.floor(F.col("image_no") / 10).alias("stack"), (F.col("image_no") % 10).alias("z"), "y", "x", "value")


_S = "s as (select image_no // 10 as stack, image_no % 10 as z, y, x, value from pixels)"


def s10_explode_image(spark, d):
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return pixels.explode_image(b.table(spark, d, "embeddings").select("vec_id", rows.alias("image")), "vec_id", "image").select("vec_id", F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("value").cast("double").alias("value"))


def a21_image_profile(spark, d):
    return pixels.image_profile(b.pixels(spark, d), "image_no")


def p18_robust_rescale(spark, d):
    return pixels.robust_rescale(b.pixels(spark, d), "image_no").select("image_no", "y", "x", R("scaled"))


def p19_compose_channels(spark, d):
    wide = b.pixels(spark, d).groupBy("image_no", "y").pivot("x", list(range(8))).agg(F.first("value"))
    return wide.select("image_no", "y", F.round(pixels.compose_channels(wide, {"0": 1.0, "3": 0.5, "5": 2.0}, "max"), 6).alias("brightest"), F.round(pixels.compose_channels(wide, {"0": 1.0, "3": 0.5}, "sum"), 6).alias("total"))


def p20_threshold_masks(spark, d):
    return b.pixels(spark, d).select("image_no", "y", "x", pixels.threshold_mask(0.05).alias("mask"))


def a1_count_density(spark, d):
    return pixels.count_density(_labels(spark, d), "image_no", 0.227).select("image_no", "cell_count", F.round("area_mm2", 12).alias("area_mm2"), R("density", 3))


def a2_object_table(spark, d):
    t = pixels.object_table(_labels(spark, d), "image_no")
    return t.select("image_no", "label", "area_px", R("cy"), R("cx"), "y0", "x0", "y1", "x1", "focus_px", R("focus_fraction"), R("mean_intensity"), R("max_intensity"), "perimeter_px", R("circularity"), R("eccentricity"))


def a2_local_contrast(spark, d):
    return pixels.local_contrast(_labels(spark, d), "image_no").select("image_no", "label", R("local_contrast"))


def a3_uncertainty_summary(spark, d):
    return pixels.uncertainty_summary(_labels(spark, d), "image_no").select("image_no", "label", R("mean_p"), R("std_p"), R("p10"))


def a4_marker_metrics(spark, d):
    rows = _labels(spark, d).withColumn("inverse", 1 - F.col("value"))
    m = pixels.marker_metrics(rows, "image_no", ["value", "inverse"], {"bright": F.col("value") >= 0.1})
    return m.select("image_no", "label", R("mean_value"), R("max_value"), R("sum_inverse"), R("overlap_bright"), R("mean_z_value"))


def a5_label_centroids(spark, d):
    return pixels.label_centroids(_labels(spark, d), "image_no").select("image_no", "label", R("cy"), R("cx"))


def p4_label_relabel(spark, d):
    sizes = _labels(spark, d).where("label > 0").groupBy("image_no", "label").agg(F.count(F.lit(1)).alias("size"))
    return rules.size_filter_relabel(sizes, "image_no", "label", "size", 6, 10).select("image_no", "label", "new_label")


def j14_distance_to_mask(spark, d):
    rows = _labels(spark, d)
    return pixels.distance_to_mask(pixels.label_centroids(rows, "image_no"), rows.where("value >= 0.2"), "image_no").select("image_no", "label", R("distance"))


def a10_otsu_threshold(spark, d):
    return pixels.otsu_threshold(b.pixels(spark, d), "image_no", 16).select("image_no", R("threshold"))


def _raster(spark, d):
    """Images of 32 by 32 pixels: each pixel of the small ones as a block of 4 by 4."""
    step = lambda c: F.explode(F.sequence(F.col(c) * 4, F.col(c) * 4 + 3)).alias(c)
    return b.pixels(spark, d).select("image_no", "value", "x", step("y")).select("image_no", "value", "y", step("x"))


_RASTER = "ra as (select image_no, y*4 + a.range as y, x*4 + c.range as x, value from pixels, range(4) a, range(4) c)"
_OTSU = "lh as (select image_no, min(value) as lo, max(value) as hi from {t} group by 1), hb as (select image_no, lo, hi, case when hi > lo then cast(least({n} - 1, floor((value - lo)/(hi - lo)*{n})) as int) else 0 end as bin, count(*) as n from {t} join lh using (image_no) group by all), hv as (select *, lo + (bin + 0.5::double)*(hi - lo)/{n} as v from hb), hw as (select *, sum(n) over u as w0, sum(n*v) over u as m0, sum(n) over (partition by image_no) as w, sum(n*v) over (partition by image_no) as m from hv window u as (partition by image_no order by bin)), hg as (select *, coalesce(w0*(w-w0)*pow(m0/w0 - (m-m0)/nullif(w-w0, 0), 2), -1) as between_var from hw), th as (select image_no, v as threshold from (select *, row_number() over (partition by image_no order by round(between_var, 9) desc, bin) as k from hg) where k = 1)"


def _box_sql(step, source, half, erode):
    """SQL of one step of morphology: along rows, then along columns; an erosion gives 0 where its box leaves the image."""
    frame = f"rows between {half} preceding and {half} following"
    value = f"case when count(*) over w = {2 * half + 1} then min(o) over w else 0 end" if erode else "max(o) over w"
    rows = f"{step}r as (select image_no, y, x, {value} as o from {source} window w as (partition by image_no, y order by x {frame}))"
    return f"{rows}, {step} as (select image_no, y, x, {value} as o from {step}r window w as (partition by image_no, x order by y {frame}))"


_STEPS = ((2, True), (2, False), (4, False), (4, True))
_MASK = "m0 as (select image_no, y, x, case when value > threshold then 1 else 0 end as o from ra join th using (image_no)), " + ", ".join(_box_sql(f"m{i + 1}", f"m{i}", *s) for i, s in enumerate(_STEPS))


def a10_tissue_mask(spark, d):
    return pixels.tissue_mask(_raster(spark, d), "image_no", 2, 4).select("image_no", "y", "x", "on")


def a11_tissue_coverage(spark, d):
    mask = b.pixels(spark, d).withColumn("on", (F.col("value") > 0.02).cast("int"))
    return pixels.tissue_coverage(mask, "image_no", 3.5, 3.5).select("image_no", R("mask_fraction"), R("disc_coverage"))


def w12_box_morphology(spark, d):
    mask = b.pixels(spark, d).withColumn("on", (F.col("value") > -0.05).cast("int"))
    opened = pixels.box_morphology(pixels.box_morphology(mask, "image_no", 1, True), "image_no", 1, False)
    return opened.select("image_no", "y", "x", "on")


def w13_stencils(spark, d):
    return pixels.stencils(b.pixels(spark, d), ["image_no"]).select("image_no", "y", "x", R("lap"), R("grad2"))


def a13_tile_focus_qc(spark, d):
    return pixels.tile_focus_qc(b.pixels(spark, d), "image_no", 4, -0.05, 0.05).select("image_no", "ty", "tx", R("brightness"), R("lap_var"), R("tenengrad"), R("score"), "in_focus")


def a15_slice_focus(spark, d):
    return pixels.slice_focus(_slices(spark, d), "stack").select("stack", "z", R("focus"), R("mean"), R("p99"))


def w4_slab_catalog(spark, d):
    focus = _slices(spark, d).groupBy("stack", "z").agg(F.avg(F.col("value") * F.col("value")).alias("focus"))
    return pixels.slab_catalog(focus, "stack", (3, 6, 24), 2).select("stack", "size", "start", R("mean_focus", 9), R("max_focus", 9), "rank", "is_best")


def a16_project_max(spark, d):
    return pixels.project_z(_slices(spark, d), "stack", "max").select("stack", "y", "x", R("value"))


def a16_project_percentile(spark, d):
    return pixels.project_z(_slices(spark, d), "stack", "percentile", q=0.3).select("stack", "y", "x", R("value"))


def a16_project_weighted(spark, d):
    w = _slices(spark, d).groupBy("stack", "z").agg(F.avg("value").alias("weight"))
    return pixels.project_z(_slices(spark, d), "stack", "weighted", w).select("stack", "y", "x", R("value"))


def j24_apply_projection_recipe(spark, d):
    focus = _slices(spark, d).groupBy("stack", "z").agg(F.avg(F.col("value") * F.col("value")).alias("focus"))
    recipes = spark.createDataFrame([("all", "full", 0), ("best3", "best_slab", 3)], "recipe string, kind string, size int")
    return pixels.apply_projection_recipe(_slices(spark, d), recipes, pixels.slab_catalog(focus, "stack", (3, 6), 2), "stack").select("recipe", "stack", "y", "x", R("value"))


def t6_topk_focus_slices(spark, d):
    from morphlake.operators.evaluation import top_candidates

    focus = _slices(spark, d).groupBy("stack", "z").agg(F.round(F.avg(F.col("value") * F.col("value")), 9).alias("focus"))
    return top_candidates(focus, "stack", [F.desc("focus"), F.asc("z")], 3)


def a17_tta_vote(spark, d):
    p = b.pixels(spark, d)
    t = F.element_at(F.array(F.lit("identity"), F.lit("flip_h"), F.lit("flip_v"), F.lit("rot90")), (F.col("image_no") % 4 + 1).cast("int"))
    votes = p.select(F.floor(F.col("image_no") / 4).alias("image"), t.alias("transform"), "y", "x", (F.col("value") > 0).alias("on"))
    return pixels.tta_vote(votes, "image", 8, 8).select("image", "y", "x", R("probability"), "mask")


def a19_overlap_scores(spark, d):
    p = _labels(spark, d)
    other = p.withColumn("label", F.when(F.col("value") > 0.05, 1).otherwise(0)).where("y > 0")
    return pixels.overlap_scores(p, other, "image_no").select("image_no", R("dice"), R("iou"))


def j16_tile_overlap_pairs(spark, d):
    p = _labels(spark, d)
    left = p.where("x < 6").select("image_no", F.lit(0).alias("tile"), "y", "x", "label")
    right = p.where("x >= 2").select("image_no", F.lit(1).alias("tile"), "y", "x", F.when(F.col("value") > -0.02, 1 + F.floor(F.col("y") / 4)).otherwise(0).alias("label"))
    return pixels.tile_overlap_pairs(left.unionByName(right), least=3)


def g4_pixel_components(spark, d):
    return graph.pixel_components(b.pixels(spark, d).where("value > 0.03"), "image_no").groupBy("image_no", "instance").agg(F.count(F.lit(1)).alias("size"))


_COMPONENTS = "+ f as (select image_no, y, x, y*8 + x as id from pixels where value > 0.03), st as (select a.image_no, a.id as a, b.id as b from f a join f b on a.image_no = b.image_no and abs(a.y - b.y) + abs(a.x - b.x) = 1), re as (select image_no, id as start, id from f union select re.image_no, re.start, st.b from re join st on st.image_no = re.image_no and st.a = re.id), ro as (select image_no, id, min(start) as root from re group by 1, 2) select image_no, dense_rank() over (partition by image_no order by root) as instance, count(*) as size from ro group by image_no, root"


def a18_density_grid(spark, d):
    cells = spark.range(16).select((F.col("id") * 64.0).alias("x")).crossJoin(spark.range(16).select((F.col("id") * 64.0).alias("y")))
    grid = b.images(spark, d).crossJoin(F.broadcast(cells))
    return pixels.density_grid(rq._points(spark, d), grid, "image_no", 50.0).select("image_no", "x", "y", R("density"))


def a18_hexbin(spark, d):
    return pixels.hexbin(rq._points(spark, d), "image_no", 100.0).groupBy("image_no").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("n").alias("n_points"))


def p15_physical_to_pixel(spark, d):
    dims = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_no"), *[x for a in "xyz" for x in (F.lit(0.0).alias(f"{a}_min"), (F.col("s_suppkey") % 7 + 1.0).alias(f"{a}_max"), F.lit(64.0).alias(f"{a}_count"))], F.when(F.col("s_suppkey") % 2 == 0, "mm").otherwise("um").alias("unit"))
    p = b.objects(spark, d).select("image_no", "object_id", (F.col("centroid_x_px") / 200).alias("x_um"), (F.col("centroid_y_px") / 200).alias("y_um"), F.lit(0.5).alias("z_um"))
    return geometry.physical_to_pixel(p, dims, "image_no").select("image_no", "object_id", R("x_px"), R("y_px_clipped"), "inside_bounds")


_DIMS = "d as (select s_suppkey as image_no, s_suppkey % 7 + 1.0::double as mx, case when s_suppkey % 2 = 0 then 1000.0::double else 1.0 end as u from supplier)"


def _pairs(spark, d):
    counts = b.objects(spark, d).groupBy(F.col("image_no").alias("sample_id")).agg(F.count(F.lit(1)).alias("n_objects"))
    return track.consecutive_samples(b.manifest(spark, d), counts)


def _track_points(spark, d):
    return rq._points(spark, d).select("image_no", "id", "x", "y")


def _given(spark, d):
    """Matches of consecutive samples that SQL can tell as well: pairs within 20 px that are each other's nearest."""
    before, after = track._sides(_pairs(spark, d), _track_points(spark, d))
    return matching.mutual_nearest(near_pairs(before, after, "pair", 20.0), "pair")


def k3_given_matches(spark, d):
    q = track.pair_qc(_pairs(spark, d), _given(spark, d))
    return q.select("sample_id", "prev_sample_id", "n_matched", R("matched_fraction"), R("mean_d"), R("median_d"), "unmatched_prev", "unmatched_cur")


def k4_given_matches(spark, d):
    return track.follow_samples(b.manifest(spark, d), _pairs(spark, d), _track_points(spark, d), 20.0, mutual=True).select("sample_id", "object_id", "track_id", R("displacement"))


def k5_given_modes(spark, d):
    pairs = _pairs(spark, d)
    shifts = track.estimate_shift(pairs, _track_points(spark, d), 30.0)
    used = shifts.withColumn("used", F.when(F.col("dx").isNull(), "fallback_missing").when(F.col("pair") % 3 > 0, "registered").otherwise("fallback_no_improvement"))
    return track.common_frame(pairs, used).select("sample_id", "segment", R("offset_x"), R("offset_y"))


def k6_given_matches(spark, d):
    tracks = track.follow_samples(b.manifest(spark, d), _pairs(spark, d), _track_points(spark, d), 20.0, mutual=True)
    t = track.track_summary(tracks, track.pair_qc(_pairs(spark, d), track.track_pairs(tracks)))
    return t.select("animal_id", "eye", "n_tracks", "n_observations", "n_pairs", R("mean_displacement"), R("mean_matched_fraction"))


def _given_sets(spark, d):
    truth, found = _sets(spark, d)
    return truth, found, matching.mutual_nearest(near_pairs(truth, found, "roi_id", 12.0), "roi_id")


def b1_given_matches(spark, d):
    return matching.match_metrics(*_given_sets(spark, d), ["roi_id"], [2.0, 8.0]).select("roi_id", "tolerance", "tp", "fp", "fn", R("precision"), R("recall"), R("f1"), "count_bias", "count_abs", R("mean_distance"))


def b2_given_matches(spark, d):
    m = matching.match_metrics(*_given_sets(spark, d), ["roi_id"], [1.0, 6.0, 10.0])
    return m.groupBy("tolerance").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])


def j23_given_matches(spark, d):
    truth, _, matches = _given_sets(spark, d)
    return matching.unmatched(truth.select("roi_id", "id", "x", "y"), matches.where("d <= 8"), ["roi_id"], "a")


def b12_given_matches(spark, d):
    truth, found, matches = _given_sets(spark, d)
    return matching.curation_delta(truth, found, ["roi_id"], 8.0, matches)


_CONSECUTIVE = """oc as (select image_no as sample_id, count(*) as n from objects group by 1), mp as (select m.*, lag(m.sample_id) over w as prev, coalesce(n, 0) as n_cur, lag(coalesce(n, 0)) over w as n_prev from manifest m left join oc using (sample_id) window w as (partition by animal_id, eye order by timepoint_dpi, m.sample_id)),
 op as (select image_no, object_id as id, centroid_x_px as x, centroid_y_px as y from objects)"""
_NEARBY = ", nr as (select mp.sample_id as pair, a.id as a, b.id as b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2, a.x-b.x as mx, a.y-b.y as my from mp join op a on a.image_no = mp.prev join op b on b.image_no = mp.sample_id where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= {0}*{0})"
_MUTUAL = ", mu as (select {0}, a, b, sqrt(d2) as d from (select *, row_number() over (partition by {0}, a order by d2, b) as ra, row_number() over (partition by {0}, b order by d2, a) as rb from nr) where ra = 1 and rb = 1)"
_QC = ", qc as (select animal_id, eye, mp.sample_id, prev as prev_sample_id, n_cur, n_prev, coalesce(k, 0) as n_matched, mean_d, median_d, case when least(n_prev, n_cur) > 0 then coalesce(k, 0) / least(n_prev, n_cur) end as fraction from mp left join (select pair, count(*) as k, avg(d) as mean_d, median(d) as median_d from mu group by 1) g on g.pair = mp.sample_id where prev is not null)"
_TRACKS = """, st as (select op.image_no as sample_id, op.id as object_id, mp.prev, mu.a, mu.d, animal_id, eye, timepoint_dpi from op join mp on mp.sample_id = op.image_no left join mu on mu.pair = op.image_no and mu.b = op.id),
 bg as (select *, row_number() over (order by animal_id, eye, timepoint_dpi, sample_id, object_id) as track_id from st where a is null),
 tr as (select sample_id, object_id, track_id from bg union all select st.sample_id, st.object_id, tr.track_id from tr join st on st.prev = tr.sample_id and st.a = tr.object_id)"""
_SHIFT = """, bn as (select pair, cast(floor(mx/2) as bigint) as ux, cast(floor(my/2) as bigint) as uy, count(*) as votes, avg(mx) as dx, avg(my) as dy from nr group by 1, 2, 3),
 bs as (select pair, dx, dy, votes from (select *, row_number() over (partition by pair order by votes desc, abs(ux) + abs(uy), ux desc, uy desc) as k from bn) where k = 1),
 sh as (select mp.sample_id as pair, dx, dy, votes, case when votes is null then 'missing' else 'estimated' end as status from mp left join bs on bs.pair = mp.sample_id where prev is not null)"""
_ROI_SETS = """ins as (select r.roi_id, o.object_id as id, o.centroid_x_px - r.x0 as x, o.centroid_y_px - r.y0 as y, kept, l_discount from objects o join rois r on r.image_no = o.image_no and o.centroid_x_px >= r.x0 and o.centroid_x_px < r.x0 + r.width and o.centroid_y_px >= r.y0 and o.centroid_y_px < r.y0 + r.height),
 tru as (select roi_id, id, x, y from ins where kept), fou as (select roi_id, id, x + 1 as x, y from ins where l_discount > 0.02),
 nr as (select a.roi_id, a.id as a, b.id as b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) as d2 from tru a join fou b using (roi_id) where (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 144)""" + _MUTUAL.format("roi_id")
_ROI_METRICS = """, nn as (select roi_id, coalesce(nt, 0) as nt, coalesce(nf, 0) as nf from (select roi_id, count(*) as nt from tru group by 1) full join (select roi_id, count(*) as nf from fou group by 1) using (roi_id)),
 mt as (select roi_id, tolerance, nt, nf, count(d) as tp, avg(d) as mean_distance from (select nn.*, unnest([{0}])::double as tolerance from nn) t left join mu using (roi_id) where d is null or d <= tolerance group by all union all
  select roi_id, tolerance, nt, nf, 0, null from (select nn.*, unnest([{0}])::double as tolerance from nn) t where exists (select 1 from mu where mu.roi_id = t.roi_id) and not exists (select 1 from mu where mu.roi_id = t.roi_id and d <= tolerance)),
 pr as (select *, coalesce(tp / nullif(nf, 0), 0) as precision, coalesce(tp / nullif(nt, 0), 0) as recall from mt), fs as (select *, coalesce(2*precision*recall / nullif(precision + recall, 0), 0) as f1 from pr)"""


def j20_consecutive_samples(spark, d):
    return _pairs(spark, d)


def j9a_gated_candidates(spark, d):
    before, after = track._sides(_pairs(spark, d), _track_points(spark, d))
    return near_pairs(before, after, "pair", 20.0)


def j9b_gated_assignment(spark, d):
    return track.match_samples(_pairs(spark, d), _track_points(spark, d), 20.0)


def k1_estimate_shift(spark, d):
    return track.estimate_shift(_pairs(spark, d), _track_points(spark, d), 30.0).withColumns({"dx": F.round("dx", 6), "dy": F.round("dy", 6)})


def _modes(spark, d):
    return track.register_samples(_pairs(spark, d), _track_points(spark, d), 10.0, 30.0)


def k2_choose_mode(spark, d):
    return _modes(spark, d).select("pair", "n_raw", "n_reg", "used")


def k3_pair_qc(spark, d):
    return track.pair_qc(_pairs(spark, d), j9b_gated_assignment(spark, d))


def k4_track_ids(spark, d):
    return track.follow_samples(b.manifest(spark, d), _pairs(spark, d), _track_points(spark, d), 20.0)


def k5_common_frame(spark, d):
    return track.common_frame(_pairs(spark, d), _modes(spark, d))


def k6_track_summary(spark, d):
    tracks = track.follow_samples(b.manifest(spark, d), _pairs(spark, d), _track_points(spark, d), 20.0)
    return track.track_summary(tracks, track.pair_qc(_pairs(spark, d), track.track_pairs(tracks)))


def _sets(spark, d):
    from morphlake.operators.neighbors import points_in_rois

    o = b.objects(spark, d).select("image_no", F.struct("object_id", "kept", "l_discount").alias("id"), F.col("centroid_x_px").alias("x"), F.col("centroid_y_px").alias("y"))
    inside = points_in_rois(o, b.rois(spark, d), "image_no")
    inside = cut(inside.select("roi_id", F.col("id.object_id").alias("id"), F.col("local_x").alias("x"), F.col("local_y").alias("y"), "image_no", "id.kept", "id.l_discount"))
    return inside.where("kept"), inside.where("l_discount > 0.02").withColumn("x", F.col("x") + 1)


def j10_point_match(spark, d):
    truth, found = _sets(spark, d)
    return matching.point_match(truth, found, ["roi_id"])


def b1_match_metrics(spark, d):
    truth, found = _sets(spark, d)
    return matching.match_metrics(truth, found, matching.point_match(truth, found, ["roi_id"]), ["roi_id"], [8.0])


def b2_tolerance_sweep(spark, d):
    truth, found = _sets(spark, d)
    m = matching.match_metrics(truth, found, matching.point_match(truth, found, ["roi_id"]), ["roi_id"], [6.0, 8.0, 10.0])
    return m.groupBy("tolerance").agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "f1")])


def j23_unmatched(spark, d):
    truth, found = _sets(spark, d)
    return matching.unmatched(truth.select("roi_id", "id", "x", "y"), matching.point_match(truth, found, ["roi_id"]).where("d <= 8"), ["roi_id"], "a")


def b12_curation_delta(spark, d):
    truth, found = _sets(spark, d)
    return matching.curation_delta(truth, found, ["roi_id"], 1.5)


_BORDER = "k as (select *, coalesce(lag(value) over (r order by x), lead(value) over (r order by x)) as l, coalesce(lead(value) over (r order by x), lag(value) over (r order by x)) as rr from t window r as (partition by {p}, y)), g as (select *, l + 2*value + rr as sm, rr - l as gx from k), v as (select *, coalesce(lag(value) over (c order by y), lead(value) over (c order by y)) as u, coalesce(lead(value) over (c order by y), lag(value) over (c order by y)) as dn, coalesce(lead(sm) over (c order by y), lag(sm) over (c order by y)) - coalesce(lag(sm) over (c order by y), lead(sm) over (c order by y)) as gyy, coalesce(lag(gx) over (c order by y), lead(gx) over (c order by y)) + 2*gx + coalesce(lead(gx) over (c order by y), lag(gx) over (c order by y)) as gxx from g window c as (partition by {p}, x)), st as (select *, l + rr + u + dn - 4*value as lap, gxx*gxx + gyy*gyy as grad2 from v)"
_SCALED = "pc as (select {k}, quantile_cont(value, 0.01) as a, quantile_cont(value, 0.995) as b, min(value) as mn, max(value) as mx from {t} group by all), bo as (select *, case when b <= a then mn else a end as lo, case when b <= a then mx else b end as h0 from pc), bb as (select *, case when h0 <= lo then lo + 1 else h0 end as hi from bo), sc as (select t0.*, least(1.0, greatest(0.0, (value - lo)/greatest(hi - lo, 1e-6))) as scaled from {t} t0 join bb using ({k}))"
_FOCUS = "fo as (select stack, z, avg(value*value) as focus from s group by 1, 2)"
QUERIES = {
    "s10_explode_image": (s10_explode_image, with_tables("pixels", "select image_no as vec_id, y, x, value from pixels")),
    "a21_image_profile": (a21_image_profile, with_tables("pixels", "select image_no, max(y) + 1 as height, max(x) + 1 as width, count(*) as n_pixels from pixels group by 1")),
    "p18_robust_rescale": (p18_robust_rescale, with_tables("pixels", "+ " + _SCALED.format(k="image_no", t="pixels") + " select image_no, y, x, round(scaled, 6) as scaled from sc")),
    "p19_compose_channels": (p19_compose_channels, with_tables("pixels", "+ w as (select image_no, y, max(value) filter (x = 0) as a, max(value) filter (x = 3) as b, max(value) filter (x = 5) as c from pixels group by 1, 2) select image_no, y, round(greatest(a, 0.5*b, 2*c), 6) as brightest, round(a + 0.5*b, 6) as total from w")),
    "p20_threshold_masks": (p20_threshold_masks, with_tables("pixels", "select image_no, y, x, value >= 0.05 as mask from pixels")),
    "a1_count_density": (a1_count_density, with_tables("pixels", "+ " + _L + ", s as (select image_no, count(distinct case when label > 0 then label end) as n, count(*) filter (in_focus) * (0.227::double*0.227/1e6) as a from l group by 1) select image_no, n as cell_count, round(a, 12) as area_mm2, round(case when a > 0 then n/a else 0 end, 3) as density from s")),
    "a2_object_table": (a2_object_table, with_tables("pixels", "+ " + _L + """, o as (select image_no, label, count(*) as area_px, avg(y) as cy, avg(x) as cx, min(y) as y0, min(x) as x0, max(y)+1 as y1, max(x)+1 as x1, count(*) filter (in_focus) as focus_px, avg(value) as mi, max(value) as ma, var_pop(y) + 1/12 as va, var_pop(x) + 1/12 as vb, covar_pop(x, y) as vc from l where label > 0 group by 1, 2),
        f as (select a.image_no, a.label, count(*) as perimeter_px from l a, (values (1,0),(-1,0),(0,1),(0,-1)) v(dy, dx) where a.label > 0 and not exists (select 1 from l b where b.image_no = a.image_no and b.label = a.label and b.y = a.y + dy and b.x = a.x + dx) group by 1, 2)
        select image_no, label, area_px, round(cy, 6) as cy, round(cx, 6) as cx, y0, x0, y1, x1, focus_px, round(focus_px/area_px, 6) as focus_fraction, round(mi, 6) as mean_intensity, round(ma, 6) as max_intensity, perimeter_px, round(4*pi()*area_px/(perimeter_px*perimeter_px), 6) as circularity, round(sqrt(greatest(0, 1 - (va+vb-sqrt((va-vb)*(va-vb)+4*vc*vc))/(va+vb+sqrt((va-vb)*(va-vb)+4*vc*vc)))), 6) as eccentricity from o join f using (image_no, label)""")),
    "a2_local_contrast": (a2_local_contrast, with_tables("pixels", "+ " + _L + ", bx as (select image_no, label, min(y)-3 as y0, max(y)+3 as y1, min(x)-3 as x0, max(x)+3 as x1 from l where label > 0 group by 1, 2) select bx.image_no, bx.label, round(coalesce(avg(value) filter (l.label = bx.label) - avg(value) filter (l.label <> bx.label), 0), 6) as local_contrast from bx join l on l.image_no = bx.image_no and y between y0 and y1 and x between x0 and x1 group by 1, 2")),
    "a3_uncertainty_summary": (a3_uncertainty_summary, with_tables("pixels", "+ " + _L + " select image_no, label, round(avg(value), 6) as mean_p, round(stddev_pop(value), 6) as std_p, round(quantile_cont(value, 0.1), 6) as p10 from l where label > 0 group by 1, 2")),
    "a4_marker_metrics": (a4_marker_metrics, with_tables("pixels", "+ " + _L + ", m as (select image_no, label, avg(value) as a, max(value) as b, sum(1 - value) as c, avg(case when value >= 0.1 then 1.0::double else 0 end) as o from l where label > 0 group by 1, 2), z as (select *, avg(a) over (partition by image_no) as za, stddev_pop(a) over (partition by image_no) as zs from m) select image_no, label, round(a, 6) as mean_value, round(b, 6) as max_value, round(c, 6) as sum_inverse, round(o, 6) as overlap_bright, round(case when zs > 1e-12 then (a - za)/zs else 0 end, 6) as mean_z_value from z")),
    "a5_label_centroids": (a5_label_centroids, with_tables("pixels", "+ " + _L + " select image_no, label, round(avg(y), 6) as cy, round(avg(x), 6) as cx from l where label > 0 group by 1, 2")),
    "p4_label_relabel": (p4_label_relabel, with_tables("pixels", "+ " + _L + ", z as (select image_no, label, count(*) as n from l where label > 0 group by 1, 2) select image_no, label, row_number() over (partition by image_no order by label) as new_label from z where n between 6 and 10")),
    "j14_distance_to_mask": (j14_distance_to_mask, with_tables("pixels", "+ " + _L + ", c as (select image_no, label, avg(y) as cy, avg(x) as cx from l where label > 0 group by 1, 2) select c.image_no, c.label, round(min(sqrt((cx-x)*(cx-x) + (cy-y)*(cy-y))), 6) as distance from c join l on l.image_no = c.image_no and value >= 0.2 group by 1, 2")),
    "a10_otsu_threshold": (a10_otsu_threshold, with_tables("pixels", "+ " + _OTSU.format(t="pixels", n=16) + " select image_no, round(threshold, 6) as threshold from th")),
    "a10_tissue_mask": (a10_tissue_mask, with_tables("pixels", "+ " + _RASTER + ", " + _OTSU.format(t="ra", n=64) + ", " + _MASK + " select image_no, y, x, o as \"on\" from m4")),
    "a11_tissue_coverage": (a11_tissue_coverage, with_tables("pixels", "+ m as (select image_no, avg(case when value > 0.02 then 1.0::double else 0 end) as f, count(*) filter (value > 0.02) as n, max(sqrt((x-3.5)*(x-3.5) + (y-3.5)*(y-3.5))) filter (value > 0.02) as r from pixels group by 1) select image_no, round(f, 6) as mask_fraction, round(coalesce(n/(pi()*r*r), 0), 6) as disc_coverage from m")),
    "w12_box_morphology": (w12_box_morphology, with_tables("pixels", "+ m as (select image_no, y, x, case when value > -0.05 then 1 else 0 end as o from pixels), e as (select a.image_no, a.y, a.x, case when count(*) = 9 then min(b.o) else 0 end as o from m a join m b on a.image_no = b.image_no and abs(a.y-b.y) <= 1 and abs(a.x-b.x) <= 1 group by 1, 2, 3) select a.image_no, a.y, a.x, max(b.o) as on from e a join e b on a.image_no = b.image_no and abs(a.y-b.y) <= 1 and abs(a.x-b.x) <= 1 group by 1, 2, 3".replace(" as on ", ' as "on" '))),
    "w13_stencils": (w13_stencils, with_tables("pixels", "+ t as (select * from pixels), " + _BORDER.format(p="image_no") + " select image_no, y, x, round(lap, 6) as lap, round(grad2, 6) as grad2 from st")),
    "a13_tile_focus_qc": (a13_tile_focus_qc, with_tables("pixels", "+ t as (select *, y // 4 as ty, x // 4 as tx from pixels), " + _BORDER.format(p="image_no, ty, tx") + ", q as (select image_no, ty, tx, avg(value) as br, var_pop(lap) as lv, avg(grad2) as tg from st group by 1, 2, 3), z as (select *, (lv - avg(lv) over w)/case when stddev_pop(lv) over w > 1e-12 then stddev_pop(lv) over w else 1 end as z1, (tg - avg(tg) over w)/case when stddev_pop(tg) over w > 1e-12 then stddev_pop(tg) over w else 1 end as z2 from q window w as (partition by image_no)) select image_no, ty, tx, round(br, 6) as brightness, round(lv, 6) as lap_var, round(tg, 6) as tenengrad, round((z1+z2)/2, 6) as score, br between -0.05 and 0.05 and (z1+z2)/2 >= 0 as in_focus from z")),
    "a15_slice_focus": (a15_slice_focus, with_tables("pixels", "+ " + _S + ", " + _SCALED.format(k="stack, z", t="s") + ", t as (select stack, z, y, x, scaled as value from sc), " + _BORDER.format(p="stack, z") + " select stack, z, round(avg(grad2), 6) as focus, round(avg(value), 6) as mean, round(quantile_cont(value, 0.99), 6) as p99 from st group by 1, 2")),
    "w4_slab_catalog": (w4_slab_catalog, with_tables("pixels", "+ " + _S + ", " + _FOCUS + ", n as (select stack, max(z)+1 as n from fo group by 1), sz as (select distinct stack, n, least(u, n) as size from n, (select unnest([3, 6, 24]) as u)), st as (select distinct stack, size, start from (select stack, size, unnest(range(0, n - size + 1, 2)) as start from sz union all select stack, size, n - size from sz)), w as (select st.stack, size, start, avg(focus) as mf, max(focus) as xf from st join fo on fo.stack = st.stack and z >= start and z < start + size group by 1, 2, 3), k as (select *, row_number() over (partition by stack, size order by mf desc, xf desc, start) as rank from w) select stack, size, start, round(mf, 9) as mean_focus, round(xf, 9) as max_focus, rank, rank = 1 as is_best from k")),
    "a16_project_max": (a16_project_max, with_tables("pixels", "+ " + _S + " select stack, y, x, round(max(value), 6) as value from s group by 1, 2, 3")),
    "a16_project_percentile": (a16_project_percentile, with_tables("pixels", "+ " + _S + " select stack, y, x, round(quantile_cont(value, 0.3), 6) as value from s group by 1, 2, 3")),
    "a16_project_weighted": (a16_project_weighted, with_tables("pixels", "+ " + _S + ", w0 as (select stack, z, greatest(avg(value), 0) as w from s group by 1, 2), w1 as (select stack, z, case when sum(w) over (partition by stack) > 0 then w / sum(w) over (partition by stack) else 1.0 / count(*) over (partition by stack) end as w from w0) select stack, y, x, round(sum(w*value), 6) as value from s join w1 using (stack, z) group by 1, 2, 3")),
    "j24_apply_projection_recipe": (j24_apply_projection_recipe, with_tables("pixels", "+ " + _S + ", " + _FOCUS + ", n as (select stack, max(z)+1 as n from fo group by 1), st as (select distinct stack, start from (select stack, unnest(range(0, n - 2, 2)) as start from n union all select stack, n - 3 from n)), w as (select st.stack, start, avg(focus) as mf, max(focus) as xf from st join fo on fo.stack = st.stack and z >= start and z < start + 3 group by 1, 2), b as (select stack, start from (select *, row_number() over (partition by stack order by mf desc, xf desc, start) as k from w) where k = 1) select 'all' as recipe, stack, y, x, round(max(value), 6) as value from s group by all union all select 'best3', s.stack, y, x, round(max(value), 6) from s join b on b.stack = s.stack and z >= start and z < start + 3 group by all")),
    "t6_topk_focus_slices": (t6_topk_focus_slices, with_tables("pixels", "+ " + _S + ", f as (select stack, z, round(avg(value*value), 9) as focus from s group by 1, 2) select * from (select *, row_number() over (partition by stack order by focus desc, z) as rank from f) where rank <= 3")),
    "a17_tta_vote": (a17_tta_vote, with_tables("pixels", "+ v as (select image_no // 4 as image, image_no % 4 as t, y, x, case when value > 0 then 1.0::double else 0 end as o from pixels), p as (select image, case t when 2 then 7 - y when 3 then x else y end as y2, case t when 1 then 7 - x when 3 then 7 - y else x end as x2, o from v) select image, y2 as y, x2 as x, round(avg(o), 6) as probability, avg(o) >= 0.5 as mask from p group by 1, 2, 3")),
    "a19_overlap_scores": (a19_overlap_scores, with_tables("pixels", "+ s as (select image_no, count(*) filter (value > 0.05 and y > 0) as i, count(*) filter (value > 0) as np, count(*) filter (value > 0.05 and y > 0) as nr from pixels group by 1) select image_no, round(case when np + nr = 0 then 1 else 2*i/(np+nr) end, 6) as dice, round(case when np + nr = 0 then 1 else i/(np+nr-i) end, 6) as iou from s")),
    "j16_tile_overlap_pairs": (j16_tile_overlap_pairs, with_tables("pixels", "+ w as (select image_no, y, x, case when value > 0 then 1 + x // 4 + 2 * (y // 4) else 0 end as la, case when value > -0.02 then 1 + y // 4 else 0 end as lb from pixels where x >= 2 and x < 6), a as (select image_no, la, count(*) as na from w where la > 0 group by 1, 2), b as (select image_no, lb, count(*) as nb from w where lb > 0 group by 1, 2), c as (select image_no, la, lb, count(*) as common from w where la > 0 and lb > 0 group by 1, 2, 3) select image_no, 0 as ta, 1 as tb, la, lb, common from c join a using (image_no, la) join b using (image_no, lb) where common >= 3 and (common/(na+nb-common) >= 0.1 or common/least(na, nb) >= 0.25)")),
    "g4_pixel_components": (g4_pixel_components, with_tables("pixels", _COMPONENTS).replace("with", "with recursive", 1)),
    "a18_density_grid": (a18_density_grid, with_tables("objects", "+ p as (select distinct image_no, centroid_x_px as px, centroid_y_px as py from objects), g as (select a.range*64.0::double as x, b.range*64.0::double as y from range(16) a, range(16) b) select image_no, x, y, round(sum(exp(-((x-px)*(x-px)+(y-py)*(y-py))/5000.0)), 6) as density from p, g where (x-px)*(x-px)+(y-py)*(y-py) <= 40000 group by 1, 2, 3")),
    "a18_hexbin": (a18_hexbin, with_tables("objects", "+ ax as (select image_no, (sqrt(3.0::double)/3*centroid_x_px - centroid_y_px/3)/100 as q, (2.0::double/3*centroid_y_px)/100 as r from objects), ro as (select *, round_even(q, 0) as nq, round_even(r, 0) as nr, round_even(-q - r, 0) as ns, -q - r as s from ax), dd as (select *, abs(nq - q) as dq, abs(nr - r) as dr, abs(ns - s) as ds from ro), hx as (select image_no, case when dq > dr and dq > ds then -nr - ns else nq end as hq, case when not (dq > dr and dq > ds) and dr > ds then -nq - ns else nr end as hr, count(*) as n from dd group by 1, 2, 3) select image_no, count(*) as n_cells, cast(sum(n) as bigint) as n_points from hx group by 1")),
    "p15_physical_to_pixel": (p15_physical_to_pixel, with_tables("objects", "+ " + _DIMS + " select image_no, object_id, round(centroid_x_px/200/(mx*u/64), 6) as x_px, round(least(63.0, greatest(0.0, centroid_y_px/200/(mx*u/64))), 6) as y_px_clipped, centroid_x_px/200/(mx*u/64) < 64 and centroid_y_px/200/(mx*u/64) < 64 and 0.5/(mx*u/64) < 64 as inside_bounds from objects join d using (image_no)")),
    "j20_consecutive_samples": (j20_consecutive_samples, with_tables("objects manifest", "+ c as (select image_no as sample_id, count(*) as n from objects group by 1), m as (select * from manifest left join c using (sample_id)) select animal_id, eye, sample_id, timepoint_dpi, lag(sample_id) over w as prev_sample_id, lag(timepoint_dpi) over w as prev_timepoint, lag(coalesce(n, 0)) over w as n_prev, coalesce(n, 0) as n_cur from m window w as (partition by animal_id, eye order by timepoint_dpi, sample_id)")),
    "j9a_gated_candidates": (j9a_gated_candidates, with_tables("objects manifest", "+ m as (select sample_id, lag(sample_id) over (partition by animal_id, eye order by timepoint_dpi, sample_id) as prev from manifest) select m.sample_id as pair, a.object_id as a, b.object_id as b, (a.centroid_x_px-b.centroid_x_px)*(a.centroid_x_px-b.centroid_x_px) + (a.centroid_y_px-b.centroid_y_px)*(a.centroid_y_px-b.centroid_y_px) as d2 from m join objects a on a.image_no = m.prev join objects b on b.image_no = m.sample_id where (a.centroid_x_px-b.centroid_x_px)*(a.centroid_x_px-b.centroid_x_px) + (a.centroid_y_px-b.centroid_y_px)*(a.centroid_y_px-b.centroid_y_px) <= 400")),
    "j9b_gated_assignment": (j9b_gated_assignment, None),
    "k1_estimate_shift": (k1_estimate_shift, with_tables("objects manifest", "+ " + _CONSECUTIVE + _NEARBY.format(30) + _SHIFT + " select pair, round(dx, 6) as dx, round(dy, 6) as dy, votes, status from sh")),
    "k3_given_matches": (k3_given_matches, with_tables("objects manifest", "+ " + _CONSECUTIVE + _NEARBY.format(20) + _MUTUAL.format("pair") + _QC + " select sample_id, prev_sample_id, n_matched, round(fraction, 6) as matched_fraction, round(mean_d, 6) as mean_d, round(median_d, 6) as median_d, n_prev - n_matched as unmatched_prev, n_cur - n_matched as unmatched_cur from qc")),
    "k4_given_matches": (k4_given_matches, with_tables("objects manifest", "+ " + _CONSECUTIVE + _NEARBY.format(20) + _MUTUAL.format("pair") + _TRACKS + " select sample_id, object_id, track_id, round(case when prev is null then 0 else d end, 6) as displacement from tr join st using (sample_id, object_id)").replace("with", "with recursive", 1)),
    "k5_given_modes": (k5_given_modes, with_tables("objects manifest", "+ " + _CONSECUTIVE + _NEARBY.format(30) + _SHIFT + ", u as (select mp.*, dx, dy, dx is not null and pair % 3 > 0 as reg from mp left join sh on sh.pair = mp.sample_id), sg as (select *, sum(case when coalesce(reg, false) then 0 else 1 end) over (partition by animal_id, eye order by timepoint_dpi, sample_id) as segment from u) select sample_id, segment, round(sum(case when coalesce(reg, false) then dx else 0 end) over v, 6) as offset_x, round(sum(case when coalesce(reg, false) then dy else 0 end) over v, 6) as offset_y from sg window v as (partition by animal_id, eye, segment order by timepoint_dpi, sample_id rows unbounded preceding)")),
    "k6_given_matches": (k6_given_matches, with_tables("objects manifest", "+ " + _CONSECUTIVE + _NEARBY.format(20) + _MUTUAL.format("pair") + _QC + _TRACKS + ", t as (select animal_id, eye, count(distinct track_id) as n_tracks, count(*) as n_observations, avg(case when prev is not null then d end) as md from tr join st using (sample_id, object_id) group by 1, 2), q as (select animal_id, eye, count(*) as n_pairs, avg(fraction) as mf from qc group by 1, 2) select animal_id, eye, coalesce(n_tracks, 0) as n_tracks, coalesce(n_observations, 0) as n_observations, coalesce(n_pairs, 0) as n_pairs, round(md, 6) as mean_displacement, round(mf, 6) as mean_matched_fraction from t full join q using (animal_id, eye)").replace("with", "with recursive", 1)),
    "b1_given_matches": (b1_given_matches, with_tables("objects rois", "+ " + _ROI_SETS + _ROI_METRICS.format("2.0, 8.0") + " select roi_id, tolerance, tp, nf - tp as fp, nt - tp as fn, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, nf - nt as count_bias, abs(nf - nt) as count_abs, round(mean_distance, 6) as mean_distance from fs")),
    "b2_given_matches": (b2_given_matches, with_tables("objects rois", "+ " + _ROI_SETS + _ROI_METRICS.format("1.0, 6.0, 10.0") + " select tolerance, round(avg(precision), 6) as mean_precision, round(avg(recall), 6) as mean_recall, round(avg(f1), 6) as mean_f1 from fs group by 1")),
    "j23_given_matches": (j23_given_matches, with_tables("objects rois", "+ " + _ROI_SETS + " select roi_id, id, x, y from tru where not exists (select 1 from mu where mu.roi_id = tru.roi_id and mu.a = tru.id and d <= 8)")),
    "b12_given_matches": (b12_given_matches, with_tables("objects rois", "+ " + _ROI_SETS + _ROI_METRICS.format("8.0") + " select roi_id, nf - tp as added, nt - tp as deleted, nf as final from fs")),
    "k2_choose_mode": (k2_choose_mode, None),
    "k3_pair_qc": (k3_pair_qc, None),
    "k4_track_ids": (k4_track_ids, None),
    "k5_common_frame": (k5_common_frame, None),
    "k6_track_summary": (k6_track_summary, None),
    "j10_point_match": (j10_point_match, None),
    "b1_match_metrics": (b1_match_metrics, None),
    "b2_tolerance_sweep": (b2_tolerance_sweep, None),
    "j23_unmatched": (j23_unmatched, None),
    "b12_curation_delta": (b12_curation_delta, None),
}
