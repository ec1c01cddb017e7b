"""Operators on pixel tables: (group, y, x, value) and (group, y, x, label), label 0 being background."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.columns import clip
from morphlake.operators.neighbors import nearest
from morphlake.operators.numbering import packed

EPS = 1e-12


def explode_image(images: DataFrame, key: str, pixels: str) -> DataFrame:
    """Rows of an array of rows: (key, y, x, value)."""
    return images.select(key, F.posexplode(pixels).alias("y", "__row")).select(key, "y", F.posexplode("__row").alias("x", "value"))


def image_profile(pixels: DataFrame, key: str) -> DataFrame:
    return pixels.groupBy(key).agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.count(F.lit(1)).alias("n_pixels"))


def robust_rescale(pixels: DataFrame, key: str, low: float = 0.01, high: float = 0.995) -> DataFrame:
    """Values between two percentiles of their image as 0 to 1; where these coincide, between the extremes."""
    s = pixels.groupBy(key).agg(F.percentile("value", F.array(F.lit(low), F.lit(high))).alias("p"), F.min("value").alias("least"), F.max("value").alias("most"))
    flat = F.col("p")[1] <= F.col("p")[0]
    lo = F.when(flat, F.col("least")).otherwise(F.col("p")[0])
    hi = F.when(flat, F.col("most")).otherwise(F.col("p")[1])
    bounds = s.select(key, lo.alias("__lo"), F.when(hi <= lo, lo + 1.0).otherwise(hi).alias("__hi"))
    scaled = clip((F.col("value") - F.col("__lo")) / F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1e-6)), 0.0, 1.0)
    return pixels.join(bounds, key).withColumn("scaled", scaled).drop("__lo", "__hi")


def compose_channels(channels: DataFrame, weights: Mapping[str, float], how: str = "max") -> Column:
    """A virtual channel over wide channel columns: the largest or the sum of weighted sources; unknown sources raise."""
    missing = [c for c in weights if c not in channels.columns]
    if missing:
        raise ValueError(f"unknown channels {missing}")
    parts = [F.col(c) * w for c, w in weights.items()]
    return F.greatest(*parts) if how == "max" and len(parts) > 1 else parts[0] if how == "max" else sum(parts[1:], parts[0])


def threshold_mask(least: float, value: str = "value") -> Column:
    return F.coalesce(F.col(value) >= least, F.lit(False))


def count_density(labels: DataFrame, key: str, um_per_px: float) -> DataFrame:
    """Distinct labels and their density over the pixels in focus; density 0 without such pixels."""
    s = labels.groupBy(key).agg(F.countDistinct(F.when(F.col("label") > 0, F.col("label"))).alias("cell_count"), (F.count_if("in_focus") * (um_per_px**2 / 1e6)).alias("area_mm2"))
    return s.withColumn("density", F.when(F.col("area_mm2") > 0, F.col("cell_count") / F.col("area_mm2")).otherwise(0.0))


def label_centroids(labels: DataFrame, key: str) -> DataFrame:
    return labels.where("label > 0").groupBy(key, "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))


def object_table(labels: DataFrame, key: str) -> DataFrame:
    """Area, centroid, half-open box, focus overlap, intensity, moments and border pixels of each label.

    eccentricity from central second moments (with the pixel's own 1/12); perimeter counts 4-neighbour sides that face
    another label or the outside; circularity is 4 pi area over its square, 0 for none.
    """
    fg = labels.where("label > 0")
    s = fg.groupBy(key, "label").agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"),
        F.count_if("in_focus").alias("focus_px"), F.avg("value").alias("mean_intensity"), F.max("value").alias("max_intensity"), (F.var_pop("y") + 1 / 12).alias("__a"), (F.var_pop("x") + 1 / 12).alias("__b"), F.covar_pop("x", "y").alias("__c"),
    )
    root = F.sqrt((F.col("__a") - F.col("__b")) ** 2 + 4 * F.col("__c") ** 2)
    big, small = (F.col("__a") + F.col("__b") + root) / 2, (F.col("__a") + F.col("__b") - root) / 2
    sides = F.array(*[F.struct((F.col("y") + dy).alias("ny"), (F.col("x") + dx).alias("nx")) for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    facing = fg.select(key, "label", F.inline(sides)).join(fg.select(key, F.col("label"), F.col("y").alias("ny"), F.col("x").alias("nx")), [key, "label", "ny", "nx"], "left_anti")
    edge = facing.groupBy(key, "label").agg(F.count(F.lit(1)).alias("perimeter_px"))
    out = s.join(edge, [key, "label"])
    return out.withColumns({
        "focus_fraction": F.col("focus_px") / F.col("area_px"), "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - F.try_divide(small, big))),
        "circularity": F.when(F.col("perimeter_px") > 1e-6, 4 * F.pi() * F.col("area_px") / (F.col("perimeter_px") * F.col("perimeter_px"))).otherwise(0.0),
    }).drop("__a", "__b", "__c")


def local_contrast(labels: DataFrame, key: str, pad: int = 3) -> DataFrame:
    """Mean of each object less the mean of all other pixels in its box widened by ``pad``; 0 where there are none."""
    boxes = labels.where("label > 0").groupBy(key, "label").agg((F.min("y") - pad).alias("y0"), (F.max("y") + pad).alias("y1"), (F.min("x") - pad).alias("x0"), (F.max("x") + pad).alias("x1"))
    inside = labels.select(key, F.col("label").alias("own"), "y", "x", "value").join(boxes, key).where("y between y0 and y1 and x between x0 and x1")
    own = F.col("own") == F.col("label")
    s = inside.groupBy(key, "label").agg(F.avg(F.when(own, F.col("value"))).alias("fg"), F.avg(F.when(~own, F.col("value"))).alias("bg"))
    return s.select(key, "label", F.coalesce(F.col("fg") - F.col("bg"), F.lit(0.0)).alias("local_contrast"))


def uncertainty_summary(labels: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Mean, population deviation and 10th percentile of a probability over each object."""
    return labels.where("label > 0").groupBy(key, "label").agg(F.avg(value).alias("mean_p"), F.stddev_pop(value).alias("std_p"), F.percentile(value, 0.1).alias("p10"))


def marker_metrics(labels: DataFrame, key: str, channels: Sequence[str], masks: Mapping[str, Column]) -> DataFrame:
    """Mean, maximum and sum of each channel, share of each mask, and z-scores of the means within the image (0 where constant)."""
    aggs = [f(c).alias(f"{n}_{c}") for c in channels for f, n in ((F.avg, "mean"), (F.max, "max"), (F.sum, "sum"))]
    s = labels.where("label > 0").groupBy(key, "label").agg(*aggs, *[F.avg(m.cast("double")).alias(f"overlap_{n}") for n, m in masks.items()])
    whole = Window.partitionBy(key)
    z = lambda c: F.when(F.stddev_pop(c).over(whole) > EPS, (F.col(c) - F.avg(c).over(whole)) / F.stddev_pop(c).over(whole)).otherwise(0.0)
    return s.withColumns({f"mean_z_{c}": z(f"mean_{c}") for c in channels})


def distance_to_mask(centroids: DataFrame, mask: DataFrame, key: str, side: float = 64.0) -> DataFrame:
    """From each centroid to the nearest mask pixel, by blocks that see what bounds leave; images without mask pixels have no rows."""
    points = centroids.select(key, F.col("label").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    pixels = mask.select(key, packed(("y", 1 << 31), ("x", 1 << 31)).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return nearest(points, pixels, key, side).select(key, F.col("a").alias("label"), F.col("d").alias("distance"))


def otsu_threshold(pixels: DataFrame, key: str, bins: int = 64) -> DataFrame:
    """The cut between bins of each image's histogram that separates its two classes best; constant images cut at their value.

    A row an image is the built side of joins: exploded pixels look few to the planner.
    """
    s = pixels.groupBy(key).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins))
    h = pixels.join(s.hint("shuffle_hash"), key).withColumn("bin", F.coalesce(at, F.lit(0)).cast("int")).groupBy(key, "lo", "hi", "bin").agg(F.count(F.lit(1)).alias("n"))
    centre = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    h = h.withColumns({"v": centre, "m": F.col("n") * centre})
    up, whole = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(key)
    h = h.withColumns({"w0": F.sum("n").over(up), "m0": F.sum("m").over(up), "w": F.sum("n").over(whole), "mm": F.sum("m").over(whole)})
    w1 = F.col("w") - F.col("w0")
    gap = F.col("m0") / F.col("w0") - F.try_divide(F.col("mm") - F.col("m0"), w1)
    best = h.withColumn("between", F.coalesce(F.col("w0") * w1 * gap * gap, F.lit(-1.0)))
    return best.groupBy(key).agg(F.max(F.struct(F.round("between", 9).alias("b"), (-F.col("bin")).alias("nb"), "v")).alias("t")).select(key, F.col("t.v").alias("threshold"))


def box_morphology(mask: DataFrame, key: str, k: int, erode: bool) -> DataFrame:
    """Dilation or erosion of a 0/1 column ``on`` over full images by a (2k+1) box; outside the image counts as background."""
    out = mask
    for across, along in (("y", "x"), ("x", "y")):
        frame = Window.partitionBy(key, across).orderBy(along).rowsBetween(-k, k)
        value = F.when(F.count(F.lit(1)).over(frame) == 2 * k + 1, F.min("on").over(frame)).otherwise(0) if erode else F.max("on").over(frame)
        out = out.withColumn("on", value)
    return out


def open_close(mask: DataFrame, key: str, opening: int, closing: int) -> DataFrame:
    """A mask opened, then closed, by boxes of the given half widths; 0 leaves a step out."""
    for k, order in ((opening, (True, False)), (closing, (False, True))):
        for erode in order if k else ():
            mask = box_morphology(mask, key, k, erode)
    return mask


def tissue_mask(pixels: DataFrame, key: str, opening: int = 0, closing: int = 0) -> DataFrame:
    """Pixels above the image's Otsu threshold, opened and closed by boxes of the given half widths (2 and 4: 5 by 5, 9 by 9)."""
    m = pixels.join(otsu_threshold(pixels, key).hint("shuffle_hash"), key).withColumn("on", (F.col("value") > F.col("threshold")).cast("int"))
    return open_close(m, key, opening, closing)


def tissue_coverage(mask: DataFrame, key: str, x0: float, y0: float) -> DataFrame:
    """Share of mask pixels, and of the disc around the origin that reaches the farthest of them."""
    far = F.max(F.when(F.col("on") == 1, F.hypot(F.col("x") - x0, F.col("y") - y0)))
    s = mask.groupBy(key).agg(F.avg("on").alias("mask_fraction"), F.sum("on").alias("n"), far.alias("r"))
    return s.select(key, "mask_fraction", F.coalesce(F.try_divide(F.col("n").cast("double"), F.pi() * F.col("r") * F.col("r")), F.lit(0.0)).alias("disc_coverage"))


def stencils(pixels: DataFrame, plane: Sequence[str]) -> DataFrame:
    """Adds lap (5-point Laplacian) and grad2 (squared 3 by 3 Sobel); borders mirror without repeating the edge pixel."""
    rows, cols = Window.partitionBy(*plane, "y").orderBy("x"), Window.partitionBy(*plane, "x").orderBy("y")

    def pair(c: str, w: Window) -> tuple[Column, Column]:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce(before, after, F.col(c)), F.coalesce(after, before, F.col(c))

    left, right = pair("value", rows)
    h = pixels.withColumns({"__l": left, "__r": right})
    up, down = pair("value", cols)
    h = h.withColumns({"__u": up, "__d": down, "__s": F.col("__l") + 2 * F.col("value") + F.col("__r"), "__g": F.col("__r") - F.col("__l")})
    su, sd = pair("__s", cols)
    gu, gd = pair("__g", cols)
    h = h.withColumns({"__gy": sd - su, "__gx": gu + 2 * F.col("__g") + gd})
    return h.withColumns({"lap": F.col("__l") + F.col("__r") + F.col("__u") + F.col("__d") - 4 * F.col("value"), "grad2": F.col("__gx") ** 2 + F.col("__gy") ** 2}).drop("__l", "__r", "__u", "__d", "__s", "__g", "__gx", "__gy")


def tile_focus_qc(pixels: DataFrame, key: str, tile: int, low: float, high: float, threshold: float = 0.0) -> DataFrame:
    """Brightness, Laplacian variance and mean squared gradient of each tile, their z-scores in the image, and the verdict."""
    placed = pixels.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    t = stencils(placed, [key, "ty", "tx"]).groupBy(key, "ty", "tx").agg(F.avg("value").alias("brightness"), F.var_pop("lap").alias("lap_var"), F.avg("grad2").alias("tenengrad"))
    whole = Window.partitionBy(key)
    z = lambda c: (F.col(c) - F.avg(c).over(whole)) / F.when(F.stddev_pop(c).over(whole) > EPS, F.stddev_pop(c).over(whole)).otherwise(1.0)
    t = t.withColumn("score", (z("lap_var") + z("tenengrad")) / 2)
    return t.withColumn("in_focus", F.col("brightness").between(low, high) & (F.col("score") >= threshold))


def slice_focus(slices: DataFrame, key: str) -> DataFrame:
    """Mean squared gradient, mean and 99th percentile of each rescaled plane (key, z)."""
    both = robust_rescale(slices.withColumn("__plane", F.struct(key, "z")), "__plane").withColumn("value", F.col("scaled"))
    return stencils(both, [key, "z"]).groupBy(key, "z").agg(F.avg("grad2").alias("focus"), F.avg("value").alias("mean"), F.percentile("value", 0.99).alias("p99"))


def slab_catalog(focus: DataFrame, key: str, sizes: Sequence[int], stride: int) -> DataFrame:
    """Windows of slices of each size (at most all), every ``stride`` and at the end, ranked by mean focus within their size."""
    n = focus.groupBy(key).agg((F.max("z") + 1).alias("n"))
    size = n.select(key, "n", F.explode(F.array_distinct(F.transform(F.lit(list(sizes)), lambda s: F.least(s, F.col("n"))))).alias("size"))
    last = F.col("n") - F.col("size")
    starts = size.select(key, "size", F.explode(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), last, F.lit(stride).cast("bigint")), F.array(last)))).alias("start"))
    inside = starts.join(focus, key).where("z >= start and z < start + size")
    s = inside.groupBy(key, "size", "start").agg(F.avg("focus").alias("mean_focus"), F.max("focus").alias("max_focus"))
    rank = F.row_number().over(Window.partitionBy(key, "size").orderBy(F.desc("mean_focus"), F.desc("max_focus"), "start"))
    return s.withColumn("rank", rank).withColumn("is_best", F.col("rank") == 1)


def project_z(slices: DataFrame, key: str, how: str, weights: DataFrame | None = None, q: float = 0.5) -> DataFrame:
    """One plane of a stack: max, mean, sum, percentile, or a mean weighted by slice (negative weights 0, all 0 uniform)."""
    by = [key, "y", "x"]
    if how == "weighted":
        w = weights.select(key, "z", F.greatest("weight", F.lit(0.0)).alias("w"))
        total = Window.partitionBy(key)
        w = w.withColumn("w", F.when(F.sum("w").over(total) > 0, F.col("w") / F.sum("w").over(total)).otherwise(1.0 / F.count(F.lit(1)).over(total)))
        return slices.join(w, [key, "z"]).groupBy(*by).agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return slices.groupBy(*by).agg({"max": F.max("value"), "mean": F.avg("value"), "sum": F.sum("value"), "percentile": F.percentile("value", q)}[how].alias("value"))


def apply_projection_recipe(slices: DataFrame, recipes: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Maximum over the slab that each recipe (recipe, kind, size) names: all slices, or the best slab of a size; others raise."""
    kind = F.when(F.col("kind").isin("full", "best_slab"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown recipe "), "kind")))
    best = catalog.where("is_best").select(key, F.col("size").alias("slab"), "start")
    wanted = F.broadcast(recipes.withColumn("kind", kind))
    ranges = best.select(key).distinct().join(wanted, F.lit(True)).join(best, [key], "left").where("kind = 'full' or slab = size")
    ranges = ranges.select(key, "recipe", F.when(F.col("kind") == "full", 0).otherwise(F.col("start")).alias("lo"), F.when(F.col("kind") == "full", 1 << 30).otherwise(F.col("start") + F.col("slab")).alias("hi")).distinct()
    return slices.join(ranges, key).where("z >= lo and z < hi").groupBy("recipe", key, "y", "x").agg(F.max("value").alias("value"))


def tta_vote(votes: DataFrame, key: str, height: int, width: int) -> DataFrame:
    """Foreground probability from votes of transformed predictions (transform, y, x, on), each put back in place; mask at 0.5."""
    t = F.col("transform")
    y = F.when(t == "flip_v", height - 1 - F.col("y")).when(t == "rot90", F.col("x")).otherwise(F.col("y"))
    x = F.when(t == "flip_h", width - 1 - F.col("x")).when(t == "rot90", width - 1 - F.col("y")).otherwise(F.col("x"))
    p = votes.select(key, y.alias("y"), x.alias("x"), F.col("on").cast("double").alias("on")).groupBy(key, "y", "x").agg(F.avg("on").alias("probability"))
    return p.withColumn("mask", F.col("probability") >= 0.5)


def overlap_scores(predicted: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Dice and IoU of the foregrounds of two label tables, 1 where both are empty."""
    p = predicted.select(key, "y", "x", (F.col("label") > 0).alias("p"))
    both = p.join(reference.select(key, "y", "x", (F.col("label") > 0).alias("r")), [key, "y", "x"], "full_outer").fillna(False, ["p", "r"])
    s = both.groupBy(key).agg(F.count_if(F.col("p") & F.col("r")).alias("i"), F.count_if("p").alias("np"), F.count_if("r").alias("nr"))
    empty = (F.col("np") + F.col("nr")) == 0
    return s.select(key, F.when(empty, 1.0).otherwise(F.try_divide(2.0 * F.col("i"), F.col("np") + F.col("nr"))).alias("dice"), F.when(empty, 1.0).otherwise(F.try_divide(F.col("i").cast("double"), (F.col("np") + F.col("nr") - F.col("i")).cast("double"))).alias("iou"))


def tile_overlap_pairs(labels: DataFrame, least: int = 8, iou: float = 0.10, share: float = 0.25) -> DataFrame:
    """Labels of two tiles (image, tile, y, x, label) that cover enough common pixels of the tiles' intersection to be one object."""
    a, b = labels.alias("a"), labels.alias("b")
    same = (F.col("a.image_no") == F.col("b.image_no")) & (F.col("a.y") == F.col("b.y")) & (F.col("a.x") == F.col("b.x")) & (F.col("a.tile") < F.col("b.tile"))
    window = a.join(b, same).select(F.col("a.image_no").alias("image_no"), F.col("a.tile").alias("ta"), F.col("b.tile").alias("tb"), F.col("a.label").alias("la"), F.col("b.label").alias("lb"))
    area = lambda c: window.where(f"{c} > 0").groupBy("image_no", "ta", "tb", c).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    common = window.where("la > 0 and lb > 0").groupBy("image_no", "ta", "tb", "la", "lb").agg(F.count(F.lit(1)).alias("common"))
    j = common.join(area("la"), ["image_no", "ta", "tb", "la"]).join(area("lb"), ["image_no", "ta", "tb", "lb"])
    keep = (F.col("common") >= least) & ((F.col("common") / (F.col("n_la") + F.col("n_lb") - F.col("common")) >= iou) | (F.col("common") / F.least("n_la", "n_lb") >= share))
    return j.where(keep).select("image_no", "ta", "tb", "la", "lb", "common")


def density_grid(points: DataFrame, cells: DataFrame, key: str, sigma: float) -> DataFrame:
    """Sum over distinct points within 4 sigma of a Gaussian at each cell (key, x, y)."""
    from morphlake.operators.neighbors import near_pairs

    spots = points.select(key, "x", "y").distinct().withColumn("id", F.struct("x", "y"))
    grid = cells.select(key, F.struct("x", "y").alias("id"), "x", "y")
    near = near_pairs(grid, spots, key, 4 * sigma)
    return near.groupBy(key, F.col("a.x").alias("x"), F.col("a.y").alias("y")).agg(F.sum(F.exp(-F.col("d2") / (2 * sigma * sigma))).alias("density"))


def hexbin(points: DataFrame, key: str, size: float) -> DataFrame:
    """Points in each hexagon of the given radius, by axial coordinates."""
    q, r = (F.sqrt(F.lit(3.0)) / 3 * F.col("x") - F.col("y") / 3) / size, (2.0 / 3 * F.col("y")) / size
    h = points.withColumns({"__q": q, "__r": r}).withColumn("__s", -F.col("__q") - F.col("__r"))
    h = h.withColumns({f"__n{c}": F.rint(f"__{c}") for c in "qrs"}).withColumns({f"__d{c}": F.abs(F.col(f"__n{c}") - F.col(f"__{c}")) for c in "qrs"})
    far_q = (F.col("__dq") > F.col("__dr")) & (F.col("__dq") > F.col("__ds"))
    far_r = F.col("__dr") > F.col("__ds")
    hq = F.when(far_q, -F.col("__nr") - F.col("__ns")).otherwise(F.col("__nq"))
    hr = F.when(~far_q & far_r, -F.col("__nq") - F.col("__ns")).otherwise(F.col("__nr"))
    return h.groupBy(key, hq.cast("bigint").alias("q"), hr.cast("bigint").alias("r")).agg(F.count(F.lit(1)).alias("n"))
