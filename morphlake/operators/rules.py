"""Filters, relabelling, class rules and replayed edits on object tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.columns import all_of, any_of, clip

# Bound -> (column, whether it is a lower bound).
BOUNDS = {
    "min_area_px": ("area_px", True), "max_area_px": ("area_px", False), "min_focus_overlap": ("focus_overlap_fraction", True), "min_mean_intensity": ("mean_intensity", True),
    "min_local_contrast": ("local_contrast", True), "max_eccentricity": ("eccentricity", False), "min_solidity": ("solidity", True), "min_circularity": ("circularity", True),
}


def filter_objects(objects: DataFrame, bounds: Mapping[str, float]) -> DataFrame:
    """Sets ``kept``: every bound met; a missing column or a null fails its bound. Without bounds nothing changes."""
    if not bounds:
        return objects
    tests = []
    for name, limit in bounds.items():
        column, lower = BOUNDS[name]
        if column in objects.columns:
            value = F.col(column)
            tests.append(F.coalesce(value >= limit if lower else value <= limit, F.lit(False)))
        else:
            tests.append(F.lit(False))
    return objects.withColumn("kept", all_of(*tests))


def kept_only(objects: DataFrame) -> DataFrame:
    """Rows whose ``kept`` is true or null; all where there is no such column."""
    return objects.where(F.coalesce("kept", F.lit(True))) if "kept" in objects.columns else objects


def filter_accounting(before: DataFrame, after: DataFrame, image: str) -> DataFrame:
    """Objects before and after filters for each image, how many went, and whether any filter applied."""
    n = before.groupBy(image).agg(F.count(F.lit(1)).alias("n_before"))
    m = after.groupBy(image).agg(F.count_if("kept").alias("n_after"))
    both = n.join(m, image, "left").fillna(0, ["n_after"])
    return both.withColumns({"n_dropped": F.col("n_before") - F.col("n_after"), "applied": F.col("n_before") != F.col("n_after")})


def size_filter_relabel(sizes: DataFrame, image: str, label: str, size: str, least: int, most: int) -> DataFrame:
    """Labels whose size lies in [least, most], renumbered 1.. within each image in the order of their old numbers."""
    kept = sizes.where(F.col(size).between(least, most))
    return kept.withColumn("new_label", F.row_number().over(Window.partitionBy(image).orderBy(label)).cast("bigint"))


def marker_rule_cascade(objects: DataFrame, image: str, rgc_overlap: Column, microglia_overlap: Column, rules: Mapping[str, float]) -> DataFrame:
    """Adds reason (the first rule that fails, else kept) and new_label (1.. for kept objects of an image, else null)."""
    reason = F.when((F.col("area_px") < rules["min_area_px"]) | (F.col("area_px") > rules["max_area_px"]), "area_out_of_range").when(F.col("circularity") < rules["min_circularity"], "circularity_low")
    reason = reason.when(~F.coalesce(rgc_overlap, F.lit(False)), "rgc_negative").when(F.coalesce(microglia_overlap, F.lit(False)), "microglia_overlap").otherwise("kept")
    out = objects.withColumn("reason", reason)
    rank = F.sum((F.col("reason") == "kept").cast("int")).over(Window.partitionBy(image).orderBy("object_id"))
    return out.withColumn("new_label", F.when(F.col("reason") == "kept", rank))


_OPS = {
    "ge": Column.__ge__, "gt": Column.__gt__, "le": Column.__le__, "lt": Column.__lt__,
    "eq": Column.__eq__, "ne": Column.__ne__,
}


def _operand(rule: Mapping, columns: Sequence[str]) -> Column | None:
    feature = rule["feature"]
    suffix = rule.get("channel") if feature.startswith("channel.") else rule.get("target") if feature.startswith("relation.") else None
    name = f"{feature}.{suffix}" if suffix else feature
    return F.col(f"`{name}`") if name in columns else None


def class_conditions(classes: Mapping[str, Mapping], columns: Sequence[str]) -> dict[str, Column]:
    """A condition for each class: all includes and no exclude; other classes are put in where class.is names them.

    A comparison with a null or a missing column is false, under exclude too. Circular references raise.
    """
    done: dict[str, Column] = {}

    def test(rule: Mapping, path: tuple[str, ...]) -> Column:
        if rule["feature"] == "class.is":
            return build(str(rule["value"]), path)
        value = _operand(rule, columns)
        return F.lit(False) if value is None else F.coalesce(_OPS[rule["op"]](value, F.lit(rule["value"])), F.lit(False))

    def build(name: str, path: tuple[str, ...]) -> Column:
        if name in path:
            raise ValueError(f"classes refer to each other in a circle: {' -> '.join((*path, name))}")
        if name not in done:
            spec, inner = classes[name], (*path, name)
            done[name] = all_of(*[test(r, inner) for r in spec.get("include", ())]) & ~any_of(*[test(r, inner) for r in spec.get("exclude", ())])
        return done[name]

    for name in classes:
        build(name, ())
    return done


def assign_phenotypes(objects: DataFrame, classes: Mapping[str, Mapping]) -> DataFrame:
    """The class of highest priority (the first given, among equals) whose condition holds, else unclassified and -1."""
    conditions = class_conditions(classes, objects.columns)
    ordered = sorted(classes, key=lambda c: -int(classes[c].get("priority", 0)))
    hit = F.coalesce(*[F.when(conditions[c], F.struct(F.lit(c).alias("n"), F.lit(int(classes[c].get("priority", 0))).alias("p"))) for c in ordered], F.struct(F.lit("unclassified").alias("n"), F.lit(-1).alias("p")))
    return objects.withColumn("__hit", hit).withColumns({"phenotype": F.col("__hit.n"), "phenotype_priority": F.col("__hit.p"), "phenotype_engine": F.lit("v2")}).drop("__hit")


def replay_edits(objects: DataFrame, edits: DataFrame, image: str) -> DataFrame:
    """Objects after the edits of their image in order of ``seq``: adds new_object_id, dense from 1 in old-id order.

    edits: image, seq, op, object_id, keep_object_id, object_ids (array), phenotype. A merge moves the pixels of all
    object_ids to keep_object_id and takes their rows away; edits of ids that are gone change nothing; unknown ops raise.
    Only objects that an edit names are folded over their image's edits, which must fit a row; all others stay as they are.
    """
    known = F.col("op").isin("delete_object", "merge_objects", "relabel_phenotype", "set_landmarks")
    edits = edits.withColumn("op", F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown edit "), F.col("op")))))
    ids = F.concat(F.array(F.col("object_id").cast("bigint"), F.col("keep_object_id").cast("bigint")), F.coalesce(F.col("object_ids").cast("array<bigint>"), F.array().cast("array<bigint>")))
    named = edits.select(F.col(image).alias("__image"), F.explode(ids).alias("__named")).where("__named is not null").distinct()
    logs = edits.groupBy(F.col(image).alias("__image")).agg(F.array_sort(F.collect_list(F.struct("seq", "op", "object_id", "keep_object_id", "object_ids", "phenotype"))).alias("__log"))
    mine = objects.join(named, (F.col(image) == F.col("__image")) & (F.col("object_id") == F.col("__named")), "left").drop("__image")
    joined = mine.join(logs, (F.col(image) == F.col("__image")) & F.col("__named").isNotNull(), "left")
    start = F.struct(F.col("object_id").cast("bigint").alias("label"), F.lit(True).alias("alive"), F.col("phenotype").alias("phenotype"))

    def step(at: Column, e: Column) -> Column:
        own, op = F.col("object_id"), e["op"]
        merged = lambda i: F.array_contains(e["object_ids"], i) & (i != e["keep_object_id"])
        label = F.when((op == "delete_object") & (at["label"] == e["object_id"]), F.lit(0).cast("bigint"))
        label = label.when((op == "merge_objects") & merged(at["label"]), e["keep_object_id"].cast("bigint")).otherwise(at["label"])
        gone = ((op == "delete_object") & (own == e["object_id"])) | ((op == "merge_objects") & merged(own))
        renamed = (op == "relabel_phenotype") & (own == e["object_id"]) & at["alive"]
        return F.struct(label.alias("label"), (at["alive"] & ~F.coalesce(gone, F.lit(False))).alias("alive"), F.when(renamed, e["phenotype"]).otherwise(at["phenotype"]).alias("phenotype"))

    folded = joined.withColumn("__end", F.aggregate(F.coalesce("__log", F.array().cast(logs.schema["__log"].dataType)), start, step))
    present = folded.select(image, F.col("__end.label").alias("object_id")).where("object_id <> 0").distinct()
    numbered = present.withColumn("new_object_id", F.row_number().over(Window.partitionBy(image).orderBy("object_id")).cast("bigint"))
    alive = folded.where("__end.alive").withColumn("phenotype", F.col("__end.phenotype")).drop("__image", "__log", "__end", "__named")
    return alive.join(numbered, [image, "object_id"])


def filter_split(rows: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the included splits without the excluded ones; tokens may be comma lists, a blank split is 'benchmark'."""
    def names(values: Sequence[str]) -> list[str]:
        return [t.strip() for v in values for t in v.split(",") if t.strip()]

    filled = rows.withColumn("split", F.when(F.trim(F.coalesce("split", F.lit(""))) == "", "benchmark").otherwise(F.trim("split")))
    if names(include):
        filled = filled.where(F.col("split").isin(names(include)))
    return filled.where(~F.col("split").isin(names(exclude))) if names(exclude) else filled


def subtype_scores(objects: DataFrame, subtypes: Mapping[str, Mapping], location_weight: float = 0.7, marker_weight: float = 0.3) -> DataFrame:
    """Probabilities of subtypes from location priors and marker evidence; adds the first best, its probability, its lead.

    subtypes: name -> {location_priors: {axis: {weight, priors: {label: p}}}, markers: [{feature, direction, center, scale, weight}]}.
    A label without prior and a null marker are no evidence; without any evidence of a kind its score is 0.5 and doesn't
    count; scores are normalised over the subtypes, uniform where they are all 0.
    """
    raw = {}
    for name, spec in subtypes.items():
        top, weight = F.lit(0.0), F.lit(0.0)
        for axis, prior in spec.get("location_priors", {}).items():
            value = F.create_map(*[x for k, v in prior["priors"].items() for x in (F.lit(k), F.lit(float(v)))])[F.col(axis)]
            top, weight = top + F.coalesce(value * prior["weight"], F.lit(0.0)), weight + F.when(value.isNotNull(), prior["weight"]).otherwise(0.0)
        location, located = F.coalesce(F.try_divide(top, weight), F.lit(0.5)), weight > 0
        top, weight = F.lit(0.0), F.lit(0.0)
        for m in spec.get("markers", ()):
            sign = 1.0 if m.get("direction", "high") == "high" else -1.0
            score = 1 / (1 + F.exp(-clip((F.col(f"`{m['feature']}`") - m["center"]) / m["scale"] * sign, -50.0, 50.0)))
            top, weight = top + F.coalesce(score * m["weight"], F.lit(0.0)), weight + F.when(score.isNotNull(), m["weight"]).otherwise(0.0)
        marker, marked = F.coalesce(F.try_divide(top, weight), F.lit(0.5)), weight > 0
        a, b = F.when(located, location_weight).otherwise(0.0), F.when(marked, marker_weight).otherwise(0.0)
        raw[name] = F.coalesce(F.try_divide(a * location + b * marker, a + b), F.lit(0.5))
    names = list(raw)
    out = objects.withColumns({f"__raw_{i}": raw[n] for i, n in enumerate(names)})
    total = sum((F.col(f"__raw_{i}") for i in range(len(names))), F.lit(0.0))
    out = out.withColumns({f"prob_{n}": F.when(total > 0, F.col(f"__raw_{i}") / total).otherwise(1.0 / len(names)) for i, n in enumerate(names)})
    probs = F.array(*[F.col(f"prob_{n}") for n in names])
    best = F.array_max(probs)
    lead = best - F.element_at(F.sort_array(probs, asc=False), 2) if len(names) > 1 else best
    top1 = F.element_at(F.lit(names), F.array_position(probs, best).cast("int"))
    return out.withColumns({"top1": top1, "top1_prob": best, "margin": lead}).drop(*[f"__raw_{i}" for i in range(len(names))])
