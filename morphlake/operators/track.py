"""Objects followed over the samples of an animal's eye."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphlake.operators.graph import chain_roots
from morphlake.operators.matching import TILE_POINTS, assigned_within, gated_assignment, mutual_nearest, mutual_within, near_parts
from morphlake.operators.neighbors import near_pairs
from morphlake.operators.numbering import numbered, packed, summed_before
from morphlake.operators.runs import by_groups, changes, column, taken
from morphlake.sources.storage import cut, kept

#: Points of consecutive samples that a task takes together (more only where one sample has more).
RUN_POINTS = 20_000


def consecutive_samples(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Each sample with the one before it of the same (animal, eye) by (timepoint, sample), and both object counts.

    A sample without objects is a previous one all the same, so it breaks the chain.
    """
    order = Window.partitionBy("animal_id", "eye").orderBy("timepoint_dpi", "sample_id")
    m = manifest.join(counts, "sample_id", "left").fillna(0, ["n_objects"])
    pairs = m.withColumns({"prev_sample_id": F.lag("sample_id").over(order), "n_prev": F.lag("n_objects").over(order), "prev_timepoint": F.lag("timepoint_dpi").over(order)})
    return pairs.select("animal_id", "eye", "sample_id", "timepoint_dpi", "prev_sample_id", "prev_timepoint", F.col("n_prev"), F.col("n_objects").alias("n_cur"))


def _sides(pairs: DataFrame, points: DataFrame) -> tuple[DataFrame, DataFrame]:
    real = pairs.where("prev_sample_id is not null and n_prev > 0 and n_cur > 0")
    p = points.select(F.col("image_no").alias("s"), "id", "x", "y")
    before = real.select(F.col("sample_id").alias("pair"), F.col("prev_sample_id").alias("s")).hint("shuffle_hash").join(p, "s").select("pair", "id", "x", "y")
    after = real.select(F.col("sample_id").alias("pair"), F.col("sample_id").alias("s")).hint("shuffle_hash").join(p, "s").select("pair", "id", "x", "y")
    return before, after


def _run_roles(pairs: DataFrame, least: int = 0) -> DataFrame:
    """(s, head, turn, real) of every sample: the run of consecutive samples it is in, named by its first one, and its place.

    The sample before a run is in it too, as turn 0. real: the sample has a previous one and both have points; ``least``:
    only samples that are in such a pair, of at most that many points.
    """
    order = Window.partitionBy("animal_id", "eye").orderBy("timepoint_dpi", "sample_id")
    real = F.coalesce(F.col("prev_sample_id").isNotNull() & (F.col("n_prev") > 0) & (F.col("n_cur") > 0), F.lit(False))
    real = real & (F.col("n_prev") + F.col("n_cur") <= least) if least else real
    before = F.coalesce(F.sum("n_cur").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pairs.withColumns({"real": real, "run": F.floor(before / RUN_POINTS)})
    inside = Window.partitionBy("animal_id", "eye", "run").orderBy("timepoint_dpi", "sample_id")
    rows = rows.withColumns({"head": F.first("sample_id").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "turn": F.row_number().over(inside)})
    rows = rows.withColumns({"next": F.lead("head").over(order), "goes_on": F.coalesce(F.lead("real").over(order), F.lit(False))})
    needed = (F.col("real") | F.col("goes_on")) if least else F.lit(True)
    own = F.when(needed, F.struct("head", "turn", "real", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next")))
    ahead = F.when(F.col("goes_on") & (F.col("next") != F.col("head")), F.struct(F.col("next").alias("head"), F.lit(0).alias("turn"), F.lit(False).alias("real"), F.lit(None).cast(pairs.schema["sample_id"].dataType).alias("next")))
    return rows.select(F.col("sample_id").alias("s"), F.inline(F.array_compact(F.array(own, ahead))))


def _in_runs(roles: DataFrame, points: DataFrame, solve: Callable, schema: str) -> DataFrame:
    """``solve`` over the points of whole runs: called with rows by (head, turn, id), and (first, middle, last) of each sample beside the one before.

    first to middle are the rows of the sample before (none unless the sample is ``real``), middle to last its own.
    """
    p = points.select(F.col("image_no").alias("s"), F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = roles.hint("shuffle_hash").join(p, "s")

    def run(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        turn, real = column(table, "turn"), column(table, "real")
        at = np.unique(np.concatenate([starts[:-1], np.flatnonzero(np.diff(turn)) + 1])).astype(np.int64) if len(turn) else np.zeros(0, dtype=np.int64)
        ends = np.append(at[1:], len(turn))
        samples, head = [], set(starts.tolist())
        for k, (m, last) in enumerate(zip(at.tolist(), ends.tolist(), strict=True)):
            joined = bool(real[m]) and m not in head and turn[m] == turn[at[k - 1]] + 1
            samples.append((int(at[k - 1]) if joined else m, m, last))
        return solve(table, samples)

    return by_groups(rows, ["head"], run, schema, ["turn", "id", "x", "y"])


def _differ(table: pa.Table, name: str) -> np.ndarray:
    """Whether each value but the first differs from the one before."""
    return changes(table.column(name).combine_chunks())


def _shift(table: tuple[np.ndarray, np.ndarray], first: int, m: int, last: int, reach: float, cell: float) -> tuple[float, float, int] | None:
    """(dx, dy, votes) of the displacement most pairs of rows first to m and m to last agree on; None without a pair."""
    x, y = table
    bins = _displacements(x[first:m], y[first:m], x[m:last], y[m:last], reach, cell)
    if not len(bins[0]):
        return None
    bx, by, votes, sx, sy = bins
    k = np.lexsort((by, bx, -np.abs(bx) - np.abs(by), votes))[-1]
    return sx[k] / votes[k], sy[k] / votes[k], int(votes[k])


def _displacements(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float, cell: float) -> tuple[np.ndarray, ...]:
    """Bins (x, y) of the displacements of all pairs within ``reach``: pairs in each, and sums of dx and dy; about a million pairs are held at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    for i, j, _ in near_parts(ax, ay, bx, by, reach):
        dx, dy = ax[i] - bx[j], ay[i] - by[j]
        held.append((np.stack([np.floor(dx / cell), np.floor(dy / cell)], 1).astype(np.int64), np.ones(len(i), dtype=np.int64), dx, dy))
        held = [_binned(held)]
    if not held:
        held = [(np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0))]
    place, n, dx, dy = held[0]
    return place[:, 0], place[:, 1], n, dx, dy


def _binned(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    place, n, dx, dy = (np.concatenate([p[k] for p in parts]) for k in range(4))
    low = place.min(0, initial=0)
    wide = int(place[:, 1].max(initial=0) - low[1] + 1)
    key, at = np.unique((place[:, 0] - low[0]) * wide + place[:, 1] - low[1], return_inverse=True)
    sums = [np.bincount(at, v, len(key)) for v in (n, dx, dy)]
    return np.stack([key // wide + low[0], key % wide + low[1]], 1), np.rint(sums[0]).astype(np.int64), sums[1], sums[2]


def register_samples(pairs: DataFrame, points: DataFrame, reach: float, shift_reach: float, cell: float = 2.0) -> DataFrame:
    """``choose_mode`` of the matches within ``reach``, raw and after moving by ``estimate_shift`` within ``shift_reach``.

    A task takes the points of a run of consecutive samples once, and gives a row a sample; no pair and no match travels.
    Pairs of more than TILE_POINTS points are matched in tiles.
    """
    pairs = cut(pairs)
    kind = pairs.schema["sample_id"].dataType.simpleString()
    large = pairs.where((F.col("n_prev") > 0) & (F.col("n_cur") > 0) & (F.col("n_prev") + F.col("n_cur") > TILE_POINTS))

    def solve(table: pa.Table, samples: list[tuple[int, int, int]]) -> pa.RecordBatch:
        x, y = column(table, "x"), column(table, "y")
        out: list[tuple] = []
        for first, m, last in samples:
            shift = _shift((x, y), first, m, last, shift_reach, cell) if first < m else None
            if first == m:
                continue
            sides = x[first:m], y[first:m], x[m:last], y[m:last]
            raw = assigned_within(*sides, reach)[2]
            moved = assigned_within(*sides[:2], sides[2] + shift[0], sides[3] + shift[1], reach)[2] if shift else raw[:0]
            out.append((m, *(shift or (None, None, None)), *[v for d in (raw, moved) for v in (len(d), float(np.median(d)) if len(d) else None)]))
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64())
        at, *columns = (pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))
        return pa.RecordBatch.from_arrays([taken(table, "s", at.to_numpy()), *columns], names=["pair", "dx", "dy", "votes", "n_raw", "median_raw", "n_reg", "median_reg"])

    names = "dx double, dy double, votes long, n_raw long, median_raw double, n_reg long, median_reg double"
    found = _in_runs(_run_roles(pairs, TILE_POINTS), points, solve, f"pair {kind}, {names}")
    if large.limit(1).count():
        shifts = cut(estimate_shift(large, points, shift_reach, cell))
        found = found.unionByName(_sized(match_samples(large, points, reach), match_samples(large, points, reach, shifts), shifts).drop("status"))
    both = pairs.where("prev_sample_id is not null").select(F.col("sample_id").alias("pair")).join(found, "pair", "left").fillna(0, ["n_raw", "n_reg"])
    return _with_mode(both.withColumn("status", F.when(F.col("votes").isNull(), "missing").otherwise("estimated")))


def estimate_shift(pairs: DataFrame, points: DataFrame, reach: float, cell: float = 2.0, dims: DataFrame | None = None) -> DataFrame:
    """(pair, dx, dy, votes, status): the displacement that most point pairs agree on, averaged inside its bin.

    dims: (image_no, width, height); pairs of different sizes are shape_mismatch and get no shift. Pairs without any
    candidate are missing.
    """
    before, after = _sides(pairs, points)
    near = near_pairs(before, after, "pair", reach)
    xy = near.join(before.select("pair", F.col("id").alias("a"), F.col("x").alias("px"), F.col("y").alias("py")), ["pair", "a"]).join(after.select("pair", F.col("id").alias("b"), F.col("x").alias("cx"), F.col("y").alias("cy")), ["pair", "b"])
    moved = xy.select("pair", (F.col("px") - F.col("cx")).alias("dx"), (F.col("py") - F.col("cy")).alias("dy"))
    bins = moved.groupBy("pair", F.floor(F.col("dx") / cell).alias("bx"), F.floor(F.col("dy") / cell).alias("by")).agg(F.count(F.lit(1)).alias("votes"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy"))
    best = bins.groupBy("pair").agg(F.max(F.struct("votes", -F.abs("bx") - F.abs("by"), "bx", "by", "dx", "dy")).alias("m")).select("pair", "m.dx", "m.dy", "m.votes")
    out = pairs.where("prev_sample_id is not null").select(F.col("sample_id").alias("pair"), "prev_sample_id").join(best, "pair", "left")
    status = F.when(F.col("votes").isNull(), "missing").otherwise("estimated")
    if dims is not None:
        out = out.join(dims.select(F.col("image_no").alias("pair"), "width", "height"), "pair").join(dims.select(F.col("image_no").alias("prev_sample_id"), F.col("width").alias("pw"), F.col("height").alias("ph")), "prev_sample_id")
        differs = (F.col("width") != F.col("pw")) | (F.col("height") != F.col("ph"))
        status = F.when(differs, "shape_mismatch").otherwise(status)
    out = out.withColumn("status", status)
    ok = F.col("status") == "estimated"
    return out.select("pair", F.when(ok, F.col("dx")).alias("dx"), F.when(ok, F.col("dy")).alias("dy"), "votes", "status")


def choose_mode(raw: DataFrame, registered: DataFrame, shifts: DataFrame) -> DataFrame:
    """(pair, used): registered where its matches are at least as many and, with three or more on both sides, not farther.

    Otherwise raw, named by why: fallback_<status of the shift> or fallback_no_improvement.
    """
    return _with_mode(_sized(raw, registered, shifts))


def _sized(raw: DataFrame, registered: DataFrame, shifts: DataFrame) -> DataFrame:
    s = lambda m, n: m.groupBy("pair").agg(F.count(F.lit(1)).alias(f"n_{n}"), F.percentile("d", 0.5).alias(f"median_{n}"))
    return shifts.join(s(raw, "raw"), "pair", "left").join(s(registered, "reg"), "pair", "left").select("pair", "dx", "dy", "votes", "status", "n_raw", "median_raw", "n_reg", "median_reg").fillna(0, ["n_raw", "n_reg"])


def _with_mode(both: DataFrame) -> DataFrame:
    better = (F.col("n_reg") >= F.col("n_raw")) & (F.when((F.col("n_reg") >= 3) & (F.col("n_raw") >= 3), F.col("median_reg") <= F.col("median_raw")).otherwise(True))
    used = F.when(F.col("status") != "estimated", F.concat(F.lit("fallback_"), "status")).when(better, "registered").otherwise("fallback_no_improvement")
    return both.withColumn("used", used)


def match_samples(pairs: DataFrame, points: DataFrame, reach: float, shifts: DataFrame | None = None) -> DataFrame:
    """(pair, a, b, d): gated one-to-one matches of each sample (b) with the one before (a), after moving b by its shift."""
    before, after = _sides(pairs, points)
    if shifts is not None:
        after = after.join(shifts.where("dx is not null").select("pair", "dx", "dy"), "pair").select("pair", "id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    return gated_assignment(before, after, "pair", reach)


def pair_qc(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Counts, matched share of the smaller side (null where a side is empty), unmatched on both sides, mean and median distance."""
    m = matches.groupBy("pair").agg(F.count(F.lit(1)).alias("n_matched"), F.avg("d").alias("mean_d"), F.percentile("d", 0.5).alias("median_d"))
    q = pairs.where("prev_sample_id is not null").join(m, F.col("sample_id") == F.col("pair"), "left").drop("pair").fillna(0, ["n_matched"])
    least = F.least("n_prev", "n_cur")
    return q.withColumns({"matched_fraction": F.when(least > 0, F.col("n_matched") / least), "unmatched_prev": F.col("n_prev") - F.col("n_matched"), "unmatched_cur": F.col("n_cur") - F.col("n_matched")})


def track_ids(manifest: DataFrame, points: DataFrame, matches: DataFrame) -> DataFrame:
    """(sample_id, object_id, track_id, displacement): matched objects carry on a track, others begin one.

    All pairs are matched at once; a track's beginning is found by doubling along the matches. Tracks are numbered over
    everything by group, sample and object, in ranges of track beginnings. Samples are below 2**31, objects below 2**32.
    """
    key = lambda s, o: packed((s, 1 << 31), (o, 1 << 32))
    order = Window.partitionBy("animal_id", "eye").orderBy("timepoint_dpi", "sample_id")
    m = manifest.withColumn("prev", F.lag("sample_id").over(order)).select("sample_id", "prev", "animal_id", "eye", "timepoint_dpi")
    rows = points.select(F.col("image_no").alias("sample_id"), F.col("id").alias("object_id")).join(m.hint("shuffle_hash"), "sample_id")  # few columns of many points look small
    linked = rows.join(matches.select(F.col("pair").alias("sample_id"), F.col("b").alias("object_id"), "a", "d"), ["sample_id", "object_id"], "left")
    steps = linked.withColumns({"id": key("sample_id", "object_id"), "parent": F.when(F.col("a").isNotNull(), key("prev", "a"))})
    roots = chain_roots(steps.select("id", "parent"))
    order = [F.col(c) for c in ("animal_id", "eye", "timepoint_dpi", "sample_id", "object_id")]
    starts = numbered(steps.where("parent is null").select(F.col("id").alias("root"), *order), order, "track_id").select("root", F.col("track_id").cast("int").alias("track_id"))
    shown = F.when(F.col("prev").isNull(), 0.0).otherwise(F.col("d"))
    return steps.join(roots.hint("merge"), "id").join(starts.hint("merge"), "root").select("animal_id", "eye", "sample_id", "object_id", "track_id", F.col("prev").alias("prev_sample_id"), shown.alias("displacement"))


def follow_samples(manifest: DataFrame, pairs: DataFrame, points: DataFrame, reach: float, mutual: bool = False) -> DataFrame:
    """``track_ids`` of the matches within ``reach``: one to one, or with ``mutual`` of points that are each other's nearest.

    A task takes the points of a run of consecutive samples once, matches them and names each object's track by its beginning
    (sample of the run, how many begin there before it), or by the object of the sample before the run that it goes on from.
    Only the latter are followed from run to run. Beginnings are numbered by a running sum over samples. Where a pair has
    more than TILE_POINTS points, all go by rows of matches.
    """
    pairs = cut(pairs)
    if pairs.where((F.col("n_prev") > 0) & (F.col("n_cur") > 0) & (F.col("n_prev") + F.col("n_cur") > TILE_POINTS)).limit(1).count():
        if mutual:
            return track_ids(manifest, points, cut(mutual_nearest(near_pairs(*_sides(pairs, points), "pair", reach), "pair")))
        return track_ids(manifest, points, match_samples(pairs, points, reach))
    kind, match = pairs.schema["sample_id"].dataType.simpleString(), mutual_within if mutual else assigned_within

    def solve(table: pa.Table, samples: list[tuple[int, int, int]]) -> pa.RecordBatch:
        x, y, ids, turn = (column(table, c) for c in ("x", "y", "id", "turn"))
        heads = np.concatenate([[True], _differ(table, "head")]) if table.num_rows else np.zeros(0, dtype=bool)
        nth, place, distance = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int32), np.full(len(x), np.nan)
        shown, begun, links, helds, number = [], [], [], [], 0
        for first, m, last in samples:
            number = 0 if heads[m] else number
            if turn[m] == 0:  # the sample before the run
                place[m:last] = np.arange(last - m)
                continue
            number += 1
            i, j, d = match(x[first:m], y[first:m], x[m:last], y[m:last], reach)
            free = np.ones(last - m, dtype=bool)
            free[j] = False
            begins = m + np.flatnonzero(free)
            nth[begins], place[begins] = number, np.arange(1, len(begins) + 1)
            nth[m + j], place[m + j], distance[m + j] = nth[first + i], place[first + i], d
            if number == 1:
                held = np.sort(place[m + j])
            shown.append((m, last, number))
            begun.append(len(begins))
            links.append(held if number == 1 else held[:0])
            helds.append(held)
        for (m, last, _), held in zip(shown, helds, strict=True):  # places among those of the sample before that go on
            back = m + np.flatnonzero(nth[m:last] == 0)
            place[back] = np.searchsorted(held, place[back])
        at = np.array([s[0] for s in shown], dtype=np.int64)
        rows = np.concatenate([np.arange(m, last) for m, last, _ in shown]) if shown else np.zeros(0, dtype=np.int64)
        lists = lambda v, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), v)
        each = np.concatenate([[0], np.cumsum([last - m for m, last, _ in shown])])
        columns = [lists(pa.array(ids[rows]), each), lists(pa.array(distance[rows], from_pandas=True), each), lists(pa.array(nth[rows]), each), lists(pa.array(place[rows]), each)]
        joined = lists(pa.array(np.concatenate(links) if links else np.zeros(0), pa.int32()), np.concatenate([[0], np.cumsum([len(v) for v in links])]))
        small = [taken(table, c, at) for c in ("head", "s", "next")]
        return pa.RecordBatch.from_arrays([*small, pa.array([s[2] for s in shown], pa.int32()), pa.array(begun, pa.int64()), joined, *columns], names=["head", "s", "next", "number", "begun", "links", "ids", "d", "nth", "place"])

    schema = f"head {kind}, s {kind}, next {kind}, number int, begun long, links array<int>, ids array<long>, d array<double>, nth array<int>, place array<int>"
    found = kept(_in_runs(_run_roles(pairs), points, solve, schema))
    sample = pairs.select(F.col("sample_id").alias("s"), "animal_id", "eye", "timepoint_dpi", "prev_sample_id")
    order = [F.col(c) for c in ("animal_id", "eye", "timepoint_dpi", "s")]
    offsets = cut(summed_before(found.select("head", "s", "number", "begun").join(sample, "s"), order, "begun", "before").select("head", "number", "before"))
    link = lambda head, k: F.struct(head.alias("head"), k.cast("int").alias("k"))
    asked = found.where("number = 1 and size(links) > 0").select(F.col("head").alias("to"), F.posexplode("links").alias("k", "at"))
    ends = found.where("next is not null").select(F.col("next").alias("to"), F.col("head").alias("of"), F.posexplode(F.arrays_zip("nth", "place")).alias("at", "e"))
    steps = cut(asked.join(ends.hint("merge"), ["to", "at"]).select(link(F.col("to"), F.col("k")).alias("id"), "of", "e.nth", "e.place"))
    roots = chain_roots(steps.select("id", F.when(F.col("nth") == 0, link(F.col("of"), F.col("place"))).alias("parent")))
    starts = steps.where("nth > 0").select(F.col("id").alias("root"), F.col("of").alias("head"), F.col("nth").alias("number"), "place")
    told = roots.join(starts.join(offsets, ["head", "number"]).select("root", (F.col("before") + F.col("place")).alias("track")), "root").select("id.head", "id.k", "track")
    listed = lambda f, key, value, name: f.groupBy("head").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda v: v[value]).alias(name))
    runs = listed(offsets, "number", "before", "befores").join(listed(told, "k", "track", "tracks"), "head", "left")
    rows = found.select("head", "s", "ids", "d", "nth", "place").join(runs, "head").join(sample, "s")
    rows = rows.select("animal_id", "eye", F.col("s").alias("sample_id"), "prev_sample_id", "befores", "tracks", F.inline(F.arrays_zip("ids", "d", "nth", "place")))
    track = F.when(F.col("nth") > 0, F.get("befores", F.col("nth") - 1) + F.col("place")).otherwise(F.get("tracks", F.col("place")))
    shown = F.when(F.col("prev_sample_id").isNull(), 0.0).otherwise(F.col("d"))
    return rows.select("animal_id", "eye", "sample_id", F.col("ids").cast(points.schema["id"].dataType).alias("object_id"), track.cast("int").alias("track_id"), "prev_sample_id", shown.alias("displacement"))


def track_pairs(tracks: DataFrame) -> DataFrame:
    """(pair, d) of all matches that tracks are made of."""
    return tracks.where("prev_sample_id is not null and displacement is not null").select(F.col("sample_id").alias("pair"), F.col("displacement").alias("d"))


def common_frame(pairs: DataFrame, used: DataFrame) -> DataFrame:
    """(sample_id, segment, offset_x, offset_y): shifts added up along registered pairs; any other pair begins a segment."""
    order = Window.partitionBy("animal_id", "eye").orderBy("timepoint_dpi", "sample_id")
    rows = pairs.join(used.select(F.col("pair").alias("sample_id"), "dx", "dy", "used"), "sample_id", "left")
    on = F.coalesce(F.col("used") == "registered", F.lit(False))
    seg = rows.withColumn("segment", F.sum((~on).cast("int")).over(order))
    inside = Window.partitionBy("animal_id", "eye", "segment").orderBy("timepoint_dpi", "sample_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = lambda c: F.sum(F.when(on, F.col(c)).otherwise(0.0)).over(inside)
    return seg.select("animal_id", "eye", "sample_id", "segment", part("dx").alias("offset_x"), part("dy").alias("offset_y"))


def track_summary(tracks: DataFrame, qc: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Tracks (counted at their beginnings), observations, pairs, mean matched share and mean displacement of each (animal, eye)."""
    t = tracks.groupBy("animal_id", "eye").agg(F.count_if(F.col("prev_sample_id").isNull() | F.col("displacement").isNull()).alias("n_tracks"), F.count(F.lit(1)).alias("n_observations"), F.avg(F.when(F.col("prev_sample_id").isNotNull(), F.col("displacement"))).alias("mean_displacement"))
    q = qc if used is None else qc.join(used.select(F.col("pair").alias("sample_id"), "used"), "sample_id", "left")
    kind = F.lit(None).cast("string") if used is None else F.col("used")
    p = q.groupBy("animal_id", "eye").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(kind == "registered").alias("registered_pairs"), F.count_if(kind.startswith("fallback")).alias("fallback_pairs"), F.avg("matched_fraction").alias("mean_matched_fraction"))
    return t.join(p, ["animal_id", "eye"], "full_outer").fillna(0, ["n_tracks", "n_observations", "n_pairs", "registered_pairs", "fallback_pairs"])
