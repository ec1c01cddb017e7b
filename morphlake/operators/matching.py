"""One-to-one matching of points, gated by distance or not, and the metrics that follow from it."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.operators.graph import connected_components
from morphlake.operators.runs import by_groups, column, sided, taken
from morphlake.sources.storage import cut


#: Candidate pairs, of whole components, that a task solves at a time (more only where one component has more).
EDGES = 2000
#: Points of both sides of a tile, its margin apart.
TILE_POINTS = 20_000


def sparse_assignment(start: Sequence[int], to: Sequence[int], cost: Sequence[float], columns: int) -> tuple[list[int], list[float], list[float]] | None:
    """(column of each row, prices of rows, prices of columns) of the cheapest assignment of all rows along the given edges.

    Edges of row i are start[i] to start[i + 1]. A shortest augmenting path for each row, over edges only; None where some
    row can't be assigned. No edge costs less than its two prices, assigned ones exactly these, free columns have price 0.
    """
    rows = len(start) - 1
    mate, owner, u, v = [-1] * rows, [-1] * columns, [0.0] * rows, [0.0] * columns
    for i in range(rows):
        if start[i] == start[i + 1]:
            return None
        e = min(range(start[i], start[i + 1]), key=cost.__getitem__)
        u[i] = cost[e]
        if owner[to[e]] < 0:
            mate[i], owner[to[e]] = to[e], i
    for row in range(rows):
        if mate[row] >= 0:
            continue
        best: dict[int, float] = {}
        came: dict[int, int] = {}
        done: list[int] = []
        closed: set[int] = set()
        heap: list[tuple[float, int]] = []
        i, base = row, 0.0
        while True:
            for e in range(start[i], start[i + 1]):
                j = to[e]
                if j not in closed and (d := base + max(0.0, cost[e] - u[i] - v[j])) < best.get(j, math.inf):
                    best[j], came[j] = d, i
                    heappush(heap, (d, j))
            while heap and heap[0][1] in closed:
                heappop(heap)
            if not heap:
                return None
            base, j = heappop(heap)
            closed.add(j)
            if owner[j] < 0:
                break
            done.append(j)
            i = owner[j]
        u[row] += base
        for k in done:
            u[owner[k]] += base - best[k]
            v[k] -= base - best[k]
        while j >= 0:
            i = came[j]
            owner[j], mate[i], j = i, j, mate[i]
    return mate, u, v


def _edges(rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, n: int) -> tuple[list[int], list[int], list[float]]:
    order = np.lexsort((columns, rows))
    return np.searchsorted(rows[order], np.arange(n + 1)).tolist(), columns[order].tolist(), cost[order].tolist()


def closest_assignment(left: np.ndarray, right: np.ndarray, nearest: int = 8, cells: int = 1 << 20) -> list[tuple[int, int]]:
    """One-to-one pairs of all points of the smaller side of least total distance, without a table of all distances.

    Solved along the edges to each point's ``nearest`` others. Prices then show, a block of distances at a time, which
    left-out pairs would be better; these become edges, until none is. Where not all points find a partner, more edges are taken.
    """
    if len(left) > len(right):
        return [(b, a) for a, b in closest_assignment(right, left, nearest, cells)]
    n, m, step = len(left), len(right), max(1, cells // max(1, len(right)))
    if n == 1:
        return [(0, int(np.hypot(left[0, 0] - right[:, 0], left[0, 1] - right[:, 1]).argmin()))]
    blocks = lambda: ((a, np.hypot(left[a : a + step, None, 0] - right[None, :, 0], left[a : a + step, None, 1] - right[None, :, 1])) for a in range(0, n, step))
    while True:
        k = min(m, nearest)
        parts = [(np.repeat(np.arange(a, a + len(d)), k), at.reshape(-1), np.take_along_axis(d, at, 1).reshape(-1)) for a, d in blocks() for at in [np.argpartition(d, k - 1, axis=1)[:, :k]]] if n else []
        while parts:
            rows, columns, cost = (np.concatenate(x) for x in zip(*parts, strict=True))
            solved = sparse_assignment(*_edges(rows, columns, cost, n), m)
            if solved is None:
                break
            mate, u, v = solved
            if k == m:  # no pair is left out
                return list(enumerate(mate))
            missing = []
            for a, d in blocks():
                better = d - np.array(u[a : a + len(d)])[:, None] - np.array(v)[None] < -1e-9 * (1.0 + d)
                at = np.nonzero(better)
                missing.append((at[0] + a, at[1], d[at]))
            if not sum(len(x[0]) for x in missing):
                return list(enumerate(mate))
            parts += missing
        if not n:
            return []
        nearest *= 4


def _solve_component(pdf: pd.DataFrame) -> pd.DataFrame:
    """Most pairs first, then the least total distance, among the allowed edges of a component."""
    left, a = np.unique(pdf["a"], return_inverse=True)
    right, b = np.unique(pdf["b"], return_inverse=True)
    d = pdf["d"].to_numpy()
    alone = float(d.sum()) + 1.0  # the cost of staying without a partner: more than any set of pairs, so as few as possible do
    n, m = len(left), len(right)
    start, to, cost = _edges(np.concatenate([a, np.arange(n)]), np.concatenate([b, m + np.arange(n)]), np.concatenate([d, np.full(n, alone)]), n)
    mate = sparse_assignment(start, to, cost, m + n)[0]
    pairs = [(i, j) for i, j in enumerate(mate) if j < m]
    of = {(i, j): x for i, j, x in zip(a.tolist(), b.tolist(), d.tolist(), strict=True)}
    return pd.DataFrame({"g": pdf["g"].iloc[0], "a": [left[i] for i, _ in pairs], "b": [right[j] for _, j in pairs], "d": [of[p] for p in pairs]})


def _solve_components(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.concat([_solve_component(part) for _, part in pdf.groupby("c")], ignore_index=True)


def near_parts(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Indices and squared distance of all pairs of two point sets at most ``reach`` apart, about a million candidates at a time."""
    order = np.argsort(bx, kind="stable")
    low, high = np.searchsorted(bx[order], ax - 1.01 * reach), np.searchsorted(bx[order], ax + 1.01 * reach, "right")
    a, ends = 0, np.cumsum(high - low)
    while a < len(ax):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
        n = high[a:z] - low[a:z]
        i = np.repeat(np.arange(a, a + len(n)), n)
        j = order[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:z], n)]
        d2 = (ax[i] - bx[j]) * (ax[i] - bx[j]) + (ay[i] - by[j]) * (ay[i] - by[j])
        hit = d2 <= reach * reach
        yield i[hit], j[hit], d2[hit]
        a = z


def _near(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``near_parts`` together."""
    out = list(near_parts(ax, ay, bx, by, reach))
    return tuple(np.concatenate([o[k] for o in out]) if out else np.zeros(0, dtype=t) for k, t in enumerate(("i8", "i8", "f8")))


def assigned_within(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distance of the most pairs within ``reach`` that are one to one, of least total distance."""
    i, j, d2 = _near(ax, ay, bx, by, reach)
    if not len(i):
        return i, j, d2
    return _solve_edges(i, j, np.sqrt(d2), _components(i, j, len(ax), len(bx)))


def mutual_within(ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and distance of the pairs within ``reach`` that are each other's nearest, ties to the smaller index (``mutual_nearest``)."""
    i, j, d2 = _near(ax, ay, bx, by, reach)
    first, second = np.lexsort((j, d2, i)), np.lexsort((i, d2, j))
    own = lambda order, of: order[np.concatenate([[True], of[order][1:] != of[order][:-1]])] if len(order) else order
    both = np.intersect1d(own(first, i), own(second, j))
    return i[both], j[both], np.sqrt(d2[both])


def _components(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """The component of each edge between n left and m right points, named by its smallest left point."""
    left, right = np.arange(n), np.full(m, n)
    while True:
        before = left.copy()
        np.minimum.at(right, b, left[a])
        np.minimum.at(left, a, right[b])
        left = left[left]
        if np.array_equal(left, before):
            return left[a]


def _solve_edges(a: np.ndarray, b: np.ndarray, d: np.ndarray, component: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_solve_component`` for many components of edges (ids a and b) at once; pairs that are their own component need no solver."""
    _, c, size = np.unique(component, return_inverse=True, return_counts=True)
    alone = np.bincount(c, d, len(size)) + 1.0
    single = size[c] == 1
    left, i = np.unique(a[~single], return_inverse=True)
    right, j = np.unique(b[~single], return_inverse=True)
    n, m, cost = len(left), len(right), np.empty(len(left))
    cost[i] = alone[c[~single]]
    start, to, costs = _edges(np.concatenate([i, np.arange(n)]), np.concatenate([j, m + np.arange(n)]), np.concatenate([d[~single], cost]), n)
    mate = np.array(sparse_assignment(start, to, costs, m + n)[0], dtype=np.int64)
    row = np.flatnonzero(mate < m)
    key = i * m + j
    order = np.argsort(key, kind="stable")
    at = order[np.searchsorted(key[order], row * m + mate[row])]
    return np.concatenate([a[single], left[row]]), np.concatenate([b[single], right[mate[row]]]), np.concatenate([d[single], d[~single][at]])


def _tiled(points: DataFrame, large: DataFrame | None, group: str, reach: float, spread: bool) -> DataFrame:
    """Adds the tile of each point, or of each tile that it reaches, and whether that is the only one; groups that aren't ``large`` are one tile."""
    if large is None:
        return points.select("*", F.lit(0).cast("bigint").alias("__tx"), F.lit(0).cast("bigint").alias("__ty"), F.lit(True).alias("__only"))
    placed = points.join(F.broadcast(large), group, "left")
    at = lambda c, shift: F.when(F.col("__k").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("__k") - 1, F.floor((F.col(c) + shift - F.col(f"__{c}0")) / F.col("__w"))))).cast("bigint")
    if not spread:
        tiles = placed.withColumns({"__tx": at("x", 0.0), "__ty": at("y", 0.0), "__only": F.lit(True)})
    else:
        margin = 1.01 * reach
        tiles = placed.withColumns({"__xs": F.sequence(at("x", -margin), at("x", margin)), "__ys": F.sequence(at("y", -margin), at("y", margin))})
        tiles = tiles.withColumn("__only", (F.size("__xs") == 1) & (F.size("__ys") == 1)).select("*", F.explode("__xs").alias("__tx")).select("*", F.explode("__ys").alias("__ty"))
    return tiles.select(*points.columns, "__tx", "__ty", "__only")


def joined_points(x: np.ndarray, y: np.ndarray, reach: float) -> np.ndarray:
    """For each point the smallest index of those that links of at most ``reach`` lead to; about a million pairs are held at a time."""
    order = np.argsort(x, kind="stable")
    sx, sy, root = x[order], y[order], np.arange(len(x))
    n = np.searchsorted(sx, sx + 1.01 * reach, "right") - np.arange(1, len(x) + 1)
    a, ends = 0, np.cumsum(n)
    while a < len(x):
        z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + (1 << 20), "right")))
        m = n[a:z]
        i = np.repeat(np.arange(a, a + len(m)), m)
        j = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + i + 1
        hit = (sx[i] - sx[j]) * (sx[i] - sx[j]) + (sy[i] - sy[j]) * (sy[i] - sy[j]) <= reach * reach
        left, right = root[order[i[hit]]], root[order[j[hit]]]
        while (apart := left != right).any():
            left, right = left[apart], right[apart]
            np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
            while not np.array_equal(up := root[root], root):
                root = up
            left, right = root[left], root[right]
        a = z
    return root


def _large_groups(both: DataFrame, group: str, reach: float) -> DataFrame | None:
    """Groups of more than TILE_POINTS points, and how they are cut into tiles; None if there are none."""
    sizes = both.groupBy(group).agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{n}_{c}") for c in "xy" for f, n in ((F.min, "min"), (F.max, "max"))])
    k = F.ceil(F.sqrt(F.col("n") / TILE_POINTS))
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    large = cut(sizes.where(F.col("n") > TILE_POINTS).select(group, k.alias("__k"), F.greatest(extent / k, F.lit(4.0 * reach)).alias("__w"), F.col("min_x").alias("__x0"), F.col("min_y").alias("__y0")))
    return large if large.limit(1).count() else None


def point_components(points: DataFrame, group: str, reach: float) -> DataFrame:
    """(group, id, root): points (group, id, x, y) that have another within ``reach``, and the smallest id that chains of these lead to.

    Ids are unique within a group. A task joins the points of a group, or of a tile of a group with more than TILE_POINTS
    points and of the margin around it; no row is made for a pair. Only parts that other tiles may go on with become links,
    whose components are found over all tiles.
    """
    one = points.select(group, F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    large = _large_groups(one, group, reach)
    kind = points.schema[group].dataType.simpleString()

    def solve(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids, x, y, only = (column(rows, c) for c in ("id", "x", "y", "__only"))
        kept, roots, solved = [], [], []
        for first, last in zip(starts, starts[1:], strict=False):
            at = joined_points(x[first:last], y[first:last], reach)
            linked = np.bincount(at, minlength=last - first)[at] > 1
            open_ = np.zeros(last - first, dtype=bool)
            open_[at[~only[first:last]]] = True
            kept.append(first + np.flatnonzero(linked))
            roots.append(ids[first + at[linked]])
            solved.append(~open_[at[linked]])
        at, root, done = (np.concatenate(v) for v in (kept, roots, solved))
        return pa.RecordBatch.from_arrays([taken(rows, group, at), pa.array(ids[at]), pa.array(root), pa.array(done)], names=[group, "id", "root", "solved"])

    # sorted by id within a group, so that the smallest index has the smallest id
    found = by_groups(_tiled(one, large, group, reach, True), [group, "__tx", "__ty"], solve, f"`{group}` {kind}, id long, root long, solved boolean", ["id"])
    if large is None:
        return found.select(group, "id", "root")
    found = cut(found)
    open_ = found.where("not solved").select(F.col(group).alias("g"), "id", "root")
    node = lambda c: F.xxhash64("g", c)
    comp = connected_components(open_.select(node("id").alias("a"), node("root").alias("b")))
    placed = open_.select("g", "id", node("id").alias("node")).distinct().join(comp.withColumnRenamed("root", "c"), "node")
    least = placed.groupBy("g", "c").agg(F.min("id").alias("root"))
    placed = placed.join(least, ["g", "c"]).select(F.col("g").alias(group), "id", "root")
    return found.where("solved").select(group, "id", "root").unionByName(placed)


def gated_assignment(previous: DataFrame, following: DataFrame, group: str, reach: float) -> DataFrame:
    """(group, a, b, d): the largest set of pairs within ``reach``, of least total distance.

    Candidate pairs split into components, which are solved on their own. A task finds the pairs and components of a group,
    or of a tile of a group with more than TILE_POINTS points, and solves at once those components that no other tile can
    have a part of. Only pairs of the rest become rows, whose components are found over all tiles.
    """
    keys = [group, "__tx", "__ty"]
    both = sided(previous, following, [group])
    large = _large_groups(both, group, reach)
    kind = previous.schema[group].dataType.simpleString()

    def solve(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        side, ids, x, y, only = (column(rows, c) for c in ("__side", "id", "x", "y", "__only"))
        out: list[tuple] = []
        for first, last in zip(starts, starts[1:], strict=False):
            m = first + int(np.searchsorted(side[first:last], 1))
            i, j, d2 = _near(x[first:m], y[first:m], x[m:last], y[m:last], reach)
            if not len(i):
                continue
            component = _components(i, j, m - first, last - m)
            a, b, d = ids[first:m][i], ids[m:last][j], np.sqrt(d2)
            open_ = np.isin(component, component[~only[m:last][j]])
            for edges, solved in ((_solve_edges(a[~open_], b[~open_], d[~open_], component[~open_]), True), ((a[open_], b[open_], d[open_]), False)):
                out.append((np.full(len(edges[0]), first), *edges, np.full(len(edges[0]), solved)))
        at, a, b, d, solved = (np.concatenate([o[c] for o in out]) if out else np.zeros(0, dtype=t) for c, t in enumerate(("i8", "i8", "i8", "f8", "?")))
        return pa.RecordBatch.from_arrays([taken(rows, group, at), pa.array(a), pa.array(b), pa.array(d), pa.array(solved)], names=["g", "a", "b", "d", "solved"])

    tiled = _tiled(both.where("__side = 0"), large, group, reach, False).unionByName(_tiled(both.where("__side = 1"), large, group, reach, True))
    found = cut(by_groups(tiled, keys, solve, f"g {kind}, a long, b long, d double, solved boolean", ["__side"]))
    done = found.where("solved").select(F.col("g").alias(group), "a", "b", "d")
    if large is None:
        return done
    return done.unionByName(_solve_open(found.where("not solved").select("g", "a", "b", "d")).withColumnRenamed("g", group))


def _solve_open(edges: DataFrame) -> DataFrame:
    """(g, a, b, d) of the pairs taken among edges (g, a, b, d) whose components may reach over several tiles."""
    node = lambda side, c: F.xxhash64("g", F.lit(side), c)
    named = edges.withColumns({"na": node("l", "a"), "nb": node("r", "b")})
    comp = connected_components(named.select(F.col("na").alias("a"), F.col("nb").alias("b")))
    placed = named.join(comp.select(F.col("node").alias("na"), F.col("root").alias("c")), "na").select("g", "a", "b", "d", "c")
    size = placed.groupBy("c", "g").agg(F.count(F.lit(1)).alias("n"))
    placed = placed.join(size.select("c", "n"), "c")
    parts = size.where("n > 1").groupBy("g").agg(F.ceil(F.sum("n") / EDGES).cast("int").alias("parts"))
    several = placed.where("n > 1").select("c", "g", "a", "b", "d").join(parts, "g")
    kind = edges.schema["g"].dataType.simpleString()
    solved = several.groupBy("g", F.pmod(F.xxhash64("c"), F.col("parts")).alias("part")).applyInPandas(_solve_components, f"g {kind}, a long, b long, d double")
    return cut(placed.where("n = 1").select("g", "a", "b", "d").unionByName(solved))


def point_match(truth: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, d): the assignment of least total distance over all points of each region, not limited by any distance.

    truth, found: keys, id, x, y. A task holds one region's points and a few edges of each (``closest_assignment``), small
    regions many at a time. Apply a tolerance to d afterwards.
    """
    names = list(keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in truth.select(*names).schema) + ", a long, b long, d double"

    def solve(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        side, ids, x, y = (column(rows, c) for c in ("__side", "id", "x", "y"))
        xy, out = np.stack([x, y], 1), [np.zeros((0, 2), dtype=np.int64)]
        for first, last in zip(starts, starts[1:], strict=False):
            m = first + int(np.searchsorted(side[first:last], 1))
            if m == first or m == last:
                continue
            pairs = closest_assignment(xy[first:m], xy[m:last])
            out.append(np.array(pairs, dtype=np.int64).reshape(-1, 2) + (first, m))
        i, j = np.concatenate(out).T
        d = np.sqrt(((xy[i] - xy[j]) ** 2).sum(1))
        return pa.RecordBatch.from_arrays([*[taken(rows, n, i) for n in names], pa.array(ids[i]), pa.array(ids[j]), pa.array(d)], names=[*names, "a", "b", "d"])

    return by_groups(sided(truth, found, names), names, solve, schema, ["__side", "id"])


def match_metrics(truth: DataFrame, found: DataFrame, matches: DataFrame, keys: Sequence[str], tolerances: Sequence[float]) -> DataFrame:
    """True and false positives, misses, precision, recall, F1, count error and mean distance at each tolerance.

    All three ratios are 1 where both sides are empty, 0 where undefined. The matching is solved once for all tolerances.
    """
    n = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_true")).join(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found")), list(keys), "full_outer").fillna(0)
    at = n.select("*", F.explode(F.lit([float(t) for t in tolerances])).alias("tolerance"))
    hits = matches.join(at.select(*keys, "tolerance"), list(keys)).where("d <= tolerance").groupBy(*keys, "tolerance").agg(F.count(F.lit(1)).alias("tp"), F.avg("d").alias("mean_distance"))
    s = at.join(hits, [*keys, "tolerance"], "left").fillna(0, ["tp"])
    empty = (F.col("n_true") == 0) & (F.col("n_found") == 0)
    share = lambda top, below: F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(top.cast("double"), below.cast("double")), F.lit(0.0)))
    s = s.withColumns({"fp": F.col("n_found") - F.col("tp"), "fn": F.col("n_true") - F.col("tp"), "precision": share(F.col("tp"), F.col("n_found")), "recall": share(F.col("tp"), F.col("n_true"))})
    f1 = F.when(empty, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    return s.withColumns({"f1": f1, "count_bias": F.col("n_found") - F.col("n_true"), "count_abs": F.abs(F.col("n_found") - F.col("n_true"))})


def unmatched(rows: DataFrame, matches: DataFrame, keys: Sequence[str], side: str) -> DataFrame:
    """Points of one side (a or b) that no match has."""
    return rows.join(matches.select(*keys, F.col(side).alias("id")), [*keys, "id"], "left_anti")


def mutual_nearest(near: DataFrame, group: str) -> DataFrame:
    """(group, a, b, d) of candidate pairs (group, a, b, d2) that are each other's nearest, ties to the smaller id: a matching without a solver."""
    first = near.groupBy(group, "a").agg(F.min(F.struct("d2", "b")).alias("m")).select(group, "a", "m.b", "m.d2")
    second = near.groupBy(group, "b").agg(F.min(F.struct("d2", "a")).alias("m")).select(group, "m.a", "b")
    return first.join(second, [group, "a", "b"]).select(group, "a", "b", F.sqrt("d2").alias("d"))


def curation_delta(first: DataFrame, final: DataFrame, keys: Sequence[str], tolerance: float, matches: DataFrame | None = None) -> DataFrame:
    """Points added, deleted and left between two versions of a point set, by ``matches`` or the assignment of least total distance."""
    m = match_metrics(first, final, point_match(first, final, keys) if matches is None else matches, keys, [tolerance])
    return m.select(*keys, F.col("fp").alias("added"), F.col("fn").alias("deleted"), F.col("n_found").alias("final"))
