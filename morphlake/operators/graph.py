"""Iterative relational operators: components, chains, and greedy suppression in rounds of tiles."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.operators.numbering import packed
from morphlake.operators.runs import by_groups, column, taken
from morphlake.sources.storage import cut


def connected_components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, b) links -> (node, root): the smallest id of each node's component; nodes without links don't appear.

    Rounds of large and small stars: every node's neighbours are linked with its smallest neighbour, until nothing moves.
    Among 100,000 links or more, nodes with over 1/500 of all (at most 1000 nodes) are joined by broadcast, so none fills a task.
    """

    def with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
        if count < 100_000:
            return edges.join(least.select("u", "m"), "u")
        hubs = F.broadcast(least.where(F.col("n") > limit).select("u", "m"))
        rest = edges.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("n") <= limit).select("u", "m"), "u")
        return edges.join(hubs, "u").unionByName(rest)

    links = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, count = None, links.count()
    for _ in range(rounds):
        limit = count // 500
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_least(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(least.select("u", F.col("m").alias("v")).unionByName(small).distinct())
        now = tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        count = now[0]
        if now == before:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = now
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def pixel_runs(pixels: DataFrame, group: str) -> DataFrame:
    """(group, y, x0, x1): unbroken runs of pixels (group, y, x) along rows."""
    row = Window.partitionBy(group, "y").orderBy("x")
    p = pixels.select(group, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x")).distinct()
    return p.withColumn("run", F.col("x") - F.row_number().over(row)).groupBy(group, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def pixel_components(pixels: DataFrame, group: str, size: int = 1 << 20, cell: int = 64) -> DataFrame:
    """Instances of foreground pixels (group, y, x) joined side by side; instance is 1.. within its image by first pixel.

    Runs along rows are the nodes, linked where runs of neighbouring rows overlap; these meet in stretches of ``cell``
    columns. Rows and columns are below ``size``, groups below 2**63 / size**2; larger ones raise.
    """
    runs = cut(pixel_runs(pixels, group).withColumn("id", packed((group, (1 << 63) // (size * size)), ("y", size), ("x0", size))))
    spread = runs.select(group, "y", "x0", "x1", "id", F.explode(F.sequence(F.floor(F.col("x0") / cell), F.floor(F.col("x1") / cell))).alias("cell"))
    above = spread.select(F.col(group).alias("g"), (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("id").alias("a"), "cell")
    below = spread.select(F.col(group).alias("g"), "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"), F.col("id").alias("b"), "cell")
    links = above.join(below, ["g", "y", "cell"]).where("a0 <= b1 and b0 <= a1").select("a", "b").distinct()
    roots = connected_components(links)
    found = runs.join(roots, runs["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
    number = found.select(group, "root").distinct().withColumn("instance", F.row_number().over(Window.partitionBy(group).orderBy("root")).cast("bigint"))
    return found.join(number, [group, "root"]).select(group, "y", F.explode(F.sequence("x0", "x1")).alias("x"), "instance")


def chain_roots(steps: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, parent or null) -> (id, root): follow parents to the start by doubling; log2 of the longest chain rounds.

    Rows without a parent are their own roots and don't travel; of the others only those that haven't arrived look on.
    """
    going = cut(steps.where("parent is not null").select("id", F.col("parent").alias("up")))
    arrived = []
    for _ in range(rounds):
        every = going
        for frame in arrived:
            every = every.unionByName(frame)
        ahead = every.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jumped = cut(going.join(ahead, "up", "left").select("id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")))
        arrived.append(jumped.where("not moved").drop("moved"))
        going = jumped.where("moved").drop("moved")
        if not going.limit(1).count():
            roots = steps.where("parent is null").select("id", F.col("id").alias("root"))
            for frame in arrived:
                roots = roots.unionByName(frame.select("id", F.col("up").alias("root")))
            return roots
    raise RuntimeError(f"chains have not ended in {rounds} rounds")


#: Points of a tile, its margin apart, that one task decides at a time; side of a tile where fewer are in it.
TILE_POINTS, TILE_SIDE = 20_000, 4096.0


def _near_lists(x: np.ndarray, y: np.ndarray, distance: float, closed: bool) -> tuple[np.ndarray, np.ndarray]:
    """For points in order: the earlier points near each, one after another, and where each point's begin."""
    by_x = np.argsort(x, kind="stable")
    low, high = np.searchsorted(x[by_x], x - distance, "left"), np.searchsorted(x[by_x], x + distance, "right")
    who, earlier = [], []
    for a in range(0, len(x), 1024):
        n = high[a : a + 1024] - low[a : a + 1024]
        i = np.repeat(np.arange(a, a + len(n)), n)
        j = by_x[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a : a + 1024], n)]
        d2 = (x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2
        hit = (j < i) & ((d2 <= distance * distance) if closed else (d2 < distance * distance))
        who.append(i[hit])
        earlier.append(j[hit])
    who, earlier = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (who, earlier))
    return earlier, np.searchsorted(who, np.arange(len(x) + 1))


def decide(x: np.ndarray, y: np.ndarray, state: np.ndarray, own: np.ndarray, distance: float, closed: bool) -> np.ndarray:
    """States (1 kept, -1 dropped, 0 open) of points in order, as far as what is near them tells: a point goes where an
    earlier one near it is kept, and stays where all earlier ones near it go; one that isn't ``own`` may have others near it."""
    earlier, start = _near_lists(x, y, distance, closed)
    now, near = state.tolist(), earlier.tolist()
    for i in range(len(now)):
        if now[i] == 0:
            states = [now[j] for j in near[start[i] : start[i + 1]]]
            now[i] = -1 if 1 in states else 1 if own[i] and 0 not in states else 0
    return np.array(now, dtype=np.int64)


def suppress_min_distance(points: DataFrame, group: str, order: Sequence[Column], distance: float, closed: bool = False, side: float = TILE_SIDE) -> DataFrame:
    """Points kept by a greedy pass in ``order`` (then by id) that drops points nearer than ``distance`` to a kept one.

    closed: points exactly at the distance go too. A task has the points of a tile and of a margin as wide as the distance,
    and decides in order whatever these tell; points that depend on others beyond are left open for the next round, whose
    tiles are shifted by half. Each round decides the first open point of every group at least, so there is no limit of
    rounds; their number grows with the tiles that a chain of dependent points crosses, not with its points. Tiles are halved
    until none has more than TILE_POINTS points or they are four distances wide. points: group, id, x, y and what the order
    needs; id must be unique within its group.
    """
    names = points.columns
    open_ = cut(points.withColumn("__state", F.lit(0)))

    def tiles(shift: float) -> list[Column]:
        return [F.floor((F.col(c) + shift) / side).alias(f"__t{c}") for c in "xy"]

    while side > 4 * distance and (open_.groupBy(group, *tiles(0.0)).count().agg(F.max("count")).first()[0] or 0) > TILE_POINTS:
        side /= 2
    kind = points.schema[group].dataType.simpleString()

    def solve(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x, y, state, own = (column(rows, f"__{c}") for c in ("x", "y", "state", "own"))
        new = np.zeros(rows.num_rows, dtype=np.int64)
        for a, b in zip(starts, starts[1:], strict=False):
            if (own[a:b] & (state[a:b] == 0)).any():
                new[a:b] = decide(x[a:b], y[a:b], state[a:b], own[a:b], distance, closed)
        told = np.flatnonzero(own & (state == 0))
        return pa.RecordBatch.from_arrays([taken(rows, group, told), taken(rows, "id", told), pa.array(new[told])], names=[group, "id", "__new"])

    turn = 0
    while open_.where("__state = 0").limit(1).count():
        shift = side / 2 * (turn % 2)
        near = lambda c: F.explode(F.sequence(F.floor((F.col(c) + (shift - distance)) / side), F.floor((F.col(c) + (shift + distance)) / side)))  # noqa: B023, E731
        spread = open_.select("*", *tiles(shift)).select("*", near("x").alias("__bx")).select("*", near("y").alias("__by"))
        own = (F.col("__tx") == F.col("__bx")) & (F.col("__ty") == F.col("__by"))
        spread = spread.withColumns({"__x": F.col("x").cast("double"), "__y": F.col("y").cast("double"), "__state": F.col("__state").cast("bigint"), "__own": own})
        told = by_groups(spread, [group, "__bx", "__by"], solve, f"`{group}` {kind}, id {points.schema['id'].dataType.simpleString()}, __new long", [*order, F.asc("id")])
        state = F.coalesce(F.col("__new"), F.col("__state").cast("bigint")).cast("int")
        open_ = cut(open_.join(told, [group, "id"], "left").withColumn("__state", state).where("__state >= 0").select(*names, "__state"))
        turn += 1
    return open_.select(*names)


def merge_candidates(points: DataFrame, group: str, tolerance: float) -> DataFrame:
    """Points of several sources (group, id, x, y, source, row): in source order, without those within ``tolerance`` of a kept one."""
    return suppress_min_distance(points, group, [F.asc("source"), F.asc("row")], tolerance, closed=True)
