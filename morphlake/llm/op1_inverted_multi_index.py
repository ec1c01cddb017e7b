"""Approximate nearest neighbours by an inverted multi-index.

The two halves of a vector are quantised on their own, so ``codewords`` centroids a half make codewords**2 cells. A query
visits cells in order of the summed squared distances of its halves to the two centroids, taken from a heap that grows
along both sorted lists, until the cells visited hold enough entries; the entries of those cells are then ranked by
their exact distance. How many entries are enough is measured: a sample of queries is searched by brute force, and enough
is what lets them meet the aimed share of their true neighbours.

Visited cells are those whose sum is at most that of the last one, so a query carries two numbers, not a list. Queries are
dealt into chunks in the order of their nearest cells, entries into parts of neighbouring cells; an entry goes to the chunks
that have a query which visits its cell.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, table

CHUNK, PART = 2048, 20_000
RECALL, MEASURED = 0.97, 64


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, no null or non-finite component, not all zero, not empty.

    All others are left out; of different lengths, the commonest (the smallest of these) takes part. A null id is kept.
    """
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(sound, F.lit(False)))
    width = kept.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return kept.where(F.size("v") == (width["d"] if width else 0))


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None])


def _slack(points: np.ndarray, centres: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """A bound on the error of ``squares`` from rounding, of the vectors' own moving and scaling too (their components were at most 1)."""
    eps = np.finfo(np.float64).eps
    moved = 8 * eps * math.sqrt(points.shape[1])
    return 8 * (points.shape[1] + 8) * eps * ((points**2).sum(1)[:, None] + (centres**2).sum(1)[None]) + 2 * np.sqrt(squares) * moved + moved**2


def distances(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to one vector; where squares overflow or vanish, of scaled components."""
    apart = points - to
    with np.errstate(over="ignore", under="ignore"):
        out = np.sqrt((apart**2).sum(axis=1))
    odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
    if len(odd):
        a, b = points[odd] / 2, to / 2  # halves, so that differences don't overflow
        most = np.abs(a - b).max(axis=1)
        scale = np.where(most > 0, most, 1.0)
        with np.errstate(over="ignore"):
            out[odd] = np.where(most > 0, np.sqrt((((a - b) / scale[:, None]) ** 2).sum(axis=1)) * scale * 2, 0.0)
    return out


class Codebook:
    """Centroids of both halves, of vectors moved by ``centre`` and divided by ``scale`` so that squares stay finite."""

    def __init__(self, points: np.ndarray, scale: float, k: int, rounds: int):
        self.scale = scale
        points = points / scale
        self.centre = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        self.half = points.shape[1] // 2
        self.one, self.two = (self._kmeans(h, k, rounds) for h in self._halves(points - self.centre))
        self.wide = len(self.two)

    @staticmethod
    def _kmeans(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
        distinct = np.unique(points, axis=0)
        centres = distinct[np.random.default_rng(7).permutation(len(distinct))[:k]].copy()
        for _ in range(rounds):
            own = _squares(points, centres).argmin(axis=1)
            held = np.bincount(own, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, own, points)
            centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
        return centres

    def _halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def moved(self, x: np.ndarray) -> np.ndarray:
        return x / self.scale - self.centre

    def squares(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of the halves of moved vectors to the centroids."""
        a, b = self._halves(x)
        return _squares(a, self.one), _squares(b, self.two)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.squares(x)
        return a.argmin(axis=1) * self.wide + b.argmin(axis=1)


def fit(vectors: DataFrame, rows: int, sample: int = 16_384, rounds: int = 15) -> Codebook:
    """Fitted on the ``sample`` vectors of smallest hash (all, if fewer); codewords grow with the rows, from 16 to 256 a half."""
    drawn = vectors.select("v").orderBy(F.xxhash64("vec_id", "v")).limit(sample).collect()
    most = vectors.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]
    return Codebook(np.array([r[0] for r in drawn], dtype=np.float64), float(most or 1.0), min(256, max(16, round(math.sqrt(rows) / 4))), rounds)


def reach(first: np.ndarray, second: np.ndarray, entries: np.ndarray, enough: int) -> float:
    """The sum of the last cell (i * len(second) + j, by growing first[i] + second[j]) visited until ``enough`` entries are met."""
    rows, cols = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, got, last = [(first[rows[0]] + second[cols[0]], 0, 0)], {(0, 0)}, 0, -1.0
    while heap and got < enough:
        last, i, j = heapq.heappop(heap)
        got += int(entries[int(rows[i]) * len(second) + int(cols[j])])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(rows) and y < len(cols) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[rows[x]] + second[cols[y]], x, y))
    return float(last)


class Query:
    """A query with the best entries met so far: ids, exact distances, cells, and upper bounds of the squares ``limit`` is taken from."""

    def __init__(self, row, book: Codebook):
        self.id, self.row, self.v = row.vec_id, row.query_row, np.asarray(row.v, dtype=np.float64)
        self.moved = book.moved(self.v[None])[0]
        self.best = (np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))

    def meet(self, k: int, points: np.ndarray, ids: np.ndarray, cells: np.ndarray, about: np.ndarray, slack: np.ndarray) -> None:
        """Rank the entries that can be among the best ``k`` by their exact distances."""
        high = about + slack
        limit = self.best[3].max() if len(self.best[0]) == k else np.inf
        if len(high) > k:
            limit = min(limit, np.partition(high, k - 1)[k - 1])
        take = np.flatnonzero(about - slack <= limit)
        if len(take):
            new = (distances(points[take], self.v), ids[take], cells[take], high[take])
            d, own, at, top = (np.append(x, y) for x, y in zip(self.best, new, strict=True))
            order = np.lexsort((own, d))[:k]
            self.best = (d[order], own[order], at[order], top[order])

    def found(self) -> pd.DataFrame:
        d, ids, cells, _ = self.best
        return pd.DataFrame({"query_id": self.id, "query_row": self.row, "vec_id": ids, "score": d, "cell": cells})


FOUND = "query_id long, query_row long, vec_id long, score double, cell int"


def _meet_all(queries: list[Query], entries: pd.DataFrame, book: Codebook, k: int, reaches: tuple | None = None) -> None:
    """Show entries to all queries, or to those whose (first, second, limit) reaches their cells; a query's own row is no entry."""
    step = max(64, (1 << 21) // max(1, len(queries)))
    q = np.array([x.moved for x in queries])
    for at in range(0, len(entries), step):
        rows = entries.iloc[at : at + step]
        ids, cells, first = rows["vec_id"].to_numpy(), rows["cell"].to_numpy(), rows["occ"].to_numpy() == 1
        x = np.array(rows["v"].tolist(), dtype=np.float64)
        moved = book.moved(x)
        about = _squares(q, moved)
        slack = _slack(q, moved, about)
        may = np.ones(about.shape, dtype=bool) if reaches is None else reaches[0][:, cells // book.wide] + reaches[1][:, cells % book.wide] <= reaches[2][:, None]
        for i, query in enumerate(queries):
            own = np.flatnonzero((ids == query.id) & first)
            may[i, own[(x[own] == query.v).all(axis=1)]] = False
            held = np.flatnonzero(may[i])
            if len(held):
                query.meet(k, x[held], ids[held], cells[held], about[i, held], slack[i, held])


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "query_row").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _enough(entries: DataFrame, queries: DataFrame, book: Codebook, held: np.ndarray, k: int, recall: float, measured: int) -> int:
    """Entries to be met so that ``measured`` queries, of smallest hash, meet a share of ``recall`` of their true neighbours."""
    drawn = queries.orderBy(F.xxhash64("vec_id", "v"), "query_row").limit(measured).collect()
    if not drawn:
        return 1

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = [Query(r, book) for r in drawn]
        for pdf in batches:
            _meet_all(asked, pdf, book, k)
        yield pd.concat([q.found() for q in asked])

    near, of = _best(entries.mapInPandas(brute, FOUND), k).select("query_row", "cell").collect(), {}  # at most measured * k rows
    for r in drawn:
        a, b = (x[0] for x in book.squares(Query(r, book).moved[None]))
        of[r.query_row] = (a[:, None] + b[None]).reshape(-1)
    needed = [int(held[of[r.query_row] < of[r.query_row][r.cell]].sum()) + 1 for r in near]
    return math.ceil(np.quantile(needed, recall, method="higher")) if needed else 1


def _ranges(counts: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, groups): neighbouring cells share a group of at most about ``most`` rows, a fuller one has several."""
    out, group, size = [], 0, 0
    for cell in np.flatnonzero(counts).tolist():
        n = int(counts[cell])
        if size and size + n > most:
            group, size = group + 1, 0
        pieces = max(1, -(-n // most))
        out.append((cell, group, pieces))
        group, size = (group + pieces, 0) if pieces > 1 else (group, size + n)
    return out


def _counts(frame: DataFrame, cells: int) -> np.ndarray:
    out = np.zeros(cells, dtype=np.int64)
    for r in frame.groupBy("cell").count().collect():  # at most 256 * 256 rows
        out[r["cell"]] = r["count"]
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, sample: int = 16_384, recall: float = RECALL, measured: int = MEASURED, all_cells: bool = False) -> DataFrame:
    """The ``k`` nearest entries found for each query: query_id, rank (from 1), vec_id, score (Euclidean distance).

    vectors: (vec_id, v) as ``usable`` gives them; queries: rows of them. A query's own row is no candidate; each row of a
    repeated id is a query, and a candidate of the others. Rows without an id take no part. A query looks at the cells that
    hold its first ``enough`` entries in visiting order, which is measured (isotropic vectors need up to half of all for a
    recall of 0.9; clustered ones far less); ``all_cells`` makes the search exact. Ties go to the smaller vec_id. Of equal
    vectors only the k + 1 of smallest id can be among the k nearest of any query, so no others are ranked; nothing else is
    left out. Very large, very small and far off-centre components are allowed. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    equal, same = Window.partitionBy("v").orderBy("vec_id"), Window.partitionBy("v", "vec_id").orderBy(F.lit(0))
    entries = vectors.where("vec_id is not null").withColumn("twin", F.row_number().over(equal)).where(F.col("twin") <= k + 1)
    entries = entries.withColumn("occ", F.row_number().over(same)).select("vec_id", "v", "occ")
    asked = cut(queries.where("vec_id is not null").select("vec_id", "v", F.monotonically_increasing_id().alias("query_row")))
    entries = cut(entries)
    rows = entries.count()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    book = fit(entries, rows, sample)
    cells = len(book.one) * book.wide

    def with_cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(cell=book.cells(book.moved(np.array(pdf["v"].tolist(), dtype=np.float64))).astype(np.int32) if len(pdf) else pd.Series(dtype=np.int32))

    entries = cut(entries.mapInPandas(with_cell, "vec_id long, v array<double>, occ int, cell int"))
    held = _counts(entries, cells)
    enough = int(held.sum()) if all_cells else _enough(entries, asked, book, held, k, recall, measured)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                a, b = book.squares(book.moved(np.array(pdf["v"].tolist(), dtype=np.float64)))
                first = a.argmin(axis=1) * book.wide + b.argmin(axis=1)
                yield pdf.assign(cell=first.astype(np.int32), reach=[reach(p, q, held, enough) * (1 + 1e-9) + 1e-30 for p, q in zip(a, b, strict=True)])

    asked = cut(asked.mapInPandas(probe, "vec_id long, v array<double>, query_row long, cell int, reach double"))
    chunks = spark.createDataFrame(_ranges(_counts(asked, cells), CHUNK), "cell int, start int, pieces int")
    parts = spark.createDataFrame(_ranges(held, max(PART, rows // 2000)), "cell int, start int, pieces int")
    dealt = lambda key: (F.col("start") + F.pmod(F.xxhash64(key), F.col("pieces"))).cast("int")
    asked = asked.join(F.broadcast(chunks), "cell").select(dealt("query_row").alias("chunk"), "vec_id", "v", "query_row", "reach")  # at most 65,536 rows

    def visits(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = book.squares(book.moved(np.array(pdf["v"].tolist(), dtype=np.float64)))
        seen = np.zeros((len(book.one), book.wide), dtype=bool)
        for p, q, most in zip(a, b, pdf["reach"], strict=True):
            seen |= p[:, None] + q[None] <= most * (1 + 1e-9)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[0], "cell": np.flatnonzero(seen.reshape(-1) & (held > 0)).astype(np.int32)})

    needed = asked.groupBy("chunk").applyInPandas(visits, "chunk int, cell int").join(F.broadcast(parts), "cell")
    needed = cut(needed.select("chunk", "cell", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("pieces") - 1)).alias("part")))
    met = entries.join(F.broadcast(parts), "cell").withColumn("part", dealt("vec_id")).join(needed, ["cell", "part"])
    both = asked.join(needed.select("chunk", "part").distinct(), "chunk").select("chunk", "part", F.lit(0).alias("kind"), "vec_id", "v", F.lit(0).alias("occ"), F.lit(0).alias("cell"), "query_row", "reach")
    both = both.unionByName(met.select("chunk", "part", F.lit(1).alias("kind"), "vec_id", "v", "occ", "cell"), allowMissingColumns=True)
    both = both.repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind")

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best k of each query of a (chunk, part), whose queries come before its entries."""
        now, wanted, reaches = None, [], None
        for pdf in batches:
            for group, rows in pdf.groupby(["chunk", "part"], sort=False):
                if group != now:
                    yield from (q.found() for q in wanted)
                    now, wanted, reaches = group, [], None
                wanted += [Query(q, book) for q in rows[rows["kind"] == 0].astype({"query_row": "int64"}).itertuples()]
                limits = rows.loc[rows["kind"] == 0, "reach"].to_numpy()
                if len(limits):
                    squares = book.squares(np.array([q.moved for q in wanted[-len(limits) :]]))
                    new = (*squares, limits)
                    reaches = new if reaches is None else tuple(np.concatenate(x) for x in zip(reaches, new, strict=True))
                _meet_all(wanted, rows[rows["kind"] == 1], book, k, reaches)
        yield from (q.found() for q in wanted)

    return _best(both.mapInPandas(rank, FOUND), k).select("query_id", "rank", "vec_id", "score")


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings"))
    return search(vectors, vectors.where("vec_id % 100 = 0"))
