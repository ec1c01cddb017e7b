"""Rows sorted by their keys, handed to a task whole group by whole group, many small groups at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    if pa.types.is_struct(column.type):
        parts = [changes(c) for c in column.flatten()]
        null = column.is_null().to_numpy(zero_copy_only=False)
        return np.logical_or.reduce([*parts, null[1:] != null[:-1]])
    null = column.is_null().to_numpy(zero_copy_only=False)
    unequal = pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
    return unequal | (null[1:] != null[:-1])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of some whole groups, where each group begins and the last one ends), from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []

    def given(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        cuts = np.zeros(rows.num_rows - 1, dtype=bool)
        for k in keys:
            cuts |= changes(rows.column(k).combine_chunks())
        return rows, np.concatenate([[0], np.flatnonzero(cuts) + 1, [rows.num_rows]])

    for batch in batches:
        if not batch.num_rows:
            continue
        edge = pa.Table.from_batches([*(h.slice(h.num_rows - 1) for h in held[-1:]), batch]).combine_chunks()
        cuts = np.zeros(edge.num_rows - 1, dtype=bool)
        for k in keys:
            cuts |= changes(edge.column(k).combine_chunks())
        if not cuts.any():
            held.append(batch)
            continue
        first = int(np.flatnonzero(cuts)[-1]) + 1 - (edge.num_rows - batch.num_rows)
        ready = [*held, batch.slice(0, first)] if first else held
        yield given([r for r in ready if r.num_rows])
        held = [batch.slice(first)]
    if held:
        yield given(held)


def by_groups(rows: DataFrame, keys: Sequence[str], solve: Callable, schema: str, order: Sequence[Column | str] = ()) -> DataFrame:
    """``solve`` over the rows of whole groups: called with a table and where its groups begin, it gives a record batch.

    Groups are dealt by a hash of their keys, sorted by Spark; a task holds one batch of rows and one group beyond it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            yield solve(table, starts)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def taken(table: pa.Table, name: str, rows: np.ndarray) -> pa.Array:
    return table.column(name).combine_chunks().take(pa.array(rows, pa.int64()))


def sided(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points (keys, id, x, y) of two tables as one, with __side 0 and 1."""
    one = lambda f, s: f.select(*[F.col(k).alias(k) for k in keys], F.lit(s).cast("byte").alias("__side"), F.col("id").cast("bigint").alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return one(left, 0).unionByName(one(right, 1))
