"""Ranked lexical search the other way round: the items are indexed, the documents are the queries.

An inverted index of the items' terms (term -> items that hold it, and how often) goes to every task. Documents stream
through it: a document's counts of indexed terms meet the items of those terms, so a document is read by itself and never
shuffled. Each item has a heap of its best documents so far, which is all that a task holds of its documents, and the
heaps of all tasks are merged. A pass before it gathers how many documents hold each indexed term.

The index is bounded: items with more terms in all than ``most_terms`` are dealt to parts by hash, until no part has more
(or is a single item), and documents stream through one part after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heappushpop
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, table
from morphlake.llm.textblocks import alphanumeric_words, counted, encode, word_hashes

TOP = 20
#: Distinct terms, summed over items, of one part of the index: 24 bytes each, with the statistics 50 MB.
MOST_TERMS = 2_000_000
#: Bytes of text taken at a time, and cells of the table of documents by items that these fill at a time.
SLICE, CELLS = 4 << 20, 4_000_000
#: Up to here sums of whole numbers in doubles are exact.
_EXACT = 1 << 53
_MERGERS = 64


@dataclass
class Index:
    """Terms in order of hash; postings of term t are those from start[t] to start[t + 1]; ids has None for a null id."""

    terms: np.ndarray
    start: np.ndarray
    item: np.ndarray
    times: np.ndarray
    ids: list[int | None]


def _item_terms(items: DataFrame) -> DataFrame:
    """(row, item_id, terms, times): a row for each item that has a term, with its distinct terms' hashes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, per_item = word_hashes(encode(batch.column(2).to_pylist()), alphanumeric_words())
            found = [counted(part) for part in np.split(hashes, np.cumsum(per_item)[:-1])]
            terms = pa.array([t.view(np.int64) for t, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), terms, pa.array([c for _, c in found], pa.list_(pa.int64()))], names=["row", "item_id", "terms", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return cut(rows.mapInArrow(read, "row long, item_id long, terms array<long>, times array<long>").where(F.size("terms") > 0))


def _parts(terms: DataFrame, most_terms: int) -> list[DataFrame]:
    """The items dealt by hash to as few parts as keep each within the bound; a part above it is a single item."""
    n, size = 1, F.size("terms")
    while True:
        part = F.pmod(F.xxhash64("row"), F.lit(n))
        most = terms.groupBy(part.alias("part")).agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("items")).where("items > 1").agg(F.max("size")).first()[0]
        if most is None or most <= most_terms:
            return [terms.where(part == p) for p in range(n)]
        n *= 2


def _index(part: DataFrame) -> Index:
    """The inverted index of one part, whose size has been checked."""
    rows = part.orderBy("row").toArrow()
    sizes = rows["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, dtype=np.int64)
    flat = lambda name: rows[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) if rows.num_rows else np.zeros(0, dtype=np.int64)
    term, item, times = flat("terms").view(np.uint64), np.repeat(np.arange(rows.num_rows), sizes), flat("times")
    order = np.argsort(term, kind="stable")
    terms, df = counted(term)
    return Index(terms, np.concatenate([[0], np.cumsum(df)]).astype(np.int64), item[order], times[order], rows["item_id"].to_pylist())


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= SLICE:
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def _indexed_terms(texts: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text with repeats; and (text, term, occurrences) of the indexed ones, by text."""
    hashes, per_text = word_hashes(texts, alphanumeric_words())
    if not len(terms):
        return per_text, *(np.zeros(0, dtype=np.int64),) * 3
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    known = terms[at] == hashes
    keys, tf = counted(np.repeat(np.arange(len(texts)), per_text)[known] * len(terms) + at[known])
    return per_text, keys // len(terms), keys % len(terms), tf


def _statistics(docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms in all, and the number of documents that hold each indexed term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = index.value.terms
        df, n, total = np.zeros(len(terms), dtype=np.int64), 0, 0
        for batch in batches:
            texts = encode(batch.column(0).to_pylist())
            for a, b in _slices(texts):
                per_text, _, term, _ = _indexed_terms(texts[a:b], terms)
                df += np.bincount(term, minlength=len(terms))
                n, total = n + int((per_text > 0).sum()), total + int(per_text.sum())
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held]), pa.int64()), pa.array(np.concatenate([[n, total], df[held]]), pa.int64())], names=["term", "n"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row a term of the part
    found = dict(zip(sums["term"].to_pylist(), sums["n"].to_pylist(), strict=True))
    return found.get(-2, 0), found.get(-1, 0), np.array([found.get(t, 0) for t in range(len(index.value.terms))], dtype=np.int64)


class Heaps:
    """The ``top`` best (score, -doc_id) of each item; a null doc_id comes after all others."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        self.least = np.ones(items, dtype=np.int64)  # a score must reach this to enter

    def offer(self, scores: np.ndarray, doc_ids: list[int | None]) -> None:
        """scores: a row a document, a column an item."""
        doc, item = np.nonzero(scores >= self.least)
        score = scores[doc, item]
        if len(doc) > self.top * len(self.heaps):  # of many, only each item's best with all their ties can enter
            order = np.lexsort((-score, item))
            doc, item, score = doc[order], item[order], score[order]
            first = np.searchsorted(item, np.arange(len(self.heaps)))
            last = np.minimum(first + self.top - 1, len(item) - 1)
            bound = np.where(item[last] == np.arange(len(self.heaps)), score[last], 0)
            enters = score >= bound[item]
            doc, item, score = doc[enters], item[enters], score[enters]
        for d, i, s in zip(doc.tolist(), item.tolist(), score.tolist(), strict=True):
            entry, heap = (s, -(1 << 64) if doc_ids[d] is None else -doc_ids[d]), self.heaps[i]
            if len(heap) < self.top:
                heappush(heap, entry)
            else:
                heappushpop(heap, entry)
            if len(heap) == self.top:
                self.least[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int | None, int]]:
        for item, heap in enumerate(self.heaps):
            for score, key in heap:
                yield item, None if key == -(1 << 64) else -key, score


def _scores(index: Index, weight: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
    """The whole-number score of each document (row) for each item (column)."""
    items = len(index.ids)
    part = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
    length = index.start[term + 1] - index.start[term]
    at = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length) + np.repeat(index.start[term], length)
    value, cell = np.repeat(part, length) * index.times[at], np.repeat(doc, length) * items + index.item[at]
    if float(value.sum(dtype=np.float64)) < _EXACT:
        return np.bincount(cell, value, len(m) * items).astype(np.int64).reshape(len(m), items)
    out = np.zeros(len(m) * items, dtype=np.int64)
    np.add.at(out, cell, value)
    return out.reshape(len(m), items)


def _best(docs: DataFrame, index, weight, n: int, total: int, top: int) -> DataFrame:
    """(item, item_id, doc_id, score): the heaps of every task."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = index.value, weight.value
        heaps = Heaps(len(own.ids), top)
        step = max(1, CELLS // max(1, len(own.ids)))
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())
            for a, b in _slices(texts):
                per_text, doc, term, tf = _indexed_terms(texts[a:b], own.terms)
                m = 100 - 25 + (25 * per_text * n) // max(1, total)
                for low, high in pairwise([*range(0, b - a, step), b - a]):
                    x, y = np.searchsorted(doc, [low, high])
                    heaps.offer(_scores(own, weights, m[low:high], doc[x:y] - low, term[x:y], tf[x:y]), ids[a + low : a + high])
        rows = list(heaps.rows())
        columns = [[r[0] for r in rows], [own.ids[r[0]] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item", "item_id", "doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(stream, "item long, item_id long, doc_id long, score long")


def reversed_search(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of highest score for each item, ties to the smaller doc_id.

    Every row of ``items`` is an item of its own and every row of ``docs`` a document, those of equal id too, each with its
    own ranks and places. Null ids are kept, a document's comes last among ties. Null and empty texts have no terms: such an
    item has no rows, such a document no score and no part in the counts. Without items or documents there are no rows.
    Texts of any length are read whole, and more text than ``SLICE`` is taken in slices of whole texts. Other columns,
    whatever their names, are ignored. Terms are compared by 64-bit hashes.
    """
    context, out = docs.sparkSession.sparkContext, None
    for number, part in enumerate(_parts(_item_terms(items), most_terms)):
        index = context.broadcast(_index(part))  # bounded by most_terms
        n, total, df = _statistics(docs, index)
        weight = context.broadcast(np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64))
        heaps = _best(docs, index, weight, n, total, top).withColumns({"part": F.lit(number), "merger": F.spark_partition_id() % _MERGERS})
        out = heaps if out is None else out.unionByName(heaps)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    merged = out.withColumn("rank", rank("part", "item", "merger")).where(F.col("rank") <= top)  # so that no task merges the heaps of all
    merged = merged.withColumn("rank", rank("part", "item")).where(F.col("rank") <= top)
    return merged.select("item_id", "rank", "doc_id", "score")


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
