"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text alone are binned at quantiles. Boosting goes round the features; each step fits a shallow tree (at
most four leaves) on one feature's histogram of gradients and adds it to that feature's lookup table, so that the model
stays a sum of tables. Then the pairs of features that explain most of what is left get tables of their own, boosted
the same way with one cut on each feature. A score is a sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import learns_from, table
from morphlake.llm.textblocks import PIECE, cased_words, encode, line_bytes, mix, runs

FEATURES = (
    "words", "word_length", "word_spread", "upper", "digits", "signs", "stops", "other_bytes", "spaces", "lines", "distinct_words", "commonest_word",
    "repeated_lines", "line_length", "signed_words", "capital_words", "longest_word", "distinct_pairs", "packed", "byte_entropy", "doubled_words", "bare_signs",
)
SAMPLE = 20_000
BINS, ROUNDS, RATE, PAIRS, LEAST = 32, 60, 0.15, 6, 20
KEEP_AT = 0.7


def _classes() -> np.ndarray:
    """A row for each class of bytes: upper, lower, digit, full stop or comma, other ASCII sign, non-ASCII, space, line feed."""
    out = np.zeros((8, 256), dtype=bool)
    for row, chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,", [], range(128, 256), [0x20, *range(9, 14)], [10])):
        out[row, list(chars)] = True
    out[4] = ~out[[0, 1, 2, 3, 5, 6]].any(axis=0)
    return out


_CLASS = _classes().astype(np.float64)
_SIGN_BYTES = np.isin(np.arange(256), list(b"!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~"))


def _largest(doc: np.ndarray, values: np.ndarray, docs: int) -> np.ndarray:
    """The largest of each document's values, 0 where it has none; ``doc`` ascends."""
    out = np.zeros(docs)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        out[doc[first]] = np.maximum.reduceat(values, first)
    return out


def _distinct(doc: np.ndarray, values: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different values (44-bit hashes) each document has, and how often its commonest occurs."""
    keys = np.sort(doc.astype(np.uint64) << np.uint64(44) | values >> np.uint64(20))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    of = (keys[first] >> np.uint64(44)).astype(np.int64)
    return np.bincount(of, minlength=docs).astype(np.float64), _largest(of, np.diff(np.append(first, len(keys))), docs)


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; zeros for texts without words. Worked out for a megabyte of texts at a time."""
    out, at = [np.zeros((0, len(FEATURES)))], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) + 1 <= PIECE):
            size += len(texts[end]) + 1
            end += 1
        out.append(_features(texts[at:end]))
        at = end
    return np.concatenate(out)


def _features(texts: list[bytes]) -> np.ndarray:
    raw, docs = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8), len(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    of_byte = np.repeat(np.arange(docs), size + 1)
    held = np.bincount(of_byte * 256 + raw, minlength=docs * 256).reshape(docs, 256).astype(np.float64)
    held[:, 10] -= 1  # the byte between two texts
    upper, lower, digit, stop, sign, other, space, feed = _CLASS @ held.T
    starts, ends, words = runs(raw, cased_words())
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n, length = np.bincount(doc, minlength=docs), (ends - starts).astype(np.float64)
    some, size = np.maximum(n, 1), np.maximum(size, 1)
    mean = np.bincount(doc, weights=length, minlength=docs) / some
    spread = np.sqrt(np.bincount(doc, weights=(length - mean[doc]) ** 2, minlength=docs) / some)
    longest = _largest(doc, length, docs)
    seen, most = _distinct(doc, words, docs)
    line_starts, _, lines = runs(raw, line_bytes())
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    full, total = np.bincount(line_doc, minlength=docs), feed + 1
    different = _distinct(line_doc, lines, docs)[0] + (full < total)
    beside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = _distinct(doc[beside], mix(words[beside] * np.uint64(3) + words[beside + 1]), docs)[0]
    doubled = np.bincount(doc[beside[words[beside] == words[beside + 1]]], minlength=docs)
    signed, capital = _SIGN_BYTES[raw[ends - 1]], (raw[starts] >= 65) & (raw[starts] <= 90)
    count = lambda which: np.bincount(doc[which], minlength=docs)
    share = held / size[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    packed = np.array([len(zlib.compress(t, 1)) for t in texts]) / size
    rows = [
        np.log1p(n), mean, spread, upper / np.maximum(1.0, upper + lower), digit / size, sign / size, stop / size, other / size, space / size, feed / size, seen / some,
        most / some, 1 - different / total, np.log1p(size / total), count(signed) / some, count(capital) / some, np.log1p(longest),
        pairs / np.maximum(1, n - 1), packed, entropy, doubled / some, count(signed & (length == 1)) / some,
    ]
    return np.where(n[:, None] > 0, np.column_stack(rows), 0.0)


class AdditiveModel:
    """Bin edges, one table for each feature, and one for each chosen pair; all bounded by the parameters."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = BINS, rounds: int = ROUNDS, rate: float = RATE, pairs: int = PAIRS):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T] if len(x) else [np.zeros(0)] * len(FEATURES)
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        rate_of_ones = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
        if not len(x):
            return
        binned = self.binned(x)
        at = np.full(len(y), self.base)
        for _ in range(rounds):
            for j, column in enumerate(binned):
                step = rate * _shallow(*_histogram(column, len(self.tables[j]), at, y))
                self.tables[j] += step
                at += step[column]
        if not pairs:
            return
        coarse = [np.minimum(c * 8 // len(t), 7) for c, t in zip(binned, self.tables, strict=True)]
        gains = sorted(((-_pair_step(*_histogram(a * 8 + b, 64, at, y), (8, 8))[1], i, j) for i, a in enumerate(coarse) for j, b in enumerate(coarse) if i < j))
        self.pairs = [(i, j) for _, i, j in gains[:pairs]]
        self.pair_tables = [np.zeros((len(self.tables[i]), len(self.tables[j]))) for i, j in self.pairs]
        for _ in range(rounds // 2):
            for (i, j), grid in zip(self.pairs, self.pair_tables, strict=True):
                step = rate * _pair_step(*_histogram(binned[i] * grid.shape[1] + binned[j], grid.size, at, y), grid.shape)[0]
                grid += step
                at += step[binned[i], binned[j]]

    def binned(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        total = np.full(len(x), self.base)
        for t, c in zip(self.tables, b, strict=True):
            total += t[c]
        for (i, j), grid in zip(self.pairs, self.pair_tables, strict=True):
            total += grid[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _histogram(cell: np.ndarray, cells: int, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = 1 / (1 + np.exp(-at))
    return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells), np.bincount(cell, minlength=cells)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> int:
    """The best place to cut a row of bins in two, 0 for none."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gain = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    gain = np.where((nl >= LEAST) & (n.sum() - nl >= LEAST), gain, 0)
    return int(gain.argmax()) + 1 if len(gain) and gain.max() > 1e-6 else 0


def _shallow(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    at = _cut(g, h, n) if depth else 0
    if not at:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    return np.concatenate([_shallow(g[:at], h[:at], n[:at], depth - 1), _shallow(g[at:], h[at:], n[at:], depth - 1)])


def _pair_step(g: np.ndarray, h: np.ndarray, n: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, float]:
    """The best tree of one cut on each feature (four quadrants), as a table, and its gain."""
    G, H, N = (np.cumsum(np.cumsum(v.reshape(shape), axis=0), axis=1) for v in (g, h, n))

    def quadrants(c: np.ndarray) -> list[np.ndarray]:
        low, right, bottom = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [low, right - low, bottom - low, c[-1, -1] - right - bottom + low]

    if min(shape) < 2:
        return np.zeros(shape), 0.0
    gq, hq, nq = quadrants(G), quadrants(H), quadrants(N)
    gain = sum(_gain(a, b) for a, b in zip(gq, hq, strict=True))
    gain = np.where(np.minimum.reduce(nq) >= LEAST, gain, 0)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    if gain[a, b] <= 0:
        return np.zeros(shape), 0.0
    v = [gq[k][a, b] / (hq[k][a, b] + 1.0) for k in range(4)]
    rows, cols = np.arange(shape[0])[:, None] <= a, np.arange(shape[1])[None] <= b
    return np.where(rows & cols, v[0], np.where(rows, v[1], np.where(cols, v[2], v[3]))), float(gain[a, b])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    """Fit on the ``sample`` labelled ids of smallest id hash (all, if fewer) among those that learn.

    Rows without label, text or id, and those whose crc32(doc_id) mod 4 is 2, are not learnt from; nor are ids with both
    labels. Of documents that share an id the text of smallest hash is learnt from. Without any label the score is 0.5;
    where only one label occurs it is near that label.
    """
    known = labels.where("quality is not null and doc_id is not null").where(learns_from("doc_id", 4, 2))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
    known = known.select("id", F.col("low").cast("double").alias("y")).orderBy(F.xxhash64("id"), "id").limit(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": list(features(encode(pdf["text"])))})

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null").join(F.broadcast(known), "id")
    one = texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = one.mapInPandas(measure, "id long, y double, x array<double>").collect()  # at most ``sample`` rows
    rows.sort(key=lambda r: r["id"])
    return AdditiveModel(np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES)), np.array([r["y"] for r in rows], dtype=np.float64))


def with_score(docs: DataFrame, model: AdditiveModel, column: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``column`` (replaced if there); null and empty texts have one score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series(shared.value.score(features(encode(s))))

    return docs.withColumn(column, score(F.col("text")))


def keep_good(docs: DataFrame, labels: DataFrame, at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns, null and shared ids too."""
    own = "__quality"
    while own in docs.columns:
        own += "_"
    return with_score(docs, fit_quality(docs, labels), own).where(F.col(own) >= at).drop(own)


def op8_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = with_score(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~learns_from("doc_id", 4, 2)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))
