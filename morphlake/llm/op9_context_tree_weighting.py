"""Language-model scoring by context-tree weighting.

A byte is eight binary decisions; each of the 255 nodes of that decomposition has a context tree whose levels are the
bytes before (``DEPTH`` of them). Every tree node holds a Krichevsky-Trofimov estimate, and the weighted mixture over
all prunings of the tree is computed from the leaves to the root, as logarithms of block probabilities. Scoring goes down
the path of the actual context and mixes the estimates of all depths by the posterior weight that the tree stops there; a
context that training hasn't seen gives each bit 1/2, as the weighting has it.

No task, and not the driver, holds the model. Texts are packed into blocks; each block names the byte sequences and words
that it holds. These are merged by their three nearest bytes (words: by a part of their hash), where the lower levels of
the tree are weighted; the upper levels are small aggregates. Each block then gets back the values of its own sequences
and words only, in front of its texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, learns_from, table
from morphlake.llm.textblocks import counted, merged, mix, whitespace_words, word_hashes

DEPTH = 5
#: Bytes of the context that a group of sequences shares, and bits that a code has below them.
SHARED, LOW_BITS = 3, 8 * (DEPTH + 1 - 3)
#: Sequences whose nodes a worker holds at a time, some 300 bytes each; groups of over twice as many are taken in slices.
MOST_CODES = 1 << 18
PIECE_BYTES, BLOCK_BYTES, FAN = 1 << 20, 32 << 20, 64
END = np.uint64(0x5851F42D4C957F2D)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_HALF_LOG_2PI = 0.9189385332046727
WORDS, BYTES = 0, 1
PACKED = "part int, seq int, ids binary, flags binary, sizes binary, blob binary, raw long"
HELD = "kind int, block int, grp long, keys binary, n binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, learns, text) rows as compressed pieces of about a megabyte; flags: 1 it is learnt from, 2 no id."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        text = batch.column(2).cast(pa.large_string()).fill_null("")
        if not len(text):
            continue
        _, ends, data = text.buffers()
        offsets = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        raw = memoryview(data) if data is not None else memoryview(b"")
        ids = batch.column(0)
        flags = batch.column(1).fill_null(True).to_numpy(zero_copy_only=False).astype(np.uint8) + 2 * ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(text):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, side="right")) - 1)
            low = bytes(raw[offsets[at] : offsets[end]]).translate(_LOWER)
            row = (part, seq, ids[at:end].tobytes(), flags[at:end].tobytes(), np.diff(offsets[at : end + 1]).tobytes(), pa.compress(low, codec="zstd", asbytes=True), len(low))
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.int64()), strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])
            seq, at = seq + 1, end


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Ids, flags and lower-cased texts of a piece."""
    sizes = np.frombuffer(row["sizes"], dtype=np.int64)
    blob = pa.decompress(row["blob"], decompressed_size=row["raw"], codec="zstd", asbytes=True) if row["raw"] else b""
    ends = np.cumsum(sizes).tolist()
    return np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["flags"], dtype=np.uint8), [blob[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _sequences(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the bytes (and a closing zero byte) of each text behind the DEPTH bytes before, the nearest highest; and their numbers."""
    raw = np.frombuffer(b"".join(b"\0" * DEPTH + d + b"\0" for d in docs), dtype=np.uint8).astype(np.uint64)
    codes = raw[DEPTH:].copy()
    for back in range(1, DEPTH + 1):
        codes |= raw[DEPTH - back : len(raw) - back] << np.uint64(8 * (DEPTH + 1 - back))
    sizes = np.array([len(d) + 1 for d in docs], dtype=np.int64)
    starts = np.cumsum(sizes + DEPTH) - sizes - DEPTH
    inside = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return codes[inside], sizes


def _learnt(values: np.ndarray, learn: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of the values that are learnt from, and zeros for the others."""
    others = counted(values[~learn])
    return [counted(values[learn]), (others[0], np.zeros_like(others[1]))]


def _grouped(kind: int, block: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted keys with counts as rows of one group each."""
    bits = LOW_BITS if kind == BYTES else 52
    group = (keys >> np.uint64(bits)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    low = (keys & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32) if kind == BYTES else keys
    ends = np.append(starts[1:], len(keys))
    for i in range(0, len(starts), 4096):
        cuts = list(zip(starts[i : i + 4096].tolist(), ends[i : i + 4096].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([kind] * len(cuts), pa.int32()), pa.array([block] * len(cuts), pa.int32()), pa.array(group[starts[i : i + 4096]], pa.int64()),
                pa.array([low[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([n[a:b].astype(np.int64).tobytes() for a, b in cuts], pa.binary()),
            ],
            names=[c.split()[0] for c in HELD.split(", ")],
        )


def _keys(kind: int, group: int, keys: bytes) -> np.ndarray:
    if kind == WORDS:
        return np.frombuffer(keys, dtype=np.uint64)
    return np.frombuffer(keys, dtype=np.uint32).astype(np.uint64) | np.uint64(group << LOW_BITS)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and byte sequences of each block, with how often those that are learnt from occur; pieces come sorted by block."""
    kept, now, words, codes, docs = whitespace_words(), None, [], [], 0

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None:
            words.append((np.array([END]), np.array([docs])))
            yield from _grouped(WORDS, now, *merged(words))
            yield from _grouped(BYTES, now, *merged(codes))

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != now:
                yield from done()
                now, words, codes, docs = row["block"], [], [], 0
            _, flags, texts = _unpack(row)
            learn = (flags & 1) == 1
            docs += int(learn.sum())
            hashes, n = word_hashes(texts, kept)
            words += _learnt(hashes, np.repeat(learn, n))
            grams, sizes = _sequences(texts)
            codes += _learnt(grams, np.repeat(learn, sizes))
            for parts in (words, codes):
                if sum(len(p[0]) for p in parts[1:]) > max(1 << 20, len(parts[0][0])):
                    parts[:] = [merged(parts)]
    yield from done()


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each (kind, grp, block) from rows sorted by these; block is here a number of several blocks."""
    now, parts = None, []

    def row() -> tuple:
        keys, n = merged(parts)
        low = keys if now[0] == WORDS else (keys & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint32)
        return (*now, low.tobytes(), n.astype(np.int64).tobytes())

    names = ["kind", "grp", "block", "keys", "n"]
    for pdf in batches:
        out = []
        for r in pdf[names].itertuples(index=False):
            if (r.kind, r.grp, r.block) != now:
                if now is not None:
                    out.append(row())
                now, parts = (r.kind, r.grp, r.block), []
            parts.append((_keys(r.kind, r.grp, r.keys), np.frombuffer(r.n, dtype=np.int64)))
        if out:
            yield pd.DataFrame(out, columns=names)
    if now is not None:
        yield pd.DataFrame([row()], columns=names)


def _merged_counts(held: DataFrame, blocks: int) -> DataFrame:
    """(kind, grp, keys, n) of the whole corpus; at most FAN rows of a group meet in a step, so a common group is no hot one."""
    while True:
        blocks = -(-blocks // FAN)
        held = held.withColumn("block", F.expr(f"int(block div {FAN})")) if blocks > 1 else held.withColumn("block", F.lit(0))
        held = held.repartition("kind", "grp", "block").sortWithinPartitions("kind", "grp", "block").mapInPandas(_merge, "kind int, grp long, block int, keys binary, n binary")
        if blocks <= 1:
            return cut(held.drop("block"))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, after moving small arguments up by eight."""
    small = x < 8
    y = np.where(small, x + 8, x)
    out = (y - 0.5) * np.log(y) - y + _HALF_LOG_2PI + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    rise = np.ones_like(y)
    few = x[small]
    if len(few):
        product = np.ones_like(few)
        for i in range(8):
            product *= few + i
        rise[small] = product
    return out - np.log(rise)


def log_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log block probability of so many zeros and ones by Krichevsky and Trofimov."""
    out = np.zeros(len(zeros))
    some = zeros + ones > 0
    a, b = zeros[some], ones[some]
    out[some] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def _log_blocks(zeros: pd.Series, ones: pd.Series) -> pd.Series:
    return pd.Series(log_block(zeros.to_numpy(dtype=np.float64), ones.to_numpy(dtype=np.float64)))


def _depths(codes: np.ndarray, n: np.ndarray, last: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, counts, item of each item of the depth before) of the depths DEPTH to ``last``, from sorted codes with counts."""
    out = [(codes, n.astype(np.float64), np.arange(len(codes)))]
    for _ in range(DEPTH - last):
        items, counts, _ = out[-1]
        wider, to_here = np.unique(((items >> np.uint64(16)) << np.uint64(8)) | (items & np.uint64(255)), return_inverse=True)
        out.append((wider, np.bincount(to_here, weights=counts, minlength=len(wider)), to_here))
    return out


def _levels(depths: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> list[dict]:
    """Binary nodes of bit ``k`` of each of ``depths``, in this order.

    A node: ``of`` (node of each item of the depth), ``key`` (context and bits so far), counts, the probability ``p`` of a
    one, the log of its weighted probability ``total``, the posterior weight of its own estimate, and ``up``, its parent's node.
    """
    out: list[dict] = []
    for items, counts, to_here in depths:
        context, symbol = items >> np.uint64(8), items & np.uint64(255)
        key = (context << np.uint64(8)) | np.uint64(1 << k) | (symbol >> np.uint64(8 - k))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of = np.zeros(len(items), dtype=np.int64)
        of[first[1:]] = 1
        of = np.cumsum(of)
        bit = (symbol >> np.uint64(7 - k)) & np.uint64(1)
        ones = np.bincount(of, weights=counts * bit, minlength=len(first))
        zeros = np.bincount(of, weights=counts, minlength=len(first)) - ones
        node = {"of": of, "key": key[first], "zeros": zeros, "ones": ones, "p": (ones + 0.5) / (zeros + ones + 1), "first": first, "bit": bit}
        if not out:
            node |= {"total": log_block(zeros, ones), "own": np.ones(len(first))}
        else:
            deeper = out[-1]
            deeper["up"] = of[to_here[deeper["first"]]]
            node |= _weighed(zeros, ones, np.bincount(deeper["up"], weights=deeper["total"], minlength=len(first)))
        out.append(node)
    return out


def _weighed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> dict[str, np.ndarray]:
    """Log weighted probability of nodes, and the weight of their own estimate, from what lies below them."""
    block = log_block(zeros, ones)
    total = np.logaddexp(block, below) - np.log(2)
    return {"total": total, "own": np.exp(block - np.log(2) - total)}


def _codes_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and counts of several groups, sorted, and the numbers of codes of each group in this order."""
    parts = [_keys(BYTES, g, k) for g, k in zip(pdf["grp"].tolist(), pdf["keys"], strict=True)]
    return np.concatenate(parts), np.concatenate([np.frombuffer(b, dtype=np.int64) for b in pdf["n"]]), np.array([len(p) for p in parts])


def _few_codes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of ``grp``, in frames of about MOST_CODES codes; a group of more is a frame of its own."""
    for pdf in batches:
        pdf = pdf.sort_values("grp", kind="stable", ignore_index=True)
        step = (pdf["keys"].map(len).cumsum() // (4 * MOST_CODES)).to_numpy()
        for s in np.unique(step):
            frame = pdf[step == s]
            large = (frame["keys"].map(len) > 4 * MOST_CODES).to_numpy()
            if not large.all() and len(frame) - large.sum():
                yield frame[~large].reset_index(drop=True)
            for i in np.flatnonzero(large):
                yield frame.iloc[i : i + 1].reset_index(drop=True)


def _slices(codes: np.ndarray) -> list[tuple[int, int]]:
    """Where to cut sorted codes so that no node deeper than SHARED bytes is cut: one slice, or for many codes one for about MOST_CODES, between fourth bytes."""
    if len(codes) <= 2 * MOST_CODES:
        return [(0, len(codes))]
    fourth = codes >> np.uint64(8 * (DEPTH - SHARED))
    starts = np.flatnonzero(np.concatenate([[True], fourth[1:] != fourth[:-1]]))
    kept = [0]
    for a, b in zip(starts, [*starts[1:], len(codes)], strict=True):
        if b - kept[-1] > MOST_CODES and a > kept[-1]:
            kept.append(int(a))
    return list(zip(kept, [*kept[1:], len(codes)], strict=True))


def _top_nodes(codes: np.ndarray, n: np.ndarray) -> Iterator[dict]:
    """The nodes of depth SHARED for each of the eight bits. Many codes are taken slice by slice, and their nodes summed."""
    slices = _slices(codes)
    if len(slices) == 1:
        depths = _depths(codes, n, SHARED)
        yield from (_levels(depths, k)[-1] for k in range(8))
        return
    parts: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(8)]
    for a, b in slices:
        depths = _depths(codes[a:b], n[a:b], SHARED)
        for k in range(8):
            nodes = _levels(depths, k)
            below = np.bincount(nodes[-2]["up"], weights=nodes[-2]["total"], minlength=len(nodes[-1]["key"]))
            parts[k].append((nodes[-1]["key"], nodes[-1]["zeros"], nodes[-1]["ones"], below))
    for k in range(8):
        keys, at = np.unique(np.concatenate([p[0] for p in parts[k]]), return_inverse=True)
        zeros, ones, below = (np.bincount(at, weights=np.concatenate([p[i] for p in parts[k]]), minlength=len(keys)) for i in (1, 2, 3))
        yield {"key": keys, "zeros": zeros, "ones": ones, "p": (ones + 0.5) / (zeros + ones + 1), **_weighed(zeros, ones, below)}


def _shared_nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the nodes of depth SHARED, summed by the context one byte shorter: zeros, ones, log weighted probability."""
    for pdf in _few_codes(batches):
        codes, n, _ = _codes_of(pdf)
        for node in _top_nodes(codes, n):
            short = ((node["key"] >> np.uint64(16)) << np.uint64(8)) | (node["key"] & np.uint64(255))
            keys, at = np.unique(short, return_inverse=True)
            sums = {c: np.bincount(at, weights=node[c], minlength=len(keys)) for c in ("zeros", "ones", "total")}
            yield pd.DataFrame({"context": (keys >> np.uint64(8)).astype(np.int64), "node": (keys & np.uint64(255)).astype(np.int32), **sums})


def _values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """log10 probability of each code's last byte behind its context, from the mixtures above (q, r) and the groups' own nodes."""
    for pdf in _few_codes(batches):
        codes, n, sizes = _codes_of(pdf)
        above = pdf.drop_duplicates("context")
        lengths = [len(x) for x in above["nodes"]]
        known = np.repeat(above["context"].to_numpy().astype(np.uint64), lengths) << np.uint64(8) | np.concatenate(above["nodes"].tolist()).astype(np.uint64)
        order = np.argsort(known)
        known, q0, r0 = known[order], np.concatenate(above["q"].tolist())[order], np.concatenate(above["r"].tolist())[order]
        slices, logs = _slices(codes), np.zeros(len(codes))
        tops = list(_top_nodes(codes, n)) if len(slices) > 1 else None
        for a, b in slices:
            depths = _depths(codes[a:b], n[a:b], SHARED)
            for k in range(8):
                levels = _levels(depths, k)
                if tops:  # a slice has only its part of the nodes it shares
                    whole = np.searchsorted(tops[k]["key"], levels[-1]["key"])
                    levels[-1] |= {c: tops[k][c][whole] for c in ("p", "own")}
                at = np.searchsorted(known, ((levels[-1]["key"] >> np.uint64(16)) << np.uint64(8)) | (levels[-1]["key"] & np.uint64(255)))
                q, r = q0[at], r0[at]
                for node in reversed(levels):
                    if node is not levels[-1]:
                        q, r = q[node["up"]], r[node["up"]]
                    q, r = q + r * node["own"] * node["p"], r * (1 - node["own"])
                one = q[levels[0]["of"]]
                logs[a:b] += np.log10(np.where(levels[0]["bit"] == 1, one, 1 - one))
        ends = np.cumsum(sizes).tolist()
        yield pd.DataFrame({"grp": pdf["grp"], "keys": pdf["keys"], "n": [logs[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]})


def context_tree(grams: DataFrame) -> DataFrame:
    """(grp, keys, n): the log10 probabilities (doubles, in n) of all byte sequences in ``grams`` (grp, keys, n: counts).

    A group's rows are one; it has at most 2 ** LOW_BITS sequences, 16 bytes each, whose nodes are made for MOST_CODES at a
    time and for one bit after another. Above SHARED bytes of context the nodes are rows: at
    most 255 for each of 65,536 contexts of two bytes, 256 of one byte, and the root.
    """
    two = grams.mapInPandas(_shared_nodes, "context long, node int, zeros double, ones double, total double")
    sums = [F.sum(c).alias(c) for c in ("zeros", "ones", "total")]

    def weighted(nodes: DataFrame) -> DataFrame:
        """Sums of what lies below -> own probability p, own weight, and the node's log weighted probability."""
        block = nodes.withColumn("block", F.pandas_udf(_log_blocks, "double")("zeros", "ones"))
        high = F.greatest("block", "total")
        both = high + F.log(F.exp(F.col("block") - high) + F.exp(F.col("total") - high)) - float(np.log(2))
        return block.withColumn("both", both).select("context", "node", "zeros", "ones", F.col("both").alias("total"), F.exp(F.col("block") - float(np.log(2)) - F.col("both")).alias("own"), ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("p"))

    two = cut(weighted(two.groupBy("context", "node").agg(*sums)))
    one = cut(weighted(two.groupBy(F.shiftright("context", 8).alias("context"), "node").agg(*sums)))
    root = weighted(one.groupBy("node").agg(*sums).withColumn("context", F.lit(0).cast("long")))
    mixed = root.select("node", (F.col("own") * F.col("p")).alias("q0"), (1 - F.col("own")).alias("r0"))

    def below(nodes: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        joined = nodes.join(above, on)
        return joined.select("context", "node", (F.col("q0") + F.col("r0") * F.col("own") * F.col("p")).alias("q"), (F.col("r0") * (1 - F.col("own"))).alias("r"))

    first = below(one, F.broadcast(mixed), ["node"])  # 255 rows
    first = first.select(F.col("context").alias("near"), "node", F.col("q").alias("q0"), F.col("r").alias("r0"))
    second = below(two.withColumn("near", F.shiftright("context", 8)), F.broadcast(first), ["near", "node"])  # at most 256 * 255 rows
    packed = second.groupBy("context").agg(F.collect_list(F.struct("node", "q", "r")).alias("x")).select("context", F.col("x.node").alias("nodes"), F.col("x.q").alias("q"), F.col("x.r").alias("r"))
    return grams.withColumn("context", F.shiftright("grp", 8)).join(packed, "context").mapInPandas(_values, "grp long, keys binary, n binary")


def _give(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The values of each block's own keys: a group's values come first, then the blocks that hold keys of it."""
    now = keys = values = None
    for pdf in batches:
        out = []
        for r in pdf.itertuples(index=False):
            if r.block < 0:
                now, keys, values = (r.kind, r.grp), _keys(r.kind, r.grp, r.keys), np.frombuffer(r.n, dtype=np.float64)
            elif (r.kind, r.grp) == now:
                out.append((r.kind, r.block, r.grp, r.keys, values[np.searchsorted(keys, _keys(r.kind, r.grp, r.keys))].tobytes()))
            else:
                raise ValueError("a group of sequences has no values")
        if out:
            yield pd.DataFrame(out, columns=["kind", "block", "grp", "keys", "n"])


class Lookup:
    """Values by 64-bit key: a table of slots, and a binary search for keys whose slot another one holds."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.slots = np.zeros(1 << (64 - int(self.shift)), dtype=np.int32)
        self.slots[self._slot(self.keys)] = np.arange(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        missed = np.flatnonzero(self.keys[at] != keys)
        at[missed] = np.minimum(np.searchsorted(self.keys, keys[missed]), len(self.keys) - 1)
        if (self.keys[at[missed]] != keys[missed]).any():
            raise ValueError("a block holds a key that it hasn't named")
        return self.values[at]


def _scorer(below: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of the texts of each block; the values of its keys come before them."""
        kept, now, given, known = whitespace_words(), None, ([], []), None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != now:
                    now, given, known = row["block"], ([], []), None
                if row["blob"] is None:
                    given[row["kind"]].append((_keys(row["kind"], row["grp"], row["keys"]), np.frombuffer(row["n"], dtype=np.float64)))
                    continue
                if known is None:
                    known = [Lookup(np.concatenate([k for k, _ in g]), np.concatenate([v for _, v in g])) for g in given]
                    given = ([], [])
                ids, flags, texts = _unpack(row)
                codes, sizes = _sequences(texts)
                score = np.add.reduceat(known[BYTES](codes), np.cumsum(sizes) - sizes)
                hashes, tokens = word_hashes(texts, kept)
                doc, c = np.repeat(np.arange(len(texts)), tokens), known[WORDS](hashes)
                end = float(known[WORDS](np.array([END]))[0])
                base = np.bincount(doc, weights=np.log10((c + 1) / below), minlength=len(texts)) + np.log10((end + 1) / below)
                found = np.bincount(doc, weights=c > 0, minlength=len(texts)).astype(np.int64) + (end > 0)
                arrays = [pa.array(ids, pa.int64(), mask=flags >= 2), *[pa.array(v, t) for v, t in ((tokens + 1, pa.int64()), (found, pa.int64()), (base, pa.float64()), (score, pa.float64()), (sizes, pa.int64()))]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "n_known", "base_score", "score", "bytes"])

    return score


def score_texts(docs: DataFrame, learns: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row of ``docs``.

    learns: a condition on rows of ``docs``; counts are taken from the rows where it holds or is null. A-Z are lower-cased;
    tokens are runs of other bytes than space and 0x09 to 0x0D, then one end. base_score adds up
    log10((c + 1) / (N + 1 * (V + 1))) over the tokens; score is log10 of the probability that context-tree weighting
    gives the lower-cased bytes and a closing zero byte. Null texts are empty. Null and shared ids are kept as they are,
    each row is scored by itself. Without training rows every c, N and V is 0 and each bit has probability 1/2. An empty
    table gives an empty one. Other columns, whatever their names, are ignored.
    """
    packed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), learns.alias("learns"), F.col("text").cast("string").alias("text")).mapInArrow(_pack, PACKED))
    raw = packed.agg(F.coalesce(F.sum("raw"), F.lit(0))).first()[0]
    spread = min(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-raw // PIECE_BYTES))
    blocks = max(1, -(-raw // BLOCK_BYTES), spread)
    packed = packed.withColumn("block", F.pmod(F.xxhash64("part", "seq"), F.lit(blocks)).cast("int"))
    held = cut(packed.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_held, HELD))
    counts = _merged_counts(held, blocks)
    words = counts.where(F.col("kind") == WORDS)
    sums = words.mapInPandas(_totals, "total long, seen long").agg(F.sum("total"), F.sum("seen")).first()
    total, distinct = (int(v or 0) for v in sums)
    below = float(total + (distinct + 1))
    values = context_tree(counts.where(F.col("kind") == BYTES).drop("kind")).withColumn("kind", F.lit(BYTES))
    values = values.unionByName(words.mapInPandas(_as_doubles, "kind int, grp long, keys binary, n binary"))
    near = F.expr(f"block div {FAN * FAN}").alias("near")
    asking = held.select("kind", "grp", near).distinct()
    given = values.join(asking, ["kind", "grp"]).select("kind", F.lit(-1).alias("block"), "grp", "keys", "n", "near")
    both = given.unionByName(held.select("kind", "block", "grp", "keys", F.lit(None).cast("binary").alias("n"), near))
    given = both.repartition("kind", "grp", "near").sortWithinPartitions("kind", "grp", "near", "block").drop("near").mapInPandas(_give, HELD)
    stream = given.unionByName(packed.drop("part", "seq"), allowMissingColumns=True)
    stream = stream.repartition(blocks, "block").sortWithinPartitions("block", F.col("blob").isNotNull())
    scored = stream.mapInArrow(_scorer(below), "doc_id long, n_tokens long, n_known long, base_score double, score double, bytes long")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") / float(np.log10(2)) / F.col("bytes")).alias("bits_per_byte"))


def _totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        n = [np.frombuffer(b, dtype=np.int64) for b in pdf["n"]]
        yield pd.DataFrame({"total": [int(x.sum()) for x in n], "seen": [int((x > 0).sum()) for x in n]})


def _as_doubles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"kind": pdf["kind"], "grp": pdf["grp"], "keys": pdf["keys"], "n": [np.frombuffer(b, dtype=np.int64).astype(np.float64).tobytes() for b in pdf["n"]]})


def op9_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_texts(table(spark, sf_dir, "documents"), learns_from("doc_id", 7, 2))
    return scored.select("doc_id", (~learns_from("doc_id", 7, 2)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
