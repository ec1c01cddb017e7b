"""Sharding by sampled splitters, with DataFrame functions only.

1. A size-weighted sample of sort keys (at most about ``sample`` rows, whatever the input's size) is drawn by a hash.
2. Its weighted quantiles become range boundaries; a key that holds much of the sample gets boundaries of its own.
3. Every record finds its range by a binary search over the boundaries, a fold of log2(ranges) steps.
4. Ranges over the limit are subdivided by interpolating the key (or, inside one hot key, the tie-break hash).
5. Running sums over ranges, their subdivisions and the records of one subdivision give each record's exact byte
   offset and row number in key order, from which shard and slot follow.

The order is fixed by the keys, not by the sample, up to the subdivision of ranges; a rerun gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, table

SHARDS = 40
K, T, S = "__shard_key", "__shard_tie", "__shard_size"
R, P = "__shard_range", "__shard_part"


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _longs(values: list[int]) -> Column:
    return F.lit([int(v) for v in values]).cast("array<bigint>") if values else F.lit(None).cast("array<bigint>")


def _boundaries(keys: DataFrame, total: int, ranges: int, sample: int) -> list[tuple[int, int]]:
    """Sorted first keys of every range but the first; at most ``ranges`` and two for each of at most 4 * ranges hot keys."""
    uniform = F.pmod(F.xxhash64(K, T, F.lit("splitters")), F.lit(1 << 40)) / float(1 << 40)
    drawn = keys.select(K, T, F.greatest(F.col(S).cast("double"), F.lit(total / sample)).alias("w"), (uniform < F.col(S) * (sample / total)).alias("in")).where("in")
    running = drawn.withColumn("c", F.sum("w").over(Window.orderBy(K, T).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    scaled = running.withColumn("q", F.floor(F.col("c") * (ranges / total)))
    cuts = {(r.first[0], r.first[1]) for r in scaled.groupBy("q").agg(F.min(F.struct(K, T)).alias("first")).collect()}
    hot = [r[0] for r in drawn.groupBy(K).agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).where((F.col("w") >= total / (4.0 * ranges)) & (F.col("n") > 1)).select(K).collect()]
    low, high = -(1 << 63), (1 << 63) - 1
    for k in hot:
        cuts |= {(k, low), (k + 1, low)} if k < high else {(k, low)}
    return sorted(cuts)


def _search(cuts: list[tuple[int, int]]) -> Column:
    """How many boundaries are at or before the record's (key, tie)."""
    if not cuts:
        return F.lit(0)
    ks, ts = _longs([c[0] for c in cuts]), _longs([c[1] for c in cuts])
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def step(low: Column, by: Column) -> Column:
        at = low + by
        k, t = F.get(ks, at - 1), F.get(ts, at - 1)
        reached = (at <= len(cuts)) & ((k < F.col(K)) | ((k == F.col(K)) & (t <= F.col(T))))
        return F.when(F.coalesce(reached, F.lit(False)), at).otherwise(low)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def _part(cuts: list[tuple[int, int]], parts: list[int]) -> Column:
    """Which subdivision of its range a record falls into; grows with the key."""
    low, high = -(1 << 63), (1 << 63) - 1
    edges = [(low, low), *cuts, (high, high)]
    by_tie = [a[0] == b[0] or (a[0] + 1 == b[0] and b[1] == low) for a, b in zip(edges, edges[1:], strict=False)]
    starts, ends = [], []
    for (a, b), tie in zip(zip(edges, edges[1:], strict=False), by_tie, strict=True):
        starts.append(float(a[1] if tie else a[0]))
        ends.append(float((b[1] if a[0] == b[0] else high) if tie else b[0]))
    at = F.col(R)
    value = F.when(F.get(F.lit(by_tie), at), F.col(T)).otherwise(F.col(K)).cast("double")
    start, end, n = F.get(F.lit(starts), at), F.get(F.lit(ends), at), F.get(F.lit(parts), at)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((value - start) / F.greatest(end - start, F.lit(1.0)) * n))).cast("int")


def sampled_splitters(records: DataFrame, key: Column, tie: Column, size: Column, shards: int = SHARDS, ranges: int = 320, sample: int = 16_384, part_rows: int = 20_000) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard) to every record.

    key, tie: hashes (long) that order the records; size: bytes, at least 1. Records are laid end to end in order of
    (range, subdivision, key, tie, size) and the total is cut at multiples of total / shards; a record goes to the shard
    that its middle byte lies in, so shards differ from their share by less than one record. Records of one key
    are neighbours. Rows equal in key, tie and size are interchangeable; those equal in key and tie meet in one task. An empty table stays empty; columns named
    shard or slot are replaced; null keys are hashed like any value by the caller.
    ranges, sample, part_rows bound what one task sorts and what the driver holds; they don't change what is kept.
    """
    keyed = records.drop("shard", "slot").withColumns({K: key, T: tie, S: size})
    keys = keyed.select(K, T, S).persist()
    try:
        total, rows = keys.agg(F.coalesce(F.sum(S), F.lit(0)), F.count(F.lit(1))).first()
        cuts = _boundaries(keys, total, ranges, sample) if rows else []
        ranged = keys.withColumn(R, _search(cuts))
        held = {r[R]: (r["b"], r["n"]) for r in ranged.groupBy(R).agg(F.sum(S).alias("b"), F.count(F.lit(1)).alias("n")).collect()}
        sizes = [held.get(i, (0, 0)) for i in range(len(cuts) + 1)]
        full = max(1, total // (4 * shards))
        parts = [max(1, -(-n // part_rows), -(-b // full)) for b, n in sizes]
        before = [(0, 0)]
        for b, n in sizes[:-1]:
            before.append((before[-1][0] + b, before[-1][1] + n))
        earlier = Window.partitionBy(R).orderBy(P).rowsBetween(Window.unboundedPreceding, -1)
        cells = cut(
            ranged.withColumn(P, _part(cuts, parts)).groupBy(R, P).agg(F.sum(S).alias("b"), F.count(F.lit(1)).alias("n")).select(
                R, P,
                (F.get(_longs([x[0] for x in before]), F.col(R)) + F.coalesce(F.sum("b").over(earlier), F.lit(0))).alias("__shard_bytes"),
                (F.get(_longs([x[1] for x in before]), F.col(R)) + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("__shard_rows"),
            )
        )

        def placed(frame: DataFrame) -> DataFrame:
            order = Window.partitionBy(R, P).orderBy(K, T, S)
            start = F.sum(S).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(S)
            found = frame.withColumn(R, _search(cuts)).withColumn(P, _part(cuts, parts)).withColumns({"__shard_at": start, "__shard_no": F.row_number().over(order) - 1}).join(cells, [R, P])
            share = F.expr(f"(((__shard_bytes + __shard_at) * 2 + {S}) * {shards}L) div {max(1, 2 * total)}L")
            return found.withColumns({"shard": F.least(F.lit(shards - 1), share).cast("int"), "__shard_row": F.col("__shard_rows") + F.col("__shard_no")})

        counts = {r["shard"]: r["n"] for r in placed(keys).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        first = [sum(counts.get(j, 0) for j in range(i)) for i in range(shards)]
    finally:
        keys.unpersist()
    slotted = placed(keyed).withColumn("slot", F.col("__shard_row") - F.get(_longs(first), F.col("shard")))
    return slotted.drop(K, T, S, R, P, "__shard_at", "__shard_no", "__shard_bytes", "__shard_rows", "__shard_row")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All columns of ``docs`` with ``shard`` and ``slot``; equal texts are neighbours, sizes are UTF-8 bytes plus 16."""
    return sampled_splitters(docs, F.xxhash64("text"), F.xxhash64("doc_id"), text_size(F.col("text")), shards)


def op3_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lean = docs.select("doc_id", F.xxhash64("text").alias("key"), text_size(F.col("text")).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")).persist()
    placed = sampled_splitters(lean, F.col("key"), F.xxhash64("doc_id"), F.col("size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
