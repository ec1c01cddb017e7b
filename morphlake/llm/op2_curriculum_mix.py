"""Mixing sources to target weights with a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, a straight line from ``start`` to ``end`` times its weight.
The integral of the schedule, shared out over all words and capped, is the source's target. A source's documents are
taken in a fixed hash order, epoch after epoch, until the target is met; the words taken before a document are a demand
that is looked up in the inverse of the schedule's running integral, which gives the document's training position.
Rows are range-sorted by position.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, table

WEIGHTS = (1.0, 2.0, 3.0)
RAMPS = ((1.5, 0.5), (0.5, 1.5))
CAP = 3
#: Sources, a short row each, up to which their targets are sent to all tasks; beyond, they are joined by a shuffle.
MOST_BROADCAST = 100_000
#: Rows of one hash beyond which each gets its own; at most 100,000 hashes have as many.
HOT_ROWS, HOT_HASHES = 1000, 100_000
OWN = "__mix_own_"
SRC, SIZE, CELL, HASH, ROW = "__mix_source", "__mix_size", "__mix_cell", "__mix_hash", "__mix_row"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.0) -> DataFrame:
    """(source, source_size) -> target, weight, ramp ends; one row a source, the only table that one task sees whole.

    Water filling in closed form: sources are ordered by cap / weight; the first whose share of what is left, after all
    before it got their caps, stays within its cap fixes the level for itself and all later ones.
    """
    everything = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    ramps = F.element_at(F.array(*[F.array(*[F.lit(x) for x in r]) for r in RAMPS]), (F.pmod(F.col("no"), F.lit(len(RAMPS))) + 1).cast("int"))
    weighed = sizes.withColumn("no", rank).withColumn("base", F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("no"), F.lit(len(WEIGHTS))) + 1).cast("int")))
    weighed = weighed.withColumns({"ramp": ramps}).withColumns({"start": F.col("ramp")[0], "end": F.col("ramp")[1]})
    weighed = weighed.withColumn("weight", F.col("base") * (F.col("start") + F.col("end")) / 2).withColumn("cap", F.col("source_size") * float(CAP))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = weighed.withColumn("level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    left = left.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    left = left.withColumn("reached", F.sum(F.col("fits").cast("int")).over(by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    final = left.withColumn("final", F.max(F.when(F.col("fits") & (F.col("reached") == 1), F.col("level"))).over(everything))
    reached = F.col("reached") > 0
    return final.withColumn("target", F.when(reached, F.least(F.col("cap"), F.col("final") * F.col("weight"))).otherwise(F.col("cap"))).select("source", "source_size", "target", "weight", "start", "end")


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    """First fit in hash order into what a source still needs, in rounds, as each row may be taken ``more`` times; the rows are of one boundary cell, of bounded size."""
    pdf = pdf.sort_values(["__mix_hash", "__mix_size"], kind="stable")
    need, more = float(pdf["need"].iloc[0]), int(pdf["more"].iloc[0])
    sizes, taken = pdf["__mix_size"].tolist(), [0] * len(pdf)
    for _ in range(more):
        for i, size in enumerate(sizes):
            if 0 < size <= need or (size == 0 and not taken[i]):
                taken[i] += 1
                need -= size
    left = [i for i, t in enumerate(taken) if t < more and sizes[i] > 0]
    if need > 0 and left:  # one more where that comes nearer
        best = min(left, key=lambda i: sizes[i])
        taken[best] += sizes[best] < 2 * need
    return pdf.assign(extra=taken)


def _spread(rows: DataFrame, most: int | None = None) -> DataFrame:
    """``rows`` with a hash of its own for each row of a hash that over ``most`` rows have (1000, or 1/100,000 of all), made of hash and number.

    Such rows are numbered within their partition and moved by the number of those in the partitions before, so no task
    holds them all; of equal rows any may get any number. At most 100,000 such hashes are broadcast.
    """
    counts = rows.groupBy(HASH).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    most = max(HOT_ROWS, int(total["all"] or 0) // HOT_HASHES) if most is None else most
    if (total["most"] or 0) <= most:
        return rows
    hot = F.broadcast(cut(counts.where(F.col("n") > most).select(HASH)))
    mine = cut(rows.join(hot, HASH).withColumn("__pid", F.spark_partition_id()))
    before = Window.partitionBy(HASH).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = mine.groupBy(HASH, "__pid").agg(F.count(F.lit(1)).alias("__n")).select(HASH, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(HASH, "__pid").orderBy(F.lit(0)))
    numbered = mine.withColumn("__inside", inside).join(offsets, [HASH, "__pid"]).withColumn(HASH, F.xxhash64(HASH, F.col("__before") + F.col("__inside")))
    return rows.join(hot, HASH, "left_anti").unionByName(numbered.select(*rows.columns))


def curriculum_mix(docs: DataFrame, key: Column | None = None, size: Column | None = None, cell_rows: int = 4096) -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies, taken and positions (an array, one for each copy).

    A source's whole epochs are floor(target / source_size); in the last, partial epoch its documents are taken in hash
    order up to the target, by first fit in the last cell of at most about ``cell_rows`` documents, again and again where
    these are too few, so that a source misses its target by at most half of the smallest document of that cell which may be
    taken once more. No document is taken more than CAP times. Null texts have size 0, a null source is a source; documents
    without words are taken once an epoch and add nothing. Null and shared ids are allowed. Equal rows are interchangeable;
    where very many rows have one id and text, each gets a hash of its own (``_spread``). Columns with the added names keep their values under OWN and their name.
    """
    key = F.xxhash64("doc_id", "text") if key is None else key
    size = word_count(F.col("text")) if size is None else size
    added = ["size", "source_size", "target", "copies", "taken", "positions"]
    kept = [c for c in docs.columns if c not in added]
    of_source = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    rows = docs.select(F.struct(*[F.col(c) if c in kept else F.col(c).alias(OWN + c) for c in docs.columns]).alias(ROW), key.alias(HASH), size.alias(SIZE), of_source.alias(SRC))
    rows = _spread(rows)
    by_source = rows.groupBy(SRC).agg(F.sum(SIZE).alias("source_size"), F.count(F.lit(1)).alias("n"))
    plain = F.when(F.col(SRC) != "n", F.substring(SRC, 2, 1 << 30))
    targets = source_targets(by_source.select(plain.alias("source"), SRC, "source_size", "n").select("source", "source_size"))
    targets = targets.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias(SRC), *[c for c in targets.columns if c != "source"])
    targets = targets.join(by_source.select(SRC, "n"), SRC).withColumn("cells", F.greatest(F.lit(1), F.ceil(F.col("n") / cell_rows)))
    uniform = F.pmod(F.col(HASH), F.lit(1 << 40)) / float(1 << 40)
    sources = by_source.count()
    known = rows.join(F.broadcast(targets) if sources <= MOST_BROADCAST else targets, SRC).withColumn(CELL, F.floor(uniform * F.col("cells")))
    epochs = F.when(F.col("source_size") > 0, F.least(F.lit(float(CAP)), F.floor(F.col("target") / F.col("source_size") + 1e-9))).otherwise(0.0)
    known = known.withColumns({"epochs": epochs.cast("int")}).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    cells = known.groupBy(SRC, CELL).agg(F.sum(SIZE).alias("cell_size"), F.first("rest").alias("rest"))
    running = Window.partitionBy(SRC).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_from", F.coalesce(F.sum("cell_size").over(running), F.lit(0))).select(SRC, CELL, "cell_size", "cell_from")
    known = known.join(cells, [SRC, CELL]).withColumn("need", F.col("rest") - F.col("cell_from"))
    whole = F.col("need") >= F.col("cell_size")
    edge = (F.col("need") > 0) & ~whole
    filled = known.where(edge).select(SRC, CELL, HASH, SIZE, "need", (F.lit(CAP) - F.col("epochs")).alias("more"))
    filled = filled.groupBy(SRC, CELL).applyInPandas(_fill, f"{SRC} string, {CELL} long, {HASH} long, {SIZE} long, need double, more int, extra long")
    filled = filled.groupBy(SRC, CELL, HASH, SIZE).agg(F.reverse(F.array_sort(F.collect_list("extra"))).alias("extras"))
    twin = Window.partitionBy(SRC, CELL, HASH, SIZE).orderBy(F.lit(0))
    inside = Window.partitionBy(SRC, CELL).orderBy(HASH, SIZE).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = known.withColumns({"twin": F.row_number().over(twin), "at": F.col("cell_from") + F.sum(SIZE).over(inside) - F.col(SIZE) / 2}).join(filled, [SRC, CELL, HASH, SIZE], "left")
    extra = F.when(whole & (F.col("rest") > 0), 1).when(edge, F.coalesce(F.get("extras", F.col("twin") - 1), F.lit(0))).otherwise(0)
    known = known.withColumn("copies", F.least(F.lit(CAP), F.col("epochs") + extra).cast("int"))
    demand = lambda e: F.least(F.lit(1.0), (e * F.col("source_size") + F.col("at")) / F.greatest(F.col("target"), F.lit(1e-9)))
    half, total = (F.col("end") - F.col("start")) / 2, (F.col("start") + F.col("end")) / 2
    inverse = lambda q: F.when(half == 0, q).otherwise((F.sqrt(F.col("start") * F.col("start") + 4 * half * q * total) - F.col("start")) / (2 * half))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda e: inverse(demand(e))))
    mixed = known.withColumns({"size": F.col(SIZE), "taken": F.col(SIZE) * F.col("copies"), "positions": positions})
    return mixed.select(f"{ROW}.*", *added)


def in_training_order(mixed: DataFrame, parts: int | None = None) -> DataFrame:
    """The rows range-sorted by the position of their first copy, then by a hash of the id; those that aren't taken come last."""
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.coalesce(F.get("positions", F.lit(0)), F.lit(2.0))
    return mixed.repartitionByRange(parts, first, F.xxhash64("doc_id")).sortWithinPartitions(first)


def training_order(mixed: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """One row for each copy taken, range-sorted by training position, with the ``columns`` that the documents had."""
    parts = parts or int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [F.col(OWN + c).alias(c) if OWN + c in mixed.columns else F.col(c) for c in columns]
    rows = mixed.where("copies > 0").select(*own, F.explode("positions").alias("__mix_position"))
    return rows.repartitionByRange(parts, "__mix_position").sortWithinPartitions("__mix_position").drop("__mix_position")


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lean = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("words"), F.xxhash64("doc_id", "text").alias("key")))
    mixed = in_training_order(curriculum_mix(lean, F.col("key"), F.col("words")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "positions")
