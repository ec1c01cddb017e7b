"""Merkle manifest of a dataset: checkpoint-and-recompute.

Rows are leaves of one tree a source, and the sources' roots are leaves of the tree above. Only every third level is
stored, as a table (tree, pos, node); with runs of three a stored node stands for an aligned subtree of 27 stored nodes
below it. A proof is taken from the top down: each aligned subtree's 27 stored nodes meet their stored parent, the two
levels between are computed anew within the group, the siblings are written down for all 27, and the levels are dropped
again. The siblings above a subtree are the same for all its nodes, so they travel once for each stored parent.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphlake.llm.shared import cut, table

#: Nodes of a run, and levels from one stored level to the next.
RUN, STRIDE = 3, 3
BLOCK = RUN**STRIDE
_STEPS = "array<struct<left:string,right:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return digest(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)))


def _above(nodes: Column, lone: Column) -> Column:
    """The level above: a digest of each run; a level of one node is its own where nothing is beside it."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int")), lambda i: digest(F.array_join(F.slice(nodes, i * RUN + 1, RUN), "")))
    return F.when(lone & (F.size(nodes) == 1), nodes).otherwise(runs)


def _levels(nodes: str, block: str) -> list[tuple[str, Column]]:
    """Names and expressions of the levels of an aligned subtree, the lowest in column ``nodes``; later ones use earlier names."""
    names = [nodes, *[f"__l{j}" for j in range(1, STRIDE + 1)]]
    return [(above, _above(F.col(below), F.col(block) == 0)) for below, above in zip(names, names[1:], strict=False)]


def _step(nodes: Column, at: Column, lone: Column) -> Column:
    """What is left and right of node ``at`` in its run, as one entry; none where the level is no run."""
    low = at - at % RUN
    entry = F.struct(F.array_join(F.slice(nodes, low + 1, at % RUN), "").alias("left"), F.array_join(F.slice(nodes, at + 2, F.lit(RUN - 1) - at % RUN), "").alias("right"))
    return F.when(lone & (F.size(nodes) == 1), F.array().cast(_STEPS)).otherwise(F.array(entry))


def _grouped(level: DataFrame) -> DataFrame:
    """Aligned subtrees: the at most 27 stored nodes of each, in order, with what else their rows hold."""
    rest = [c for c in level.columns if c not in ("tree", "pos", "node")]
    members = F.array_sort(F.collect_list(F.struct("pos", "node", *rest)))
    return level.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("block")).agg(members.alias("members")).withColumn("nodes", F.col("members.node"))


def stored_levels(leaves: DataFrame) -> list[DataFrame]:
    """Every third level of each tree as checkpointed (tree, pos, node), from ``leaves`` up to one node a tree.

    Positions count from 0 in each tree. A tree that has come down to one node is carried on as it is.
    """
    levels = [leaves]
    while levels[-1].where("pos > 0").limit(1).count():
        up = _grouped(levels[-1].select("tree", "pos", "node"))
        for name, value in _levels("nodes", "block"):
            up = up.withColumn(name, value)
        levels.append(cut(up.select("tree", F.col("block").alias("pos"), F.col(f"__l{STRIDE}")[0].alias("node"))))
    return levels


def _descend(level: DataFrame, above: DataFrame) -> DataFrame:
    """``level`` with the steps and the subroot of each node's path, from those of its stored parent (tree, pos)."""
    regrown = _grouped(level)
    for name, value in _levels("nodes", "block")[:-1]:  # levels between the stored ones, for this group alone
        regrown = regrown.withColumn(name, value)
    regrown = regrown.join(above.select("tree", F.col("pos").alias("block"), F.col("steps").alias("__up"), "subroot"), ["tree", "block"])
    each = regrown.select("*", F.posexplode("members").alias("__at", "__m"))
    names = ["nodes", *[f"__l{j}" for j in range(1, STRIDE)]]
    own = [_step(F.col(n), F.floor(F.col("__at") / RUN**j).cast("int"), F.col("block") == 0) for j, n in enumerate(names)]
    return each.select("tree", "__m.*", F.concat(*own, "__up").alias("steps"), "subroot")


def paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The leaves, each with its steps to the root of all and its subroot; top: (tree, steps, subroot) of each tree's root."""
    if len(levels) == 1:  # every tree is its only leaf
        return levels[0].join(top, "tree")
    return reduce(lambda up, level: _descend(level, up), reversed(levels[:-1]), top.withColumn("pos", F.lit(0).cast("long")))


def fold(node: Column, steps: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(steps, node, lambda at, s: digest(F.concat(s["left"], at, s["right"])))


def proof_digest(steps: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def placed(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """Adds ``pos``: 0, 1, ... in ``order`` within each ``tree``, without a task for a whole tree.

    Rows are range-partitioned by tree and order and stored so; a row's place is that within its range and tree, moved by
    the tree's rows in the ranges before, of which there is one number for each range and tree that meet.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(parts, "tree", *order, "__tie").withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy("tree").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("tree", "__range").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("tree", "__range").orderBy(*order))
    out = ranged.withColumn("__inside", inside).join(offsets.select("tree", "__range", "__before"), ["tree", "__range"])
    return out.withColumn("pos", F.col("__before") + F.col("__inside") - 1).drop("__tie", "__range", "__inside", "__before")


@dataclass
class Manifest:
    """The stored levels of the sources' trees, and of the tree above them; ``root`` is None without rows."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    root: str | None

    def proofs(self) -> DataFrame:
        """The leaves (tree, pos, node and kept columns) with ``subroot`` and ``steps``, the siblings up to the root of all."""
        none = self.upper[-1].select("tree", F.array().cast(_STEPS).alias("steps"), F.lit(None).cast("string").alias("subroot"))
        tops = paths(self.upper, none).select(F.col("source_tree").alias("tree"), "steps", F.col("node").alias("subroot"))
        return paths(self.levels, tops)


def manifest(docs: DataFrame, **kept: Column) -> Manifest:
    """Stored levels of the trees over ``docs``; columns ``kept`` stay beside the leaves.

    A tree is a source (null is one too, before all others). Its leaves ascend by doc_id (null first), those of equal
    doc_id by their digest; equal rows are leaves of their own. Null columns and empty texts are leaves like others, a text
    of any length is hashed whole. Without rows there are no leaves and no root. Other columns, whatever their names, are
    not hashed.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))  # "-" sorts before "="
    rows = cut(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(F.col("text")).alias("node"), *[v.alias(k) for k, v in kept.items()]))
    levels = stored_levels(cut(placed(rows, [F.col("doc_id").asc_nulls_first(), F.col("node").asc()])))
    upper = stored_levels(cut(placed(levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source_tree"), "node"), [F.col("source_tree").asc()])))
    root = upper[-1].select("node").first()
    return Manifest(levels, upper, root and root["node"])


def without_line_feeds(text: Column, doc_id: Column) -> Column:
    """A tampered text: without line feeds where the id's crc32 is even; others, and those of a null id, are left alone."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verify(docs: DataFrame, altered: Column) -> DataFrame:
    """Each row's leaf, proof and the root that its text, as ``altered`` gives it, leads to with the original siblings."""
    text = F.col("text")
    made = manifest(docs, altered=F.when(altered.eqNullSafe(text), leaf_digest(text)).otherwise(leaf_digest(altered)))
    root = F.lit(made.root).cast("string")
    out = made.proofs().select("doc_id", F.col("node").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), fold(F.col("altered"), F.col("steps")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(table(spark, sf_dir, "documents"), without_line_feeds(F.col("text"), F.col("doc_id")))
