"""Logical tables over the star-schema tables: an image is a supplier, an object is a line item.

Each binding is one list of expressions that Spark evaluates and that also makes the SQL text of the oracle, so that both
read the same definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OBJECTS = (
    "l_suppkey as image_no",
    "row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as object_id",
    "cast((l_partkey*37 + l_linenumber*101) % 1024 as double) as centroid_x_px",
    "cast((l_orderkey*53 + l_linenumber*17) % 1024 as double) as centroid_y_px",
    "cast(l_quantity as bigint)*10 as area_px",
    "l_returnflag as phenotype",
    "l_linestatus='O' as kept",
    "l_extendedprice/1000 as mean_intensity",
    "l_discount*10 as circularity",
    "1-l_tax as solidity",
    "l_discount",
    "l_tax",
)
MANIFEST = (
    "s_suppkey as sample_id",
    "s_nationkey as animal_id",
    "case when s_suppkey % 2 = 0 then 'OD' else 'OS' end as eye",
    "case when cast(floor(s_suppkey/2.0) as bigint) % 2 = 0 then 'control' else 'treated' end as condition",
    "cast(7*(s_suppkey % 3) as double) as timepoint_dpi",
    "r_name as genotype",
    "cast(512 as double) as onh_x_px",
    "cast(512 as double) as onh_y_px",
    "cast(512 as double) as dorsal_x_px",
    "cast(0 as double) as dorsal_y_px",
    "cast(0.5 as double) as um_per_px",
)
ROIS = (
    "p_partkey as roi_id",
    "p_partkey % n_images as image_no",
    "p_partkey*13 % 960 as x0",
    "p_partkey*29 % 960 as y0",
    "cast(64 as bigint) as width",
    "cast(64 as bigint) as height",
    "case p_size % 3 when 0 then 'dev' when 1 then 'locked_eval' else 'qc_or_exclude' end as split",
    "p_type as marker",
)
EDITS = (
    "p_partkey % n_images as image_no",
    "p_partkey as seq",
    "case when p_partkey % 7 = 0 then 'delete_object' when p_partkey % 11 = 0 then 'merge_objects' else 'relabel_phenotype' end as op",
    "p_partkey % 500 + 2 as object_id",
    "p_partkey % 500 + 1 as keep_object_id",
    "p_brand as phenotype",
)
EDIT_ROWS = "p_partkey % 7 = 0 or p_partkey % 11 = 0 or p_partkey % 13 = 0"
RUNS = ("o_orderpriority as config_id", "o_orderstatus as split", "o_orderkey as roi_id", "o_totalprice/500000 as f1", "o_custkey % 7 as count_mae", "o_custkey % 11 as n_manual", "o_totalprice/600000 as recall")
#: Images whose pixels one task makes.
IMAGES = 100
TISSUE = "x * 8 as x_px, y * 8 as y_px"

_FROM_MANIFEST = "from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"
SQL = {
    "objects": f"select {', '.join(OBJECTS)} from lineitem",
    "manifest": f"select {', '.join(MANIFEST)} {_FROM_MANIFEST}",
    "rois": f"select {', '.join(ROIS)} from part cross join (select count(*) as n_images from supplier)",
    "edits": f"select {', '.join(EDITS)} from part cross join (select count(*) as n_images from supplier) where {EDIT_ROWS}",
    "runs": f"select {', '.join(RUNS)} from orders",
    "tissue": "select s_suppkey as image_no, a.range * 8 as x, b.range * 8 as y from supplier, range(128) a, range(128) b where not (a.range < 32 and b.range < 32)",
    "pixels": "select vec_id as image_no, pos // 8 as y, pos % 8 as x, cast(embedding[pos+1] as double) as value from embeddings, (select range as pos from range(64))",
    "manual": "select l_suppkey as sample_id, count(*) filter (l_tax < 0.04) as manual_count, count(*) filter (l_linestatus = 'O') as cell_count from lineitem group by 1",
}


def with_tables(names: str, body: str) -> str:
    """SQL text in which the named bindings are defined."""
    return "with " + ", ".join(f"{n} as ({SQL[n]})" for n in names.split()) + (", " if body.lstrip().startswith("+") else " ") + body.lstrip().removeprefix("+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*OBJECTS)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(*MANIFEST)


def _images(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").withColumn("n_images", F.lit(_images(spark, sf_dir))).selectExpr(*ROIS)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(EDIT_ROWS).withColumn("n_images", F.lit(_images(spark, sf_dir))).selectExpr(*EDITS)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*RUNS)


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("image_no"))


def lattice(spark: SparkSession) -> DataFrame:
    """The tissue pixels that all images share: 128 by 128 points, 8 px apart, without one corner."""
    rows = spark.range(128).select(F.col("id").alias("a")).crossJoin(F.broadcast(spark.range(128).select(F.col("id").alias("b"))))
    return rows.where("not (a < 32 and b < 32)").selectExpr("a * 8 as x", "b * 8 as y")


def tissue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lattice for every image, for what needs a row for each image and pixel; a task has about IMAGES images."""
    dealt = images(spark, sf_dir).repartition(max(1, -(-_images(spark, sf_dir) // IMAGES)), "image_no")
    return dealt.crossJoin(F.broadcast(lattice(spark)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiny 8 by 8 images: the components of a vector in rows."""
    flat = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
    return flat.selectExpr("vec_id as image_no", "cast(floor(pos / 8) as bigint) as y", "cast(pos % 8 as bigint) as x", "cast(val as double) as value")


def manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample_id"))
    return counts.agg(F.count_if(F.col("l_tax") < 0.04).alias("manual_count"), F.count_if(F.col("l_linestatus") == "O").alias("cell_count"))
