"""The pipeline's stages, one on another's rows, against brute-force versions."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from morphlake.llm import op6_suffix_automaton as op6
from morphlake.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "benchmark_passages", "source_mix", "shards"]
    docs = table(spark, SF, "documents")
    columns, at = docs.columns, {"in": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns[: len(columns)] == columns
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = {r.doc_id for r in at["quality"].collect()}
    of = collections.Counter((labels[i], i in kept) for i in labels)
    assert of[1, True] >= 0.98 * (of[1, True] + of[1, False]) and of[0, False] >= 0.8 * (of[0, True] + of[0, False])
    ids = [r.doc_id for r in at["near_copies"].collect()]
    assert len(ids) == len(set(ids)) and set(ids) <= kept
    assert at["near_copies"].select("text").distinct().count() == len(ids)
    left = op6.match(at["benchmark_passages"], table(spark, SF, "benchmark"))
    assert left.where("n_hit > 0").count() == 0
    assert at["shards"].count() == at["source_mix"].count() and at["shards"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    slots = at["shards"].groupBy("shard").agg(F.max("slot").alias("m"), F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("k")).collect()
    assert all(r.m + 1 == r.n == r.k for r in slots)


def test_run_gives_the_last_stage(spark):
    assert {"shard", "slot"} <= set(corpus_pipeline.run(spark, SF).columns)


def _odd(spark):
    """Good documents with null and shared ids, copies, very long and empty texts, and columns named like the stages' own."""
    big = 2**60 + 1
    good = [r.text for r in table(spark, SF, "documents").join(table(spark, SF, "labels").where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    rows = [(i, t) for i, t in enumerate(good[:20])] + [(None, t) for t in good[20:26]] + [(big, t) for t in good[26:30]] + [(big, good[26]), (None, good[20]), (3, good[3]), (99, good[4])]
    rows += [(200, None), (201, ""), (None, ""), (202, " ".join(good[30:40]) * 30)]
    columns = "doc_id long, text string, source string, n_chars long, size long, target string, copies array<long>, shard string, rep long, row int, text_key string, parts double"
    return spark.createDataFrame([(i, t, "s" if k % 3 else None, None if t is None else len(t), k, "t", [None, k], "x", k, k, "y", 0.5) for k, (i, t) in enumerate(rows)], columns)


def test_stages_on_odd_rows(spark):
    docs = _odd(spark)
    whole = {tuple(map(str, r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "shards":
            assert out.schema.names == docs.schema.names
        assert stage(spark, docs.where("false"), SF).count() == 0
        got = out.select(*docs.columns).collect() if name != "shards" else out.drop("shard", "slot").collect()
        if name in ("quality", "near_copies", "source_mix"):
            assert {tuple(map(str, r)) for r in got} <= whole
        if name == "near_copies":
            texts = [r.text for r in docs.collect() if r.text]
            assert sorted(r.text for r in got if r.text) == sorted(set(texts))
            assert sum(not r.text for r in got) == 3
        if name == "benchmark_passages":
            assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
        if name == "shards":
            assert len(got) == docs.count()
