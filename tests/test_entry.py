"""The driver contract, and each query's SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from morphlake import plans

SF = "/root/testdata/sf0.001"


def test_names_agree():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(plans.registered()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _text(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return repr(round(float(v), 6) + 0.0)


SAMPLE = ("a6_region_summary", "p10_replay_edits", "j6_overlap_details", "j11_nearest_any", "c14_agreement_summary", "b3_config_summary", "x4_border_l", "j15_voronoi_cells", "c4_fdr_bh", "w13_stencils", "a2_object_table", "w4_slab_catalog")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    query, sql = plans.registered()[name]
    got = query(spark, SF)
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(_text(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(_text(r[c]) for c in sorted(names)) for r in got.collect()) == want
