"""Queries over the tissue lattice cover every image, and so does their registered SQL."""

import glob
import os

import duckdb
import pytest

from morphlake import plans

SF = "/root/testdata/sf0.001"
COMPARED = ("j13_boundary_distance", "x3_usable_radii", "x4_border_l", "x5_pair_correlation", "x9_legacy_vdri", "j15_voronoi_cells", "j15_voronoi_regularity", "a18_density_grid", "a6_region_summary", "a7_domain_areas", "p12_mask_lookup_filter")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def _text(v):
    return str(v) if isinstance(v, bool) or v is None or isinstance(v, str) else repr(round(float(v), 6) + 0.0)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_sql_of_every_image(spark, duck, name):
    query, sql = plans.registered()[name]
    got, cur = query(spark, SF), duck.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(_text(v) for v in r) for r in cur.fetchall())
    rows = sorted(tuple(_text(r[c]) for c in names) for r in got.collect())
    assert rows == want
    at = names.index("image_no")
    assert {r[at] for r in rows} == {_text(i) for (i,) in duck.execute("select s_suppkey from supplier").fetchall()}


@pytest.mark.parametrize("name", ["x6_csr_envelope", "x8_spatial_summary", "x8_spatial_curves"])
def test_searches_cover_every_image(spark, duck, name):
    got = {r.image_no for r in plans.registered()[name][0](spark, SF).select("image_no").collect()}
    assert got == {i for (i,) in duck.execute("select s_suppkey from supplier").fetchall()}
