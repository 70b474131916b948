import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")

#: A query of each operator family; the driver runs them all.
NAMES = ["field_expr_functions", "field_divide", "mesh_compare", "coverage_leaf_cells", "uniform_slice_x", "uniform_projection_z", "slice_nearest_y", "histogram2d_cell_mass", "cdf_samples", "gradient", "vorticity_mag", "flux_sphere_tbins", "flux_cylinder", "toomre_moments", "particle_isin_mask", "particle_rdivide_scalar", "particle_max_infinite", "particle_histogram1d_density", "particle_topk_modes", "particle_cic_projection"]


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall()), key=str)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns == ["py", "px", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
