import re

import pytest
from pyspark.sql import functions as F

import cellforge as cf
from cellforge.operators import mesh, stencil
from cellforge.sources import catalog, plotfile
from tests.helpers import two_levels
from tests.test_sources import write_plotfile


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mesh") / "t")
    catalog.write_tables(two_levels(spark, {"v": lambda x, y, z: x, "w": lambda x, y, z: y}), path)
    return catalog.mesh_from_tables(spark, path)


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_no_nested_loops_and_pruned_scans(stored):
    frames = [
        mesh.slice_plane(stored, "v", "z", 1.2, (0, 0, 4, 4), (4, 4)),
        mesh.project(stored, "v", "x", (0, 4), (0, 0, 4, 4), (4, 4)),
        mesh.histogram(stored.leaves(stored.cells.select("level", "i", "j", "k", "v")), F.col("v"), 4, (0, 4)),
        stencil.gradients(stored, ["v"]),
    ]
    for df in frames:
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text and "EvalPython" not in text and "InArrow" not in text
        for schema in re.findall(r"ReadSchema: (\S+)", text):
            assert "w:" not in schema


def test_planes_reach_the_scan(stored):
    """The operators' own filters, not ones made here."""
    for df in (mesh.slice_plane(stored, "v", "z", 1.2, (0, 0, 2, 1), (4, 4)), mesh.slice_nearest(stored, "v", "z", 1.2, (0, 0, 2, 1), (4, 4)), mesh.project(stored, "v", "z", (1.2, 1.4), (0, 0, 2, 1), (4, 4))):
        text = plan(df)
        pushed = " ".join(re.findall(r"PushedFilters: (.*)", text))
        assert "level" in " ".join(re.findall(r"PartitionFilters: (.*)", text))
        for column in "ijk":
            assert re.search(rf"(EqualTo|GreaterThanOrEqual)\({column},-?\d+\)", pushed), (column, pushed)
        assert "Or(" in pushed


def test_operators_open_the_fabs_and_fields_that_they_need(spark, tmp_path, monkeypatch):
    path = write_plotfile(tmp_path / "plt")
    header = plotfile.read_header(path)
    reader = plotfile._Reader(path, None, 0, None)
    kinds = plotfile
    for filters, blocks in (([kinds.EqualTo(("i",), 3)], [1]), ([kinds.In(("block",), (0,))], [0]), ([kinds.LessThan(("i",), 2)], [0]), ([kinds.GreaterThan(("k",), 2)], [None]), ([kinds.GreaterThanOrEqual(("k",), 2), kinds.LessThanOrEqual(("level",), 0)], [0, 1])):
        assert list(reader.pushFilters(filters)) == filters
        assert [p.item and p.item.block for p in reader.partitions()] == blocks
    ds = cf.open_dataset(spark, path)
    assert ds.mesh.load and header.names == ("rho", "vx")
    for image in (ds["rho"].slice("x", 3.5, (2, 2)), (ds["rho"] * 2).slice("x", 3.5, (2, 2))):
        text = plan(image.base)
        assert "rho" in text and not re.search(r"\bvx\b", text)
    rdd = ds["rho"].slice("x", 3.5, (2, 2)).base
    assert rdd.where("value = value").count() > 0
    cells = spark.read.format("amr_plotfile").load(path)
    assert cells.rdd.getNumPartitions() == 2 and cells.where("i = 3").rdd.getNumPartitions() == 1
    assert cells.where("i = 3").count() == 3
