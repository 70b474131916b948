import numpy as np
import pytest
from pyspark.sql import functions as F

import cellforge as cf
from cellforge.operators import mesh
from cellforge.sources import catalog, plotfile
from cellforge.streaming import landing
from tests.helpers import two_levels


def write_plotfile(path, order="<"):
    """Two 2x1x3 FABs of two components, and a species of three particles."""
    level = path / "Level_0"
    level.mkdir(parents=True)
    (path / "Header").write_text("HyperCLaw-V1.1\n2\nrho\nvx\n3\n0.5\n0\n0 0 0\n4 1 3\n\n((0,0,0) (3,0,2) (0,0,0))\n7\n1 1 1\n0\n0\n0 2 0.5\n7\n0 2\n0 1\n0 3\n2 4\n0 1\n0 3\nLevel_0/Cell\n")
    codes = "8 7 6 5 4 3 2 1" if order == "<" else "1 2 3 4 5 6 7 8"
    data, offsets = b"", []
    for n, box in enumerate(("((0,0,0) (1,0,2) (0,0,0))", "((2,0,0) (3,0,2) (0,0,0))")):
        offsets.append(len(data))
        data += f"FAB ((8, (64 11 52 0 1 12 0 1023)),(8, ({codes}))){box} 2\n".encode()
        data += (np.arange(12) + 100 * n).astype(order + "f8").tobytes()
    (level / "Cell_D_00000").write_bytes(data)
    (level / "Cell_H").write_text("1\n1\n2\n0\n(2 0\n((0,0,0) (1,0,2) (0,0,0))\n((2,0,0) (3,0,2) (0,0,0))\n)\n2\n" + "".join(f"FabOnDisk: Cell_D_00000 {o}\n" for o in offsets))
    stars = path / "stars"
    (stars / "Level_0").mkdir(parents=True)
    (stars / "Header").write_text("Version_Two_Dot_Zero_double\n3\n1\nmass\n0\n1\n3\n4\n0\n2\n0 2 0\n0 1 80\n")
    out = b""
    for ids in ([1, 2], [3]):
        out += np.array([[i, 0] for i in ids], "<i4").tobytes() + np.array([[i, i + 0.5, 0.25, 10 * i] for i in ids], "<f8").tobytes()
    (stars / "Level_0" / "DATA_00000").write_bytes(out)
    return str(path)


@pytest.mark.parametrize("order", ["<", ">"])
def test_plotfile(spark, tmp_path, order):
    path = write_plotfile(tmp_path / "plt", order)
    reader = cf.sources.plotfile.PlotfileReader(path) if hasattr(cf, "sources") else plotfile.PlotfileReader(path)
    assert reader.num_levels == 1 and reader.num_fabs(0) == 2 and reader.metadata()["names"] == ("rho", "vx")
    assert reader.read_fab(0, 1).shape == (2, 3, 1, 2) and reader.read_fab(0, 1, [1])[0, 2, 0, 1] == 111
    assert reader.particle_species() == ["stars"] and reader.particle_fields("stars") == ["x", "y", "z", "mass", "id", "cpu"]
    ds = cf.open_dataset(spark, path)
    got = {(r.i, r.j, r.k): r.value for r in ds["vx"].frame().collect()}
    assert got[0, 0, 0] == 6 and got[1, 0, 2] == 11 and got[3, 0, 2] == 111 and len(got) == 12
    rows = ds.particle_species("stars").rows.orderBy("chunk", "pidx").collect()
    assert [(r.chunk, r.id, r.x, r.mass) for r in rows] == [(0, 1, 1, 10), (0, 2, 2, 20), (1, 3, 3, 30)]
    one = spark.read.format("amr_plotfile").schema("level int, i int, rho double").load(path)
    assert one.columns == ["level", "i", "rho"] and one.agg(F.sum("rho")).first()[0] == 15 + 615


def test_broken_plotfiles(tmp_path):
    path = write_plotfile(tmp_path / "plt")
    (tmp_path / "plt/Level_0/Cell_D_00000").unlink()
    with pytest.raises(FileNotFoundError):
        plotfile.PlotfileReader(path)
    (tmp_path / "old").write_bytes(b"FAB: old\n")
    with pytest.raises(ValueError):
        plotfile.read_fab(plotfile.Fab(0, 0, (0,) * 3, (0,) * 3, str(tmp_path / "old"), 0))


def test_tables_round_trip(spark, tmp_path):
    m = two_levels(spark, {"v": lambda x, y, z: x + y})
    catalog.write_tables(m, str(tmp_path / "t"))
    again = cf.open_dataset(spark, f"tables://{tmp_path}/t")
    assert again.mesh.hierarchy == m.hierarchy and again.fields == ("v",)
    assert again.mesh.cells.agg(F.sum("v")).first()[0] == m.cells.agg(F.sum("v")).first()[0]


def test_landing_steps(spark, tmp_path):
    m = two_levels(spark, {"v": lambda x, y, z: 0 * x + 0.5}, lo=(0, 0, 0), hi=(3, 7, 7))
    m.cells.withColumn("step", F.lit(3)).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    query = landing.watch_cells(spark, str(tmp_path / "in"), schema, m.hierarchy, lambda x: mesh.histogram(x.leaves(), F.col("v"), 1, (0, 1)), str(tmp_path / "out"), str(tmp_path / "ck"))
    query.awaitTermination(120)
    assert [(r.step, r["count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(3, 288.0)]
