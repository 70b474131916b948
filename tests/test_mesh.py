import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.operators import mesh, stencil
from tests.helpers import box, two_levels


def image(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.py, r.px] = r.value
    return out


def counts(df, *keys):
    return [r["count"] for r in sorted(df.collect(), key=lambda r: tuple(r[k] for k in keys))]


V = np.array([[[0.1, 0.2], [0.6, 0.7]], [[0.9, 0.4], [0.3, 0.8]]])


def test_histograms(spark):
    m = box(spark, {"v": V, "w": np.arange(1, 9).reshape(2, 2, 2)})
    assert counts(mesh.histogram(m.leaves(), F.col("v"), 5, (0, 1)), "bin") == [1, 2, 1, 2, 2]
    assert counts(mesh.histogram(m.leaves(), F.col("v"), 5, (0, 1), F.col("w")), "bin") == [1, 9, 6, 7, 13]
    want, _, _ = np.histogram2d(V.ravel(), np.arange(1, 9), bins=(3, 2), range=((0, 1), (0, 8)))
    got = counts(mesh.histogram2d(m.leaves(), F.col("v"), F.col("w"), (3, 2), ((0, 1), (0, 8))), "xbin", "ybin")
    assert np.array_equal(np.reshape(got, (3, 2)), want)
    m = box(spark, {"v": np.full((2, 2, 2), 0.5)}, dx=2.0)
    assert counts(mesh.histogram2d(m.leaves(), F.col("v"), F.col("v"), (1, 1), ((0, 1), (0, 1)), mesh.weight_of(m, F.col("v"), "cell_volume", None)), "xbin") == [64]
    with pytest.raises(ValueError):
        mesh.histogram(m.leaves(), F.col("v"), 0, (0, 1))


def test_covered_cells_are_left_out(spark):
    m = two_levels(spark, {"v": lambda x, y, z: np.full(x.shape, 0.5)}, lo=(0, 0, 0), hi=(3, 7, 7))
    assert counts(mesh.histogram(m.leaves(), F.col("v"), 1, (0, 1)), "bin") == [288]


def test_slice_and_projection_of_a_constant(spark):
    m = two_levels(spark, {"v": lambda x, y, z: np.ones(x.shape)}, lo=(0, 0, 0), hi=(3, 7, 7))
    for axis in "xyz":
        assert image(mesh.slice_plane(m, "v", axis, 1.2, (0, 0, 4, 4), (4, 4)), (4, 4)) == pytest.approx(1.0)
        assert image(mesh.project(m, "v", axis, (0, 4), (0, 0, 4, 4), (4, 4)), (4, 4)) == pytest.approx(4.0)
    wide = image(mesh.slice_plane(m, "v", "z", 1.2, (0, 0, 8, 8), (4, 4)), (4, 4))
    assert wide[:2, :2] == pytest.approx(1.0) and np.isnan(wide[2:, :]).all() and np.isnan(wide[:, 2:]).all()
    wide = image(mesh.project(m, "v", "z", (0, 4), (0, 0, 8, 8), (4, 4)), (4, 4))
    assert wide[:2, :2] == pytest.approx(16.0) and (wide[2:] == 0).all()
    part = image(mesh.slice_plane(m, "v", "z", 1.2, (0, 0, 6, 4), (4, 1)), (1, 4))
    assert part[0, :3] == pytest.approx([1, 1, 2 / 3]) and math.isnan(part[0, 3])  # diluted by the whole pixel


def test_slice_takes_the_lowest_fine_layer(spark):
    m = two_levels(spark, {"v": lambda x, y, z: z}, lo=(0, 0, 0), hi=(7, 7, 7))
    assert image(mesh.slice_plane(m, "v", "z", 1.9, (0, 0, 4, 4), (2, 2)), (2, 2)) == pytest.approx(1.25)
    assert image(mesh.slice_nearest(m, "v", "z", 1.9, (0, 0, 4, 4), (2, 2)), (2, 2)) == pytest.approx(1.25)


def test_native_resolution_slice_is_the_plane(spark):
    v = np.random.default_rng(0).random((6, 5, 4))
    m = box(spark, {"v": v})
    assert image(mesh.slice_plane(m, "v", "z", 2.5, (0, 0, 6, 5), (6, 5)), (5, 6)) == pytest.approx(v[:, :, 2].T)
    assert image(mesh.project(m, "v", "y", (0.5, 3), (0, 0, 6, 4), (6, 4)), (4, 6)) == pytest.approx((0.5 * v[:, 0] + v[:, 1] + v[:, 2]).T)


def test_cdfs(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "bin int, count double")
    assert [r.cdf for r in mesh.cdf_from_histogram(df).orderBy("bin").collect()] == pytest.approx([1 / 6, 3 / 6, 1])
    df = spark.createDataFrame([(2.0,), (1.0,), (3.0,), (2.0,)], "v double")
    got = sorted((r.value, r.cdf) for r in mesh.cdf_from_samples(df, "v").collect())
    assert got == [(1, 0.25), (2, 0.5), (2, 0.75), (3, 1.0)]


def test_affine_gradient_across_levels(spark):
    m = two_levels(spark, {"f": lambda x, y, z: x + 2 * y + 3 * z})
    for r in stencil.gradients(m, ["f"]).where("level = 0").collect():
        assert (r.f_gx, r.f_gy, r.f_gz) == pytest.approx((1, 2, 3), abs=1e-8)


def test_vorticity_of_linear_fields(spark):
    m = two_levels(spark, {"u": lambda x, y, z: 2 * y + 3 * z, "v": lambda x, y, z: 7 * x + 5 * z, "w": lambda x, y, z: 11 * x + 13 * y})
    got = [r.value for r in stencil.vorticity(m, "u", "v", "w", level=0).collect()]
    assert len(got) == 64 and got == pytest.approx([math.sqrt(153)] * 64)


def test_gradient_of_a_single_cell_is_zero(spark):
    r = stencil.gradients(box(spark, {"f": np.ones((1, 1, 1))}), ["f"]).first()
    assert (r.f_gx, r.f_gy, r.f_gz) == (0, 0, 0)


def test_reports_and_sub_boxes(spark):
    m = two_levels(spark, {"v": lambda x, y, z: np.where(x < 1, np.nan, x)})
    got = {(r.level, r.block): (r.min, r.max) for r in mesh.fab_minmax(m, "v").collect()}
    assert got == {(0, 0): (1.5, 3.5), (1, 0): (1.25, 3.75)}
    assert mesh.subbox(m, 1, (2, 1, 1), (3, 2, 2)).count() == 8
    assert mesh.subbox_fetch(m, 1, 0, 1).where("level = 1").count() == 0
