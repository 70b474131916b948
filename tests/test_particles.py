import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.operators import particles
from tests.helpers import box, two_levels

NAN, INF = math.nan, math.inf


def column(spark, values, name="v", chunk=0):
    return spark.createDataFrame([(chunk, i, float(v)) for i, v in enumerate(values)], f"chunk int, pidx long, {name} double")


def values(df, c):
    return [r[0] for r in df.orderBy("chunk", "pidx").select(c).collect()]


def test_zip_cuts_to_the_shorter(spark):
    both = particles.zip_columns(column(spark, [10, 20, 30, 40], "a"), column(spark, [1, 2, 3], "b"))
    assert values(both, particles.BINARY["subtract"](F.col("a"), F.col("b"))) == [9, 18, 27]


def test_masks(spark):
    df = column(spark, [1, NAN, INF, -2])
    assert values(df, ieee.isfinite(F.col("v"))) == [True, False, False, True]
    assert values(df, ieee.isin(F.col("v"), [1.0, NAN])) == [True, False, False, False]
    assert values(df, particles.abs_lt(F.col("v"), 1.5)) == [True, False, False, False]
    with pytest.raises(ValueError):
        particles.compare_scalar(F.col("v"), "near", 1.0)
    with pytest.raises(ValueError):
        particles.all_of()


def test_histograms(spark):
    df = spark.createDataFrame([(0.1, 2.0), (0.2, 3.0), (0.8, 5.0), (NAN, 1.0)], "v double, w double")
    hist = lambda **k: [r["count"] for r in particles.histogram_edges(df, F.col("v"), [0, 0.5, 1], **k).orderBy("bin").collect()]
    assert hist() == [2, 1] and hist(weight=F.col("w")) == [5, 5] and hist(density=True) == pytest.approx([4 / 3, 2 / 3])


def test_reductions(spark):
    r = particles.summary(column(spark, [1, 2, NAN, INF]), F.col("v"), F.col("v") > 1).first()
    assert r.len == 4 and r.min == 1 and r.max == 2
    assert particles.summary(column(spark, [1, 2, NAN, INF]), F.col("v"), finite_only=False).first().max == INF
    r = particles.summary(column(spark, [1]).where("v > 5"), F.col("v")).first()
    assert (r.sum, r.len, r.min, r.max) == (0.0, 0, INF, -INF)


def test_topk_ties_and_padding(spark):
    got = particles.topk_modes(column(spark, [1, 1, 2, 2, 3, NAN]), F.col("v"), 4).orderBy("rank").collect()
    assert [r.value for r in got[:3]] == [2, 1, 3] and math.isnan(got[3].value) and [r["count"] for r in got] == [2, 2, 1, 0]


def species(spark, rows):
    return spark.createDataFrame([(0, 0, 0, i, *map(float, r)) for i, r in enumerate(rows)], "chunk int, level int, grid int, pidx long, x double, y double, z double, mass double")


def test_cloud_in_cell(spark):
    m = box(spark, {"v": np.zeros((4, 4, 4))})
    grid = lambda rows: {(r.i, r.j, r.k): r.density for r in particles.cic_grid(m, species(spark, rows), "z").collect()}
    assert grid([(1.5, 2.5, 0.5, 1)]) == {(1, 2, 0): 1.0}
    assert grid([(1, 2, 0.5, 1)]) == {(0, 1, 0): 0.25, (0, 2, 0): 0.25, (1, 1, 0): 0.25, (1, 2, 0): 0.25}
    assert grid([(0, 1.5, 0.5, 1)]) == {(0, 1, 0): 0.5}  # the share outside the block is dropped
    assert grid([(1, 1, 1, -1), (1, 1, 1, NAN), (NAN, 1, 1, 1), (1, 1, 9, 1)]) == {}
    image = particles.cic_project(m, species(spark, [(1, 2, 0.5, 8), (1, 2, 3.5, 8)]), "z", (0, 1), (0, 0, 4, 4), (2, 2)).collect()
    assert {(r.py, r.px): r.value for r in image} == pytest.approx({(0, 0): 4, (1, 0): 4, (0, 1): 0, (1, 1): 0})


def test_covered_cells_take_no_mass(spark):
    m = two_levels(spark, {"v": lambda x, y, z: 0 * x}, lo=(0, 0, 0), hi=(3, 7, 7))
    got = {(r.i, r.j): r.density for r in particles.cic_grid(m, species(spark, [(2, 2.5, 0.5, 1)]), "z").collect()}
    assert got == {(2, 2): 0.5}
