"""Particle operators on species tables (chunk, level, grid, pidx, x, y, z, ...): masks, arithmetic, reductions, deposits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.operators.mesh import CELL, Mesh, _rect, all_bins, pixel_grid, spread
from cellforge.plans.geometry import axis_index, plane_axes


def compare_scalar(x: Column, comparison: str, value: float) -> Column:
    if comparison not in ieee.COMPARE:
        raise ValueError(f"comparison must be one of {', '.join(ieee.COMPARE)}")
    return ieee.COMPARE[comparison](x.cast("double"), float(value))


def abs_lt(x: Column, value: float) -> Column:
    return ieee.lt(F.abs(x.cast("double")), float(value))


def all_of(*masks: Column) -> Column:
    if not masks:
        raise ValueError("at least one mask is needed")
    return fold(lambda a, b: a & b, masks)


BINARY = {"add": lambda a, b: a + b, "subtract": lambda a, b: a - b, "multiply": lambda a, b: a * b, "divide": ieee.div, "power": F.pow}
SCALAR = {
    "add": lambda a, s: a + s, "subtract": lambda a, s: a - s, "rsubtract": lambda a, s: s - a, "multiply": lambda a, s: a * s,
    "divide": ieee.div, "rdivide": lambda a, s: ieee.div(s, a), "power": F.pow, "rpower": lambda a, s: F.pow(s, a),
}


def distance3(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    dx, dy, dz = ax - bx, ay - by, az - bz
    return F.sqrt(dx * dx + dy * dy + dz * dz)


def zip_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two imported column tables side by side: the inner join on (chunk, pidx) cuts each chunk to the shorter."""
    return left.join(right, ["chunk", "pidx"])


def aggregates(x: Column, mask: Column | None = None, finite_only: bool = True) -> dict[str, Column]:
    """sum, len, count (of the mask), mean, min and max; of no rows: 0, 0, 0, null, +inf, -inf.

    finite_only=False lets infinities into min and max; NaN never is.
    """
    x = x.cast("double")
    ok = ieee.isfinite(x) if finite_only else ~F.isnan(x)
    m = F.lit(True) if mask is None else mask
    own = F.when(ok, x)
    low, high = F.coalesce(F.min(own), F.lit(ieee.INF)), F.coalesce(F.max(own), F.lit(-ieee.INF))
    return {"sum": ieee.finite_sum(x), "len": F.count("*"), "count": F.count_if(m), "mean": F.avg(x), "min": low, "max": high}


def summary(rows: DataFrame, x: Column, mask: Column | None = None, finite_only: bool = True) -> DataFrame:
    """One row of the aggregates()."""
    return rows.agg(*[c.alias(n) for n, c in aggregates(x, mask, finite_only).items()])


def histogram_edges(rows: DataFrame, x: Column, edges: Sequence[float], weight: Column | None = None, density: bool = False) -> DataFrame:
    """(bin, lo, hi, count double) over explicit edges, the last bin closed; density divides by total and width at the end."""
    edges = list(map(float, edges))
    if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("edges must be two or more and ascend")
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = rows.select(ieee.edge_bin(x, edges).alias("bin"), w.alias("w")).where(F.col("bin").isNotNull() & ieee.isfinite(F.col("w")))
    out = all_bins(rows.sparkSession, rows.groupBy("bin").agg(F.sum("w").alias("count")), {"bin": len(edges) - 1})
    at = F.array(*[F.lit(e) for e in edges])
    out = out.select("bin", at[F.col("bin")].alias("lo"), at[F.col("bin") + 1].alias("hi"), "count")
    if density:
        from pyspark.sql import Window

        total = F.sum("count").over(Window.partitionBy())  # as many rows as bins
        out = out.withColumn("count", ieee.div(F.col("count"), total * (F.col("hi") - F.col("lo"))))
    return out


def topk_modes(rows: DataFrame, x: Column, k: int) -> DataFrame:
    """(rank, value, count): the k most frequent finite values, larger values first on ties, padded with NaN and 0."""
    if k <= 0:
        raise ValueError("k must be positive")
    x = x.cast("double")
    counts = rows.select(x.alias("value")).where(ieee.isfinite(F.col("value"))).groupBy("value").count()
    top = counts.orderBy(F.desc("count"), F.desc("value")).limit(k)
    top = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), (-F.col("value")).alias("v")))).alias("a"))  # k rows at most
    top = top.select(F.posexplode("a").alias("rank", "s")).select("rank", (-F.col("s.v")).alias("value"), (-F.col("s.c")).alias("count"))
    grid = rows.sparkSession.range(k).select(F.col("id").cast("int").alias("rank"))
    return grid.join(top, "rank", "left").select("rank", F.coalesce("value", F.lit(ieee.NAN)).alias("value"), F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def _deposit(mesh: Mesh, particles: DataFrame, axis: int, bounds: tuple[float, float] | None, mass_max: float | None) -> DataFrame:
    """(level, i, j, k, m): masses shared by bilinear weights among four cells of the particle's plane.

    Shares outside the particle's own block or in covered cells are dropped.
    """
    h = mesh.hierarchy
    u, v = plane_axes(axis)
    names = "xyz"
    a = F.col(names[axis])
    rows = particles.select("level", F.col("grid").alias("block"), *[F.col(n).cast("double").alias(n) for n in (*names, "mass")])
    ok = F.col("mass") > 0
    for n in (*names, "mass"):
        ok = ok & ieee.isfinite(F.col(n))
    if mass_max is not None:
        ok = ok & (F.col("mass") <= float(mass_max))
    if bounds is not None:
        ok = ok & (a >= float(min(bounds))) & (a <= float(max(bounds)))
    rows = rows.where(ok)
    blocks = mesh.hierarchy.blocks_frame(particles.sparkSession).drop("step")
    rows = rows.join(blocks, ["level", "block"])
    cell = F.floor((a - h.per_level(lambda x: x.x0[axis])) / h.per_level(lambda x: x.dx[axis])).cast("int") + h.per_level(lambda x: x.origin[axis])
    rows = rows.withColumn("ijk"[axis], cell).where(F.col("ijk"[axis]).between(F.col(f"lo{axis}"), F.col(f"hi{axis}")))
    for w in (u, v):
        g = (F.col(names[w]) - h.per_level(lambda x, w=w: x.x0[w])) / h.per_level(lambda x, w=w: x.dx[w]) - 0.5
        rows = rows.withColumn(f"g{w}", g).withColumn(f"f{w}", F.floor(F.col(f"g{w}")))
    corners = []
    for p in (0, 1):
        for q in (0, 1):
            fu, fv = F.col(f"g{u}") - F.col(f"f{u}"), F.col(f"g{v}") - F.col(f"f{v}")
            weight = (fu if p else 1 - fu) * (fv if q else 1 - fv)
            place = [(F.col(f"f{w}") + s + h.per_level(lambda x, w=w: x.origin[w])).cast("int").alias("ijk"[w]) for w, s in ((u, p), (v, q))]
            corners.append(F.struct(*place, (weight * F.col("mass")).alias("m")))
    rows = rows.withColumn("c", F.explode(F.array(*corners)))
    rows = rows.where(F.col("c.m") > 0)
    for w in (u, v):
        rows = rows.where(F.col(f"c.{'ijk'[w]}").between(F.col(f"lo{w}"), F.col(f"hi{w}")))
    rows = rows.select("level", F.col("ijk"[axis]), F.col(f"c.{'ijk'[u]}"), F.col(f"c.{'ijk'[v]}"), F.col("c.m"))
    return mesh.leaves(rows.groupBy(*CELL).agg(F.sum("m").alias("m")))


def cic_grid(mesh: Mesh, particles: DataFrame, axis: str | int, bounds: tuple[float, float] | None = None, mass_max: float | None = None) -> DataFrame:
    """(level, i, j, k, density): deposited mass over the cell's volume, for cells that get any."""
    rows = _deposit(mesh, particles, axis_index(axis), bounds, mass_max)
    return rows.select(*CELL, (F.col("m") / mesh.volume()).alias("density"))


def cic_project(mesh: Mesh, particles: DataFrame, axis: str | int, bounds: tuple[float, float], rect: Sequence[float], resolution: tuple[int, int], mass_max: float | None = None) -> DataFrame:
    """(py, px, value): deposited mass, each cell's shared among pixels by area."""
    a = axis_index(axis)
    rect, du, dv = _rect(rect, resolution)
    u, v = plane_axes(a)
    h = mesh.hierarchy
    rows = _deposit(mesh, particles, a, bounds, mass_max).groupBy("level", "ijk"[u], "ijk"[v]).agg(F.sum("m").alias("m"))
    rows = rows.withColumns({f"{n}{s}": h.edge(w, F.col("ijk"[w]) + k) for n, w in (("u", u), ("v", v)) for s, k in (("0", 0), ("1", 1))})
    rows = spread(spread(rows, "u0", "u1", rect[0], du, resolution[0], "px", "ou"), "v0", "v1", rect[1], dv, resolution[1], "py", "ov")
    share = F.col("m") * F.col("ou") * F.col("ov") / ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0")))
    sums = rows.groupBy("py", "px").agg(F.sum(share).alias("s"))
    return pixel_grid(mesh.cells, resolution).join(sums, ["py", "px"], "left").select("py", "px", F.coalesce("s", F.lit(0.0)).alias("value"))
