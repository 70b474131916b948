"""Mesh operators on cell tables (level, block, i, j, k, fields): slices, projections, histograms, reports."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.plans.geometry import Hierarchy, axis_index, plane_axes

CELL = ("level", "i", "j", "k")


@dataclass(frozen=True)
class Mesh:
    """A cell table over a hierarchy. load: the table with these stored fields only, where the source can't prune by itself."""

    cells: DataFrame
    hierarchy: Hierarchy
    fields: tuple[str, ...] = field(default=())
    load: Callable[[Sequence[str]], DataFrame] | None = field(default=None, compare=False)

    def with_field(self, name: str, value: Column) -> Mesh:
        return self.with_fields({name: value})

    def with_fields(self, values: dict[str, Column]) -> Mesh:
        """The mesh with more fields. A source that can't prune by itself is asked for the fields that these are made of."""
        cells = self.cells
        if self.load is not None:
            used = cells.select(*values.values())._jdf.queryExecution().analyzed().references().toSeq()
            names = {used.apply(i).name() for i in range(used.size())}
            cells = self.load([f for f in self.fields if f in names])
        return Mesh(cells.withColumns(values), self.hierarchy, (*self.fields, *values))

    def only(self, *names: str) -> DataFrame:
        """The cells with these fields at least."""
        return self.cells if self.load is None or not set(names) <= set(self.fields) else self.load(names)

    def leaves(self, cells: DataFrame | None = None) -> DataFrame:
        """The cells that no finer level covers."""
        return self.hierarchy.drop_covered(self.cells if cells is None else cells)

    def volume(self) -> Column:
        return self.hierarchy.per_level(lambda x: x.dx[0] * x.dx[1] * x.dx[2])


def pixel_grid(cells: DataFrame, resolution: tuple[int, int]) -> DataFrame:
    nx, ny = resolution
    n = cells.sparkSession.range(nx * ny)
    return n.select(F.floor(F.col("id") / nx).cast("int").alias("py"), (F.col("id") % nx).cast("int").alias("px"))


def spread(rows: DataFrame, lo: str, hi: str, origin: float, width: float, n: int, pixel: str, overlap: str) -> DataFrame:
    """Each row once for each of n pixels from `origin` that [lo, hi] overlaps, with the length of the overlap.

    The pixels are generated from the interval, so this is no join; pixels that only touch are left out.
    """
    first = F.greatest(F.floor((F.col(lo) - origin) / width), F.lit(0))
    last = F.least(F.ceil((F.col(hi) - origin) / width) - 1, F.lit(n - 1))
    out = rows.where((F.col(hi) > origin) & (F.col(lo) < origin + n * width))
    out = out.withColumn(pixel, F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    out = out.withColumn(pixel, F.col(pixel).cast("int"))
    left = F.greatest(F.col(lo), origin + F.col(pixel) * width)
    right = F.least(F.col(hi), origin + (F.col(pixel) + 1) * width)
    return out.withColumn(overlap, right - left).where(F.col(overlap) > 0)


#: Blocks of a level up to which a window names them; beyond, their cells' indices alone prune.
NAMED_BLOCKS = 1000


def _window(h: Hierarchy, cells: DataFrame, axis: int, layers: dict[int, tuple[int, int]], rect: Sequence[float] | None) -> DataFrame:
    """The cells of each level's layers that may touch rect, by literal ranges that reach the scan."""
    own = h.window(axis, layers, rect)
    if not own:
        return cells.where(F.lit(False))
    keep, blocks = [], set()
    for level, (ranges, hit) in own.items():
        part = [F.col("level") == level]
        part += [F.col(n) == a if a == b else F.col(n).between(a, b) for n, (a, b) in zip("ijk", ranges, strict=True)]
        keep.append(functools.reduce(operator.and_, part))
        blocks.update(hit)
    # conjuncts of their own for sources that take no alternatives
    cells = cells.where(F.col("level").isin(sorted(own)))
    if "block" in cells.columns and len(blocks) <= NAMED_BLOCKS:
        cells = cells.where(F.col("block").isin(sorted(blocks)))
    for a, n in enumerate("ijk"):
        cells = cells.where(F.col(n).between(min(r[a][0] for r, _ in own.values()), max(r[a][1] for r, _ in own.values())))
    return cells.where(functools.reduce(operator.or_, keep))


def _plane_cells(mesh: Mesh, axis: int, layers: dict[int, tuple[int, int]], rect: Sequence[float], name: str, value: Column) -> DataFrame:
    """Uncovered cells of a plane or slab that may touch rect, with their in-plane edges."""
    h = mesh.hierarchy
    u, v = plane_axes(axis)
    cells = _window(h, mesh.only(name), axis, layers, rect)
    edges = {f"{n}{s}": h.edge(w, F.col("ijk"[w]) + k) for n, w in (("u", u), ("v", v)) for s, k in (("0", 0), ("1", 1))}
    return mesh.leaves(cells.select(*CELL, value.alias("x"))).withColumns(edges)


def _rect(rect: Sequence[float], resolution: tuple[int, int]) -> tuple[tuple[float, float, float, float], float, float]:
    u0, v0, u1, v1 = map(float, rect)
    u0, u1, v0, v1 = min(u0, u1), max(u0, u1), min(v0, v1), max(v0, v1)
    if u0 == u1 or v0 == v1 or min(resolution) < 1:
        raise ValueError("the rectangle and resolution must not be empty")
    return (u0, v0, u1, v1), (u1 - u0) / resolution[0], (v1 - v0) / resolution[1]


def slice_plane(mesh: Mesh, name: str, axis: str | int, coord: float, rect: Sequence[float], resolution: tuple[int, int]) -> DataFrame:
    """(py, px, value): area-weighted cell values over each pixel, divided by the whole pixel; NaN where no cell is.

    The plane takes one layer of cells of each level, the lowest of those that the base level's cell holds.
    """
    a = axis_index(axis)
    rect, du, dv = _rect(rect, resolution)
    planes = mesh.hierarchy.plane_index(a, coord)
    rows = _plane_cells(mesh, a, {n: (k, k) for n, k in planes.items()}, rect, name, F.col(name).cast("double"))
    rows = spread(spread(rows, "u0", "u1", rect[0], du, resolution[0], "px", "ou"), "v0", "v1", rect[1], dv, resolution[1], "py", "ov")
    area = F.col("ou") * F.col("ov")
    sums = rows.groupBy("py", "px").agg(F.sum(F.col("x") * area).alias("s"), F.sum(area).alias("a"))
    value = F.when(F.col("a").isNull() | (F.col("a") == 0), F.lit(ieee.NAN)).otherwise(F.col("s") / (du * dv))
    return pixel_grid(mesh.cells, resolution).join(sums, ["py", "px"], "left").select("py", "px", value.alias("value"))


def slice_nearest(mesh: Mesh, name: str, axis: str | int, coord: float, rect: Sequence[float], resolution: tuple[int, int]) -> DataFrame:
    """(py, px, value): the finest uncovered cell at each pixel's centre; NaN outside the data."""
    a = axis_index(axis)
    rect, du, dv = _rect(rect, resolution)
    u0, v0, _, _ = rect
    u, v = plane_axes(a)
    h = mesh.hierarchy
    planes = h.plane_index(a, coord)
    grid = pixel_grid(mesh.cells, resolution)
    points = None
    for x in h.levels:
        at = {w: F.floor((o + (F.col(p) + 0.5) * d - x.x0[w]) / x.dx[w]).cast("int") + x.origin[w] for w, o, p, d in ((u, u0, "px", du), (v, v0, "py", dv))}
        own = grid.select("py", "px", F.lit(x.level).alias("level"), at[u].alias("ijk"[u]), at[v].alias("ijk"[v]), F.lit(planes[x.level]).alias("ijk"[a]))
        points = own if points is None else points.unionByName(own)
    cells = _window(h, mesh.only(name), a, {n: (k, k) for n, k in planes.items()}, rect).select(*CELL, F.col(name).cast("double").alias("value"))
    best = points.join(cells, list(CELL)).groupBy("py", "px").agg(F.max_by("value", "level").alias("value"))
    return grid.join(best, ["py", "px"], "left").select("py", "px", F.coalesce("value", F.lit(ieee.NAN)).alias("value"))


def project(mesh: Mesh, name: str, axis: str | int, bounds: tuple[float, float], rect: Sequence[float], resolution: tuple[int, int]) -> DataFrame:
    """(py, px, value): cell values times the volume that lies in the pixel's column and bounds; 0 where no cell is."""
    a = axis_index(axis)
    rect, du, dv = _rect(rect, resolution)
    lo, hi = min(bounds), max(bounds)
    h, n = mesh.hierarchy, "ijk"[a]
    low, high = h.edge(a, n), h.edge(a, F.col(n) + 1)
    depth = F.least(high, F.lit(hi)) - F.greatest(low, F.lit(lo))
    layers = {x.level: (x.index(a, lo) - 1, x.index(a, hi) + 1) for x in h.levels}
    rows = _plane_cells(mesh, a, layers, rect, name, F.when((high > lo) & (low < hi), F.col(name).cast("double") * depth)).where("x is not null")
    # cells of a column of one level share their pixels: summed before they spread
    rows = rows.groupBy("u0", "u1", "v0", "v1").agg(F.sum("x").alias("x"))
    rows = spread(spread(rows, "u0", "u1", rect[0], du, resolution[0], "px", "ou"), "v0", "v1", rect[1], dv, resolution[1], "py", "ov")
    sums = rows.groupBy("py", "px").agg(F.sum(F.col("x") * F.col("ou") * F.col("ov")).alias("s"))
    return pixel_grid(mesh.cells, resolution).join(sums, ["py", "px"], "left").select("py", "px", F.coalesce("s", F.lit(0.0)).alias("value"))


def all_bins(spark, counts: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """counts with a zero row for each bin without one."""
    total = 1
    for n in sizes.values():
        total *= n
    grid, left = spark.range(total), F.col("id")
    for name, n in reversed(sizes.items()):
        grid = grid.withColumn(name, (left % n).cast("int"))
        left = F.floor(left / n)
    return grid.drop("id").join(counts, list(sizes), "left").select(*sizes, F.coalesce("count", F.lit(0.0)).alias("count"))


def histogram(rows: DataFrame, value: Column, bins: int, bounds: tuple[float, float], weight: Column | None = None) -> DataFrame:
    """(bin, count double): finite values of [lo, hi] in equal bins, the last closed; non-finite weights are left out."""
    lo, hi = _bounds(bounds, bins)
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = rows.select(ieee.uniform_bin(value, lo, hi, bins).alias("bin"), w.alias("w")).where(F.col("bin").isNotNull() & ieee.isfinite(F.col("w")))
    return all_bins(rows.sparkSession, rows.groupBy("bin").agg(F.sum("w").alias("count")), {"bin": bins})


def histograms(rows: DataFrame, specs: Sequence[tuple[Column, int, tuple[float, float], Column | None]]) -> DataFrame:
    """(which, bin, count) of several (value, bins, bounds, weight) in one pass over the rows; bins without a value are absent."""
    parts = []
    for n, (value, bins, bounds, weight) in enumerate(specs):
        lo, hi = _bounds(bounds, bins)
        w = F.lit(1.0) if weight is None else weight.cast("double")
        parts.append(F.struct(F.lit(n).alias("which"), ieee.uniform_bin(value, lo, hi, bins).alias("bin"), w.alias("w")))
    each = rows.select(F.explode(F.array(*parts)).alias("h")).select("h.*").where(F.col("bin").isNotNull() & ieee.isfinite(F.col("w")))
    return each.groupBy("which", "bin").agg(F.sum("w").alias("count"))


def histogram2d(rows: DataFrame, x: Column, y: Column, bins: tuple[int, int], bounds: tuple[tuple[float, float], tuple[float, float]], weight: Column | None = None) -> DataFrame:
    """(xbin, ybin, count double)."""
    (x0, x1), (y0, y1) = (_bounds(b, n) for b, n in zip(bounds, bins, strict=True))
    w = F.lit(1.0) if weight is None else weight.cast("double")
    rows = rows.select(ieee.uniform_bin(x, x0, x1, bins[0]).alias("xbin"), ieee.uniform_bin(y, y0, y1, bins[1]).alias("ybin"), w.alias("w"))
    rows = rows.where(F.col("xbin").isNotNull() & F.col("ybin").isNotNull() & ieee.isfinite(F.col("w")))
    return all_bins(rows.sparkSession, rows.groupBy("xbin", "ybin").agg(F.sum("w").alias("count")), {"xbin": bins[0], "ybin": bins[1]})


def _bounds(bounds: tuple[float, float], bins: int) -> tuple[float, float]:
    lo, hi = map(float, bounds)
    if not (abs(lo) < ieee.INF and abs(hi) < ieee.INF and hi > lo) or int(bins) != bins or bins < 1:
        raise ValueError("a histogram needs a positive number of bins and finite, ascending bounds")
    return lo, hi


def weight_of(mesh: Mesh, x: Column, mode: str, weight: Column | None) -> Column | None:
    """cell_mass: x times the cell's volume; cell_volume: the volume; any other mode: the given weight."""
    if mode == "cell_mass":
        return x.cast("double") * mesh.volume()
    return mesh.volume() if mode == "cell_volume" else weight


def histogram_edges(bins: int, lo: float, hi: float) -> list[float]:
    return [lo + i * ((hi - lo) / bins) for i in range(bins + 1)]


def cdf_from_histogram(counts: DataFrame, normalize: bool = True) -> DataFrame:
    """(bin, cdf): running sums over the bins, divided by the total where that is positive."""
    from pyspark.sql import Window

    w = Window.orderBy("bin")  # as many rows as bins
    run, total = F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("count").over(Window.partitionBy())
    return counts.select("bin", (F.when(total > 0, run / total).otherwise(run) if normalize else run).alias("cdf"))


def cdf_from_samples(rows: DataFrame, value: str) -> DataFrame:
    """(value, cdf): sorted samples with (rank + 1) / n; ties take consecutive ranks.

    Equal values are counted first; value ranges are then ranked apart, so no task sees all rows.
    """
    from pyspark.sql import Window

    n = rows.count()
    counts = rows.groupBy(F.col(value).cast("double").alias("value")).agg(F.count("*").alias("n"))
    parts = counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()).sortWithinPartitions("value")
    parts = parts.withColumn("before", F.sum("n").over(Window.partitionBy("part").orderBy("value")) - F.col("n"))
    totals = parts.groupBy("part").agg(F.sum("n").alias("t"))
    totals = totals.withColumn("base", F.sum("t").over(Window.orderBy("part")) - F.col("t")).drop("t")  # one row a partition
    rank = F.explode(F.sequence(F.col("base") + F.col("before") + 1, F.col("base") + F.col("before") + F.col("n")))
    return parts.join(F.broadcast(totals), "part").select("value", rank.alias("r")).select("value", (F.col("r") / n).alias("cdf"))


def fab_minmax(mesh: Mesh, name: str) -> DataFrame:
    """(level, block, min, max) of the values that aren't NaN."""
    x = F.col(name).cast("double")
    x = F.when(~F.isnan(x), x)
    return mesh.cells.groupBy("level", "block").agg(F.min(x).alias("min"), F.max(x).alias("max"))


def subbox(mesh: Mesh, level: int, lo: Sequence[int], hi: Sequence[int]) -> DataFrame:
    """The cells of one level within inclusive index bounds."""
    keep = F.col("level") == level
    for n, a, b in zip("ijk", lo, hi, strict=True):
        keep = keep & F.col(n).between(int(a), int(b))
    return mesh.cells.where(keep)


def subbox_fetch(mesh: Mesh, level: int, block: int, halo: int) -> DataFrame:
    """Cells of all other blocks, on every level, that overlap the block's bounds widened by `halo` of its cells."""
    h = mesh.hierarchy
    own, x = next(b for b in h.on(level) if b.block == block), h.at(level)
    keep = ~((F.col("level") == level) & (F.col("block") == block))
    for a, n in enumerate("ijk"):
        keep = keep & (h.edge(a, n) < x.edge(a, own.hi[a] + 1 + halo)) & (h.edge(a, F.col(n) + 1) > x.edge(a, own.lo[a] - halo))
    return mesh.cells.where(keep)
