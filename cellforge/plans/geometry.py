"""Levels, blocks, plane geometry and coverage of a block-structured hierarchy."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = {"x": 0, "y": 1, "z": 2}
#: Cells of a tile's edge: covered boxes and cells meet on tiles, then by their bounds.
TILE = 16


@dataclass(frozen=True)
class Level:
    level: int
    dx: tuple[float, float, float]
    x0: tuple[float, float, float] = (0.0, 0.0, 0.0)
    origin: tuple[int, int, int] = (0, 0, 0)
    periodic: tuple[bool, bool, bool] = (False, False, False)
    ref_ratio: int = 2  # to the next finer level

    def edge(self, axis: int, index):
        return self.x0[axis] + (index - self.origin[axis]) * self.dx[axis]

    def index(self, axis: int, x: float) -> int:
        return math.floor((x - self.x0[axis]) / self.dx[axis]) + self.origin[axis]


@dataclass(frozen=True)
class Block:
    level: int
    block: int
    lo: tuple[int, int, int]
    hi: tuple[int, int, int]  # inclusive


def axis_index(axis: str | int) -> int:
    if axis in AXES:
        return AXES[axis]
    if axis in (0, 1, 2) and not isinstance(axis, bool):
        return int(axis)
    raise ValueError(f"axis must be x, y or z, not {axis!r}")


def plane_axes(axis: int) -> tuple[int, int]:
    return [(1, 2), (0, 2), (0, 1)][axis]


@dataclass(frozen=True)
class Hierarchy:
    """Levels coarse to fine, and their blocks."""

    levels: tuple[Level, ...]
    blocks: tuple[Block, ...]

    def at(self, level: int) -> Level:
        return next(x for x in self.levels if x.level == level)

    def on(self, level: int) -> list[Block]:
        return [b for b in self.blocks if b.level == level]

    def domain(self) -> tuple[list[float], list[float]]:
        """Lower and upper corner of the coarsest level's blocks."""
        base = self.levels[0]
        own = self.on(base.level) or list(self.blocks)
        return ([base.edge(a, min(b.lo[a] for b in own)) for a in range(3)], [base.edge(a, max(b.hi[a] for b in own) + 1) for a in range(3)])

    def plane_index(self, axis: int, coord: float) -> dict[int, int]:
        """The plane's index on each level: that of the base level's cell, refined to its lowest fine cell."""
        base = self.levels[0]
        steps, out = base.index(axis, coord) - base.origin[axis], {}
        for x in self.levels:
            out[x.level] = steps + x.origin[axis]
            steps *= x.ref_ratio
        return out

    def slab_index(self, axis: int, lo: float, hi: float) -> dict[int, tuple[int, int]]:
        """The inclusive index range that [lo, hi] touches on each level, from the base level's cells."""
        base = self.levels[0]
        first = base.index(axis, lo) - base.origin[axis]
        last = math.ceil((hi - base.x0[axis]) / base.dx[axis]) - 1
        out, ratio = {}, 1
        for x in self.levels:
            out[x.level] = (first * ratio + x.origin[axis], (max(last, first) + 1) * ratio - 1 + x.origin[axis])
            ratio *= x.ref_ratio
        return out

    def covered_boxes(self, level: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
        """Boxes of the next finer level on this one's indices: lower ends floor, upper ends take whole cells only."""
        x = self.at(level)
        finer = next((y for y in self.levels if y.level == level + 1), None)
        if finer is None:
            return []
        r, out = x.ref_ratio, []
        for b in self.on(finer.level):
            lo = tuple((b.lo[a] - finer.origin[a]) // r + x.origin[a] for a in range(3))
            hi = tuple((b.hi[a] - finer.origin[a] + 1) // r - 1 + x.origin[a] for a in range(3))
            if all(p <= q for p, q in zip(lo, hi, strict=True)):
                out.append((lo, hi))
        return out

    def blocks_at(self, axis: int, coord: float, rect: Sequence[float] | None = None) -> list[Block]:
        """Blocks that the plane of each level cuts, and that touch rect (u0, v0, u1, v1)."""
        planes = self.plane_index(axis, coord)
        return [b for b in self.blocks if b.lo[axis] <= planes[b.level] <= b.hi[axis] and self._touches(b, axis, rect)]

    def blocks_in(self, axis: int, lo: float, hi: float, rect: Sequence[float] | None = None) -> list[Block]:
        out = []
        for b in self.blocks:
            x = self.at(b.level)
            if x.edge(axis, b.lo[axis]) < hi and x.edge(axis, b.hi[axis] + 1) > lo and self._touches(b, axis, rect):
                out.append(b)
        return out

    def window(self, axis: int, layers: dict[int, tuple[int, int]], rect: Sequence[float] | None = None) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
        """By level, the inclusive index ranges of the cells in these layers that may touch rect, and the blocks that hold any.

        In the plane a cell more is taken on each side, so that rounding leaves out none; levels without a block are absent.
        """
        out = {}
        for x in self.levels:
            ranges = [(0, 0)] * 3
            ranges[axis] = layers[x.level]
            own = [b for b in self.on(x.level)]
            for i, a in enumerate(plane_axes(axis)):
                if rect is None:
                    ranges[a] = (min((b.lo[a] for b in own), default=0), max((b.hi[a] for b in own), default=0))
                else:
                    ends = sorted((x.index(a, rect[i]), x.index(a, rect[i + 2])))
                    ranges[a] = (ends[0] - 1, ends[1] + 1)
            hit = [b.block for b in own if all(b.lo[a] <= ranges[a][1] and b.hi[a] >= ranges[a][0] for a in range(3))]
            if hit:
                out[x.level] = (ranges, hit)
        return out

    def adjacent(self, spark: SparkSession) -> DataFrame:
        """(level, block, other, axis, side): blocks of one level that share part of a face, periodic axes closed.

        side 1: the other block is at the upper end of the axis. An equi-join on the plane between them and on tiles of the
        plane's two axes, then by bounds, so that its rows grow with the faces.
        """
        size = max((h - a + 1 for b in self.blocks for a, h in zip(b.lo, b.hi, strict=True)), default=1)
        blocks = self.blocks_frame(spark).drop("step")
        parts = []
        for a in range(3):
            u, v = plane_axes(a)
            spans = {x.level: (min(b.lo[a] for b in self.on(x.level)), max(b.hi[a] for b in self.on(x.level)) + 1) for x in self.levels if x.periodic[a] and self.on(x.level)}
            face = F.col(f"hi{a}") + 1
            for level, (lo, hi) in spans.items():
                face = F.when((F.col("level") == level) & (F.col(f"hi{a}") + 1 == hi), F.lit(lo)).otherwise(face)

            def tiles(rows: DataFrame, names: Sequence[str], u=u, v=v) -> DataFrame:
                for w, n in zip((u, v), names, strict=True):
                    rows = rows.withColumn(n, F.explode(F.sequence(F.floor(F.col(f"lo{w}") / size), F.floor(F.col(f"hi{w}") / size))))
                return rows

            upper = tiles(blocks.withColumn("face", face), ("tu", "tv"))
            lower = tiles(blocks.withColumn("face", F.col(f"lo{a}")), ("tu", "tv"))
            lower = lower.select("level", "face", "tu", "tv", F.col("block").alias("other"), *[F.col(f"{e}{w}").alias(f"o{e}{w}") for e in ("lo", "hi") for w in (u, v)])
            meet = (F.col(f"lo{u}") <= F.col(f"ohi{u}")) & (F.col(f"hi{u}") >= F.col(f"olo{u}")) & (F.col(f"lo{v}") <= F.col(f"ohi{v}")) & (F.col(f"hi{v}") >= F.col(f"olo{v}"))
            pairs = upper.join(lower, ["level", "face", "tu", "tv"]).where(meet).select("level", "block", "other").distinct()
            parts.append(pairs.select("level", "block", "other", F.lit(a).alias("axis"), F.lit(1).alias("side")))
            parts.append(pairs.select("level", F.col("other").alias("block"), F.col("block").alias("other"), F.lit(a).alias("axis"), F.lit(0).alias("side")))
        return functools.reduce(DataFrame.unionAll, parts)

    def _touches(self, b: Block, axis: int, rect: Sequence[float] | None) -> bool:
        if rect is None:
            return True
        x = self.at(b.level)
        return all(x.edge(a, b.lo[a]) < rect[2 + i] and x.edge(a, b.hi[a] + 1) > rect[i] for i, a in enumerate(plane_axes(axis)))

    def levels_frame(self, spark: SparkSession, step: int = 0) -> DataFrame:
        rows = [(step, x.level, *x.dx, *x.x0, *x.origin, *x.periodic, x.ref_ratio) for x in self.levels]
        return spark.createDataFrame(rows, "step int, level int, dx0 double, dx1 double, dx2 double, x00 double, x01 double, x02 double, o0 int, o1 int, o2 int, per0 boolean, per1 boolean, per2 boolean, ref_ratio int")

    def blocks_frame(self, spark: SparkSession, step: int = 0) -> DataFrame:
        return spark.createDataFrame([(step, b.level, b.block, *b.lo, *b.hi) for b in self.blocks], "step int, level int, block int, lo0 int, lo1 int, lo2 int, hi0 int, hi1 int, hi2 int")

    def per_level(self, value, column: str = "level") -> Column:
        """A column of value(level), by a row's level."""
        out = None
        for x in self.levels:
            v = F.lit(value(x))
            out = F.when(F.col(column) == x.level, v) if out is None else out.when(F.col(column) == x.level, v)
        return out

    def edge(self, axis: int, index: Column | str, column: str = "level") -> Column:
        index = F.col(index) if isinstance(index, str) else index
        return self.per_level(lambda x: x.x0[axis], column) + (index - self.per_level(lambda x: x.origin[axis], column)) * self.per_level(lambda x: x.dx[axis], column)

    def centre(self, axis: int, column: str = "level") -> Column:
        return self.edge(axis, "ijk"[axis], column) + self.per_level(lambda x: x.dx[axis], column) / 2

    def drop_covered(self, cells: DataFrame) -> DataFrame:
        """cells (level, i, j, k, ...) but those that a finer level covers: an anti-join on tiles, then bounds."""
        boxes = [(x.level, *lo, *hi) for x in self.levels for lo, hi in self.covered_boxes(x.level)]
        if not boxes:
            return cells
        spark = cells.sparkSession
        cover = spark.createDataFrame(boxes, "c_level int, l0 int, l1 int, l2 int, h0 int, h1 int, h2 int")
        for a in range(3):
            cover = cover.withColumn(f"t{a}", F.explode(F.sequence(F.floor(F.col(f"l{a}") / TILE), F.floor(F.col(f"h{a}") / TILE))))
        on = (cells["level"] == cover["c_level"])
        for a, name in enumerate("ijk"):
            on = on & (F.floor(cells[name] / TILE) == cover[f"t{a}"]) & cells[name].between(cover[f"l{a}"], cover[f"h{a}"])
        return cells.join(cover, on, "left_anti")


def plane(hierarchy: Hierarchy, axis: str | int, coord: float | None = None, zoom: float = 1.0, resolution: tuple[int, int] = (512, 512)) -> dict:
    """Default coordinate, rectangle, bounds and labels of a plane or projection view."""
    a = axis_index(axis)
    if not (isinstance(zoom, int | float) and math.isfinite(zoom) and zoom > 0):
        raise ValueError("zoom must be positive")
    if len(resolution) != 2 or any(int(n) != n or n <= 0 for n in resolution):
        raise ValueError("resolution must be two positive whole numbers")
    lo, hi = hierarchy.domain()
    base = hierarchy.levels[0]
    if coord is None:
        cells = round((hi[a] - lo[a]) / base.dx[a])
        coord = lo[a] + (cells // 2 + 0.5) * base.dx[a]
    u, v = plane_axes(a)
    rect = []
    for sign in (-1, 1):
        for w in (u, v):
            mid, half = (lo[w] + hi[w]) / 2, (hi[w] - lo[w]) / 2
            rect.append(mid + sign * half / zoom)
    return {"axis": a, "coord": float(coord), "rect": tuple(rect), "bounds": (lo[a], hi[a]), "labels": ("xyz"[u], "xyz"[v]), "resolution": (int(resolution[0]), int(resolution[1]))}
