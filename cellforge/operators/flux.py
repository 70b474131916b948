"""Surface-flux integrals through spheres and cylinders about the coordinate origin, and annular disk moments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.operators.mesh import CELL, Mesh
from cellforge.operators.stencil import gradients

COMPONENTS = ("mass", "energy", "momentum_energy", "scalar")
STATE = ("density", "momentum_x", "momentum_y", "momentum_z", "energy", "scalar", "bx", "by", "bz")


def with_plane_area(rows: DataFrame, normal: Sequence[str], low: Sequence[str], size: Sequence[str], distance: str, name: str) -> DataFrame:
    """rows with the area of the plane n.x = distance inside a box, by inclusion and exclusion over the corners along n.

    With m non-zero components of n and d the distance left from the corner nearest along n, it is the other edges' lengths
    times sum((-1)^|b| max(0, d - b.|n|L)^(m-1)) / ((m-1)! prod |n|); with one, the face if the plane cuts the box. What terms
    share is a column of its own, so that generated code stays small; null components count as none.
    """
    left = F.col(distance)
    for n, lo, s in zip(normal, low, size, strict=True):
        left = left - F.col(n) * F.when(F.col(n) >= 0, F.col(lo)).otherwise(F.col(lo) + F.col(s))
    reach = [f"_q{a}" for a in range(3)]
    steep = sum((F.when(F.col(n) != 0, 1).otherwise(0) for n in normal), F.lit(0))
    rows = rows.withColumns({q: F.abs(F.col(n)) * F.col(s) for q, n, s in zip(reach, normal, size, strict=True)} | {"_left": left, "_m": steep})

    def corners(axes: Sequence[int], power: int) -> Column:
        total = F.lit(0.0)
        for corner in product((0, 1), repeat=len(axes)):
            rest = F.col("_left")
            for a, b in zip(axes, corner, strict=True):
                rest = rest - F.col(reach[a]) if b else rest
            rest = F.greatest(rest, F.lit(0.0))
            total = total + (-1.0) ** sum(corner) * (F.pow(rest, F.lit(2.0)) if power == 2 else rest)
        return total

    n, s = [F.abs(F.col(x)) for x in normal], [F.col(x) for x in size]
    out = F.when(F.col("_m") == 3, F.greatest(corners((0, 1, 2), 2) / (2.0 * n[0] * n[1] * n[2]), F.lit(0.0)))
    for flat in range(3):
        a, b = (x for x in range(3) if x != flat)
        out = out.when((F.col("_m") == 2) & (n[flat] == 0), F.greatest(s[flat] * corners((a, b), 1) / (n[a] * n[b]), F.lit(0.0)))
    for steep in range(3):
        a, b = (x for x in range(3) if x != steep)
        out = out.when((F.col("_m") == 1) & (n[steep] > 0) & F.col("_left").between(F.lit(0.0), F.col(reach[steep])), s[a] * s[b])
    return rows.withColumn(name, out.otherwise(F.lit(0.0))).drop(*reach, "_left", "_m")


def _cells(mesh: Mesh, state: dict[str, str], extra: Sequence[str] = ()) -> DataFrame:
    h = mesh.hierarchy
    cols = [F.col(state[k]).cast("double").alias(k) for k in (*STATE, *extra)]
    geometry = [h.edge(a, "ijk"[a]).alias(f"l{a}") for a in range(3)] + [h.per_level(lambda x, a=a: abs(x.dx[a])).alias(f"d{a}") for a in range(3)]
    return mesh.leaves(mesh.cells.select(*CELL, *cols, *geometry))


def _fluxes(rows: DataFrame, gamma: float, area: Column, normal: Sequence[Column], speed: Column) -> list[Column]:
    c = F.col
    kinetic = 0.5 * (c("momentum_x") * c("momentum_x") + c("momentum_y") * c("momentum_y") + c("momentum_z") * c("momentum_z")) / c("density")
    magnetic = 0.5 * (c("bx") * c("bx") + c("by") * c("by") + c("bz") * c("bz"))
    hydro = c("energy") - magnetic
    pressure = (gamma - 1.0) * (hydro - kinetic)
    vb = (c("momentum_x") * c("bx") + c("momentum_y") * c("by") + c("momentum_z") * c("bz")) / c("density")
    nb = normal[0] * c("bx") + normal[1] * c("by") + normal[2] * c("bz")
    return [c("density") * speed * area, (hydro + pressure) * speed * area, ((c("energy") + pressure + magnetic) * speed - vb * nb) * area, c("scalar") * speed * area]


def _usable(names: Sequence[str]) -> Column:
    out = F.col("density") > 0
    for n in names:
        out = out & ieee.isfinite(F.col(n))
    return out


def _bins(temperature_bins: Sequence[float] | None, state: dict[str, str]) -> Sequence[str]:
    if temperature_bins is None:
        return ()
    edges = list(map(float, temperature_bins))
    if "temperature" not in state:
        raise ValueError("temperature bins need a temperature field")
    if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:], strict=False)):
        raise ValueError("temperature bins must be two or more ascending edges")
    return ("temperature",)


def _split(rows: DataFrame, keys: dict[str, int], fluxes: list[Column], temperature_bins: Sequence[float] | None) -> DataFrame:
    """Sums over keys by each component's own sign, with zero rows where nothing flows."""
    t = ieee.edge_bin(F.col("temperature"), temperature_bins) if temperature_bins is not None else F.lit(0)
    rows = rows.select(*keys, t.alias("tbin"), *[f.alias(n) for f, n in zip(fluxes, COMPONENTS, strict=True)]).where("tbin is not null")
    sums = []
    for n in COMPONENTS:
        sums += [F.sum(F.when(F.col(n) < 0, F.col(n)).otherwise(0.0)).alias(f"{n}0"), F.sum(F.when(F.col(n) < 0, 0.0).otherwise(F.col(n))).alias(f"{n}1")]
    sums = rows.groupBy(*keys, "tbin").agg(*sums)
    parts = F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), *[F.col(f"{n}{s}").alias(n) for n in COMPONENTS]) for s in (0, 1)])).alias("p")
    sums = sums.select(*keys, "tbin", parts).select(*keys, "tbin", "p.*")
    spark = rows.sparkSession
    sizes = keys | {"tbin": 1 if temperature_bins is None else len(temperature_bins) - 1, "sign": 2}
    grid = spark.range(1).drop("id")
    for n, size in sizes.items():
        grid = grid.withColumn(n, F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    out = grid.join(sums, [*keys, "tbin", "sign"], "left")
    return out.select(*keys, "sign", "tbin", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in COMPONENTS])


def _radii(radius, what: str = "radius") -> list[float]:
    out = [float(r) for r in (radius if isinstance(radius, list | tuple | np.ndarray) else [radius])]
    if not out or any(not math.isfinite(r) or r <= 0 for r in out):
        raise ValueError(f"each {what} must be positive and finite")
    return out


def _box_range(lo: Sequence[float], hi: Sequence[float], axes: Sequence[int]) -> tuple[float, float]:
    """Least and largest distance squared from the origin to a box."""
    near = sum(0.0 if lo[a] <= 0 <= hi[a] else min(lo[a] ** 2, hi[a] ** 2) for a in axes)
    return near, sum(max(lo[a] ** 2, hi[a] ** 2) for a in axes)


def _reached(mesh: Mesh, radius: float, axes: Sequence[int], height: float | None = None) -> bool:
    for b in mesh.hierarchy.blocks:
        x = mesh.hierarchy.at(b.level)
        lo, hi = [x.edge(a, b.lo[a]) for a in range(3)], [x.edge(a, b.hi[a] + 1) for a in range(3)]
        near, far = _box_range(lo, hi, axes)
        if near <= radius**2 <= far or height is not None and near <= radius**2 and lo[2] <= height and hi[2] >= -height:
            return True
    return False


def _square_range(rows: DataFrame, axes: Sequence[int]) -> tuple[Column, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for a in axes:
        lo, hi = F.col(f"l{a}"), F.col(f"l{a}") + F.col(f"d{a}")
        near = near + F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(lo * lo, hi * hi))
        far = far + F.greatest(lo * lo, hi * hi)
    return near, far


def flux_sphere(mesh: Mesh, state: dict[str, str], radius, gamma: float = 5 / 3, temperature_bins: Sequence[float] | None = None) -> DataFrame:
    """(radius_index, sign, tbin, mass, energy, momentum_energy, scalar): fluxes through spheres, in- and outward apart.

    In each uncovered cell that a sphere cuts, the surface is the plane at the radius across the direction of the cell's
    centre. A field with a non-finite value or density not above zero leaves the cell out. Sign 0 holds what flows in.
    """
    radii, extra = _radii(radius), _bins(temperature_bins, state)
    for r in radii:
        if not _reached(mesh, r, (0, 1, 2)):
            raise ValueError(f"radius {r} meets no block")
    rows = _cells(mesh, state, extra)
    near, far = _square_range(rows, (0, 1, 2))
    rows = rows.withColumns({"near": near, "far": far}).where((F.col("near") <= max(radii) ** 2) & (F.col("far") >= min(radii) ** 2))
    rows = rows.where(_usable([*STATE, *extra]))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("radius_index"), F.lit(r).alias("radius")) for n, r in enumerate(radii)])).alias("r")
    rows = rows.select("*", each).select("*", "r.*").where((F.col("near") <= F.col("radius") * F.col("radius")) & (F.col("far") >= F.col("radius") * F.col("radius")))
    mid = [F.col(f"l{a}") + F.col(f"d{a}") / 2 for a in range(3)]
    rows = rows.withColumns({f"c{a}": m for a, m in enumerate(mid)})
    rows = rows.withColumn("rc", F.sqrt(sum((F.col(f"c{a}") * F.col(f"c{a}") for a in range(3)), F.lit(0.0)))).where("rc > 0")
    speed = (F.col("c0") * F.col("momentum_x") + F.col("c1") * F.col("momentum_y") + F.col("c2") * F.col("momentum_z")) / (F.col("density") * F.col("rc"))
    rows = rows.withColumns({f"n{a}": F.col(f"c{a}") / F.col("rc") for a in range(3)} | {"speed": speed})
    # a plane that misses the cell has area 0 and adds nothing
    rows = with_plane_area(rows, ("n0", "n1", "n2"), ("l0", "l1", "l2"), ("d0", "d1", "d2"), "radius", "area")
    fluxes = _fluxes(rows, gamma, F.col("area"), [F.col("n0"), F.col("n1"), F.col("n2")], F.col("speed"))
    return _split(rows, {"radius_index": len(radii)}, fluxes, temperature_bins)


def flux_cylinder(mesh: Mesh, state: dict[str, str], radius: float, height, gamma: float = 5 / 3, temperature_bins: Sequence[float] | None = None) -> DataFrame:
    """(height_index, section, sign, tbin, components): fluxes through a cylinder about z, of half-heights `height`.

    Section 0 is the end caps, taken as whole cell faces where the cell comes within the radius; 1 the walls, planes across
    the direction of the cell's centre in the xy plane, with z cut to the half-height.
    """
    (radius,), heights, extra = _radii(radius), _radii(height, "height"), _bins(temperature_bins, state)
    for z in heights:
        if not _reached(mesh, radius, (0, 1), z):
            raise ValueError(f"a cylinder of radius {radius} and half-height {z} meets no block")
    rows = _cells(mesh, state, extra)
    near, far = _square_range(rows, (0, 1))
    rows = rows.withColumns({"near": near, "far": far}).where(F.col("near") <= radius**2).where(_usable([*STATE, *extra]))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("height_index"), F.lit(z).alias("height")) for n, z in enumerate(heights)])).alias("r")
    rows = rows.select("*", each).select("*", "r.*")
    low, high = F.col("l2"), F.col("l2") + F.col("d2")
    rows = rows.withColumns({f"c{a}": F.col(f"l{a}") + F.col(f"d{a}") / 2 for a in range(2)})
    rows = rows.withColumn("rc", F.sqrt(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1")))
    face = F.col("d0") * F.col("d1")
    z0, z1 = F.greatest(low, -F.col("height")), F.least(high, F.col("height"))
    normal = [F.when(F.col("rc") > 0, F.col(f"c{a}") / F.col("rc")).otherwise(F.lit(0.0)) for a in range(2)] + [F.lit(0.0)]
    rows = rows.withColumns({f"w{a}": n for a, n in enumerate(normal)} | {"z0": z0, "depth": z1 - z0, "radius": F.lit(radius)})
    rows = with_plane_area(rows, ("w0", "w1", "w2"), ("l0", "l1", "z0"), ("d0", "d1", "depth"), "radius", "wall")
    normal = [F.col(f"w{a}") for a in range(3)]
    wall = F.when((F.col("rc") > 0) & (F.col("far") >= radius**2) & (F.col("depth") > 0), F.col("wall")).otherwise(F.lit(0.0))
    piece = lambda section, area, n: F.struct(F.lit(section).alias("section"), area.alias("area"), *[x.alias(f"n{a}") for a, x in enumerate(n)])
    cap = lambda z: F.when((low <= z) & (high >= z), face).otherwise(F.lit(0.0))
    pieces = F.array(piece(0, cap(F.col("height")), [F.lit(0.0), F.lit(0.0), F.lit(1.0)]), piece(0, cap(-F.col("height")), [F.lit(0.0), F.lit(0.0), F.lit(-1.0)]), piece(1, wall, normal))
    rows = rows.withColumn("p", F.explode(pieces)).select("*", "p.*").where("area > 0")
    speed = (F.col("n0") * F.col("momentum_x") + F.col("n1") * F.col("momentum_y") + F.col("n2") * F.col("momentum_z")) / F.col("density")
    fluxes = _fluxes(rows, gamma, F.col("area"), [F.col("n0"), F.col("n1"), F.col("n2")], speed)
    return _split(rows, {"height_index": len(heights), "section": 2}, fluxes, temperature_bins)


MOMENTS = ("mass", "internal_energy", "magnetic_square", "radial_momentum", "radial_momentum_square", "radial_force", "volume")
DISK = ("density", "momentum_x", "momentum_y", "internal_energy", "bx", "by", "bz")


def disk_moments(mesh: Mesh, state: dict[str, str], potential: str, z_bounds: tuple[float, float], edges: Sequence[float], center: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """(rbin, the seven moments): sums over annuli of the disk between z_bounds, radius from center in x and y.

    The last annulus is closed. Cells with a non-finite value or density not above zero are left out; at radius 0 the
    radial terms are 0. The potential's gradient is the composite stencil's, asked for in the annuli's cells only.
    """
    edges = list(map(float, edges))
    if len(edges) < 2 or any(not a < b for a, b in zip(edges, edges[1:], strict=False)) or edges[0] < 0:
        raise ValueError("radial edges must be two or more, ascending and not negative")
    z0, z1 = map(float, z_bounds)
    if not z0 < z1:
        raise ValueError("z bounds must ascend")
    h = mesh.hierarchy
    low, high = h.edge(2, "k"), h.edge(2, F.col("k") + 1)
    rows = mesh.leaves(mesh.cells.where((high > z0) & (low < z1)).select(*CELL, *[F.col(state[n]).cast("double").alias(n) for n in DISK]))
    x, y = h.centre(0) - float(center[0]), h.centre(1) - float(center[1])
    depth = F.least(F.greatest(low, high), F.lit(z1)) - F.greatest(F.least(low, high), F.lit(z0))
    volume = h.per_level(lambda v: abs(v.dx[0] * v.dx[1])) * depth
    rows = rows.withColumns({"x": x, "y": y, "volume": volume}).withColumn("r", F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")))
    rows = rows.withColumn("rbin", ieee.edge_bin(F.col("r"), edges)).where("rbin is not null and volume > 0")
    g = gradients(mesh, [potential], targets=rows.select(*CELL)).select(*CELL, F.col(f"{potential}_gx").alias("gx"), F.col(f"{potential}_gy").alias("gy"))
    rows = rows.join(g, list(CELL)).where(_usable([*DISK, "gx", "gy"]))
    inverse = F.when(F.col("r") > 0, 1.0 / F.when(F.col("r") > 0, F.col("r"))).otherwise(F.lit(0.0))
    mass = F.col("density") * F.col("volume")
    vr = (F.col("x") * F.col("momentum_x") + F.col("y") * F.col("momentum_y")) * inverse / F.col("density")
    gr = (F.col("x") * F.col("gx") + F.col("y") * F.col("gy")) * inverse
    b2 = F.col("bx") * F.col("bx") + F.col("by") * F.col("by") + F.col("bz") * F.col("bz")
    values = [mass, F.col("internal_energy") * F.col("volume"), b2 * F.col("volume"), mass * vr, mass * vr * vr, mass * gr, F.col("volume")]
    sums = rows.groupBy("rbin").agg(*[F.sum(v).alias(n) for n, v in zip(MOMENTS, values, strict=True)])
    grid = rows.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("rbin"))
    return grid.join(sums, "rbin", "left").select("rbin", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in MOMENTS])


def _derivative(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Second-order differences over each run of finite values; NaN elsewhere."""
    out, ok = np.full(len(y), np.nan), np.isfinite(y) & np.isfinite(x)
    start = 0
    for i in range(len(y) + 1):
        if i == len(y) or not ok[i]:
            if i - start >= 2:
                out[start:i] = np.gradient(y[start:i], x[start:i], edge_order=2 if i - start > 2 else 1)
            start = i + 1
    return out


def disk_stability(moments: dict[str, Sequence[float]], edges: Sequence[float], gamma: float = 5 / 3, gravity: float = 6.674e-8) -> dict[str, np.ndarray]:
    """Surface density, speeds, epicyclic frequency and Q: thermal, with turbulence, and with turbulence and magnetic field.

    As many rows as annuli, hence on the driver. Negative dispersions within rounding count as 0; empty annuli give NaN.
    """
    edges = np.asarray(edges, float)
    m = {n: np.asarray(moments[n], float) for n in MOMENTS}
    r, area = (edges[1:] + edges[:-1]) / 2, np.pi * (edges[1:] ** 2 - edges[:-1] ** 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        density = m["mass"] / area
        sound2 = gamma * (gamma - 1) * m["internal_energy"] / m["mass"]
        alfven2 = m["magnetic_square"] / m["mass"]
        mean = m["radial_momentum"] / m["mass"]
        square = m["radial_momentum_square"] / m["mass"]
        spread2 = square - mean**2
        spread2 = np.where((spread2 < 0) & (spread2 > -1e-10 * np.maximum(square, 1.0)), 0.0, spread2)
        omega = np.sqrt(m["radial_force"] / m["mass"] / r)
        kappa2 = r * _derivative(omega**2, r) + 4 * omega**2
        kappa = np.sqrt(kappa2)
        base = kappa / (np.pi * gravity * density)
        return {"radius": r, "surface_density": density, "sound_speed": np.sqrt(sound2), "alfven_speed": np.sqrt(alfven2), "dispersion": np.sqrt(spread2), "omega": omega, "kappa": kappa, "q_thermal": base * np.sqrt(sound2), "q_turbulent": base * np.sqrt(sound2 + spread2), "q_total": base * np.sqrt(sound2 + spread2 + alfven2)}
