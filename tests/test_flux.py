import itertools
import math

import numpy as np
import pytest

from cellforge.operators import flux
from cellforge.plans.geometry import Block, Hierarchy, Level
from cellforge.sources.catalog import mesh_from_numpy

STATE = {n: n for n in flux.STATE}
GAMMA = 1.4


def polygon_area(n, lo, size, d):
    """Area of the plane n.x = d inside a box: its cuts of the twelve edges, in order about their middle."""
    n, lo, size = (np.asarray(x, float) for x in (n, lo, size))
    points = []
    for axis in range(3):
        others = [a for a in range(3) if a != axis]
        for corner in itertools.product((0, 1), repeat=2):
            p = lo.copy()
            p[others] += size[others] * corner
            rate = n[axis] * size[axis]
            if abs(rate) > 1e-14:
                t = (d - n @ p) / rate
                if -1e-12 <= t <= 1 + 1e-12:
                    q = p.copy()
                    q[axis] += t * size[axis]
                    points.append(q)
    if len(points) < 3:
        return 0.0
    points = np.array(points)
    middle = points.mean(axis=0)
    u = np.linalg.svd(np.eye(3) - np.outer(n, n))[0][:, :2]
    flat = (points - middle) @ u
    x, y = flat[np.argsort(np.arctan2(flat[:, 1], flat[:, 0]))].T
    return abs(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2


def random_mesh(spark, seed):
    """Two levels of random states about the origin, one of density zero and one not finite among them."""
    rng = np.random.default_rng(seed)
    h = Hierarchy((Level(0, (0.8, 0.9, 1.1), (-2.4, -2.7, -3.3)), Level(1, (0.4, 0.45, 0.55), (-2.4, -2.7, -3.3))), (Block(0, 0, (0,) * 3, (5,) * 3), Block(1, 0, (4, 4, 4), (9, 7, 7))))
    fields = {}
    for n in (*flux.STATE, "temperature"):
        chunks = {}
        for b in h.blocks:
            v = rng.normal(size=[q - p + 1 for p, q in zip(b.lo, b.hi, strict=True)])
            chunks[b.level, b.block] = np.abs(v) + 0.2 if n in ("density", "temperature") else v
        fields[n] = chunks
    fields["density"][0, 0][1, 1, 1] = 0.0
    fields["bx"][0, 0][2, 1, 1] = math.nan
    return mesh_from_numpy(spark, h, fields), h, fields


def leaf_cells(h, fields):
    for b in h.blocks:
        x = h.at(b.level)
        for c in itertools.product(*(range(p, q + 1) for p, q in zip(b.lo, b.hi, strict=True))):
            if any(all(lo[a] <= c[a] <= hi[a] for a in range(3)) for lo, hi in h.covered_boxes(b.level)):
                continue
            s = {n: v[b.level, b.block][tuple(c[a] - b.lo[a] for a in range(3))] for n, v in fields.items()}
            if s["density"] > 0 and all(map(math.isfinite, s.values())):
                yield np.array([x.edge(a, c[a]) for a in range(3)]), np.array(x.dx), s


def through(s, area, n):
    """The four fluxes of a state through an area across n."""
    m, b = np.array([s[f"momentum_{a}"] for a in "xyz"]), np.array([s[f"b{a}"] for a in "xyz"])
    speed, kinetic, magnetic = n @ m / s["density"], m @ m / s["density"] / 2, b @ b / 2
    pressure = (GAMMA - 1) * (s["energy"] - magnetic - kinetic)
    return np.array([s["density"] * speed, (s["energy"] - magnetic + pressure) * speed, (s["energy"] + pressure + magnetic) * speed - (m @ b / s["density"]) * (n @ b), s["scalar"] * speed]) * area


def check(frame, want, keys):
    for r in frame.collect():
        own = want.get(tuple(r[k] for k in keys), np.zeros(4))
        assert [r[c] for c in flux.COMPONENTS] == pytest.approx(own, abs=1e-9)


def reach(lo, size, axes):
    """Least and largest squared distance of a box from the origin."""
    near = sum(0 if lo[a] <= 0 <= lo[a] + size[a] else min(lo[a] ** 2, (lo[a] + size[a]) ** 2) for a in axes)
    return near, sum(max(lo[a] ** 2, (lo[a] + size[a]) ** 2) for a in axes)


def add(want, key, f):
    for c in range(4):
        want.setdefault((*key, int(f[c] >= 0)), np.zeros(4))[c] += f[c]


@pytest.mark.parametrize("seed", [1, 2])
def test_spheres_against_polygons(spark, seed):
    m, h, fields = random_mesh(spark, seed)
    radii, edges, want = [0.7, 1.9], [0.0, 0.9, 5.0], {}
    for lo, size, s in leaf_cells(h, fields):
        mid = lo + size / 2
        if not np.linalg.norm(mid):
            continue
        n = mid / np.linalg.norm(mid)
        near, far = reach(lo, size, range(3))
        for i, r in enumerate(radii):
            if not near <= r * r <= far:
                continue  # the sphere doesn't cut the cell, though its plane may
            f = through(s, polygon_area(n, lo, size, r), n)
            add(want, (i, int(s["temperature"] >= edges[1])), f)
    frame = flux.flux_sphere(m, STATE | {"temperature": "temperature"}, radii, GAMMA, edges)
    check(frame, want, ("radius_index", "tbin", "sign"))
    both = flux.flux_sphere(m, STATE, radii[0], GAMMA)
    check(both, {(0, s): want.get((0, 0, s), 0) + want.get((0, 1, s), 0) for s in (0, 1)}, ("radius_index", "sign"))


def test_cylinders_against_polygons(spark):
    m, h, fields = random_mesh(spark, 3)
    radius, heights, want = 1.3, [0.6, 1.7], {}
    for lo, size, s in leaf_cells(h, fields):
        for i, z in enumerate(heights):
            near, far = reach(lo, size, range(2))
            if near > radius**2:
                continue
            for side in (1, -1):
                if lo[2] <= side * z <= lo[2] + size[2]:
                    add(want, (i, 0), through(s, size[0] * size[1], np.array([0, 0, side])))
            mid = (lo + size / 2) * [1, 1, 0]
            low, high = max(lo[2], -z), min(lo[2] + size[2], z)
            if high > low and far >= radius**2 and np.linalg.norm(mid):
                n = mid / np.linalg.norm(mid)
                add(want, (i, 1), through(s, polygon_area(n, [*lo[:2], low], [*size[:2], high - low], radius), n))
    check(flux.flux_cylinder(m, STATE, radius, heights, GAMMA), want, ("height_index", "section", "sign"))


def test_generated_code_compiles(spark, capfd):
    """Stage code of the surface integrals is within the size that the JVM compiles."""
    m, _, _ = random_mesh(spark, 4)
    for frame in (flux.flux_sphere(m, STATE, [0.7, 1.9]), flux.flux_cylinder(m, STATE, 1.3, [0.6])):
        frame.collect()
        codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(frame._jdf.queryExecution().executedPlan())
        assert "Found 0 WholeStageCodegen" not in codes
        sizes = [int(x) for x in __import__("re").findall(r"maxMethodCodeSize:(\d+)", codes)]
        assert sizes and max(sizes) < 64 * 1024 and "failed to compile" not in capfd.readouterr().err


@pytest.mark.parametrize(("radius", "bins"), [(0, None), (-2.5, None), (math.inf, None), (90.0, None), (0.7, [0, 3]), ([], None)])
def test_rejections(spark, radius, bins):
    m, _, _ = random_mesh(spark, 5)
    with pytest.raises(ValueError):
        flux.flux_sphere(m, STATE, radius, temperature_bins=bins)


def test_disk_moments_against_cells(spark):
    """A potential a*x^2 + b*y^2 has central differences that are exact, so each cell's force is known."""
    rng = np.random.default_rng(6)
    h = Hierarchy((Level(0, (0.5, 0.5, 0.4), (-3.0, -3.0, -0.8)),), (Block(0, 0, (0,) * 3, (11, 11, 3)),))
    fields = {n: {(0, 0): rng.uniform(0.5, 2, (12, 12, 4))} for n in flux.DISK}
    x = (np.arange(12) + 0.5) * 0.5 - 3.0
    gx, gy = np.meshgrid(x, x, indexing="ij")
    fields["phi"] = {(0, 0): np.repeat((0.7 * gx**2 + 0.3 * gy**2)[:, :, None], 4, axis=2)}
    edges, z, cx = [0.4, 1.1, 1.9], (-0.5, 0.3), 0.2
    want = np.zeros((2, 7))
    for i, j, k in itertools.product(range(12), range(12), range(4)):
        lo = -0.8 + 0.4 * k
        depth = min(lo + 0.4, z[1]) - max(lo, z[0])
        px, py = x[i] - cx, x[j]
        r = math.hypot(px, py)
        bin_ = int(np.searchsorted(edges, r, "right")) - 1
        if depth <= 0 or not 0 <= bin_ < 2:
            continue
        s = {n: fields[n][0, 0][i, j, k] for n in flux.DISK}
        v, vr = 0.25 * depth, (px * s["momentum_x"] + py * s["momentum_y"]) / r / s["density"]
        force = (px * 1.4 * x[i] + py * 0.6 * x[j]) / r
        mass = s["density"] * v
        want[bin_] += [mass, s["internal_energy"] * v, (s["bx"] ** 2 + s["by"] ** 2 + s["bz"] ** 2) * v, mass * vr, mass * vr**2, mass * force, v]
    rows = flux.disk_moments(mesh_from_numpy(spark, h, fields), {n: n for n in flux.DISK}, "phi", z, edges, (cx, 0.0, 0.0)).orderBy("rbin").collect()
    assert [[r[c] for c in flux.MOMENTS] for r in rows] == [pytest.approx(w) for w in want]


def test_stability_follows_its_definition():
    """A flat rotation curve of speed v: omega = v / r and kappa = sqrt(2) omega."""
    edges = np.linspace(2.0, 9.0, 141)
    r, area = (edges[1:] + edges[:-1]) / 2, np.pi * np.diff(edges**2)
    v, surface = 3.0, 7.0 / (1 + edges[1:])
    mass, gamma, gravity = surface * area, 1.5, 0.25
    sound, spread, alfven = 0.8, 0.5, 0.3
    moments = {"mass": mass, "internal_energy": mass * sound**2 / (gamma * (gamma - 1)), "magnetic_square": mass * alfven**2, "radial_momentum": 0.2 * mass, "radial_momentum_square": mass * (spread**2 + 0.04), "radial_force": mass * v**2 / r, "volume": area}
    q = flux.disk_stability(moments, edges, gamma, gravity)
    assert q["surface_density"] == pytest.approx(surface) and q["omega"] == pytest.approx(v / r)
    assert q["kappa"][2:-2] == pytest.approx(math.sqrt(2) * (v / r)[2:-2], rel=2e-3)
    for name, square in (("q_thermal", sound**2), ("q_turbulent", sound**2 + spread**2), ("q_total", sound**2 + spread**2 + alfven**2)):
        assert q[name] == pytest.approx(q["kappa"] * math.sqrt(square) / (math.pi * gravity * surface))
