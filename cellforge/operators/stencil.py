"""Composite-stencil gradients and vorticity, as joins on cell indices."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellforge.operators.mesh import Mesh

_CELL = ["level", "i", "j", "k"]


def gradients(mesh: Mesh, names: Sequence[str], radius: int = 1, level: int | None = None, periodic: str = "compat", targets: DataFrame | None = None) -> DataFrame:
    """(level, i, j, k, <name>_gx, _gy, _gz for each name): weighted least squares over the cells around each cell.

    Around a cell lie (2r+1)^3 - 1 points at its own spacing. Each takes the value and centre of the finest cell that holds it;
    a cell counts once. Weights are inverse squared distances; with under three samples or a singular system the gradient
    is 0. One join serves all names: every point asks for its cell on every level, and the finest answer is kept.
    periodic: "compat" leaves wrapped centres where they are, "unwrapped" moves them next to the cell.
    """
    h, c = mesh.hierarchy, mesh.cells
    values = F.array(*[F.col(n).cast("double") for n in names])

    def centre(a: int, prefix: str = "") -> Column:
        return h.edge(a, f"{prefix}{'ijk'[a]}", f"{prefix}level") + h.per_level(lambda x: x.dx[a], f"{prefix}level") / 2

    target = c if level is None else c.where(F.col("level") == level)
    target = target if targets is None else target.join(targets, _CELL, "left_semi")
    target = target.select(*_CELL, values.alias("f"))
    offsets = [o for o in product(range(-radius, radius + 1), repeat=3) if any(o)]
    point = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias("xyz"[a]) for a, v in enumerate(o)], F.lit(n).alias("n")) for n, o in enumerate(offsets)]))
    points = target.withColumns({f"c{a}": centre(a) for a in range(3)} | {f"w{a}": h.per_level(lambda x, a=a: x.dx[a]) for a in range(3)}).withColumn("o", point)
    lo, hi = h.domain()
    base, asks = h.levels[0], []
    for x in h.levels:
        place = []
        for a in range(3):
            p = F.col(f"c{a}") + F.col(f"o.{'xyz'[a]}") * F.col(f"w{a}")
            if base.periodic[a]:
                width = hi[a] - lo[a]
                p = F.lit(lo[a]) + F.pmod(p - lo[a], F.lit(width))
            place.append((F.floor((p - x.x0[a]) / x.dx[a]) + x.origin[a]).cast("int").alias(f"s_{'ijk'[a]}"))
        asks.append(F.struct(F.lit(x.level).alias("s_level"), *place))
    # asked rows carry keys and the cell's own values; centres follow from the keys
    asked = points.select(*_CELL, "f", F.col("o.n").alias("n"), F.explode(F.array(*asks)).alias("s")).select(*_CELL, "f", "n", "s.*")
    source = c.select(*[F.col(n).alias(f"s_{n}") for n in _CELL], values.alias("s_f"))
    got = asked.join(source, [f"s_{n}" for n in _CELL])
    # from here on everything is by target cell: one exchange serves the three aggregations
    got = got.repartition(*_CELL)
    best = got.groupBy(*_CELL, "n").agg(F.first("f").alias("f"), F.max(F.struct("s_level", "s_i", "s_j", "s_k", "s_f")).alias("s"))
    once = best.groupBy(*_CELL, "s.s_level", "s.s_i", "s.s_j", "s.s_k").agg(F.first("f").alias("f"), F.first("s.s_f").alias("s_f"))
    d = []
    for a in range(3):
        e = centre(a, "s_") - centre(a)
        if periodic == "unwrapped" and base.periodic[a]:
            width = hi[a] - lo[a]
            e = e - F.lit(width) * F.round(e / width)
        d.append(e)
    rows = once.select(*_CELL, "f", "s_f", *[e.alias(f"d{a}") for a, e in enumerate(d)])
    w = F.col("d0") * F.col("d0") + F.col("d1") * F.col("d1") + F.col("d2") * F.col("d2")
    rows = rows.withColumn("q", w).where(F.col("q") > 0)
    sums = [F.count("*").alias("m")]
    for a in range(3):
        sums += [F.sum(F.col(f"d{a}") * F.col(f"d{b}") / F.col("q")).alias(f"a{a}{b}") for b in range(a, 3)]
        sums += [F.sum(F.col(f"d{a}") * (F.col("s_f")[n] - F.col("f")[n]) / F.col("q")).alias(f"b{a}_{n}") for n in range(len(names))]
    fit = rows.groupBy(*_CELL).agg(*sums)
    out = target.select(*_CELL).join(fit, _CELL, "left")
    return out.select(*_CELL, *[g.alias(f"{name}_g{'xyz'[a]}") for n, name in enumerate(names) for a, g in enumerate(_solve(n))])


def _solve(n: int) -> list[Column]:
    """Cramer's rule for the symmetric normal equations of value n."""
    a = {(p, q): F.col(f"a{min(p, q)}{max(p, q)}") for p in range(3) for q in range(3)}
    b = [F.col(f"b{p}_{n}") for p in range(3)]

    def det(m: list[list[Column]]) -> Column:
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    whole = [[a[p, q] for q in range(3)] for p in range(3)]
    total = det(whole)
    solvable = (F.col("m") >= 3) & (F.abs(total) > 1e-30)
    return [F.when(solvable, det([[b[p] if q == col else whole[p][q] for q in range(3)] for p in range(3)]) / F.when(solvable, total)).otherwise(F.lit(0.0)) for col in range(3)]


def gradient_magnitude(mesh: Mesh, name: str, level: int | None = None, **options) -> DataFrame:
    g = gradients(mesh, [name], level=level, **options)
    return g.select(*_CELL, F.sqrt(sum(F.col(f"{name}_g{x}") * F.col(f"{name}_g{x}") for x in "xyz")).alias("value"))


def vorticity(mesh: Mesh, u: str, v: str, w: str, level: int, **options) -> DataFrame:
    """(level, i, j, k, value): the curl's magnitude on one level, the three gradients from one join."""
    g = gradients(mesh, [u, v, w], level=level, **options)
    x = F.col(f"{w}_gy") - F.col(f"{v}_gz")
    y = F.col(f"{u}_gz") - F.col(f"{w}_gx")
    z = F.col(f"{v}_gx") - F.col(f"{u}_gy")
    return g.select(*_CELL, F.sqrt(x * x + y * y + z * z).alias("value"))
