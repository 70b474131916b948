"""Command line: slices, projections, reports and histograms of a dataset, written as Parquet, CSV or NumPy files."""

from __future__ import annotations

import argparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from cellforge.api import Array, open_dataset
from cellforge.operators import mesh


def save(result, path: str) -> None:
    """An image as .npy or .csv; a table as Parquet, or CSV if the name ends so."""
    if isinstance(result, Array) and path.endswith((".npy", ".csv")):
        data = result.compute()
        np.save(path, data) if path.endswith(".npy") else np.savetxt(path, data, delimiter=",")
        return
    frame = result if isinstance(result, DataFrame) else result.frame()
    frame.write.mode("overwrite").csv(path, header=True) if path.endswith(".csv") else frame.write.mode("overwrite").parquet(path)


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cellforge")
    p.add_argument("command", choices=["slice", "project", "cic", "minmax", "histogram", "mass-histogram", "flux", "cylinder", "toomre"])
    p.add_argument("dataset")
    p.add_argument("out")
    p.add_argument("--field")
    p.add_argument("--species")
    p.add_argument("--axis", default="z")
    p.add_argument("--coord", type=float)
    p.add_argument("--bounds", type=float, nargs=2)
    p.add_argument("--zoom", type=float, default=1.0)
    p.add_argument("--resolution", type=int, nargs=2, default=(512, 512))
    p.add_argument("--bins", type=int, default=64)
    p.add_argument("--periodic", help="the periodic axes, such as xy")
    p.add_argument("--density", default="density")
    p.add_argument("--momentum", nargs=3, default=("momentum_x", "momentum_y", "momentum_z"))
    p.add_argument("--energy", default="energy", help="total energy; internal energy for toomre")
    p.add_argument("--scalar")
    p.add_argument("--magnetic", nargs=3)
    p.add_argument("--potential", default="potential")
    p.add_argument("--temperature")
    p.add_argument("--temperature-bins", type=float, nargs="+")
    p.add_argument("--radius", type=float, nargs="+")
    p.add_argument("--height", type=float, nargs="+")
    p.add_argument("--center", type=float, nargs=3, default=(0.0, 0.0, 0.0))
    p.add_argument("--gamma", type=float, default=5 / 3)
    p.add_argument("--gravity", type=float, default=6.674e-8)
    a = p.parse_args(args)
    periodic = None if a.periodic is None else tuple(x in a.periodic for x in "xyz")
    ds = open_dataset(SparkSession.builder.getOrCreate(), a.dataset, periodic=periodic)
    named = lambda names: None if names is None else tuple(ds[ds.resolve_field(n)] for n in names)
    one = lambda name: None if name is None else ds[ds.resolve_field(name)]
    surface = {"passive_scalar": one(a.scalar), "magnetic_field": named(a.magnetic), "temperature": one(a.temperature), "temperature_bins": a.temperature_bins, "gamma": a.gamma}
    view = {"zoom": a.zoom, "resolution": tuple(a.resolution)}
    if a.command == "slice":
        save(ds[ds.resolve_field(a.field)].slice(a.axis, a.coord, **view), a.out)
    elif a.command == "project":
        save(ds[ds.resolve_field(a.field)].project(a.axis, a.bounds, **view), a.out)
    elif a.command == "cic":
        save(ds.particle_species(a.species).project(a.axis, a.bounds, **view), a.out)
    elif a.command == "minmax":
        save(mesh.fab_minmax(ds.mesh, ds.resolve_field(a.field)), a.out)
    elif a.command == "histogram":
        save(ds[ds.resolve_field(a.field)].histogram(a.bins, tuple(a.bounds)), a.out)
    elif a.command == "flux":
        save(one(a.density).flux_surface_integral(named(a.momentum), one(a.energy), radius=a.radius, **surface), a.out)
    elif a.command == "cylinder":
        save(one(a.density).cylindrical_flux_surface_integral(named(a.momentum), one(a.energy), a.radius[0], a.height, **surface), a.out)
    elif a.command == "toomre":
        zero = one(a.density) * 0
        table = one(a.density).toomre_q_profile(named(a.momentum), one(a.energy), named(a.magnetic) or (zero,) * 3, one(a.potential), a.bounds, radial_edges=a.radius, center=a.center, gamma=a.gamma, gravity=a.gravity).compute()
        rows = {k: v for k, v in table.items() if np.ndim(v) == 1 and len(v) == len(a.radius) - 1}
        np.savetxt(a.out, np.column_stack(list(rows.values())), delimiter=",", header=",".join(rows), comments="")
    else:
        save(ds.particle_species(a.species)["mass"].histogram(a.bins, tuple(a.bounds)), a.out)


if __name__ == "__main__":
    main()
