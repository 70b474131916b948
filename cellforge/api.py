"""Lazy arrays over meshes and particles: each operation builds a plan, compute() runs it."""

from __future__ import annotations

import contextlib
import contextvars
import math
import threading
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from numbers import Real

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.functions.expr import parse
from cellforge.operators import flux, mesh, particles, stencil
from cellforge.operators.mesh import CELL, Mesh
from cellforge.plans import geometry
from cellforge.session import ship
from cellforge.sources import catalog

_CONFIG: contextvars.ContextVar[dict] = contextvars.ContextVar("cellforge", default={"reduction.fan_in": None})  # noqa: B039


class config:  # noqa: N801
    """Settings of the current context. reduction.fan_in is a hint only: Spark plans its own partial aggregation."""

    @staticmethod
    def get(name: str):
        return _CONFIG.get()[name]

    @staticmethod
    @contextlib.contextmanager
    def set(settings: dict):
        unknown = set(settings) - set(_CONFIG.get())
        if unknown:
            raise KeyError(f"unknown settings: {', '.join(sorted(unknown))}")
        fan_in = settings.get("reduction.fan_in")
        if fan_in is not None and (not isinstance(fan_in, int) or fan_in < 2):
            raise ValueError("reduction.fan_in must be a whole number of 2 or more")
        token = _CONFIG.set(_CONFIG.get() | settings)
        try:
            yield
        finally:
            _CONFIG.reset(token)


class Client:
    """A SparkSession and the datasets opened with it."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = ship(spark or SparkSession.builder.getOrCreate())

    def open_dataset(self, uri: str, step: int = 0, level: int = 0, periodic: tuple[bool, bool, bool] | None = None) -> Dataset:
        return open_dataset(self.spark, uri, step, level, periodic)


_DEFAULT: list[Client] = []


def set_default_client(client: Client | None) -> None:
    _DEFAULT[:] = [client] if client else []


def get_default_client() -> Client:
    if not _DEFAULT:
        _DEFAULT.append(Client())
    return _DEFAULT[0]


def _number(value, finite: bool = True) -> float:
    if isinstance(value, bool) or not isinstance(value, Real):
        raise TypeError(f"a number is needed, not {type(value).__name__}")
    if finite and not math.isfinite(value):
        raise ValueError("a finite number is needed")
    return float(value)


class Lazy:
    """A value that a plan describes. Its truth and number aren't known before compute()."""

    def frame(self) -> DataFrame:
        raise NotImplementedError

    def _result(self, rows: list):
        raise NotImplementedError

    def compute(self, **options):
        return compute(self, **options)

    def persist(self):
        self._kept = self.frame().persist()
        self._kept.count()
        return self

    @property
    def is_materialized(self) -> bool:
        return getattr(self, "_kept", None) is not None

    def _plan(self) -> DataFrame:
        return self._kept if self.is_materialized else self.frame()

    def explain(self, mode: str = "formatted") -> None:
        self._plan().explain(mode)

    def visualize(self) -> str:
        """The logical plan as a graph in the DOT language."""
        lines = self._plan()._jdf.queryExecution().optimizedPlan().toString().splitlines()
        out, stack = ["digraph plan {"], []
        for n, line in enumerate(lines):
            depth = len(line) - len(line.lstrip(" :+-"))
            label = line.lstrip(" :+-").replace("\\", " ").replace('"', "'")[:80]
            out.append(f'  n{n} [label="{label}"];')
            stack = [s for s in stack if s[0] < depth]
            if stack:
                out.append(f"  n{n} -> n{stack[-1][1]};")
            stack.append((depth, n))
        return "\n".join([*out, "}"])

    def _refuse(self, *_):
        raise TypeError("the value isn't computed yet; call compute()")

    __bool__ = __float__ = __int__ = _refuse


@dataclass(frozen=True)
class RegularDomain:
    axis: int
    selection: tuple
    rect: tuple[float, float, float, float]
    resolution: tuple[int, int]

    @property
    def shape(self) -> tuple[int, int]:
        return self.resolution[::-1]


class Scalar(Lazy):
    """One number of some rows. source: those rows and the aggregate, so that numbers of the same rows are taken in one pass."""

    def __init__(self, frame: Callable[[], DataFrame], finish: Callable = lambda r: r[0], source: tuple | None = None):
        self._frame, self._finish, self.source = frame, finish, source

    def frame(self) -> DataFrame:
        return self._frame()

    def _result(self, rows):
        return self._finish(rows[0])


class Table(Lazy):
    """A bounded result: bins, surfaces or modes, as a dictionary of arrays."""

    def __init__(self, frame: Callable[[], DataFrame], order: Sequence[str], shape: Callable[[dict], dict] = lambda x: x, source: tuple | None = None):
        self._frame, self._order, self._shape, self.source = frame, list(order), shape, source

    def frame(self) -> DataFrame:
        return self._frame()

    def _result(self, rows):
        names = self._frame_columns(rows)
        rows = sorted(rows, key=lambda r: tuple(r[c] for c in self._order))
        return self._shape({n: np.array([r[n] for r in rows]) for n in names})

    def _frame_columns(self, rows):
        return list(rows[0].asDict()) if rows else self._order


class Dataset:
    """One step of a mesh and its particle species."""

    def __init__(self, spark: SparkSession, source: Mesh, step: int = 0, level: int = 0, species: dict[str, DataFrame] | None = None, opener=None):
        self.spark, self.mesh, self.step, self.level, self.opener = spark, source, step, level, opener
        self.species = species or {}
        self.derived: dict[str, Callable] = {}
        self._cache: dict[str, Array] = {}

    @property
    def fields(self) -> tuple[str, ...]:
        return tuple(self.mesh.fields)

    def resolve_field(self, name: str | None = None) -> str:
        if name is None:
            return self.fields[0]
        if name not in self.fields:
            raise KeyError(catalog.close_matches(name, self.fields))
        return name

    def __getitem__(self, name: str) -> Array:
        return self.derived_field(name) if name in self.derived else Array(self, F.col(self.resolve_field(name)).cast("double"), name)

    def select(self, step: int | None = None, level: int | None = None) -> Dataset:
        step, level = self.step if step is None else step, self.level if level is None else level
        if all(x.level != level for x in self.mesh.hierarchy.levels):
            raise ValueError(f"there is no level {level}")
        source, species = self.mesh, self.species
        if step != self.step:
            if self.opener is None:
                raise ValueError(f"this dataset has step {self.step} only")
            source, species = self.opener(step)
        out = Dataset(self.spark, source, step, level, species, self.opener)
        out.derived = dict(self.derived)
        return out

    def plane(self, axis, coord=None, zoom: float = 1.0, resolution=(512, 512)) -> dict:
        return geometry.plane(self.mesh.hierarchy, axis, coord, zoom, resolution)

    def register_derived_field(self, name: str, build: Callable[[Dataset], Array], overwrite: bool = False) -> None:
        if (name in self.derived or name in self.fields) and not overwrite:
            raise ValueError(f"field {name!r} is there already")
        self.derived[name] = build
        self._cache.pop(name, None)

    def derived_field(self, name: str, recache: bool = False) -> Array:
        if name not in self.derived:
            raise KeyError(catalog.close_matches(name, self.derived))
        if recache or name not in self._cache:
            self._cache[name] = self.derived[name](self).rename(name)
        return self._cache[name]

    def field_expr(self, text: str, variables: dict[str, str | Array], dtype: str = "float64") -> Array:
        if not 1 <= len(variables) <= 8:
            raise ValueError("an expression takes one to eight variables")
        own = {n: self[v] if isinstance(v, str) else v for n, v in variables.items()}
        for v in own.values():
            next(iter(own.values()))._same(v)
        return Array(self, parse(text, {n: v.column for n, v in own.items()}), "expression", next(iter(own.values())).domain, next(iter(own.values())).base).astype(dtype)

    def map_blocks(self, function: Callable[[int, int, dict[str, np.ndarray]], object], schema, fields: Sequence[str]) -> DataFrame:
        """function(level, block, {field: array in (i, j, k) order}) of each block, a pandas frame of `schema`, a block a call."""
        names = [self.resolve_field(f) for f in fields]
        bounds = {(b.level, b.block): (b.lo, b.hi) for b in self.mesh.hierarchy.blocks}

        def run(rows):
            level, block = int(rows["level"].iloc[0]), int(rows["block"].iloc[0])
            lo, hi = bounds[level, block]
            at = tuple(rows[n].to_numpy() - a for n, a in zip("ijk", lo, strict=True))
            data = {n: np.full([h - a + 1 for a, h in zip(lo, hi, strict=True)], np.nan) for n in names}
            for n, out in data.items():
                out[at] = rows[n].to_numpy()
            return function(level, block, data)

        return self.mesh.only(*names).select(*CELL, "block", *names).groupBy("level", "block").applyInPandas(run, schema)

    def particle_species(self, name: str) -> ParticleSpecies:
        if name not in self.species:
            raise KeyError(catalog.close_matches(name, self.species))
        return ParticleSpecies(self, name)

    def preload(self, fields: Sequence[str]) -> Dataset:
        names = [self.resolve_field(f) for f in fields]
        kept = self.mesh.only(*names).select(*CELL, "block", *names).persist()
        kept.count()
        out = Dataset(self.spark, Mesh(kept, self.mesh.hierarchy, tuple(names)), self.step, self.level, self.species, self.opener)
        out.derived = dict(self.derived)
        return out


def open_dataset(spark: SparkSession, uri: str, step: int = 0, level: int = 0, periodic: tuple[bool, bool, bool] | None = None) -> Dataset:
    """A stored dataset. periodic: which axes are, for formats that don't tell."""
    kind, path = catalog.kind_of(uri)
    if kind == "memory":
        raise ValueError("datasets in memory are built with memory_dataset()")

    def opener(s: int):
        source, species = catalog.OPENERS[kind](ship(spark), path, s, periodic), {}
        if kind == "amrex":
            species = {n: catalog.particles_from_plotfile(spark, path, n, s) for n in catalog.plotfile.PlotfileReader(path).particle_species()}
        return source, species

    source, species = opener(step)
    return Dataset(spark, source, step, level, species, opener).select(step, level)


def memory_dataset(spark: SparkSession, hierarchy: geometry.Hierarchy, store: catalog.MemoryStore, level: int = 0, species: dict[str, DataFrame] | None = None) -> Dataset:
    return Dataset(ship(spark), catalog.mesh_from_store(spark, hierarchy, store), 0, level, species)


@dataclass(eq=False)
class Array(Lazy):
    """A cell field over the hierarchy, or, with a domain, a bounded image."""

    dataset: Dataset
    column: Column
    name: str
    domain: RegularDomain | None = None
    base: DataFrame | None = None
    dtype: str = "float64"

    __hash__ = object.__hash__

    # -- guards
    def _same(self, other: Array) -> None:
        if other.dataset is not self.dataset:
            raise ValueError("the arrays are of different datasets")
        if other.domain != self.domain or other.base is not self.base:
            raise ValueError("the arrays are on different domains")

    def _amr(self, what: str) -> None:
        if self.domain is not None:
            raise ValueError(f"{what} needs a field over the hierarchy, not an image")

    def _operand(self, other) -> tuple[Column, str]:
        if isinstance(other, Array):
            self._same(other)
            wide = self.dtype == other.dtype == "float32"
            return other.column, "float32" if wide else "float64"
        return F.lit(_number(other)), self.dtype

    def _make(self, column: Column, name: str, dtype: str | None = None) -> Array:
        dtype = dtype or self.dtype
        return Array(self.dataset, column.cast("float").cast("double") if dtype == "float32" else column, name, self.domain, self.base, dtype)

    def _binary(self, other, build, symbol: str, swap: bool = False) -> Array:
        try:
            b, dtype = self._operand(other)
        except TypeError:
            return NotImplemented
        a, b = (b, self.column) if swap else (self.column, b)
        return self._make(build(a, b), f"({self.name} {symbol})", dtype)

    def __add__(self, o):
        return self._binary(o, lambda a, b: a + b, "+")

    def __radd__(self, o):
        return self._binary(o, lambda a, b: a + b, "+", True)

    def __sub__(self, o):
        return self._binary(o, lambda a, b: a - b, "-")

    def __rsub__(self, o):
        return self._binary(o, lambda a, b: a - b, "-", True)

    def __mul__(self, o):
        return self._binary(o, lambda a, b: a * b, "*")

    def __rmul__(self, o):
        return self._binary(o, lambda a, b: a * b, "*", True)

    def __truediv__(self, o):
        return self._binary(o, ieee.div, "/")

    def __rtruediv__(self, o):
        return self._binary(o, ieee.div, "/", True)

    def __pow__(self, o):
        return self._binary(o, F.pow, "**")

    def __neg__(self):
        return self._make(self.column * F.lit(-1.0), f"-{self.name}")

    def _compare(self, other, how: str) -> MeshMask:
        b, _ = self._operand(other)
        return MeshMask(self.dataset, ieee.COMPARE[how](self.column, b), self.domain, self.base)

    def __lt__(self, o):
        return self._compare(o, "lt")

    def __le__(self, o):
        return self._compare(o, "le")

    def __gt__(self, o):
        return self._compare(o, "gt")

    def __ge__(self, o):
        return self._compare(o, "ge")

    def __eq__(self, o):
        return self._compare(o, "eq")

    def __ne__(self, o):
        return self._compare(o, "ne")

    def rename(self, name: str) -> Array:
        return Array(self.dataset, self.column, name, self.domain, self.base, self.dtype)

    def astype(self, dtype) -> Array:
        dtype = np.dtype(dtype).name
        if dtype not in ("float32", "float64"):
            raise TypeError("a field is float32 or float64")
        return self._make(self.column, self.name, dtype)

    # -- materialization
    @property
    def shape(self) -> tuple[int, int]:
        if self.domain is None:
            raise ValueError("a field over the hierarchy has no shape")
        return self.domain.shape

    def frame(self) -> DataFrame:
        if self.domain is not None:
            return self.base.select("py", "px", self.column.alias("value"))
        return self._mesh().cells.select("level", "block", "i", "j", "k", F.col("_value").alias("value"))

    def _result(self, rows):
        if self.domain is not None:
            out = np.full(self.shape, np.nan)
            for r in rows:
                out[r.py, r.px] = r.value
            return out.astype(self.dtype)
        raise ValueError("a field over the hierarchy isn't gathered; use iter_chunks()")

    def iter_chunks(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(level, block, array in (i, j, k) order), a block at a time, coarse to fine."""
        self._amr("iter_chunks")
        for b in self.dataset.mesh.hierarchy.blocks:
            rows = self._plan().where((F.col("level") == b.level) & (F.col("block") == b.block)).select("i", "j", "k", "value")
            out = np.full([h - a + 1 for a, h in zip(b.lo, b.hi, strict=True)], np.nan)
            for r in rows.toLocalIterator():
                out[r.i - b.lo[0], r.j - b.lo[1], r.k - b.lo[2]] = r.value
            yield b.level, b.block, out.astype(self.dtype)

    def _mesh(self, **others: Array) -> Mesh:
        for a in others.values():
            a._amr("this operator")
            self._same(a)
        return self.dataset.mesh.with_fields({"_value": self.column} | {name: a.column for name, a in others.items()})

    def _image(self, frame: DataFrame, view: dict, selection: tuple) -> Array:
        return Array(self.dataset, F.col("value"), self.name, RegularDomain(view["axis"], selection, tuple(view["rect"]), view["resolution"]), frame)

    # -- operators
    def slice(self, axis, coord=None, resolution=(512, 512), zoom: float = 1.0, rect=None, method: str = "overlap") -> Array:
        self._amr("slice")
        view = self.dataset.plane(axis, coord, zoom, resolution)
        view["rect"] = view["rect"] if rect is None else tuple(map(float, rect))
        build = {"overlap": mesh.slice_plane, "nearest": mesh.slice_nearest}[method]
        return self._image(build(self._mesh(), "_value", view["axis"], view["coord"], view["rect"], view["resolution"]), view, (view["coord"],))

    def project(self, axis, bounds=None, resolution=(512, 512), zoom: float = 1.0, rect=None, amr_cell_average: bool = True) -> Array:
        self._amr("project")
        if not amr_cell_average:
            raise ValueError("projections are of cell averages")
        view = self.dataset.plane(axis, None, zoom, resolution)
        view["rect"] = view["rect"] if rect is None else tuple(map(float, rect))
        bounds = view["bounds"] if bounds is None else tuple(map(float, bounds))
        return self._image(mesh.project(self._mesh(), "_value", view["axis"], bounds, view["rect"], view["resolution"]), view, bounds)

    def _rows(self, **others: Array) -> DataFrame:
        if self.domain is not None:
            rows = self.base.select("py", "px", self.column.alias("_value"), *[a.column.alias(n) for n, a in others.items()])
            for a in others.values():
                self._same(a)
            return rows
        m = self._mesh(**others)
        return m.leaves(m.cells.select(*CELL, "_value", *others))

    def histogram(self, bins: int, range: tuple[float, float], weights: Array | None = None) -> Table:  # noqa: A002
        others = {} if weights is None else {"_w": weights}
        rows = lambda: mesh.histogram(self._rows(**others), F.col("_value"), bins, range, F.col("_w") if others else None)
        mesh._bounds(range, bins)
        edges = np.array(mesh.histogram_edges(bins, *map(float, range)))
        return Table(rows, ["bin"], lambda t: {"counts": t["count"], "edges": edges}, None if self.domain is not None else (self, bins, range, weights))

    def histogram2d(self, other: Array, bins: tuple[int, int], range, weights: Array | None = None, weight_mode: str = "input") -> Table:  # noqa: A002
        others = {"_y": other} | ({} if weights is None else {"_w": weights})
        self._same(other)

        def rows():
            w = mesh.weight_of(self.dataset.mesh, F.col("_value"), weight_mode, F.col("_w") if weights is not None else None)
            return mesh.histogram2d(self._rows(**others), F.col("_value"), F.col("_y"), bins, range, w)

        return Table(rows, ["xbin", "ybin"], lambda t: {"counts": t["count"].reshape(bins), "x_edges": np.array(mesh.histogram_edges(bins[0], *range[0])), "y_edges": np.array(mesh.histogram_edges(bins[1], *range[1]))})

    def gradient(self, radius: int = 1, periodic: str = "compat") -> DataFrame:
        self._amr("gradient")
        return stencil.gradients(self._mesh(), ["_value"], radius, periodic=periodic)

    def vorticity(self, y: Array | None = None, z: Array | None = None, periodic: str = "compat") -> DataFrame:
        """On the dataset's level: the curl's magnitude of three fields, or of one its gradient's."""
        self._amr("vorticity")
        level = self.dataset.level
        if y is None and z is None:
            return stencil.gradient_magnitude(self._mesh(), "_value", level, periodic=periodic)
        if y is None or z is None:
            raise ValueError("vorticity takes one field or three")
        return stencil.vorticity(self._mesh(_y=y, _z=z), "_value", "_y", "_z", level, periodic=periodic)

    def _state(self, momentum, energy, scalar, magnetic, temperature) -> tuple[Mesh, dict]:
        zero = self._make(F.lit(0.0), "0")
        own = dict(zip(flux.STATE[1:], (*momentum, energy, scalar if scalar is not None else zero, *(magnetic or (zero,) * 3)), strict=True))
        if temperature is not None:
            own["temperature"] = temperature
        names = {n: f"_{n}" for n in own}
        return self._mesh(**{names[n]: a for n, a in own.items()}), {"density": "_value"} | names

    def flux_surface_integral(self, momentum, energy, passive_scalar=None, magnetic_field=None, radius=None, temperature=None, temperature_bins=None, gamma: float = 5 / 3) -> Table:
        self._amr("flux_surface_integral")
        m, state = self._state(momentum, energy, passive_scalar, magnetic_field, temperature)
        frame = flux.flux_sphere(m, state, radius, gamma, temperature_bins)
        return Table(lambda: frame, ["radius_index", "sign", "tbin"])

    def cylindrical_flux_surface_integral(self, momentum, energy, radius, height, passive_scalar=None, magnetic_field=None, temperature=None, temperature_bins=None, gamma: float = 5 / 3) -> Table:
        self._amr("cylindrical_flux_surface_integral")
        m, state = self._state(momentum, energy, passive_scalar, magnetic_field, temperature)
        frame = flux.flux_cylinder(m, state, radius, height, gamma, temperature_bins)
        return Table(lambda: frame, ["height_index", "sign", "tbin", "section"])

    def toomre_q_profile(self, momentum, internal_energy, magnetic_field, potential, z_bounds, radial_range=None, bins=None, radial_edges=None, center=(0.0, 0.0, 0.0), gamma: float = 5 / 3, gravity: float = 6.674e-8) -> Table:
        """Annular moments, and the surface density, speeds and Q made of them."""
        self._amr("toomre_q_profile")
        if (radial_edges is None) == (radial_range is None or bins is None):
            raise ValueError("give radial edges, or a radial range and bins")
        edges = list(radial_edges) if radial_edges is not None else mesh.histogram_edges(bins, *map(float, radial_range))
        own = dict(zip(flux.DISK[1:], (*momentum[:2], internal_energy, *magnetic_field), strict=True)) | {"potential": potential}
        m = self._mesh(**{f"_{n}": a for n, a in own.items()})
        state = {"density": "_value"} | {n: f"_{n}" for n in flux.DISK[1:]}
        frame = flux.disk_moments(m, state, "_potential", z_bounds, edges, center)
        return Table(lambda: frame, ["rbin"], lambda t: t | flux.disk_stability(t, edges, gamma, gravity) | {"edges": np.array(edges), "gamma": gamma})


@dataclass(eq=False)
class MeshMask(Lazy):
    dataset: Dataset
    column: Column
    domain: RegularDomain | None
    base: DataFrame | None

    def __and__(self, other: MeshMask) -> MeshMask:
        if not isinstance(other, MeshMask):
            return NotImplemented
        if other.dataset is not self.dataset or other.domain != self.domain or other.base is not self.base:
            raise ValueError("the masks are on different domains")
        return MeshMask(self.dataset, self.column & other.column, self.domain, self.base)

    def astype(self, dtype):
        raise TypeError("masks aren't cast")

    def frame(self) -> DataFrame:
        if self.domain is not None:
            return self.base.select("py", "px", self.column.alias("value"))
        return self.dataset.mesh.with_field("_value", self.column).cells.select("level", "block", "i", "j", "k", F.col("_value").alias("value"))

    def _result(self, rows):
        if self.domain is None:
            raise ValueError("a mask over the hierarchy isn't gathered")
        out = np.zeros(self.domain.shape, bool)
        for r in rows:
            out[r.py, r.px] = r.value
        return out


class ParticleSpecies:
    def __init__(self, dataset: Dataset, name: str):
        self.dataset, self.name, self.rows = dataset, name, dataset.species[name]

    def __getitem__(self, field_name: str) -> ParticleArray:
        if field_name not in self.rows.columns:
            raise KeyError(catalog.close_matches(field_name, self.rows.columns))
        return ParticleArray(self, self.rows, F.col(field_name).cast("double"), field_name, source=field_name)

    def project(self, axis, bounds=None, resolution=(512, 512), zoom: float = 1.0, mass_max: float | None = None) -> Array:
        view = self.dataset.plane(axis, None, zoom, resolution)
        bounds = view["bounds"] if bounds is None else bounds
        frame = particles.cic_project(self.dataset.mesh, self.rows, view["axis"], bounds, view["rect"], view["resolution"], mass_max)
        return Array(self.dataset, F.col("value"), self.name, RegularDomain(view["axis"], tuple(bounds), tuple(view["rect"]), view["resolution"]), frame)

    def cic_grid(self, axis, bounds=None, mass_max: float | None = None) -> DataFrame:
        return particles.cic_grid(self.dataset.mesh, self.rows, axis, bounds, mass_max)


@dataclass(eq=False)
class ParticleArray(Lazy):
    """A column of a species; `lineage` holds the masks that filtered it, so that only like rows meet."""

    species: ParticleSpecies
    rows: DataFrame
    column: Column
    name: str
    lineage: tuple = ()
    source: str | None = None
    dtype: str = "float64"
    limit: int | None = field(default=None, repr=False)

    __hash__ = object.__hash__

    def _same(self, other) -> None:
        if other.species.dataset is not self.species.dataset or other.species.name != self.species.name:
            raise ValueError("the arrays are of different species")
        if other.lineage != self.lineage:
            raise ValueError("the arrays are filtered differently")

    def _make(self, column: Column, name: str) -> ParticleArray:
        return ParticleArray(self.species, self.rows, column, name, self.lineage)

    def _binary(self, o, how: str, swap: bool = False) -> ParticleArray:
        if isinstance(o, ParticleArray):
            self._same(o)
            return self._make(particles.BINARY[how](self.column, o.column), f"({self.name} {how})")
        if isinstance(o, bool) or not isinstance(o, Real):
            return NotImplemented
        return self._make(particles.SCALAR[("r" if swap and how in ("subtract", "divide", "power") else "") + how](self.column, F.lit(float(o))), f"({self.name} {how})")

    def __add__(self, o):
        return self._binary(o, "add")

    __radd__ = __add__

    def __sub__(self, o):
        return self._binary(o, "subtract")

    def __rsub__(self, o):
        return self._binary(o, "subtract", True)

    def __mul__(self, o):
        return self._binary(o, "multiply")

    __rmul__ = __mul__

    def __truediv__(self, o):
        return self._binary(o, "divide")

    def __rtruediv__(self, o):
        return self._binary(o, "divide", True)

    def __pow__(self, o):
        return self._binary(o, "power")

    def __rpow__(self, o):
        return self._binary(o, "power", True)

    def __neg__(self):
        return self._make(self.column * F.lit(-1.0), f"-{self.name}")

    def _mask(self, column: Column) -> ParticleMask:
        return ParticleMask(self.species, self.rows, column, self.lineage)

    def compare(self, how: str, value) -> ParticleMask:
        return self._mask(particles.compare_scalar(self.column, how, _number(value, finite=False)))

    def __lt__(self, o):
        return self.compare("lt", o)

    def __le__(self, o):
        return self.compare("le", o)

    def __gt__(self, o):
        return self.compare("gt", o)

    def __ge__(self, o):
        return self.compare("ge", o)

    def __eq__(self, o):
        return self.compare("eq", o)

    def __ne__(self, o):
        return self.compare("ne", o)

    def abs_lt(self, value) -> ParticleMask:
        return self._mask(particles.abs_lt(self.column, _number(value, finite=False)))

    def isin(self, values) -> ParticleMask:
        return self._mask(ieee.isin(self.column, list(values)))

    def isfinite(self) -> ParticleMask:
        return self._mask(ieee.isfinite(self.column))

    def __getitem__(self, mask: ParticleMask) -> ParticleArray:
        if not isinstance(mask, ParticleMask):
            raise TypeError("only masks select particles")
        self._same(mask)
        return ParticleArray(self.species, self.rows.where(mask.column), self.column, self.name, (*self.lineage, mask.token), self.source)

    def rename(self, name: str) -> ParticleArray:
        return ParticleArray(self.species, self.rows, self.column, name, self.lineage, self.source, self.dtype)

    def astype(self, dtype) -> ParticleArray:
        dtype = np.dtype(dtype).name
        if dtype not in ("float32", "float64"):
            raise TypeError("particle values are float32 or float64")
        return ParticleArray(self.species, self.rows, self.column, self.name, self.lineage, self.source, dtype)

    def frame(self) -> DataFrame:
        return self.rows.select("chunk", "pidx", self.column.alias("value"))

    def _result(self, rows):
        return np.array([r.value for r in sorted(rows, key=lambda r: (r.chunk, r.pidx))], self.dtype)

    def iter_chunks(self) -> Iterator[tuple[int, np.ndarray]]:
        now, held = None, []
        for r in self._plan().orderBy("chunk", "pidx").toLocalIterator():
            if r.chunk != now and held:
                yield now, np.array(held, self.dtype)
                held = []
            now = r.chunk
            held.append(r.value)
        if held:
            yield now, np.array(held, self.dtype)

    def _one(self, name: str, mask: Column | None = None, **options) -> Scalar:
        return Scalar(lambda: particles.summary(self.rows, self.column, mask, **options).select(name), source=(self.rows, self.column, mask, options, [name]))

    def sum(self) -> Scalar:
        return self._one("sum")

    def count(self) -> Scalar:
        return self._one("len")

    __len__ = None

    def min(self, finite_only: bool = True) -> Scalar:
        return self._one("min", finite_only=finite_only)

    def max(self, finite_only: bool = True) -> Scalar:
        return self._one("max", finite_only=finite_only)

    def mean(self) -> Scalar:
        def finish(r):
            if not r["len"]:
                raise ZeroDivisionError("the mean of no particles")
            return r["sum"] / r["len"]

        return Scalar(lambda: particles.summary(self.rows, self.column).select("sum", "len"), finish, (self.rows, self.column, None, {}, ["sum", "len"]))

    def histogram(self, bins, range=None, weights: ParticleArray | None = None, density: bool = False) -> Table:  # noqa: A002
        if isinstance(bins, int):
            if range is None:
                raise ValueError("a number of bins needs a range")
            edges = mesh.histogram_edges(bins, *mesh._bounds(range, bins))
            edges[-1] = float(range[1])
        else:
            edges = list(map(float, bins))
        rows, w = self.rows, None
        if weights is not None:
            self._same(weights)
            w = weights.column
        return Table(lambda: particles.histogram_edges(rows, self.column, edges, w, density), ["bin"], lambda t: {"counts": t["count"], "edges": np.array(edges)})

    def topk(self, k: int) -> Table:
        if self.source is None or self.lineage:
            raise ValueError("modes are of a stored field")
        if k <= 0:
            raise ValueError("k must be positive")
        return Table(lambda: particles.topk_modes(self.rows, self.column, k), ["rank"], lambda t: {"values": t["value"], "counts": t["count"]})


@dataclass(eq=False)
class ParticleMask(Lazy):
    species: ParticleSpecies
    rows: DataFrame
    column: Column
    lineage: tuple
    token: object = field(default_factory=object)

    def __and__(self, other: ParticleMask) -> ParticleMask:
        if not isinstance(other, ParticleMask):
            return NotImplemented
        if other.species.dataset is not self.species.dataset or other.species.name != self.species.name or other.lineage != self.lineage:
            raise ValueError("the masks are of different particles")
        return ParticleMask(self.species, self.rows, self.column & other.column, self.lineage)

    def astype(self, dtype):
        raise TypeError("masks aren't cast")

    def count(self) -> Scalar:
        return Scalar(lambda: self.rows.agg(F.count_if(self.column)))

    def frame(self) -> DataFrame:
        return self.rows.select("chunk", "pidx", self.column.alias("value"))

    def _result(self, rows):
        return np.array([r.value for r in sorted(rows, key=lambda r: (r.chunk, r.pidx))], bool)


def distance3(a: Sequence[ParticleArray], b: Sequence[ParticleArray]) -> ParticleArray:
    for x in (*a[1:], *b):
        a[0]._same(x)
    return a[0]._make(particles.distance3(*[x.column for x in (*a, *b)]), "distance")


def _fused_scalars(own: list[Scalar]) -> list:
    """Numbers of the same rows, by one aggregation."""
    rows, columns = own[0].source[0], []
    for n, v in enumerate(own):
        _, column, mask, options, names = v.source
        columns += [c.alias(f"{n}_{name}") for name, c in particles.aggregates(column, mask, **options).items() if name in names]
    got = rows.agg(*columns).first()
    return [v._finish(Row(**{name: got[f"{n}_{name}"] for name in v.source[4]})) for n, v in enumerate(own)]


def _fused_histograms(own: list[Table]) -> list:
    """Histograms of fields of one hierarchy, by one pass over its uncovered cells."""
    arrays = {}
    for n, v in enumerate(own):
        array, _, _, weights = v.source
        arrays |= {f"_v{n}": array} | ({} if weights is None else {f"_w{n}": weights})
    first = own[0].source[0]
    m = first._mesh(**arrays)
    specs = [(F.col(f"_v{n}"), v.source[1], v.source[2], F.col(f"_w{n}") if v.source[3] is not None else None) for n, v in enumerate(own)]
    found = {(r.which, r.bin): r["count"] for r in mesh.histograms(m.leaves(m.cells.select(*CELL, *arrays)), specs).collect()}
    return [v._result([Row(bin=b, count=found.get((n, b), 0.0)) for b in range(v.source[1])]) for n, v in enumerate(own)]


def compute(*values: Lazy, gather: bool = False, max_bytes: int | None = None):
    """Run the values of one dataset; one value gives its result, more a tuple.

    Numbers of the same particles are taken in one pass, and so are histograms of fields of the hierarchy; what is left runs
    side by side. gather and max_bytes concern arrays: a field over the hierarchy is never gathered, and particles beyond
    max_bytes raise MemoryError before they are.
    """
    if not values:
        raise ValueError("nothing to compute")
    sets = {id(d) for v in values if (d := getattr(v, "dataset", None) or getattr(getattr(v, "species", None), "dataset", None)) is not None}
    if len(sets) > 1:
        raise ValueError("the values are of different datasets")
    for v in values:
        if gather and isinstance(v, Array | MeshMask) and v.domain is None:
            raise ValueError("a field over the hierarchy isn't gathered")
        if isinstance(v, ParticleArray | ParticleMask) and max_bytes is not None:
            size = v._plan().count() * (1 if isinstance(v, ParticleMask) else np.dtype(v.dtype).itemsize)
            if size > max_bytes:
                raise MemoryError(f"{size} bytes of particles; the limit is {max_bytes}")
    jobs: dict[tuple, list[int]] = {}
    for i, v in enumerate(values):
        source = None if v.is_materialized else getattr(v, "source", None)
        if isinstance(v, Scalar) and source:
            jobs.setdefault(("scalars", id(source[0])), []).append(i)
        elif isinstance(v, Table) and source:
            jobs.setdefault(("histograms", id(source[0].dataset)), []).append(i)
        else:
            jobs["alone", i] = [i]

    def run(kind: str, own: list[int]) -> list:
        some = [values[i] for i in own]
        if kind == "scalars":
            return _fused_scalars(some)
        if kind == "histograms" and len(some) > 1:
            return _fused_histograms(some)
        (v,) = some
        return [v._plan() if isinstance(v, Array | MeshMask) and v.domain is None else v._result(v._plan().collect())]

    out = [None] * len(values)
    with ThreadPoolExecutor(min(len(jobs), 8)) as pool:
        futures = [(own, pool.submit(inheritable_thread_target(SparkSession.getActiveSession())(run), kind, own)) for (kind, _), own in jobs.items()]
        for own, future in futures:
            for i, got in zip(own, future.result(), strict=True):
                out[i] = got
    return out[0] if len(out) == 1 else tuple(out)


class Progress:
    """Stages and tasks of the jobs that run within it: `with Progress(spark) as p: ...; p.report()`.

    Jobs are told apart by a group of their own, and their states come from Spark's status tracker. With every > 0, a line is
    printed each so many seconds.
    """

    def __init__(self, spark: SparkSession, every: float = 0.0, out: Callable[[str], None] = print):
        self.context, self.every, self.out = spark.sparkContext, every, out
        self.group = f"cellforge-{id(self)}"
        self._stop = threading.Event()

    def __enter__(self) -> Progress:
        self._before = self.context.getLocalProperty("spark.jobGroup.id")
        self.context.setJobGroup(self.group, "cellforge")
        if self.every > 0:
            threading.Thread(target=self._print, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self.context.setLocalProperty("spark.jobGroup.id", self._before)

    def _print(self) -> None:
        while not self._stop.wait(self.every):
            self.out(str(self.report()))

    def report(self) -> dict[str, int]:
        """Jobs, stages, tasks and those of the tasks that are done or failed."""
        tracker, out = self.context.statusTracker(), {"jobs": 0, "stages": 0, "tasks": 0, "done": 0, "failed": 0}
        for job in tracker.getJobIdsForGroup(self.group):
            out["jobs"] += 1
            info = tracker.getJobInfo(job)
            for stage in map(tracker.getStageInfo, info.stageIds if info else ()):
                if stage:
                    out["stages"] += 1
                    for name, n in (("tasks", stage.numTasks), ("done", stage.numCompletedTasks), ("failed", stage.numFailedTasks)):
                        out[name] += n
        return out
