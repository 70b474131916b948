"""AMReX plotfiles: a parser, a direct reader, and a Spark data source with one partition a FAB or particle grid."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from cellforge.plans.geometry import Block, Hierarchy, Level

_INTS = re.compile(r"-?\d+")
_BOX = re.compile(r"\(\(([-\d,\s]+)\)\s*\(([-\d,\s]+)\)\s*\(([-\d,\s]+)\)\)")


def _ints(text: str) -> tuple[int, ...]:
    return tuple(map(int, _INTS.findall(text)))


@dataclass(frozen=True)
class Fab:
    level: int
    block: int
    lo: tuple[int, ...]
    hi: tuple[int, ...]
    path: str
    offset: int


@dataclass(frozen=True)
class Header:
    names: tuple[str, ...]
    time: float
    prob_lo: tuple[float, ...]
    prob_hi: tuple[float, ...]
    ratios: tuple[int, ...]
    domains: tuple[tuple[tuple[int, ...], tuple[int, ...]], ...]
    dx: tuple[tuple[float, ...], ...]
    steps: tuple[int, ...]
    prefixes: tuple[str, ...]

    @property
    def num_levels(self) -> int:
        return len(self.dx)


def read_header(path: str) -> Header:
    with open(os.path.join(path, "Header")) as f:
        lines = iter(f.read().splitlines())
    next(lines)  # version
    names = tuple(next(lines).strip() for _ in range(int(next(lines))))
    dim = int(next(lines))
    if dim != 3:
        raise ValueError(f"only three-dimensional plotfiles are read, not {dim}")
    time, finest = float(next(lines)), int(next(lines))
    lo, hi = (tuple(map(float, next(lines).split())) for _ in range(2))
    ratios = _ints(next(lines))
    domains = tuple((_ints(a), _ints(b)) for a, b, _ in _BOX.findall(next(lines)))
    steps = _ints(next(lines))
    dx = tuple(tuple(map(float, next(lines).split())) for _ in range(finest + 1))
    next(lines), next(lines)  # coordinate system, boundary width
    prefixes = []
    for _ in range(finest + 1):
        grids = int(next(lines).split()[1])
        next(lines)
        for _ in range(3 * grids):
            next(lines)
        prefixes.append(next(lines).strip())
    return Header(names, time, lo, hi, ratios, domains, dx, steps, tuple(prefixes))


def read_fabs(path: str, header: Header) -> list[Fab]:
    """Boxes, files and offsets of all levels; every file must be there."""
    out = []
    for level, prefix in enumerate(header.prefixes):
        base = os.path.join(path, os.path.dirname(prefix))
        with open(os.path.join(path, prefix + "_H")) as f:
            text = f.read()
        if text.split(None, 1)[0] != "1":
            raise ValueError(f"only version 1 of {prefix}_H is read")
        boxes = [(_ints(a), _ints(b)) for a, b, _ in _BOX.findall(text)]
        places = re.findall(r"FabOnDisk:\s+(\S+)\s+(\d+)", text)
        if len(boxes) != len(places):
            raise ValueError(f"{prefix}_H has {len(boxes)} boxes and {len(places)} files")
        for n, ((lo, hi), (name, offset)) in enumerate(zip(boxes, places, strict=True)):
            file = os.path.join(base, name)
            if not os.path.isfile(file):
                raise FileNotFoundError(file)
            out.append(Fab(level, n, lo, hi, file, int(offset)))
    return out


_REAL = re.compile(rb"FAB \(\((\d+), \(([\d ]+)\)\),\((\d+), \(([\d ]+)\)\)\)")


def read_fab(fab: Fab, components: list[int] | None = None) -> np.ndarray:
    """(components, nz, ny, nx) of a FAB, only the bytes of the asked components read."""
    with open(fab.path, "rb") as f:
        f.seek(fab.offset)
        line = f.readline(4096)
        if line.startswith(b"FAB:"):
            raise ValueError("the old FAB format isn't read")
        m, box = _REAL.match(line), _BOX.search(line.decode("ascii", "replace"))
        if not m or not box:
            raise ValueError(f"no FAB header at {fab.path}:{fab.offset}")
        order = tuple(map(int, m[4].split()))
        ascending = tuple(range(1, len(order) + 1))
        if order not in (ascending, ascending[::-1]) or len(order) not in (4, 8):
            raise ValueError(f"byte order {order} isn't read")
        kind = np.dtype(("<" if order == ascending[::-1] else ">") + f"f{len(order)}")
        lo, hi = _ints(box[1]), _ints(box[2])
        shape = tuple(b - a + 1 for a, b in zip(lo, hi, strict=True))[::-1]
        stored, cells = int(line.split()[-1]), int(np.prod(shape))
        start, out = f.tell(), []
        for c in range(stored) if components is None else components:
            if not 0 <= c < stored:
                raise IndexError(f"component {c} of {stored}")
            f.seek(start + c * cells * kind.itemsize)
            data = f.read(cells * kind.itemsize)
            if len(data) != cells * kind.itemsize:
                raise EOFError(f"{fab.path} ends within a FAB")
            out.append(np.frombuffer(data, kind).reshape(shape))
    return np.stack(out) if out else np.empty((0, *shape))


@dataclass(frozen=True)
class Grid:
    level: int
    grid: int
    chunk: int
    path: str
    count: int
    offset: int
    size: int  # bytes until the next grid of the file


@dataclass(frozen=True)
class Species:
    reals: tuple[str, ...]
    ints: tuple[str, ...]
    double: bool
    grids: tuple[Grid, ...]


def read_species(path: str, name: str) -> Species:
    base = os.path.join(path, name)
    with open(os.path.join(base, "Header")) as f:
        words = iter(f.read().split())
    version = next(words)
    if not version.startswith("Version_Two_Dot_"):
        raise ValueError(f"particle format {version} isn't read")
    dim = int(next(words))
    reals = [*"xyz"[:dim], *(next(words) for _ in range(int(next(words))))]
    ints = [next(words) for _ in range(int(next(words)))]
    if int(next(words)):
        ints = ["id", "cpu", *ints]
    next(words), next(words)  # particles, next id
    found = []
    sizes = [int(next(words)) for _ in range(int(next(words)) + 1)]
    for level, grids in enumerate(sizes):
        for g in range(grids):
            number, count, offset = int(next(words)), int(next(words)), int(next(words))
            found.append((level, g, os.path.join(base, f"Level_{level}", f"DATA_{number:05d}"), count, offset))
    out = []
    for chunk, (level, g, file, count, offset) in enumerate(found):
        after = [o for _, _, f, _, o in found if f == file and o > offset]
        end = min(after) if after else os.path.getsize(file) if count else offset
        out.append(Grid(level, g, chunk, file, count, offset, end - offset))
    return Species(tuple(reals), tuple(ints), version.endswith("double"), tuple(out))


def read_grid(species: Species, grid: Grid) -> dict[str, np.ndarray]:
    """Columns of a grid's particles: integers before reals, each by particle; their width shows in the grid's size."""
    n, kind = grid.count, np.dtype("<f8" if species.double else "<f4")
    if not n:
        return {c: np.empty(0, np.int64 if c in species.ints else float) for c in (*species.reals, *species.ints)}
    rest = grid.size - n * len(species.reals) * kind.itemsize
    width = 4
    if species.ints:
        width, odd = divmod(rest, n * len(species.ints))
        if odd or width not in (4, 8):
            raise ValueError(f"{grid.path}: integers of {width} bytes")
    with open(grid.path, "rb") as f:
        f.seek(grid.offset)
        ints = np.frombuffer(f.read(n * len(species.ints) * width), f"<i{width}").reshape(n, len(species.ints))
        reals = np.frombuffer(f.read(n * len(species.reals) * kind.itemsize), kind).reshape(n, len(species.reals))
    return {c: reals[:, i] for i, c in enumerate(species.reals)} | {c: ints[:, i].astype(np.int64) for i, c in enumerate(species.ints)}


class PlotfileReader:
    """Direct access to a plotfile on the driver."""

    def __init__(self, path: str):
        self.path, self.header = path, read_header(path)
        self.fabs = read_fabs(path, self.header)

    @property
    def num_levels(self) -> int:
        return self.header.num_levels

    def num_fabs(self, level: int) -> int:
        return sum(f.level == level for f in self.fabs)

    def metadata(self) -> dict:
        h = self.header
        return {"names": h.names, "time": h.time, "levels": h.num_levels, "prob_lo": h.prob_lo, "prob_hi": h.prob_hi, "ref_ratio": h.ratios, "dx": h.dx}

    def read_fab(self, level: int, block: int, components: list[int] | None = None) -> np.ndarray:
        return read_fab(next(f for f in self.fabs if (f.level, f.block) == (level, block)), components)

    def particle_species(self) -> list[str]:
        return sorted(d for d in os.listdir(self.path) if not d.startswith("Level_") and os.path.isfile(os.path.join(self.path, d, "Header")))

    def particle_fields(self, name: str) -> list[str]:
        s = read_species(self.path, name)
        return [*s.reals, *s.ints]

    def read_particles(self, name: str, chunk: int) -> dict[str, np.ndarray]:
        s = read_species(self.path, name)
        return read_grid(s, s.grids[chunk])

    def hierarchy(self) -> Hierarchy:
        h, levels = self.header, []
        for n, dx in enumerate(h.dx):
            ratio = h.ratios[n] if n < len(h.ratios) else 2
            levels.append(Level(n, dx, h.prob_lo, h.domains[n][0], ref_ratio=ratio))
        return Hierarchy(tuple(levels), tuple(Block(f.level, f.block, f.lo, f.hi) for f in self.fabs))


CELL_FIELDS = [StructField(n, IntegerType()) for n in ("step", "level", "block", "i", "j", "k")]
PARTICLE_FIELDS = [StructField(n, IntegerType()) for n in ("step", "chunk", "level", "grid")] + [StructField("pidx", LongType())]


class _Part(InputPartition):
    def __init__(self, item, extra):
        self.item, self.extra = item, extra


class PlotfileDataSource(DataSource):
    """Format "amr_plotfile": cells of the plotfile at option `path`, or with option `particles` those of a species.

    A schema given to the reader prunes: only its fields' bytes are read; so do filters of levels, blocks and indices, FAB by
    FAB. The path must be one that executors can open.
    """

    @classmethod
    def name(cls) -> str:
        return "amr_plotfile"

    def schema(self) -> StructType:
        path, species = self.options["path"], self.options.get("particles")
        if species is None:
            return StructType([*CELL_FIELDS, *[StructField(n, DoubleType()) for n in read_header(path).names]])
        s = read_species(path, species)
        return StructType([*PARTICLE_FIELDS, *[StructField(n, DoubleType()) for n in s.reals], *[StructField(n, LongType()) for n in s.ints]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("particles"), int(self.options.get("step", 0)), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, species: str | None, step: int, schema: StructType):
        self.path, self.species, self.step, self.schema = path, species, step, schema
        self.filters: list = []

    def pushFilters(self, filters):
        """Takes note of ranges of the cells' indices, levels and blocks, by which whole FABs are left out; Spark still applies them."""
        kinds = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)
        self.filters = [f for f in filters if self.species is None and isinstance(f, kinds) and f.attribute in (("level",), ("block",), ("i",), ("j",), ("k",))]
        return filters

    def wanted(self, fab: Fab) -> bool:
        """Whether any of a FAB's cells can pass the filters."""
        ranges = {"level": (fab.level, fab.level), "block": (fab.block, fab.block)} | {n: (a, b) for n, a, b in zip("ijk", fab.lo, fab.hi, strict=True)}
        for f in self.filters:
            lo, hi = ranges[f.attribute[0]]
            if isinstance(f, In):
                ok = any(v is not None and lo <= v <= hi for v in f.value)
            elif isinstance(f, EqualTo):
                ok = lo <= f.value <= hi
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                ok = hi > f.value or isinstance(f, GreaterThanOrEqual) and hi == f.value
            else:
                ok = lo < f.value or isinstance(f, LessThanOrEqual) and lo == f.value
            if not ok:
                return False
        return True

    def partitions(self):
        if self.species is None:
            header = read_header(self.path)
            return [_Part(f, header.names) for f in read_fabs(self.path, header) if self.wanted(f)] or [_Part(None, None)]
        s = read_species(self.path, self.species)
        return [_Part(g, s) for g in s.grids if g.count] or [_Part(None, None)]

    def read(self, part):
        if part.item is None:
            return
        kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "float": pa.float32()}
        fields = [(f.name, kinds[f.dataType.simpleString()]) for f in self.schema.fields]
        if self.species is None:
            fab, names = part.item, part.extra
            wanted = [n for n, _ in fields if n in names]
            data = dict(zip(wanted, read_fab(fab, [names.index(n) for n in wanted]), strict=True))
            nx, ny, nz = (b - a + 1 for a, b in zip(fab.lo, fab.hi, strict=True))
            for k in range(nz):  # a plane of cells a batch
                own = {"step": np.full(nx * ny, self.step), "level": np.full(nx * ny, fab.level), "block": np.full(nx * ny, fab.block)}
                own |= {"i": np.tile(np.arange(fab.lo[0], fab.hi[0] + 1), ny), "j": np.repeat(np.arange(fab.lo[1], fab.hi[1] + 1), nx), "k": np.full(nx * ny, fab.lo[2] + k)}
                own |= {n: v[k].ravel() for n, v in data.items()}
                yield pa.RecordBatch.from_arrays([pa.array(own[n].astype(t.to_pandas_dtype())) for n, t in fields], names=[n for n, _ in fields])
        else:
            grid = part.item
            own, n = read_grid(part.extra, grid), grid.count
            own |= {"step": np.full(n, self.step), "chunk": np.full(n, grid.chunk), "level": np.full(n, grid.level), "grid": np.full(n, grid.grid), "pidx": np.arange(n)}
            yield pa.RecordBatch.from_arrays([pa.array(own[c].astype(t.to_pandas_dtype())) for c, t in fields], names=[c for c, _ in fields])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(PlotfileDataSource)
