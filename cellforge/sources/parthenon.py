"""Parthenon HDF5 dumps as a Spark data source with one partition a mesh block; needs h5py on the driver and executors."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, StructField, StructType

from cellforge.plans.geometry import Block, Hierarchy, Level
from cellforge.sources.plotfile import CELL_FIELDS


def open_file(path: str):
    """An open dump: groups and datasets by name, their attributes under attrs."""
    try:
        import h5py
    except ImportError as error:
        raise NotImplementedError("Parthenon files need the library h5py, which isn't installed") from error
    return h5py.File(path, "r")


def _texts(value) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in np.atleast_1d(value)]


@dataclass(frozen=True)
class Layout:
    """A dump's hierarchy, the file's block of each (level, block), and each field's dataset and component."""

    hierarchy: Hierarchy
    places: dict[tuple[int, int], int]
    fields: dict[str, tuple[str, int]]
    time: float


def read_layout(path: str) -> Layout:
    """Blocks are numbered on each level in the file's order; a refined level has half the spacing of the one before."""
    with open_file(path) as f:
        if "Info" not in f or "Levels" not in f or "LogicalLocations" not in f:
            raise ValueError(f"{path} has no Info, Levels and LogicalLocations")
        info = f["Info"].attrs
        size = [int(n) for n in info["MeshBlockSize"]][:3]
        domain = [float(x) for x in info["RootGridDomain"]]  # for each axis lower end, upper end, ratio
        root = [int(n) for n in info["RootGridSize"]][:3]
        levels, where = np.asarray(f["Levels"][:], int), np.asarray(f["LogicalLocations"][:], int)
        if where.shape != (len(levels), 3):
            raise ValueError(f"LogicalLocations of {path} must have a row of three for each block")
        names = _texts(info["OutputDatasetNames"])
        parts = [int(n) for n in np.atleast_1d(info["NumComponents"])] if "NumComponents" in info else [1] * len(names)
        own = _texts(info["ComponentNames"]) if "ComponentNames" in info else []
        fields, at = {}, 0
        for name, n in zip(names, parts, strict=True):
            for c in range(n):
                fields[own[at] if at < len(own) else name if n == 1 else f"{name}_{c}"] = (name, c)
                at += 1
            if name not in f:
                fields = {k: v for k, v in fields.items() if v[0] != name}
        time = float(info["Time"]) if "Time" in info else 0.0
    lo, hi = domain[0::3][:3], domain[1::3][:3]
    geometry = tuple(Level(n, tuple((hi[a] - lo[a]) / (root[a] * 2**n) for a in range(3)), tuple(lo)) for n in range(int(levels.max(initial=-1)) + 1))
    blocks, places, seen = [], {}, {}
    for place, (level, corner) in enumerate(zip(levels.tolist(), where.tolist(), strict=True)):
        block = seen[level] = seen.get(level, -1) + 1
        first = tuple(c * n for c, n in zip(corner, size, strict=True))
        blocks.append(Block(level, block, first, tuple(x + n - 1 for x, n in zip(first, size, strict=True))))
        places[level, block] = place
    return Layout(Hierarchy(geometry, tuple(sorted(blocks, key=lambda b: (b.level, b.block)))), places, fields, time)


def read_block(path: str, layout: Layout, b: Block, names: list[str]) -> dict[str, np.ndarray]:
    """A block's arrays in (k, j, i) order; only its part of the asked datasets is read."""
    shape, place = tuple(h - a + 1 for a, h in zip(b.lo, b.hi, strict=True))[::-1], layout.places[b.level, b.block]
    out = {}
    with open_file(path) as f:
        for name in names:
            dataset, component = layout.fields[name]
            data = f[dataset]
            got = np.asarray(data[place] if len(data.shape) == 4 else data[place, component], float)
            if got.shape != shape:
                raise ValueError(f"{dataset} has blocks of {got.shape}, not {shape}")
            out[name] = got
    return out


class _Part(InputPartition):
    def __init__(self, block: Block | None):
        self.block = block


class ParthenonDataSource(DataSource):
    """Format "parthenon": cells of the dump at option `path`. A schema given to the reader prunes fields."""

    @classmethod
    def name(cls) -> str:
        return "parthenon"

    def schema(self) -> StructType:
        return StructType([*CELL_FIELDS, *[StructField(n, DoubleType()) for n in read_layout(self.options["path"]).fields]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("step", 0)), schema)


class _Reader(DataSourceReader):
    def __init__(self, path: str, step: int, schema: StructType):
        self.path, self.step, self.schema, self.layout = path, step, schema, read_layout(path)

    def partitions(self):
        return [_Part(b) for b in self.layout.hierarchy.blocks] or [_Part(None)]

    def read(self, part):
        if part.block is None:
            return
        b = part.block
        names = [f.name for f in self.schema.fields]
        data = read_block(self.path, self.layout, b, [n for n in names if n in self.layout.fields])
        k, j, i = (x.ravel() + b.lo[a] for x, a in zip(np.indices(tuple(h - a + 1 for a, h in zip(b.lo, b.hi, strict=True))[::-1]), (2, 1, 0), strict=True))
        own = {"step": np.full(len(i), self.step), "level": np.full(len(i), b.level), "block": np.full(len(i), b.block), "i": i, "j": j, "k": k} | {n: v.ravel() for n, v in data.items()}
        yield pa.RecordBatch.from_arrays([pa.array(own[n], pa.float64() if n in data else pa.int32()) for n in names], names=names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ParthenonDataSource)
