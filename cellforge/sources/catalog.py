"""Where datasets come from: memory, plotfiles, tables; formats that need libraries which aren't there say so."""

from __future__ import annotations

import difflib
import os
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cellforge.operators.mesh import Mesh
from cellforge.plans.geometry import Block, Hierarchy, Level
from cellforge.sources import parthenon, plotfile


class ReadOnlyError(RuntimeError):
    pass


class MemoryStore:
    """Chunks by (field, level, block), for tests and small inputs: NumPy arrays in (i, j, k) order, or opaque bytes."""

    def __init__(self, read_only: bool = False):
        self.chunks: dict[tuple[str, int, int], np.ndarray | bytes] = {}
        self.read_only = read_only

    def freeze(self) -> MemoryStore:
        self.read_only = True
        return self

    def set_chunk(self, field: str, level: int, block: int, data, dtype=None, shape=None) -> None:
        """Raw bytes need a dtype and a shape, or the dtype "opaque", which keeps them as they are."""
        if self.read_only:
            raise ReadOnlyError("the store is read-only")
        if isinstance(data, bytes | bytearray | memoryview):
            if dtype == "opaque":
                self.chunks[field, level, block] = bytes(data)
                return
            if dtype is None or shape is None:
                raise ValueError("raw bytes need a dtype and a shape")
            data = np.frombuffer(data, dtype).reshape(shape)
        elif dtype == "opaque":
            raise TypeError("opaque chunks are bytes")
        self.chunks[field, level, block] = np.asarray(data)

    def get_chunk(self, field: str, level: int, block: int) -> np.ndarray | bytes:
        return self.chunks[field, level, block]


def mesh_from_numpy(spark: SparkSession, hierarchy: Hierarchy, fields: dict[str, dict[tuple[int, int], np.ndarray]]) -> Mesh:
    """A mesh from dense arrays, one for each (level, block) of each field."""
    import pandas as pd

    frames = []
    for b in hierarchy.blocks:
        shape = tuple(h - a + 1 for a, h in zip(b.lo, b.hi, strict=True))
        index = np.indices(shape).reshape(3, -1)
        frame = {"level": np.full(index.shape[1], b.level), "block": np.full(index.shape[1], b.block)}
        frame |= {n: index[a] + b.lo[a] for a, n in enumerate("ijk")}
        for name, chunks in fields.items():
            data = np.asarray(chunks[b.level, b.block])
            if data.shape != shape:
                raise ValueError(f"{name} has shape {data.shape} on level {b.level}, block {b.block}; the block has {shape}")
            frame[name] = data.ravel()
        frames.append(pd.DataFrame(frame))
    ints = {n: "int32" for n in ("level", "block", "i", "j", "k")}
    return Mesh(spark.createDataFrame(pd.concat(frames, ignore_index=True).astype(ints)), hierarchy, tuple(fields))


def mesh_from_store(spark: SparkSession, hierarchy: Hierarchy, store: MemoryStore) -> Mesh:
    names = sorted({f for (f, _, _), data in store.chunks.items() if not isinstance(data, bytes)})
    return mesh_from_numpy(spark, hierarchy, {n: {(lv, b): d for (f, lv, b), d in store.chunks.items() if f == n} for n in names})


def mesh_from_plotfile(spark: SparkSession, path: str, step: int = 0, periodic: tuple[bool, bool, bool] | None = None) -> Mesh:
    """A mesh that reads the bytes of asked fields only. Plotfiles don't tell whether axes are periodic; `periodic` does."""
    plotfile.register(spark)
    reader = plotfile.PlotfileReader(path)
    names = reader.header.names
    own = plotfile.PlotfileDataSource({"path": path}).schema()

    def load(fields=names):
        schema = StructType([f for f in own.fields if f.name not in names or f.name in fields])
        return spark.read.format("amr_plotfile").schema(schema).option("step", step).load(path)

    return Mesh(load(), with_periods(reader.hierarchy(), periodic), names, load)


def with_periods(h: Hierarchy, periodic: tuple[bool, bool, bool] | None) -> Hierarchy:
    """The hierarchy with these axes periodic on all levels; as it is if None."""
    if periodic is None:
        return h
    if len(periodic) != 3 or not all(isinstance(p, bool) for p in periodic):
        raise ValueError("periodic must be three booleans")
    return Hierarchy(tuple(replace(x, periodic=tuple(periodic)) for x in h.levels), h.blocks)


def mesh_from_parthenon(spark: SparkSession, path: str, step: int = 0, periodic: tuple[bool, bool, bool] | None = None) -> Mesh:
    """A mesh of a Parthenon dump, of the bytes of asked fields only."""
    layout = parthenon.read_layout(path)
    parthenon.register(spark)
    names = tuple(layout.fields)
    own = [*plotfile.CELL_FIELDS, *[StructField(n, DoubleType()) for n in names]]

    def load(fields=names):
        schema = StructType([f for f in own if f.name not in names or f.name in fields])
        return spark.read.format("parthenon").schema(schema).option("step", step).load(path)

    return Mesh(load(), with_periods(layout.hierarchy, periodic), names, load)


def particles_from_plotfile(spark: SparkSession, path: str, species: str, step: int = 0) -> DataFrame:
    plotfile.register(spark)
    return spark.read.format("amr_plotfile").option("particles", species).option("step", step).load(path)


def mesh_from_tables(spark: SparkSession, path: str, step: int = 0, periodic: tuple[bool, bool, bool] | None = None) -> Mesh:
    """A mesh from the tables levels, blocks and cells of one folder; cells may be partitioned by step and level."""
    levels = spark.read.parquet(f"{path}/levels").where(F.col("step") == step).orderBy("level").collect()
    blocks = spark.read.parquet(f"{path}/blocks").where(F.col("step") == step).orderBy("level", "block").collect()
    h = Hierarchy(
        tuple(Level(r.level, (r.dx0, r.dx1, r.dx2), (r.x00, r.x01, r.x02), (r.o0, r.o1, r.o2), (r.per0, r.per1, r.per2), r.ref_ratio) for r in levels),
        tuple(Block(r.level, r.block, (r.lo0, r.lo1, r.lo2), (r.hi0, r.hi1, r.hi2)) for r in blocks),
    )
    cells = spark.read.parquet(f"{path}/cells").where(F.col("step") == step)
    return Mesh(cells, with_periods(h, periodic), tuple(c for c in cells.columns if c not in ("step", "level", "block", "i", "j", "k")))


def write_tables(mesh: Mesh, path: str, step: int = 0, mode: str = "errorifexists") -> None:
    """Write a mesh as tables: cells by step and level, clustered by block, so that planes and levels prune files."""
    spark = mesh.cells.sparkSession
    mesh.hierarchy.levels_frame(spark, step).write.mode(mode).parquet(f"{path}/levels")
    mesh.hierarchy.blocks_frame(spark, step).write.mode(mode).parquet(f"{path}/blocks")
    cells = mesh.cells.withColumn("step", F.lit(step)).repartitionByRange("level", "block", "k")
    cells.sortWithinPartitions("level", "block", "k", "j", "i").write.mode(mode).partitionBy("step", "level").parquet(f"{path}/cells")


def _missing(kind: str, library: str):
    def fail(*_, **__):
        raise NotImplementedError(f"{kind} files need the library {library}, which isn't installed")

    return fail


OPENERS = {"amrex": mesh_from_plotfile, "tables": mesh_from_tables, "parthenon": mesh_from_parthenon, "openpmd": _missing("openPMD", "openpmd_api")}


def kind_of(uri: str) -> tuple[str, str]:
    """(kind, path): by scheme, else a folder with a Header is a plotfile, one with cells tables, an HDF5 name Parthenon."""
    scheme, sep, rest = uri.partition("://")
    if sep and scheme != "file":
        if scheme not in ("amrex", "parthenon", "openpmd", "tables", "memory"):
            raise ValueError(f"unknown scheme {scheme!r}")
        return scheme, rest
    path = rest if sep else uri
    if os.path.isfile(os.path.join(path, "Header")):
        return "amrex", path
    if os.path.isdir(os.path.join(path, "cells")):
        return "tables", path
    if path.endswith((".phdf", ".h5", ".hdf5")):
        return "parthenon", path
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return "openpmd", path


def close_matches(name: str, names) -> str:
    near = difflib.get_close_matches(name, list(names), 3)
    return f"{name!r} isn't a field" + (f"; did you mean {', '.join(near)}?" if near else f"; there are {', '.join(names)}")
