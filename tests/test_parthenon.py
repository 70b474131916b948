"""The reader against a stand-in for an open file, and, where h5py is, against a real one."""

import contextlib

import numpy as np
import pytest

import cellforge as cf
from cellforge.sources import parthenon


class Attributes(dict):
    pass


class Group:
    def __init__(self, **attrs):
        self.attrs = Attributes(attrs)


def dump():
    """A root grid of two blocks of 2 x 3 x 4 cells, the first also refined in one block."""
    rng = np.random.default_rng(1)
    info = Group(MeshBlockSize=[2, 3, 4], RootGridDomain=[0.0, 4.0, 1.0, -3.0, 3.0, 1.0, 0.0, 2.0, 1.0], RootGridSize=[4, 3, 4], OutputDatasetNames=[b"rho", "mom", "gone"], NumComponents=[1, 3, 1], ComponentNames=["rho", "mx", "my", "mz", "gone"], Time=0.25)
    return {"Info": info, "Levels": np.array([0, 1, 0]), "LogicalLocations": np.array([[0, 0, 0], [1, 0, 1], [1, 0, 0]]), "rho": rng.random((3, 4, 3, 2)), "mom": rng.random((3, 3, 4, 3, 2))}


def test_layout_and_blocks(monkeypatch):
    data = dump()
    monkeypatch.setattr(parthenon, "open_file", lambda path: contextlib.nullcontext(data))
    layout = parthenon.read_layout("x")
    assert layout.time == 0.25 and list(layout.fields) == ["rho", "mx", "my", "mz"]
    assert [x.dx for x in layout.hierarchy.levels] == [(1.0, 2.0, 0.5), (0.5, 1.0, 0.25)]
    assert [(b.level, b.block, b.lo, b.hi) for b in layout.hierarchy.blocks] == [(0, 0, (0, 0, 0), (1, 2, 3)), (0, 1, (2, 0, 0), (3, 2, 3)), (1, 0, (2, 0, 4), (3, 2, 7))]
    source = parthenon.ParthenonDataSource({"path": "x"})
    reader = source.reader(source.schema())
    rows = [r for p in reader.partitions() for batch in reader.read(p) for r in batch.to_pylist()]
    assert len(rows) == 3 * 24
    by = {(r["level"], r["i"], r["j"], r["k"]): r for r in rows}
    assert by[0, 3, 2, 1]["my"] == data["mom"][2, 1, 1, 2, 1] and by[1, 2, 1, 7]["rho"] == data["rho"][1, 3, 1, 0]
    data["rho"] = data["rho"][:, :3]
    with pytest.raises(ValueError):
        parthenon.read_block("x", layout, layout.hierarchy.blocks[0], ["rho"])
    del data["Levels"]
    with pytest.raises(ValueError):
        parthenon.read_layout("x")


def test_a_real_file(spark, tmp_path):
    h5py = pytest.importorskip("h5py")
    path = str(tmp_path / "a.phdf")
    with h5py.File(path, "w") as f:
        for name, value in dump().items():
            if isinstance(value, Group):
                f.create_group(name).attrs.update({k: v if not isinstance(v, list) else np.array(v, "S") if isinstance(v[0], str | bytes) else v for k, v in value.attrs.items()})
            else:
                f[name] = value
    ds = cf.open_dataset(spark, path)
    assert ds["mx"].frame().count() == 72
