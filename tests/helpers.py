import numpy as np

from cellforge.plans.geometry import Block, Hierarchy, Level
from cellforge.sources.catalog import mesh_from_numpy


def box(spark, fields, shape=None, dx=1.0, x0=(0.0, 0.0, 0.0)):
    """A mesh of one block."""
    shape = shape or next(iter(fields.values())).shape
    h = Hierarchy((Level(0, (dx,) * 3, x0),), (Block(0, 0, (0, 0, 0), tuple(n - 1 for n in shape)),))
    return mesh_from_numpy(spark, h, {k: {(0, 0): np.asarray(v, float)} for k, v in fields.items()})


def two_levels(spark, f, n=4, lo=(2, 0, 0), hi=(7, 7, 7)):
    """Field values f(x, y, z) on n^3 unit cells and a refined box."""
    h = Hierarchy((Level(0, (1.0,) * 3), Level(1, (0.5,) * 3)), (Block(0, 0, (0, 0, 0), (n - 1,) * 3), Block(1, 0, lo, hi)))

    def values(level, a, b, g):
        axes = [(np.arange(p, q + 1) + 0.5) * h.at(level).dx[0] for p, q in zip(a, b, strict=True)]
        return g(*np.meshgrid(*axes, indexing="ij"))

    fields = {name: {(x.level, x.block): values(x.level, x.lo, x.hi, g) for x in h.blocks} for name, g in f.items()}
    return mesh_from_numpy(spark, h, fields)
