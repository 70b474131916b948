import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from cellforge.plans.geometry import Block, Hierarchy, Level, plane


def nested(rng, depth=3):
    """Levels of random ratios and origins, each with a few random blocks."""
    levels, blocks, dx, origin = [], [], 0.75, [rng.randrange(-9, 10) for _ in range(3)]
    start = tuple(rng.uniform(-3, 3) for _ in range(3))
    for n in range(depth):
        ratio = rng.choice([2, 3, 4])
        levels.append(Level(n, (dx,) * 3, start, tuple(origin), ref_ratio=ratio))
        for b in range(1 if n == 0 else 2):
            lo = [o + rng.randrange(0, 7) * (n > 0) for o in origin]
            blocks.append(Block(n, b, tuple(lo), tuple(x + rng.randrange(2, 9) for x in lo)))
        dx, origin = dx / ratio, [o * ratio for o in origin]
    return Hierarchy(tuple(levels), tuple(blocks))


def cells(b):
    return product(*(range(a, h + 1) for a, h in zip(b.lo, b.hi, strict=True)))


@pytest.mark.parametrize("seed", range(12))
def test_covered_boxes_hold_the_cells_whose_upper_corner_is_refined(seed):
    """By cells: a coarse cell is covered if a finer block has its last child on every axis, and starts no later than that."""
    h = nested(random.Random(seed))
    for level in (0, 1):
        x, fine = h.at(level), h.at(level + 1)
        want = set()
        for b in h.on(level + 1):
            for c in cells(b):
                last = [(c[a] - fine.origin[a] + 1) % x.ref_ratio == 0 for a in range(3)]
                if all(last):
                    want.add(tuple((c[a] - fine.origin[a]) // x.ref_ratio + x.origin[a] for a in range(3)))
        got = {c for lo, hi in h.covered_boxes(level) for c in cells(Block(level, 0, lo, hi))}
        assert got == want


@pytest.mark.parametrize("seed", range(12))
def test_planes_and_slabs_descend_from_the_base_cell(seed):
    rng = random.Random(100 + seed)
    h = nested(rng)
    axis, base = rng.randrange(3), h.levels[0]
    at, depth = rng.uniform(-2, 6), rng.uniform(0.1, 3)
    planes, slabs = h.plane_index(axis, at), h.slab_index(axis, at, at + depth)
    for x in h.levels:
        # the lowest fine cell of the base cell that holds the coordinate
        edge = base.edge(axis, base.index(axis, at))
        assert x.edge(axis, planes[x.level]) == pytest.approx(edge)
        assert x.edge(axis, slabs[x.level][0]) == pytest.approx(edge)
        top = x.edge(axis, slabs[x.level][1] + 1)
        assert top >= at + depth - 1e-9 and top - base.dx[axis] < at + depth + 1e-9
    rect = sorted(rng.uniform(-3, 6) for _ in range(2)) + sorted(rng.uniform(-3, 6) for _ in range(2))
    rect = (rect[0], rect[2], rect[1], rect[3])
    own = h.window(axis, {n: (k, k) for n, k in planes.items()}, rect)
    for b in h.blocks_at(axis, at, rect):
        ranges, hit = own[b.level]
        assert b.block in hit and ranges[axis] == (planes[b.level],) * 2
        x = h.at(b.level)
        u, v = (a for a in range(3) if a != axis)
        for c in cells(b):
            inside = all(x.edge(a, c[a]) < rect[i + 2] and x.edge(a, c[a] + 1) > rect[i] for i, a in enumerate((u, v)))
            if inside and c[axis] == planes[b.level]:
                assert all(lo <= c[a] <= hi for a, (lo, hi) in enumerate(ranges))


def test_blocks_that_share_a_face(spark):
    rng = random.Random(5)
    cuts = [0, 2, 5, 9]
    boxes = [tuple((cuts[i], cuts[i + 1] - 1) for i in c) for c in product(range(3), repeat=3) if rng.random() < 0.8]
    h = Hierarchy((Level(0, (1.0,) * 3, periodic=(False, False, True)),), tuple(Block(0, n, tuple(p for p, _ in b), tuple(q for _, q in b)) for n, b in enumerate(boxes)))
    got = {(r.block, r.other, r.axis, r.side) for r in h.adjacent(spark).collect()}
    want = set()
    top, low = max(b[2][1] for b in boxes) + 1, min(b[2][0] for b in boxes)
    for (m, a), (n, b), axis in product(enumerate(boxes), enumerate(boxes), range(3)):
        end = a[axis][1] + 1
        end = low if axis == 2 and end == top else end
        if end == b[axis][0] and all(a[w][0] <= b[w][1] and a[w][1] >= b[w][0] for w in range(3) if w != axis):
            want |= {(m, n, axis, 1), (n, m, axis, 0)}
    assert got == want and len(got) > 20


def test_views(spark):
    h = Hierarchy((Level(0, (0.5, 1.0, 2.0), (-1.0, 0.0, 3.0)),), (Block(0, 0, (0, 0, 0), (5, 6, 7)),))
    view = plane(h, "y", zoom=2.0, resolution=(3, 9))
    # the middle cell's centre on the normal axis, and half the domain about its middle on the others
    assert view["coord"] == 3.5 and view["bounds"] == (0.0, 7.0) and view["labels"] == ("x", "z")
    assert view["rect"] == pytest.approx((-0.25, 7.0, 1.25, 15.0))
    for bad in ({"axis": 3}, {"axis": "q"}, {"axis": "y", "zoom": -1}, {"axis": "y", "resolution": (4, 0)}, {"axis": "y", "resolution": (4,)}):
        with pytest.raises(ValueError):
            plane(h, **bad)
    frame = h.levels_frame(spark)
    assert frame.select(F.sum("dx2")).first()[0] == 2.0
