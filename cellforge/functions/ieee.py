"""IEEE-754 semantics as columns: Spark raises on x/0, orders NaN above all numbers and takes NaN = NaN as true."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def div(a, b) -> Column:
    """a / b with x/0 = signed infinity and 0/0 = NaN; the sign of a zero divisor counts."""
    a, b = lit(a).cast("double"), lit(b).cast("double")
    # 1/-0.0 can't be asked for directly: a negative zero is told by its text
    negative = (a < 0) != F.startswith(b.cast("string"), F.lit("-"))
    zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).otherwise(F.when(negative, F.lit(-INF)).otherwise(F.lit(INF)))
    return F.when(b == 0, zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _number(*xs: Column) -> Column:
    out = F.lit(True)
    for x in xs:
        out = out & ~F.isnan(x.cast("double"))
    return out


def eq(a, b) -> Column:
    a, b = lit(a), lit(b)
    return _number(a, b) & (a == b)


def ne(a, b) -> Column:
    return ~eq(a, b)


def lt(a, b) -> Column:
    a, b = lit(a), lit(b)
    return _number(a, b) & (a < b)


def le(a, b) -> Column:
    a, b = lit(a), lit(b)
    return _number(a, b) & (a <= b)


def gt(a, b) -> Column:
    return lt(b, a)


def ge(a, b) -> Column:
    return le(b, a)


COMPARE = {"lt": lt, "le": le, "gt": gt, "ge": ge, "eq": eq, "ne": ne}


def isfinite(x: Column) -> Column:
    x = x.cast("double")
    return ~F.isnan(x) & (F.abs(x) < INF)


def isin(x: Column, values: Sequence[float]) -> Column:
    """Exact membership; NaN is in no set."""
    keep = [float(v) for v in values if not math.isnan(float(v))]
    return _number(x) & x.isin(keep) if keep else F.lit(False)


def uniform_bin(x: Column, lo: float, hi: float, n: int) -> Column:
    """Bin of x in n equal ones over [lo, hi], the last closed; null for other values and non-finite ones."""
    x = x.cast("double")
    inside = isfinite(x) & (x >= lo) & (x <= hi)
    scaled = F.when(inside, (x - lo) * (n / (hi - lo)))
    return F.when(scaled.isNotNull(), F.when(x == hi, F.lit(n - 1)).otherwise(F.least(F.floor(scaled), F.lit(n - 1)))).cast("int")


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Bin of x among explicit edges, left-closed and the last closed; null outside. A balanced tree of comparisons."""
    x, n = x.cast("double"), len(edges) - 1

    def tree(a: int, b: int) -> Column:
        if b - a == 1:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(x < float(edges[m]), tree(a, m)).otherwise(tree(m, b))

    inside = isfinite(x) & (x >= float(edges[0])) & (x <= float(edges[-1]))
    return F.when(inside, tree(0, n)).cast("int")


def finite_sum(x: Column) -> Column:
    """Sum that is 0 rather than null over no rows."""
    return F.coalesce(F.sum(x), F.lit(0.0))
