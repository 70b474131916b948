"""Named queries of the mesh and particle operators over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.functions.expr import parse
from cellforge.operators import flux, mesh, particles, stencil
from cellforge.plans import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


_KEY = ("level", "i", "j", "k")
_CELLS = "WITH " + fixtures.cells_sql()
_SHIFTED = "WITH " + fixtures.cells_sql(-4.0)
_P = "WITH " + fixtures.PARTICLES_SQL


def r6(c: Column | str, name: str) -> Column:
    return F.round(c, 6).alias(name)


def _vars(m) -> dict[str, Column]:
    return {n: F.col(n) for n in m.fields}


def _expr(name: str, text: str, sql: str, exact: bool = False) -> None:
    @query(name, f"{_CELLS} SELECT level,i,j,k, {sql if exact else f'round({sql},9)'} AS value FROM cells")
    def _(spark, sf_dir):
        m = fixtures.mesh(spark, sf_dir)
        value = parse(text, _vars(m))
        return m.cells.select(*_KEY, (value if exact else F.round(value, 9)).alias("value"))


_expr("field_expr_ratio", "(momx/rho)+rho", "(momx/rho)+rho")
_expr("field_expr_power", "v**2 - pow(rho, 0.5) * -2", "pow(v,2) - pow(rho,5e-1) * -2e0")
_expr("field_expr_functions", "sqrt(abs(momx)) + max(v, energy) - min(v, energy) + floor(v) - ceil(energy) + fmod(temp, 7)", "sqrt(abs(momx)) + greatest(v,energy) - least(v,energy) + floor(v) - ceil(energy) + (temp % 7e0)")
_expr("field_expr_trigonometry", "sin(v) + cos(v)*tan(momx) + atan2(v, energy) + asin(momx) - acos(momy) + atan(v) + sinh(momx) - cosh(momy) + tanh(v)", "sin(v) + cos(v)*tan(momx) + atan2(v,energy) + asin(momx) - acos(momy) + atan(v) + sinh(momx) - cosh(momy) + tanh(v)")
_expr("field_expr_logs", "exp(momx) + log(rho) - log10(temp)", "exp(momx) + ln(rho) - log10(temp)")
_expr("field_expr_choice", "if(v > 25, energy, -energy) + heaviside(momx, 0.5) + (v >= energy and momx < momy)", "CASE WHEN v > 25 THEN energy ELSE -energy END + CASE WHEN momx < 0 THEN 0e0 WHEN momx = 0 THEN 5e-1 ELSE 1e0 END + CASE WHEN v >= energy AND momx < momy THEN 1e0 ELSE 0e0 END")
_expr("field_add", "v + energy", "v + energy", exact=True)
_expr("field_subtract", "v - energy", "v - energy", exact=True)
_expr("field_multiply", "v * energy", "v * energy", exact=True)
_expr("field_divide", "v / energy", "v / energy", exact=True)


@query("field_negate", f"{_CELLS} SELECT level,i,j,k, v * -1e0 AS value FROM cells")
def _(spark, sf_dir):
    return fixtures.mesh(spark, sf_dir).cells.select(*_KEY, (F.col("v") * -1.0).alias("value"))


@query("mesh_astype", f"{_CELLS} SELECT level,i,j,k, round(CAST(CAST(v AS FLOAT) AS DOUBLE),6) AS value FROM cells")
def _(spark, sf_dir):
    return fixtures.mesh(spark, sf_dir).cells.select(*_KEY, r6(F.col("v").cast("float").cast("double"), "value"))


@query("derived_field", f"{_CELLS} SELECT level,i,j,k, round(sqrt((momx*momx+momy*momy+momz*momz))/rho,6) AS value FROM cells")
def _(spark, sf_dir):
    m = fixtures.mesh(spark, sf_dir)
    m = m.with_field("speed", parse("sqrt(momx*momx+momy*momy+momz*momz)/rho", _vars(m)))
    return m.cells.select(*_KEY, r6("speed", "value"))


_OPS = {"lt": "<", "le": "<=", "gt": ">", "ge": ">=", "eq": "=", "ne": "<>"}


@query("mesh_compare", f"{_CELLS} SELECT level,i,j,k, {', '.join(f'v {s} energy AS {n}_field, v {s} 2.5e1 AS {n}_scalar' for n, s in _OPS.items())} FROM cells")
def _(spark, sf_dir):
    cols = [f(F.col("v"), b).alias(f"{n}_{w}") for n, f in ieee.COMPARE.items() for w, b in (("field", F.col("energy")), ("scalar", 25.0))]
    return fixtures.mesh(spark, sf_dir).cells.select(*_KEY, *cols)


@query("mesh_mask_and", f"{_CELLS} SELECT level,i,j,k, (v > 2e1 AND energy < 4e1) AS mask FROM cells")
def _(spark, sf_dir):
    return fixtures.mesh(spark, sf_dir).cells.select(*_KEY, (ieee.gt(F.col("v"), 20.0) & ieee.lt(F.col("energy"), 40.0)).alias("mask"))


@query("coverage_leaf_cells", f"{_CELLS} SELECT level, block, i, j, k FROM leaf")
def _(spark, sf_dir):
    m = fixtures.mesh(spark, sf_dir)
    return m.leaves().select("level", "block", "i", "j", "k")


_BLOCKS_SQL = "WITH b(level, block, x0, x1, z0, z1, k0, k1) AS (VALUES (0,0,0e0,4e0,0e0,8e0,0,7),(0,1,4e0,8e0,0e0,8e0,0,7),(1,0,2e0,4e0,2e0,6e0,4,11),(1,1,4e0,6e0,2e0,6e0,4,11))"


@query("block_prune_plane", f"{_BLOCKS_SQL} SELECT CAST(level AS INT) AS level, CAST(block AS INT) AS block FROM b WHERE (CASE WHEN level=0 THEN 1 ELSE 2 END) BETWEEN k0 AND k1")
def _(spark, sf_dir):
    return fixtures.hierarchy().blocks_frame(spark).join(_named(spark, fixtures.hierarchy().blocks_at(2, 1.5)), ["level", "block"]).select("level", "block")


@query("block_prune_slab", f"{_BLOCKS_SQL} SELECT CAST(level AS INT) AS level, CAST(block AS INT) AS block FROM b WHERE x0 < 3e0 AND x1 > 1e0")
def _(spark, sf_dir):
    return fixtures.hierarchy().blocks_frame(spark).join(_named(spark, fixtures.hierarchy().blocks_in(0, 1.0, 3.0)), ["level", "block"]).select("level", "block")


def _named(spark: SparkSession, blocks) -> DataFrame:
    return spark.createDataFrame([(b.level, b.block) for b in blocks], "level int, block int")


# ---- slices and projections --------------------------------------------------------------------------------------------

_RECT, _RES = (-0.3, 0.2, 8.4, 7.9), (6, 5)
_DU, _DV = (_RECT[2] - _RECT[0]) / _RES[0], (_RECT[3] - _RECT[1]) / _RES[1]


def _pixels_sql(axis: int) -> str:
    u, v = [("y0", "z0"), ("x0", "z0"), ("x0", "y0")][axis]
    return f"""pix AS (SELECT CAST(a.range AS INT) px, CAST(b.range AS INT) py, {_RECT[0]!r}::DOUBLE + a.range*{_DU!r}::DOUBLE pu, {_RECT[1]!r}::DOUBLE + b.range*{_DV!r}::DOUBLE pv FROM range({_RES[0]}) a, range({_RES[1]}) b),
 ov AS (SELECT py, px, leaf.*, greatest(0e0, least({u}+dx, pu+{_DU!r}::DOUBLE) - greatest({u}, pu)) * greatest(0e0, least({v}+dx, pv+{_DV!r}::DOUBLE) - greatest({v}, pv)) area FROM pix, leaf)"""


def _slices(axis: int) -> None:
    name, n = "xyz"[axis], "ijk"[axis]

    @query(f"uniform_slice_{name}", f"{_CELLS}, {_pixels_sql(axis)} SELECT py, px, CASE WHEN coalesce(sum(area) FILTER ({n} = CASE WHEN level=0 THEN 3 ELSE 6 END),0) = 0 THEN -1e0 ELSE round(sum(v*area) FILTER ({n} = CASE WHEN level=0 THEN 3 ELSE 6 END) / ({_DU!r}::DOUBLE*{_DV!r}::DOUBLE),6) END AS value FROM ov GROUP BY py, px")
    def _(spark, sf_dir):
        out = mesh.slice_plane(fixtures.mesh(spark, sf_dir), "v", axis, 3.3, _RECT, _RES)
        return out.select("py", "px", F.nanvl(F.round("value", 6), F.lit(-1.0)).alias("value"))

    @query(f"uniform_projection_{name}", f"{_CELLS}, {_pixels_sql(axis)} SELECT py, px, round(sum(v*area*greatest(0e0, least({name}0+dx, 6.7e0) - greatest({name}0, 1.2e0))),6) AS value FROM ov GROUP BY py, px")
    def _(spark, sf_dir):
        out = mesh.project(fixtures.mesh(spark, sf_dir), "v", axis, (1.2, 6.7), _RECT, _RES)
        return out.select("py", "px", r6("value", "value"))

    @query(f"slice_nearest_{name}", _nearest_sql(axis))
    def _(spark, sf_dir):
        out = mesh.slice_nearest(fixtures.mesh(spark, sf_dir), "v", axis, 3.3, _RECT, _RES)
        return out.select("py", "px", F.nanvl(F.round("value", 6), F.lit(-1.0)).alias("value"))


def _nearest_sql(axis: int) -> str:
    u, v = [("j", "k"), ("i", "k"), ("i", "j")][axis]
    return f"""{_CELLS}, pix AS (SELECT CAST(a.range AS INT) px, CAST(b.range AS INT) py, {_RECT[0]!r}::DOUBLE + (a.range+5e-1)*{_DU!r}::DOUBLE pu, {_RECT[1]!r}::DOUBLE + (b.range+5e-1)*{_DV!r}::DOUBLE pv FROM range({_RES[0]}) a, range({_RES[1]}) b)
 SELECT py, px, coalesce(round(arg_max(v, level),6), -1e0) AS value FROM pix LEFT JOIN cells ON {u} = floor(pu/dx) AND {v} = floor(pv/dx) AND {"ijk"[axis]} = CASE WHEN level=0 THEN 3 ELSE 6 END GROUP BY py, px"""


for _axis in range(3):
    _slices(_axis)


# ---- histograms --------------------------------------------------------------------------------------------------------


def _bin_sql(x: str, lo: str, hi: str, n: int) -> str:
    return f"CASE WHEN {x} >= {lo} AND {x} <= {hi} THEN CASE WHEN {x} = {hi} THEN {n - 1} ELSE CAST(floor(({x} - {lo}) * ({n} / ({hi} - {lo}))) AS INT) END END"


def _hist_sql(rows: str, x: str, lo: str, hi: str, n: int, weight: str = "1e0") -> str:
    return f"b AS (SELECT {_bin_sql(x, lo, hi, n)} bin, {weight} w FROM {rows}) SELECT CAST(r.range AS INT) AS bin, round(coalesce(sum(w),0e0),6) AS count FROM range({n}) r LEFT JOIN b ON b.bin = r.range GROUP BY r.range"


def _counts(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, r6("count", "count"))


@query("histogram1d", f"{_CELLS}, {_hist_sql('leaf', 'v', '1e1', '4e1', 7)}")
def _(spark, sf_dir):
    m = fixtures.mesh(spark, sf_dir)
    return _counts(mesh.histogram(m.leaves(), F.col("v"), 7, (10, 40)), "bin")


@query("histogram1d_weighted", f"{_CELLS}, {_hist_sql('leaf', 'v', '1e1', '4e1', 7, 'energy')}")
def _(spark, sf_dir):
    m = fixtures.mesh(spark, sf_dir)
    return _counts(mesh.histogram(m.leaves(), F.col("v"), 7, (10, 40), F.col("energy")), "bin")


def _hist2(name: str, mode: str, weight: str) -> None:
    sql = f"""{_CELLS}, b AS (SELECT {_bin_sql("v", "1e1", "4e1", 4)} xb, {_bin_sql("energy", "2e1", "6e1", 3)} yb, {weight} w FROM leaf)
 SELECT CAST(r.range AS INT) AS xbin, CAST(s.range AS INT) AS ybin, round(coalesce(sum(w),0e0),9) AS count FROM range(4) r CROSS JOIN range(3) s LEFT JOIN b ON xb = r.range AND yb = s.range GROUP BY r.range, s.range"""

    @query(name, sql)
    def _(spark, sf_dir):
        m = fixtures.mesh(spark, sf_dir)
        given = F.col("scalar") if mode == "weighted" else None
        out = mesh.histogram2d(m.leaves(), F.col("v"), F.col("energy"), (4, 3), ((10, 40), (20, 60)), mesh.weight_of(m, F.col("v"), mode, given))
        # weights are multiples of 1.25e-7: with nine digits no sum is a tie that the order of its terms would decide
        return out.select("xbin", "ybin", F.round("count", 9).alias("count"))


_hist2("histogram2d_input", "input", "1e0")
_hist2("histogram2d_weighted", "weighted", "scalar")
_hist2("histogram2d_cell_mass", "cell_mass", "v*dx*dx*dx")
_hist2("histogram2d_cell_volume", "cell_volume", "dx*dx*dx")


@query("histogram_bounded", f"{_CELLS}, {_pixels_sql(2)}, img AS (SELECT round(sum(v*area*greatest(0e0, least(z0+dx, 6.7e0) - greatest(z0, 1.2e0))),6) AS value FROM ov GROUP BY py, px), {_hist_sql('img', 'value', '0e0', '4e2', 5)}")
def _(spark, sf_dir):
    image = mesh.project(fixtures.mesh(spark, sf_dir), "v", 2, (1.2, 6.7), _RECT, _RES)
    return _counts(mesh.histogram(image, F.round("value", 6), 5, (0, 400)), "bin")


@query("cdf_histogram", f"{_CELLS}, h AS ({_CELLS}, {_hist_sql('leaf', 'v', '1e1', '4e1', 7)}) SELECT bin, round(sum(count) OVER (ORDER BY bin) / sum(count) OVER (), 6) AS cdf FROM h")
def _(spark, sf_dir):
    m = fixtures.mesh(spark, sf_dir)
    return mesh.cdf_from_histogram(mesh.histogram(m.leaves(), F.col("v"), 7, (10, 40))).select("bin", r6("cdf", "cdf"))


@query("cdf_samples", f"{_CELLS} SELECT v AS value, round(row_number() OVER (ORDER BY v) / CAST(count(*) OVER () AS DOUBLE), 6) AS cdf FROM leaf")
def _(spark, sf_dir):
    return mesh.cdf_from_samples(fixtures.mesh(spark, sf_dir).leaves(), "v").select("value", r6("cdf", "cdf"))


@query("fab_minmax", f"{_CELLS} SELECT level, block, min(v) AS min, max(v) AS max FROM cells GROUP BY level, block")
def _(spark, sf_dir):
    return mesh.fab_minmax(fixtures.mesh(spark, sf_dir), "v")


@query("subbox_fetch", f"{_CELLS} SELECT level,i,j,k,v FROM cells WHERE level=1 AND i BETWEEN 5 AND 9 AND j BETWEEN 4 AND 6 AND k BETWEEN 7 AND 20")
def _(spark, sf_dir):
    return mesh.subbox(fixtures.mesh(spark, sf_dir), 1, (5, 4, 7), (9, 6, 20)).select(*_KEY, "v")


@query("subbox_halo", f"{_CELLS} SELECT level,block,i,j,k,v FROM cells WHERE NOT (level=1 AND block=0) AND x0 < 4.5e0 AND x0+dx > 1.5e0 AND y0 < 6.5e0 AND y0+dx > 1.5e0 AND z0 < 6.5e0 AND z0+dx > 1.5e0")
def _(spark, sf_dir):
    return mesh.subbox_fetch(fixtures.mesh(spark, sf_dir), 1, 0, 1).select("level", "block", "i", "j", "k", "v")


# ---- stencils ----------------------------------------------------------------------------------------------------------


def gradient_sql(fields: list[str], shift: float = 0.0) -> str:
    """CTE `grad`: gx, gy, gz of each field for all cells, over the CTE `cells`."""
    f = ", ".join(fields)
    s = f"({shift!r}::DOUBLE)"
    values = ", ".join(f"first(f_{x}) f_{x}, arg_max(s.{x}, s.level) s_{x}" for x in fields)
    sums = ", ".join(f"sum(d{a}*d{b}/q) a{a}{b}" for a in range(3) for b in range(a, 3))
    more = ", ".join(f"sum(d{a}*(s_{x}-f_{x})/q) b{a}_{x}" for a in range(3) for x in fields)

    def det(m):
        return f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"

    whole = [[f"a{min(p, q)}{max(p, q)}" for q in range(3)] for p in range(3)]
    solved = ", ".join(f"CASE WHEN m >= 3 AND abs({det(whole)}) > 1e-30 THEN {det([[f'b{p}_{x}' if q == c else whole[p][q] for q in range(3)] for p in range(3)])}/{det(whole)} ELSE 0e0 END {x}_g{'xyz'[c]}" for x in fields for c in range(3))
    offsets = ",".join(f"({a},{b},{c})" for a, b, c in product((-1, 0, 1), repeat=3) if a or b or c)
    return f"""offs(oi,oj,ok) AS (VALUES {offsets}),
 cc AS (SELECT level,i,j,k,dx,{f}, x0+dx/2e0 cx, y0+dx/2e0 cy, z0+dx/2e0 cz FROM cells),
 pts AS (SELECT t.level,t.i,t.j,t.k,oi,oj,ok,cx,cy,cz,{", ".join(f"{x} f_{x}" for x in fields)}, cx+oi*dx px, cy+oj*dx py, cz+ok*dx pz FROM cc t, offs),
 best AS (SELECT p.level,p.i,p.j,p.k,oi,oj,ok, first(p.cx) cx, first(p.cy) cy, first(p.cz) cz, max(s.level) sl, {values}, arg_max(s.cx,s.level) sx, arg_max(s.cy,s.level) sy, arg_max(s.cz,s.level) sz
   FROM pts p JOIN cc s ON s.i = CAST(floor((px-{s})/s.dx) AS INT) AND s.j = CAST(floor((py-{s})/s.dx) AS INT) AND s.k = CAST(floor((pz-{s})/s.dx) AS INT) GROUP BY p.level,p.i,p.j,p.k,oi,oj,ok),
 uniq AS (SELECT level,i,j,k,sl,sx,sy,sz, first(sx-cx) d0, first(sy-cy) d1, first(sz-cz) d2, {", ".join(f"first(f_{x}) f_{x}, first(s_{x}) s_{x}" for x in fields)} FROM best GROUP BY level,i,j,k,sl,sx,sy,sz),
 norm AS (SELECT level,i,j,k,count(*) m,{sums},{more} FROM (SELECT *, d0*d0+d1*d1+d2*d2 q FROM uniq) WHERE q > 0 GROUP BY level,i,j,k),
 grad AS (SELECT level,i,j,k,{solved} FROM norm)"""


@query("gradient", f"{_CELLS}, {gradient_sql(['v'])} SELECT level,i,j,k, round(v_gx,8) AS v_gx, round(v_gy,8) AS v_gy, round(v_gz,8) AS v_gz FROM grad")
def _(spark, sf_dir):
    out = stencil.gradients(fixtures.mesh(spark, sf_dir), ["v"])
    return out.select(*_KEY, *[F.round(f"v_g{x}", 8).alias(f"v_g{x}") for x in "xyz"])


@query("gradient_magnitude", f"{_CELLS}, {gradient_sql(['v'])} SELECT level,i,j,k, round(sqrt(v_gx*v_gx+v_gy*v_gy+v_gz*v_gz),6) AS value FROM grad")
def _(spark, sf_dir):
    return stencil.gradient_magnitude(fixtures.mesh(spark, sf_dir), "v").select(*_KEY, r6("value", "value"))


@query("vorticity_mag", f"{_CELLS}, {gradient_sql(['momx', 'momy', 'momz'])} SELECT level,i,j,k, round(sqrt(pow(momz_gy-momy_gz,2)+pow(momx_gz-momz_gx,2)+pow(momy_gx-momx_gy,2)),6) AS value FROM grad WHERE level = 1")
def _(spark, sf_dir):
    return stencil.vorticity(fixtures.mesh(spark, sf_dir), "momx", "momy", "momz", level=1).select(*_KEY, r6("value", "value"))


# ---- surface fluxes and disk moments -----------------------------------------------------------------------------------

_STATE = dict(zip(flux.STATE, ("rho", "momx", "momy", "momz", "energy", "scalar", "bx", "by", "bz"), strict=True)) | {"temperature": "temp"}
_TBINS = (10000.0, 36000.0, 40000.0, 90000.0)


def area_sql(n: list[str], low: list[str], size: list[str], distance: str) -> str:
    left = f"({distance}" + "".join(f" - ({a})*CASE WHEN ({a}) >= 0 THEN {b} ELSE {b}+{c} END" for a, b, c in zip(n, low, size, strict=True)) + ")"
    cases = []
    for some in product((False, True), repeat=3):
        m = sum(some)
        if not m:
            continue
        here = " AND ".join(f"abs({a}) {'>' if s else '='} 0" for s, a in zip(some, n, strict=True))
        flat = "*".join(["1e0", *[c for s, c in zip(some, size, strict=True) if not s]])
        axes = [a for a in range(3) if some[a]]
        if m == 1:
            body = f"CASE WHEN {left} >= 0 AND {left} <= abs({n[axes[0]]})*{size[axes[0]]} THEN {flat} ELSE 0e0 END"
        else:
            terms = []
            for corner in product((0, 1), repeat=m):
                rest = left + "".join(f"-abs({n[a]})*{size[a]}" for a, b in zip(axes, corner, strict=True) if b)
                terms.append(f"{'-' if sum(corner) % 2 else '+'}pow(greatest(0e0, {rest}),{m - 1})")
            body = f"greatest(0e0, {flat}*({''.join(terms)})/({m - 1}e0*{'*'.join(f'abs({n[a]})' for a in axes)}))"
        cases.append(f"WHEN {here} THEN {body}")
    return f"(CASE {' '.join(cases)} ELSE 0e0 END)"


def _flux_columns(area: str, speed: str, nb: str) -> str:
    kin, mag = "(5e-1*(momx*momx+momy*momy+momz*momz)/rho)", '(5e-1*(bx*bx+"by"*"by"+bz*bz))'
    hyd = f"(energy-{mag})"
    p = f"({5 / 3 - 1!r}::DOUBLE*({hyd}-{kin}))"
    vb = '((momx*bx+momy*"by"+momz*bz)/rho)'
    return f"rho*{speed}*{area} f0, ({hyd}+{p})*{speed}*{area} f1, ((energy+{p}+{mag})*{speed}-{vb}*{nb})*{area} f2, scalar*{speed}*{area} f3"


def _sign_sql(keys: str) -> str:
    sums = ", ".join(f"round(coalesce(sum(CASE WHEN s.range = CASE WHEN f{n} < 0 THEN 0 ELSE 1 END THEN f{n} END),0e0),6) AS {c}" for n, c in enumerate(flux.COMPONENTS))
    return f"CAST(s.range AS INT) AS sign, {keys}, {sums}"


_TB_SQL = f"CASE WHEN temp < {_TBINS[0]!r} OR temp > {_TBINS[-1]!r} THEN NULL WHEN temp < {_TBINS[1]!r} THEN 0 WHEN temp < {_TBINS[2]!r} THEN 1 ELSE 2 END"


def _sphere_sql(radii: list[float], tbins: bool) -> str:
    rc = "sqrt(cx*cx+cy*cy+cz*cz)"
    area = area_sql([f"cx/{rc}", f"cy/{rc}", f"cz/{rc}"], ["x0", "y0", "z0"], ["dx", "dx", "dx"], "radius")
    radius = " UNION ALL ".join(f"SELECT {n} ri, {r!r}::DOUBLE radius" for n, r in enumerate(radii))
    near = "+".join(f"(CASE WHEN {a}0 <= 0 AND {a}0+dx >= 0 THEN 0e0 ELSE least({a}0*{a}0,({a}0+dx)*({a}0+dx)) END)" for a in "xyz")
    far = "+".join(f"greatest({a}0*{a}0,({a}0+dx)*({a}0+dx))" for a in "xyz")
    return f"""{_SHIFTED}, rad AS ({radius}), m AS (SELECT *, x0+dx/2e0 cx, y0+dx/2e0 cy, z0+dx/2e0 cz FROM leaf),
 a AS (SELECT *, {area} area, (cx*momx+cy*momy+cz*momz)/(rho*{rc}) speed, (cx*bx+cy*"by"+cz*bz)/{rc} nb, {_TB_SQL if tbins else "0"} tb FROM m, rad WHERE {near} <= radius*radius AND {far} >= radius*radius),
 f AS (SELECT ri, tb, {_flux_columns("area", "speed", "nb")} FROM a WHERE area > 0 AND rho > 0)
 SELECT CAST(rad.ri AS INT) AS radius_index, CAST(t.range AS INT) AS tbin, {_sign_sql("0 AS z").replace("0 AS z, ", "")} FROM rad CROSS JOIN range({3 if tbins else 1}) t CROSS JOIN range(2) s LEFT JOIN f ON f.ri = rad.ri AND f.tb = t.range GROUP BY rad.ri, t.range, s.range"""


def _round_flux(out: DataFrame, *keys: str) -> DataFrame:
    return out.select(*keys, *[r6(c, c) for c in flux.COMPONENTS])


@query("flux_sphere", _sphere_sql([1.3, 2.7, 3.9], False))
def _(spark, sf_dir):
    out = flux.flux_sphere(fixtures.mesh(spark, sf_dir, -4.0), _STATE, [1.3, 2.7, 3.9])
    return _round_flux(out, "radius_index", "tbin", "sign")


@query("flux_sphere_tbins", _sphere_sql([2.7], True))
def _(spark, sf_dir):
    out = flux.flux_sphere(fixtures.mesh(spark, sf_dir, -4.0), _STATE, 2.7, temperature_bins=_TBINS)
    return _round_flux(out, "radius_index", "tbin", "sign")


def _cylinder_sql(radius: float, heights: list[float]) -> str:
    r, rc = f"{radius!r}::DOUBLE", "sqrt(cx*cx+cy*cy)"
    wall = area_sql([f"cx/{rc}", f"cy/{rc}", "0e0"], ["x0", "y0", "greatest(z0,-h)"], ["dx", "dx", "(least(z0+dx,h)-greatest(z0,-h))"], r)
    near = "+".join(f"(CASE WHEN {a}0 <= 0 AND {a}0+dx >= 0 THEN 0e0 ELSE least({a}0*{a}0,({a}0+dx)*({a}0+dx)) END)" for a in "xy")
    far = "+".join(f"greatest({a}0*{a}0,({a}0+dx)*({a}0+dx))" for a in "xy")
    hs = " UNION ALL ".join(f"SELECT {n} hi, {h!r}::DOUBLE h" for n, h in enumerate(heights))
    return f"""{_SHIFTED}, hs AS ({hs}), m AS (SELECT *, x0+dx/2e0 cx, y0+dx/2e0 cy FROM leaf),
 c AS (SELECT * FROM m, hs WHERE {near} <= {r}*{r} AND rho > 0),
 a AS (SELECT *, 0 section, dx*dx area, momz/rho speed, bz nb FROM c WHERE z0 <= h AND z0+dx >= h UNION ALL SELECT *, 0, dx*dx, -momz/rho, -bz FROM c WHERE z0 <= -h AND z0+dx >= -h
  UNION ALL SELECT *, 1, {wall}, (cx*momx+cy*momy)/{rc}/rho, (cx*bx+cy*"by")/{rc} FROM c WHERE {far} >= {r}*{r} AND least(z0+dx,h) > greatest(z0,-h)),
 f AS (SELECT hi, section, {_flux_columns("area", "speed", "nb")} FROM a WHERE area > 0)
 SELECT CAST(hs.hi AS INT) AS height_index, CAST(t.range AS INT) AS section, {_sign_sql("0 AS tbin").replace("0 AS tbin", "CAST(0 AS INT) AS tbin")} FROM hs CROSS JOIN range(2) t CROSS JOIN range(2) s LEFT JOIN f ON f.hi = hs.hi AND f.section = t.range GROUP BY hs.hi, t.range, s.range"""


@query("flux_cylinder", _cylinder_sql(2.3, [0.8, 2.6]))
def _(spark, sf_dir):
    out = flux.flux_cylinder(fixtures.mesh(spark, sf_dir, -4.0), _STATE, 2.3, [0.8, 2.6])
    return _round_flux(out, "height_index", "section", "tbin", "sign")


_DISK = dict(zip(flux.DISK, ("rho", "momx", "momy", "energy", "bx", "by", "bz"), strict=True))
_EDGES = (0.0, 1.1, 2.4, 3.7)


@query("toomre_moments", f"""{_SHIFTED}, {gradient_sql(["gpot"], -4.0)},
 d AS (SELECT l.*, gpot_gx, gpot_gy, x0+dx/2e0 x, y0+dx/2e0 y, dx*dx*(least(z0+dx,1.3e0)-greatest(z0,-1.7e0)) vol FROM leaf l JOIN grad g USING (level,i,j,k) WHERE z0+dx > -1.7e0 AND z0 < 1.3e0),
 e AS (SELECT *, sqrt(x*x+y*y) r FROM d), f AS (SELECT *, CASE WHEN r > 3.7e0 THEN NULL WHEN r < 1.1e0 THEN 0 WHEN r < 2.4e0 THEN 1 ELSE 2 END rb, CASE WHEN r > 0 THEN 1e0/r ELSE 0e0 END ir FROM e WHERE rho > 0)
 SELECT CAST(t.range AS INT) AS rbin, round(coalesce(sum(rho*vol),0e0),6) AS mass, round(coalesce(sum(energy*vol),0e0),6) AS internal_energy, round(coalesce(sum((bx*bx+"by"*"by"+bz*bz)*vol),0e0),6) AS magnetic_square,
  round(coalesce(sum(rho*vol*((x*momx+y*momy)*ir/rho)),0e0),6) AS radial_momentum, round(coalesce(sum(rho*vol*((x*momx+y*momy)*ir/rho)*((x*momx+y*momy)*ir/rho)),0e0),6) AS radial_momentum_square,
  round(coalesce(sum(rho*vol*(x*gpot_gx+y*gpot_gy)*ir),0e0),6) AS radial_force, round(coalesce(sum(vol),0e0),6) AS volume FROM range(3) t LEFT JOIN f ON rb = t.range GROUP BY t.range""")  # fmt: skip
def _(spark, sf_dir):
    out = flux.disk_moments(fixtures.mesh(spark, sf_dir, -4.0), _DISK, "gpot", (-1.7, 1.3), _EDGES)
    return out.select("rbin", *[r6(c, c) for c in flux.MOMENTS])


# ---- particles ---------------------------------------------------------------------------------------------------------

_ID = ("chunk", "pidx")
_NAN = "NOT isnan(q) AND "


def _masks() -> None:
    guards = {"lt": f"({_NAN}q < 2.5e1)", "le": f"({_NAN}q <= 2.5e1)", "gt": f"({_NAN}q > 2.5e1)", "ge": f"({_NAN}q >= 2.5e1)", "eq": f"({_NAN}q = 2.5e1)", "ne": f"(NOT ({_NAN}q = 2.5e1))"}
    for name, sql in guards.items():

        @query(f"particle_{name}_mask", f"{_P} SELECT chunk, pidx, {sql} AS mask FROM p")
        def _(spark, sf_dir, name=name):
            return fixtures.particles(spark, sf_dir).select(*_ID, particles.compare_scalar(F.col("q"), name, 25.0).alias("mask"))

    others = {
        "abs_lt": (lambda: particles.abs_lt(F.col("q") - 20.0, 5.0), f"({_NAN}abs(q - 2e1) < 5e0)"),
        "isin": (lambda: ieee.isin(F.col("q"), [1.0, 7.0, 50.0, float("nan")]), f"({_NAN}q IN (1e0,7e0,5e1))"),
        "isfinite": (lambda: ieee.isfinite(F.col("q")), "isfinite(q)"),
        "and": (lambda: particles.all_of(ieee.isfinite(F.col("q")), ieee.gt(F.col("q"), 10.0), ieee.lt(F.col("b"), 3.0)), f"(isfinite(q) AND {_NAN}q > 1e1 AND b < 3e0)"),
    }
    for name, (build, sql) in others.items():

        @query(f"particle_{name}_mask", f"{_P} SELECT chunk, pidx, {sql} AS mask FROM p")
        def _(spark, sf_dir, build=build):
            return fixtures.particles(spark, sf_dir).select(*_ID, build().alias("mask"))


_masks()


@query("particle_filter", f"{_P} SELECT chunk, pidx, q FROM p WHERE isfinite(q) AND q > 1e1 AND species = 'R'")
def _(spark, sf_dir):
    rows = fixtures.particles(spark, sf_dir, "R")
    return rows.where(ieee.isfinite(F.col("q")) & ieee.gt(F.col("q"), 10.0)).select(*_ID, "q")


_DIVIDE = "CASE WHEN {b} = 0 THEN CASE WHEN {a} = 0 THEN 'NaN'::DOUBLE WHEN {a} > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END ELSE {a} / {b} END"


def _finite(c: Column) -> Column:
    """Infinities and NaN as large numbers, which any engine prints alike."""
    return F.when(F.isnan(c), F.lit(-9e99)).when(F.abs(c) == ieee.INF, F.when(c > 0, F.lit(9e99)).otherwise(F.lit(-8e99))).otherwise(F.round(c, 6))


def _finite_sql(x: str) -> str:
    return f"CASE WHEN isnan({x}) THEN -9e99 WHEN isinf({x}) THEN CASE WHEN {x} > 0 THEN 9e99 ELSE -8e99 END ELSE round({x},6) END"


def _arithmetic() -> None:
    sql = {"add": "a + b", "subtract": "a - b", "multiply": "a * b", "divide": _DIVIDE.format(a="a", b="b"), "power": "pow(a, b)"}
    for name, text in sql.items():

        @query(f"particle_{name}", f"{_P}, w AS (SELECT chunk, pidx, {text} AS v FROM p) SELECT chunk, pidx, {_finite_sql('v')} AS value FROM w")
        def _(spark, sf_dir, name=name):
            return fixtures.particles(spark, sf_dir).select(*_ID, particles.BINARY[name](F.col("a"), F.col("b")).alias("v")).select(*_ID, _finite(F.col("v")).alias("value"))

    sql = {"add": "b + 2.5e0", "subtract": "b - 2.5e0", "rsubtract": "2.5e0 - b", "multiply": "b * 2.5e0", "divide": "b / 2.5e0", "rdivide": _DIVIDE.format(a="2.5e0", b="b"), "power": "pow(a, 2.5e0)", "rpower": "pow(2.5e0, b)"}
    for name, text in sql.items():

        @query(f"particle_{name}_scalar", f"{_P}, w AS (SELECT chunk, pidx, {text} AS v FROM p) SELECT chunk, pidx, {_finite_sql('v')} AS value FROM w")
        def _(spark, sf_dir, name=name):
            x = F.col("a" if name == "power" else "b")
            return fixtures.particles(spark, sf_dir).select(*_ID, particles.SCALAR[name](x, F.lit(2.5)).alias("v")).select(*_ID, _finite(F.col("v")).alias("value"))


_arithmetic()


@query("particle_distance3", f"{_P} SELECT chunk, pidx, round(sqrt((x-y)*(x-y)+(y-z)*(y-z)+(z-x)*(z-x)),6) AS value FROM p")
def _(spark, sf_dir):
    x, y, z = (F.col(c) for c in "xyz")
    return fixtures.particles(spark, sf_dir).select(*_ID, r6(particles.distance3(x, y, z, y, z, x), "value"))


@query("particle_zip", f"{_P} SELECT s.chunk, s.pidx, s.x - t.y AS value FROM p s JOIN p t ON s.chunk = t.chunk AND s.pidx = t.pidx WHERE s.b < 4 AND t.b > 0")
def _(spark, sf_dir):
    rows = fixtures.particles(spark, sf_dir)
    both = particles.zip_columns(rows.where("b < 4").select(*_ID, "x"), rows.where("b > 0").select(*_ID, "y"))
    return both.select(*_ID, (F.col("x") - F.col("y")).alias("value"))


_ONE = {
    "sum": ("round(coalesce(sum(a),0e0),6)", "a", {}), "len": ("count(*)", "a", {}), "count": ("count(*) FILTER (a > 2e1)", "a", {}), "mean": ("round(avg(a),6)", "a", {}),
    "min": ("min(q) FILTER (isfinite(q))", "q", {}), "max": ("max(q) FILTER (isfinite(q))", "q", {}), "max_infinite": ("CASE WHEN max(q) FILTER (NOT isnan(q)) = 'Infinity'::DOUBLE THEN 9e99 ELSE max(q) FILTER (NOT isnan(q)) END", "q", {"finite_only": False}),
}
for _name, (_sql, _x, _opts) in _ONE.items():

    @query(f"particle_{_name}", f"{_P} SELECT {_sql} AS value FROM p")
    def _(spark, sf_dir, name=_name, x=_x, opts=_opts):
        out = particles.summary(fixtures.particles(spark, sf_dir), F.col(x), F.col("a") > 20, **opts)
        c = F.col(name.removesuffix("_infinite"))
        return out.select((c if name in ("len", "count") else F.when(c == ieee.INF, F.lit(9e99)).otherwise(F.round(c, 6))).alias("value"))


@query("particle_int64_sum", f"{_P} SELECT CAST(sum(pidx) AS BIGINT) AS value FROM p")
def _(spark, sf_dir):
    return fixtures.particles(spark, sf_dir).agg(F.sum("pidx").alias("value"))


def _edges_sql(weight: str = "1e0") -> str:
    return f"e(bin,lo,hi) AS (VALUES (0,0e0,3e0),(1,3e0,1e1),(2,1e1,2.5e1),(3,2.5e1,5e1)), h AS (SELECT CAST(e.bin AS INT) bin, lo, hi, coalesce(sum({weight}),0e0) c FROM e LEFT JOIN p ON isfinite(q) AND q >= lo AND (q < hi OR (bin = 3 AND q <= hi)) GROUP BY ALL)"


_HEDGES = [0.0, 3.0, 10.0, 25.0, 50.0]


def _edge_query(name: str, weight: str | None, density: bool, sql: str) -> None:
    @query(name, sql)
    def _(spark, sf_dir):
        out = particles.histogram_edges(fixtures.particles(spark, sf_dir), F.col("q"), _HEDGES, F.col(weight) if weight else None, density)
        return out.select("bin", "lo", "hi", F.round("count", 9 if density else 4).alias("count"))


_W = "CASE WHEN p.pidx IS NULL THEN NULL ELSE {} END"
_edge_query("particle_histogram1d", None, False, f"{_P}, {_edges_sql(_W.format('1e0'))} SELECT bin, lo, hi, round(c,4) AS count FROM h")
_edge_query("particle_histogram1d_weighted", "mass", False, f"{_P}, {_edges_sql('mass')} SELECT bin, lo, hi, round(c,4) AS count FROM h")
_edge_query("particle_histogram1d_density", None, True, f"{_P}, {_edges_sql(_W.format('1e0'))} SELECT bin, lo, hi, round(c/(sum(c) OVER ()*(hi-lo)),9) AS count FROM h")


@query("particle_topk_modes", f"{_P} SELECT CAST(row_number() OVER (ORDER BY c DESC, q DESC) - 1 AS INT) AS rank, q AS value, c AS count FROM (SELECT q, count(*) c FROM p WHERE isfinite(q) GROUP BY q) ORDER BY c DESC, q DESC LIMIT 7")
def _(spark, sf_dir):
    return particles.topk_modes(fixtures.particles(spark, sf_dir), F.col("q"), 7)


_DEPOSIT = """pb AS (SELECT *, CAST(floor(z) AS INT) k, x-5e-1 gu, y-5e-1 gv, CASE WHEN floor(x) < 4 THEN 0 ELSE 4 END i0, CASE WHEN floor(x) < 4 THEN 3 ELSE 7 END i1 FROM p WHERE mass > 0 AND mass <= 9e4 AND z >= 5e-1 AND z <= 6.5e0 AND floor(z) BETWEEN 0 AND 7),
 co AS (SELECT CAST(floor(gu) AS INT)+ca i, CAST(floor(gv) AS INT)+cb j, k, i0, i1, mass*(CASE WHEN ca=1 THEN gu-floor(gu) ELSE 1-(gu-floor(gu)) END)*(CASE WHEN cb=1 THEN gv-floor(gv) ELSE 1-(gv-floor(gv)) END) m FROM pb, (VALUES (0,0),(0,1),(1,0),(1,1)) c(ca,cb)),
 dep AS (SELECT i,j,k,sum(m) m FROM co WHERE i BETWEEN i0 AND i1 AND j BETWEEN 0 AND 7 AND m > 0 AND NOT (i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 AND k BETWEEN 2 AND 5) GROUP BY i,j,k)"""


@query("particle_cic_grid", f"{_P}, {_DEPOSIT} SELECT CAST(0 AS INT) AS level, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k, round(m,5) AS density FROM dep")
def _(spark, sf_dir):
    out = particles.cic_grid(fixtures.mesh(spark, sf_dir), fixtures.particles(spark, sf_dir), "z", (0.5, 6.5), 90000.0)
    return out.select(*_KEY, F.round("density", 5).alias("density"))


@query("particle_cic_projection", f"""{_P}, {_DEPOSIT}, pix AS (SELECT CAST(a.range AS INT) px, CAST(b.range AS INT) py, {_RECT[0]!r}::DOUBLE + a.range*{_DU!r}::DOUBLE pu, {_RECT[1]!r}::DOUBLE + b.range*{_DV!r}::DOUBLE pv FROM range({_RES[0]}) a, range({_RES[1]}) b)
 SELECT py, px, round(sum(m*greatest(0e0, least(i+1e0, pu+{_DU!r}::DOUBLE) - greatest(i, pu)) * greatest(0e0, least(j+1e0, pv+{_DV!r}::DOUBLE) - greatest(j, pv))),3) AS value FROM pix, dep GROUP BY py, px""")  # fmt: skip
def _(spark, sf_dir):
    out = particles.cic_project(fixtures.mesh(spark, sf_dir), fixtures.particles(spark, sf_dir), "z", (0.5, 6.5), _RECT, _RES, 90000.0)
    return out.select("py", "px", F.round("value", 3).alias("value"))
