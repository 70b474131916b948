"""Mesh and particle views of star-schema tables, for queries, tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.functions import ieee
from cellforge.operators.mesh import Mesh
from cellforge.plans.geometry import Block, Hierarchy, Level

FIELDS = ("v", "rho", "momx", "momy", "momz", "energy", "scalar", "bx", "by", "bz", "temp", "gpot")


def hierarchy(x0: float = 0.0, n: int = 8) -> Hierarchy:
    """n^3 unit cells in two blocks, the middle [n/4, 3n/4)^3 refined by 2 in two blocks."""
    q = n // 2
    levels = (Level(0, (1.0,) * 3, (x0,) * 3), Level(1, (0.5,) * 3, (x0,) * 3))
    blocks = (
        Block(0, 0, (0, 0, 0), (q - 1, n - 1, n - 1)), Block(0, 1, (q, 0, 0), (n - 1, n - 1, n - 1)),
        Block(1, 0, (q, q, q), (n - 1, 3 * q - 1, 3 * q - 1)), Block(1, 1, (n, q, q), (3 * q - 1, 3 * q - 1, 3 * q - 1)),
    )
    return Hierarchy(levels, blocks)


def mesh(spark: SparkSession, sf_dir: str, x0: float = 0.0, n: int = 8) -> Mesh:
    """Cells from lineitem, keys folded onto the index box, fields as averages of its measures."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    h, parts = hierarchy(x0, n), []
    for level, m in ((0, n), (1, 2 * n)):
        keys = [(F.col(c) % m).cast("int").alias(a) for c, a in (("l_orderkey", "i"), ("l_partkey", "j"), ("l_suppkey", "k"))]
        own = rows.select(*keys, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
        if level:
            for a in "ijk":
                own = own.where(F.col(a).between(n // 2, 3 * n // 2 - 1))
        q, d, t, p = (F.avg(c) for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice"))
        values = [q, q, d - 0.05, t - 0.04, d - t, p / 1000, F.count("*").cast("double"), q / 50, t * 2, d * 3, p]
        own = own.groupBy("i", "j", "k").agg(*[F.round(x, 6).alias(c) for x, c in zip(values, FIELDS, strict=False)])
        split = F.when(F.col("i") < (n // 2 if level == 0 else n), 0).otherwise(1)
        parts.append(own.select(F.lit(level).alias("level"), split.alias("block"), "i", "j", "k", *FIELDS[:-1]))
    cells = parts[0].unionByName(parts[1])
    x, y = h.centre(0), h.centre(1)
    return Mesh(cells.withColumn("gpot", F.lit(2.0) * (x * x + y * y)), h, FIELDS)


def particles(spark: SparkSession, sf_dir: str, species: str | None = None) -> DataFrame:
    """Particles from lineitem: one species a return flag, one chunk an order key modulo 8."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x = F.col("l_quantity") * 0.16
    out = rows.select(
        F.lit(0).alias("step"), (F.col("l_orderkey") % 8).cast("int").alias("chunk"), F.lit(0).alias("level"),
        F.when(F.floor(x) < 4, 0).otherwise(1).alias("grid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pidx"),
        x.alias("x"), (F.col("l_discount") * 80.0).alias("y"), (F.col("l_tax") * 100.0).alias("z"), F.col("l_extendedprice").alias("mass"),
        F.when(F.col("l_linenumber") == 7, F.lit(ieee.NAN)).when(F.col("l_linenumber") == 6, F.lit(ieee.INF)).otherwise(F.col("l_quantity")).alias("q"),
        F.col("l_quantity").alias("a"), (F.col("l_linenumber") - 2).cast("double").alias("b"), F.col("l_returnflag").alias("species"),
    )
    return out if species is None else out.where(F.col("species") == species)


# ---- the same views as SQL for DuckDB ----------------------------------------------------------------------------------

_AGGREGATES = """round(avg(l_quantity),6) v, round(avg(l_quantity),6) rho, round(avg(l_discount)-5e-2,6) momx, round(avg(l_tax)-4e-2,6) momy,
 round(avg(l_discount)-avg(l_tax),6) momz, round(avg(l_extendedprice)/1e3,6) energy, CAST(count(*) AS DOUBLE) scalar,
 round(avg(l_quantity)/5e1,6) bx, round(avg(l_tax)*2e0,6) "by", round(avg(l_discount)*3e0,6) bz, round(avg(l_extendedprice),6) temp"""


def cells_sql(x0: float = 0.0) -> str:
    def level(n: int, m: int) -> str:
        keys = f"CAST(l_orderkey%{m} AS INT) i, CAST(l_partkey%{m} AS INT) j, CAST(l_suppkey%{m} AS INT) k"
        return f"SELECT CAST({n} AS INT) AS level, {keys}, {_AGGREGATES} FROM lineitem GROUP BY 1,2,3,4"

    return f"""c0 AS ({level(0, 8)}), c1 AS (SELECT * FROM ({level(1, 16)}) WHERE i BETWEEN 4 AND 11 AND j BETWEEN 4 AND 11 AND k BETWEEN 4 AND 11),
 c2 AS (SELECT *, CASE WHEN level = 0 THEN 1e0 ELSE 5e-1 END dx FROM (SELECT * FROM c0 UNION ALL SELECT * FROM c1)),
 cells AS (SELECT *, CAST(CASE WHEN i < CASE WHEN level = 0 THEN 4 ELSE 8 END THEN 0 ELSE 1 END AS INT) block, ({x0!r}::DOUBLE)+i*dx x0, ({x0!r}::DOUBLE)+j*dx y0, ({x0!r}::DOUBLE)+k*dx z0,
   2e0*((({x0!r}::DOUBLE)+i*dx+dx/2e0)*(({x0!r}::DOUBLE)+i*dx+dx/2e0)+(({x0!r}::DOUBLE)+j*dx+dx/2e0)*(({x0!r}::DOUBLE)+j*dx+dx/2e0)) gpot FROM c2),
 leaf AS (SELECT * FROM cells WHERE NOT (level = 0 AND i BETWEEN 2 AND 5 AND j BETWEEN 2 AND 5 AND k BETWEEN 2 AND 5))"""


PARTICLES_SQL = """p AS (SELECT CAST(l_orderkey%8 AS INT) chunk, l_orderkey*10+l_linenumber pidx, l_quantity*1.6e-1 x, l_discount*8e1 y, l_tax*1e2 z, l_extendedprice mass,
 CASE WHEN l_linenumber = 7 THEN 'NaN'::DOUBLE WHEN l_linenumber = 6 THEN 'Infinity'::DOUBLE ELSE l_quantity END q, l_quantity a, CAST(l_linenumber - 2 AS DOUBLE) b, l_returnflag species FROM lineitem)"""
