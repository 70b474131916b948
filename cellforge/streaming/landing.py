"""Steps that land as files, analysed as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cellforge.operators.mesh import Mesh
from cellforge.plans.geometry import Hierarchy


def watch_cells(spark: SparkSession, path: str, schema, hierarchy: Hierarchy, analyse: Callable[[Mesh], DataFrame], out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Run `analyse` on each newly landed step of a cell table and append its rows, with the step, to `out`.

    A batch may hold several steps; each is written under its own step and batch, so that a replayed batch overwrites itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        fields = tuple(c for c in rows.columns if c not in ("step", "level", "block", "i", "j", "k"))
        for (step,) in rows.select("step").distinct().orderBy("step").collect():
            result = analyse(Mesh(rows.where(F.col("step") == step), hierarchy, fields))
            result.write.mode("overwrite").parquet(f"{out}/step={step}/batch={number}")
        rows.unpersist()

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def running_histogram(spark: SparkSession, path: str, schema, value: str, bins: int, bounds: tuple[float, float], watermark: str = "10 minutes", window: str = "5 minutes", time: str = "ts") -> DataFrame:
    """A stream of (window, bin, count): finite values in equal bins a time window; rows later than the watermark are dropped."""
    from cellforge.functions import ieee

    rows = spark.readStream.schema(schema).parquet(path).withWatermark(time, watermark)
    rows = rows.withColumn("bin", ieee.uniform_bin(F.col(value), *bounds, bins)).where("bin is not null")
    return rows.groupBy(F.window(time, window), "bin").count()
