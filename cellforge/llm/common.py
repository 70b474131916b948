"""Shared helpers: shared-folder tables, distributed components, tile keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a batch that a Python worker gets at a time; a longer row is a batch of its own.
BATCH_BYTES = 1 << 20
#: Rows that Spark's Parquet reader holds at a time; of whole texts, its 4,096 grow every JVM's heap by hundreds of MB.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few_rows(spark: SparkSession) -> None:
    """Parquet is read in batches of BATCH_ROWS at most, by the session's setting; for steps that read whole texts."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if int(spark.conf.get(name)) > BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where none is set and all tasks run on this machine."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        root = tempfile.mkdtemp(prefix="cellforge-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def _give_back() -> None:
    """Freed memory back to the system, as workers wait for their next task with all that they hold."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _bytes(setting: str) -> int:
    """A size as Spark gives it: digits, then b or nothing; others count as large."""
    digits = setting.lower().rstrip("b")
    return int(digits) if digits.isdecimal() else 1 << 62


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES, by the session's setting, so that workers are small whatever the rows."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(conf.get(name)) > BATCH_BYTES:
        conf.set(name, BATCH_BYTES)

    def trimmed(batches):
        yield from run(batches)
        _give_back()

    return df.mapInArrow(trimmed, schema)


def replaced(schema, *names: str) -> list:
    """The fields of a schema but those of these names, which an operator's own columns take the place of."""
    return [f for f in schema.fields if f.name.lower() not in {n.lower() for n in names}]


def without(batch: pa.RecordBatch, *names: str) -> tuple[list, list[str]]:
    """Columns and names of a batch but those of these names."""
    low = {n.lower() for n in names}
    kept = [i for i, n in enumerate(batch.schema.names) if n.lower() not in low]
    return [batch.column(i) for i in kept], [batch.schema.names[i] for i in kept]


def slices(texts: list[str | None], most: int = 1 << 19):
    """Ranges of texts of about `most` characters, so that few words are in memory at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most or i + 1 == len(texts):
            yield start, i + 1
            start, size = i + 1, 0


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it again: a short lineage that survives lost executors."""
    path = f"{shared_root(df.sparkSession)}/cellforge-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete the files of a cut() table that nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component, for n nodes and edges (a, b)."""
    p = np.arange(n)
    if not len(a):
        return p
    while True:
        q = p.copy()
        pa, pb = p[a], p[b]
        low = np.minimum(pa, pb)
        np.minimum.at(q, pa, low)
        np.minimum.at(q, pb, low)
        while True:
            r = q[q]
            if np.array_equal(r, q):
                break
            q = r
        if np.array_equal(q, p):
            return p
        p = q


def _local_forest(batches):
    for batch in batches:
        x, y = (np.asarray(batch.column(i)) for i in (0, 1))
        ids, inv = np.unique(np.concatenate([x, y]), return_inverse=True)
        root = local_labels(len(ids), inv[: len(x)], inv[len(x) :])
        k = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[k]), pa.array(ids[root[k]])], names=["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long) as (node, component), component being the smallest node.

    Each batch is first reduced to a spanning forest, then large-star and small-star steps alternate until the edge set
    stands still. Minima are partial aggregates and joins have one unique side, so hubs are split rather than gathered.
    Nodes without a link are absent; null ends and loops are ignored.
    """
    e = edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    e = e.where((edges["a"].isNotNull()) & (edges["b"].isNotNull()) & (F.col("hi") != F.col("lo")))
    e = cut(map_arrow(e, _local_forest, "hi long, lo long").distinct(), "edges")
    before = None
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionAll(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = cut(e.withColumnRenamed("lo", "u").join(low, "u").select("hi", F.col("m").alias("lo")).distinct(), "large")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = cut(small.unionAll(low.select("hi", F.col("m").alias("lo"))).distinct(), "small")
        stat = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        drop(e)
        drop(large)
        e = after
        if tuple(stat) == before:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        before = tuple(stat)
