"""SimHash near-duplicates: exact tiled comparison of fingerprints."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

SEED, RADIUS, BLOCKS = 42, 3, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the shingles' XXH64; text without words (or null) has fingerprint zero.

    Words are what ASCII white space divides, A-Z lower-cased; repeats count; fewer words than a shingle make one.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, key, fp long) for every row of docs; key: XXH64 of the text."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, shingle) for t in b.column(2).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "key", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return common.map_arrow(rows, run, "doc_id long, key long, fp long")


def _near(u: np.ndarray, v: np.ndarray, radius: int):
    """Index pairs of u x v within radius; rows of tiles whose bit counts differ by more are skipped."""
    cu, cv = np.bitwise_count(u), np.bitwise_count(v)
    ou, ov = np.argsort(cu, kind="stable"), np.argsort(cv, kind="stable")
    cu, cv = cu[ou].astype(np.int64), cv[ov].astype(np.int64)
    for i in range(0, len(u), 256):
        rows = ou[i : i + 256]
        lo, hi = np.searchsorted(cv, [cu[i] - radius, cu[min(i + 255, len(u) - 1)] + radius + 1])
        if hi > lo:
            cols = ov[lo:hi]
            x, y = np.nonzero(np.bitwise_count(u[rows][:, None] ^ v[cols][None, :]) <= radius)
            yield rows[x], cols[y]


def _compare(radius: int, width: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, t):
        _, _, w, a, x = (k.as_py() for k in key)
        fp, rep, salt = (t.column(c).to_numpy() for c in ("fp", "rep", "salt"))
        fp = fp.view(np.uint64)
        low = np.bitwise_count(fp).astype(np.int64) // width == w
        if a == x:
            tiles = [(low, low), (low, ~low)]
        else:
            p, q = salt == a, salt == x
            tiles = [(low & p, low & q), (low & p, ~low & q), (~low & p, low & q)]
        root = np.arange(len(fp))
        for p, q in tiles:
            p, q = np.flatnonzero(p), np.flatnonzero(q)
            for i, j in _near(fp[p], fp[q], radius):
                i, j = root[p[i]], root[q[j]]
                far = i != j
                if far.any():
                    root = common.local_labels(len(fp), np.concatenate([np.arange(len(fp)), i[far]]), np.concatenate([root, j[far]]))
        k = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table([pa.array(rep[k]), pa.array(rep[root[k]])], schema=schema)

    return run


def links(classes: DataFrame, radius: int = RADIUS, group: int = 4096, tile: int = 2048) -> DataFrame:
    """Edges (a, b) between representatives of classes (fp, rep) that make the same components as all pairs within radius.

    Two fingerprints within 3 bits agree on one of 4 blocks of 16 bits. Each block's low bits, as many as leave about
    `group` rows a value, and a window of two bit-count ranges are a key; rows of a key with more than `tile` rows are
    salted and met by pairs of salts. So every tile pair is bounded, and none is skipped but by its bit counts.
    """
    spark, width = classes.sparkSession, radius + 1
    n = classes.count()
    bits = max(0, min(64 // BLOCKS, math.ceil(math.log2(max(n, 1) / group))))
    mask = (1 << bits) - 1
    block = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("fp", 16 * j).bitwiseAND(F.lit(mask)).cast("int").alias("v")) for j in range(radius + 1)]))
    rng = F.floor(F.bit_count("fp") / width).cast("int")
    rows = classes.where("rep is not null").select("fp", "rep", block.alias("k"), F.explode(F.array(rng - 1, rng)).alias("w")).select("fp", "rep", "k.j", "k.v", "w")
    hot = rows.groupBy("j", "v", "w").count().where(F.col("count") > tile)
    hot = common.cut(hot.select("j", "v", "w", F.ceil(F.col("count") / tile).cast("int").alias("salts")), "hot")
    if (many := hot.count()) == 0:
        rows = rows.withColumns({"salt": F.lit(0), "a": F.lit(0), "x": F.lit(0)})
    else:
        rows = rows.join(F.broadcast(hot) if many <= 10_000 else hot, ["j", "v", "w"], "left")
        salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("salts"))).cast("int")
        rows = rows.withColumn("salt", salt).withColumn("y", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        rows = rows.withColumns({"a": F.least("salt", "y"), "x": F.greatest("salt", "y")})
    rows = rows.select("j", "v", "w", "a", "x", "fp", "rep", "salt")
    return rows.groupBy("j", "v", "w", "a", "x").applyInArrow(_compare(radius, width), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long, component_id): near duplicates by fingerprints that differ in at most radius bits.

    Null and empty texts have fingerprint zero and link like any other. Rows that repeat a doc_id are one document. A null
    doc_id keeps a row of its own fingerprint's component. Other columns of docs are not read. No rows give no rows.
    """
    if radius != RADIUS:
        raise ValueError("the blocks are laid out for a radius of 3")
    fps = common.cut(fingerprints(docs, id_col, text_col, shingle), "fps")
    classes = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    found = common.components(links(classes, radius))
    named = classes.join(found, classes["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = 3) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id, then of the least hash of its text.

    Rows are told apart by doc_id and text, so rows that repeat a doc_id with other texts are rows of their own; of rows that
    repeat both, the least in order of their columns stays. Null doc_ids come last. Null and empty texts are one group, and no
    rows give none. Columns stay as they are, whatever their names.
    """
    fps = common.cut(fingerprints(docs, id_col, text_col, shingle), "fps")
    # a fingerprint is its own class's name here
    classes = common.cut(fps.select("fp", F.col("fp").alias("rep")).distinct(), "classes")
    # written first, so that no task needs two Python workers, which would all stay and grow in later stages
    edges = common.cut(links(classes, radius), "links")
    found = common.components(edges)
    common.drop(edges)
    named = fps.join(found, fps["fp"] == found["node"], "left").select("doc_id", "key", F.coalesce("component", "fp").alias("c"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = named.groupBy("c").agg(F.min(order).alias("o")).select(F.col("c").alias("b"), "o.*")
    best = best.select("b", F.col("doc_id").alias("b_doc"), F.col("key").alias("b_key"))
    gone = named.join(best, named["c"] == best["b"]).where(~(F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("key") == F.col("b_key"))))
    gone = common.cut(gone.select("doc_id", "key").distinct(), "gone")
    again = fps.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key")
    again = common.cut(_without(again, gone, "doc_id", F.col("key")), "again")
    common.drop(classes)
    text = F.xxhash64(text_col)
    docs = _without(docs, gone, id_col, text)
    if again.isEmpty():
        return docs
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    some = _matched(docs, again, id_col, text, "left_semi").groupBy(F.col(id_col).alias("i"), text.alias("k")).agg(F.min(row).alias("r")).select("r.*")
    return _without(docs, again, id_col, text).unionAll(some)


#: Bytes of two longs and a row's overhead, and those of a join's small side up to which it is broadcast.
_PAIR_BYTES, BROADCAST_BYTES = 64, 32 << 20


def _matched(docs: DataFrame, pairs: DataFrame, id_col: str, text, how: str) -> DataFrame:
    o = pairs.select(F.col("doc_id").alias("o_doc"), F.col("key").alias("o_key"))
    o = F.broadcast(o) if pairs.count() * _PAIR_BYTES <= BROADCAST_BYTES else o
    return docs.join(o, docs[id_col].cast("long").eqNullSafe(o["o_doc"]) & (text == o["o_key"]), how)


def _without(docs: DataFrame, pairs: DataFrame, id_col: str, text) -> DataFrame:
    """docs without the rows of these (doc_id, hash of the text)."""
    return _matched(docs, pairs, id_col, text, "left_anti")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
