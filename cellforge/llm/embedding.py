"""Near-duplicate vectors: spherical-cap filters of a random product code, verified by cosine."""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

#: Codes, and filters a vector exceeds in each on average.
CODES, FILTERS = 8, 10


#: Shorter vectors are padded with zeros, so that the halves of a rotated one tell enough words apart.
LEAST_DIM = 32


#: Code words beyond which a task's code books and inner products would outgrow it.
MOST_WORDS = 1 << 15


def code_words(n: int, filters: int = FILTERS) -> int:
    """Code words of each half of a direction: as many as leave unlike vectors an eighth of a filter each, for n vectors.

    They grow with the root of n up to MOST_WORDS (some 14 million vectors); with more, filters fill up in proportion to n:
    at 10**9 vectors some 10 unlike ones share a filter. No pair is lost by that, filters of any size are met in tiles.
    """
    return 1 << min(MOST_WORDS.bit_length() - 1, max(10, math.ceil(math.log2(max(1.0, 8.0 * n * filters)) / 2)))


#: Members of a filter that one task compares; larger filters are met by pairs of salted tiles.
TILE = 512
#: Bytes of a join's small side, at 32 a row, up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


@functools.lru_cache(maxsize=16)
def _book(dim: int, code: int, seed: int):
    """(rotation, two code books): the directions are the concatenations of a word of each, all of unit length."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cuts = [dim // 2, dim - dim // 2]
    books = [rng.standard_normal((code, d)) for d in cuts]
    return rotation, [b / np.linalg.norm(b, axis=1, keepdims=True) * math.sqrt(d / dim) if d else np.zeros((code, 0)) for b, d in zip(books, cuts, strict=True)]


def threshold(dim: int, code: int, filters: int, seed: int, sample: int = 200) -> float:
    """The inner product that `filters` of a code's directions exceed for a random unit vector, on average."""
    x = np.random.default_rng(seed + 1).standard_normal((sample, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, (a, b) = _book(dim, code, seed)
    y = x @ rotation
    left, right = y[:, : a.shape[1]] @ a.T, np.sort(y[:, a.shape[1] :] @ b.T, axis=1)
    low, high = -1.0, 1.0
    for _ in range(24):
        mid = (low + high) / 2
        n = sum(r.size * len(p) - int(np.searchsorted(r, mid - p).sum()) for p, r in zip(left, right, strict=True))
        low, high = (mid, high) if n > filters * sample else (low, mid)
    return high


def decode_filters(x: np.ndarray, code: int, seed: int, limit: float) -> list[np.ndarray]:
    """For each unit vector, all filters that it exceeds: the product code is list-decoded from the words of its halves."""
    rotation, (a, b) = _book(x.shape[1], code, seed)
    y = x @ rotation
    left, right = y[:, : a.shape[1]] @ a.T, y[:, a.shape[1] :] @ b.T
    out = []
    for p, q, most in zip(left, right, right.max(axis=1), strict=True):
        i = np.flatnonzero(p >= limit - most)
        j = np.flatnonzero(q >= limit - p[i].max()) if len(i) else i
        r, c = np.nonzero(p[i][:, None] + q[j][None, :] >= limit)
        out.append(i[r] * code + j[c])
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _filters(code: int, seeds: list[int], limits: list[float], dim: int):
    def run(batches):
        for b in batches:
            x = _unit(np.array(b.column(1).flatten(), np.float64).reshape(len(b), dim))
            x = np.pad(x, ((0, 0), (0, max(dim, LEAST_DIM) - dim)))
            each = [decode_filters(x, code, s, t) for s, t in zip(seeds, limits, strict=True)]
            got = [np.concatenate([f + r * code * code for r, f in enumerate(own)]) for own in zip(*each, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.int64()))], names=["rep", "filters"])

    return run, "rep long, filters array<long>"


def _group(here: int, p: int, q: int, rep, v, copies, filters: list, salt, cosine: float):
    """(members, links counted here, root of each) of one filter's members, or of two of its tiles."""
    rows, cols = (np.arange(len(rep)),) * 2 if p == q else (np.flatnonzero(salt == p), np.flatnonzero(salt == q))
    near = v[rows] @ v[cols].T >= cosine - 1e-12
    if p == q:
        near &= rows[:, None] < cols[None, :]
    i, j = np.nonzero(near)
    i, j = rows[i], cols[j]
    keep = np.concatenate([np.einsum("ij,ij->i", v[i[x : x + 65536]], v[j[x : x + 65536]]) >= cosine for x in range(0, len(i), 65536)] or [np.zeros(0, bool)])
    i, j = i[keep], j[keep]
    if not len(i):
        return None
    # A pair counts in its first common filter only.
    used = np.unique(np.concatenate([i, j]))
    at = np.full(len(rep), -1)
    at[used] = np.arange(len(used))
    low = [[f for f in filters[u] if f < here] for u in used.tolist()]
    names, inverse = np.unique(np.concatenate([np.array(x, np.int64) for x in low]), return_inverse=True)
    member = np.zeros((len(used), len(names)), np.float32)
    member[np.repeat(np.arange(len(used)), [len(x) for x in low]), inverse] = 1
    earlier = member @ member.T > 0
    x, y = at[i], at[j]
    new = ~earlier[x, y]
    x, y = x[new], y[new]
    if not len(x):
        return None
    own = copies[used]
    n = np.bincount(x, own[y], len(used)) + np.bincount(y, own[x], len(used))
    root = common.local_labels(len(used), x, y)
    k = np.flatnonzero(n)
    return rep[used][k], n[k].astype(np.int64), rep[used][root][k]


#: Members up to which filters are compared side by side rather than one by one.
_SMALL = 16


def _compare(cosine: float):
    names = ["node", "n", "root"]

    def batch(parts):
        cols = [np.concatenate([p[k] for p in parts] or [np.empty(0, np.int64)]) for k in range(3)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def compare(t: pa.Table):
        """All whole groups of a table sorted by f, p, q."""
        f, p, q, rep, copies, salt = (t.column(c).to_numpy() for c in ("f", "p", "q", "rep", "copies", "salt"))
        v = _unit(t.column("v").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(f), -1))
        filters = t.column("filters").combine_chunks()
        first = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))
        size = np.diff(np.append(first, len(f)))
        group = np.repeat(np.arange(len(first)), size)
        single = (size <= _SMALL) & (p[first] == q[first])
        out, small = [], single[group]
        for s in range(1, int(size[single].max(initial=1))):
            i = np.flatnonzero(small[:-s] & (group[:-s] == group[s:]))
            i = i[np.einsum("ij,ij->i", v[i], v[i + s]) >= cosine]
            for a in i.tolist():
                if min(set(filters[a].as_py()) & set(filters[a + s].as_py())) == f[a]:
                    x, y = (a, a + s) if rep[a] < rep[a + s] else (a + s, a)
                    out.append((rep[[x, y]], copies[[y, x]], rep[[x, x]]))
        for g in np.flatnonzero(~single).tolist():
            x, y = first[g], first[g] + size[g]
            got = _group(int(f[x]), int(p[x]), int(q[x]), rep[x:y], v[x:y], copies[x:y], filters[x:y].to_pylist(), salt[x:y], cosine)
            if got:
                out.append(got)
        return batch(out)

    def run(batches):
        held = None
        for b in batches:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not len(t):
                continue
            # the last group may go on in the next batch
            f, p, q = (t.column(c).to_numpy() for c in ("f", "p", "q"))
            last = int(np.flatnonzero((f != f[-1]) | (p != p[-1]) | (q != q[-1])).max(initial=-1)) + 1
            held = t.slice(last).combine_chunks()
            if last:
                yield compare(t.slice(0, last))
        yield compare(held) if held is not None and len(held) else batch([])

    return run, "node long, n long, root long"


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, code: int | None = None, codes: int = CODES, filters: int = FILTERS, tile: int = TILE, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id) for every row: links are pairs whose cosine in double precision is at least `cosine`.

    Null, empty and zero vectors and those with null or non-finite components link with nothing; vectors of different
    lengths don't link. Equal vectors are one class, so copies are counted, not paired; a row that repeats a vec_id counts as
    a vector. A pair of classes is found if both exceed a common filter. No rows give no rows.
    """
    clean = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0)
    # single-precision components stay so on their way; 0.0 and -0.0 are one value
    kind = "float" if rows.schema[vec_col].dataType.elementType.typeName() == "float" else "double"
    v = F.when(clean, F.transform(vec_col, lambda x: x.cast(kind) + F.lit(0.0).cast(kind)))
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")]  # 128 bits tell vectors apart
    all_rows = common.cut(rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).select("vec_id", "v", *key), "vectors")
    classes = all_rows.where("v is not null").groupBy("k1", "k2").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.cut(classes.where("rep is not null"), "classes")
    parts, cuts = [], []
    for dim in sorted(r[0] for r in classes.select(F.size("v")).distinct().collect()):
        some = classes.where(F.size("v") == dim)
        words = code or code_words(some.count(), filters)
        seeds = [seed + 2 * r for r in range(codes)]
        run, ddl = _filters(words, seeds, [threshold(max(dim, LEAST_DIM), words, filters, s) for s in seeds], dim)
        coded = common.cut(common.map_arrow(some.select("rep", "v"), run, ddl), "coded")
        member = coded.select("rep", F.explode("filters").alias("f"))
        shared = common.cut(member.groupBy("f").agg(F.count("*").alias("members")).where("members > 1"), "shared")
        live = member.join(F.broadcast(shared) if 32 * shared.count() <= BROADCAST_BYTES else shared, "f")
        live = live.groupBy("rep").agg(F.collect_list(F.struct("f", "members")).alias("fs"))  # as many as a vector has filters
        each = classes.join(live, "rep").select("rep", "v", "copies", F.col("fs.f").alias("filters"), F.explode("fs").alias("m"))
        salts = F.ceil(F.col("m.members") / tile).cast("int")
        each = each.withColumn("salt", F.pmod(F.xxhash64("rep"), salts).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), salts - 1)))
        # a pair counts in its first common filter, so only the filters before this one go along
        before = F.filter("filters", lambda x: x <= F.col("m.f"))
        each = each.select(F.col("m.f").alias("f"), F.least("salt", "y").alias("p"), F.greatest("salt", "y").alias("q"), "rep", "v", "copies", before.alias("filters"), "salt")
        run, ddl = _compare(cosine)
        parts.append(common.map_arrow(each.repartition("f", "p", "q").sortWithinPartitions("f", "p", "q"), run, ddl))
        cuts += [coded, shared]
    if parts:
        found = parts[0]
        for more in parts[1:]:
            found = found.unionAll(more)
        found = common.cut(found, "found")
        for done in cuts:
            common.drop(done)
        links = found.groupBy("node").agg(F.sum("n").alias("n"))
        comp = common.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
        info = classes.select("k1", "k2", "rep", "copies").join(links, F.col("rep") == F.col("node"), "left").drop("node")
        info = info.join(comp, F.col("rep") == F.col("node"), "left")
        info = info.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    else:
        info = classes.select("k1", "k2", (F.col("copies") - 1).alias("n_links"), F.col("rep").alias("component_id"))
    clean_rows = all_rows.where("v is not null").select("vec_id", "k1", "k2").join(info, ["k1", "k2"], "left")
    clean_rows = clean_rows.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return clean_rows.unionAll(all_rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def op3_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: All pairs and their closure, for small tables. Components count as of full precision; a vector is scaled by its largest first.
ORACLE_SQL = """
WITH RECURSIVE clean AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scaled AS (SELECT vec_id, list_transform(e, lambda x: x / list_max(list_transform(e, lambda y: abs(y)))) AS e FROM clean),
units AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n, len(e) AS d FROM scaled),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.d = b.d AND a.vec_id <> b.vec_id WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id
"""
