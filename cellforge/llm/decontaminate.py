"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

SHINGLE, THRESHOLD = 5, 0.8
#: MinHash values of a window and an item; one equal value makes a candidate.
HASHES = 48
#: Items that one broadcast index holds; a larger benchmark is met in blocks, each against all documents.
ITEMS_PER_BLOCK = 20_000

# ASCII marks count as white space; A-Z are lower-cased.
_WORDS = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\n\v\f\r" else c + 32 * (65 <= c <= 90) for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each run of k words; none if there are fewer."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e]) for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def _permutations(n: int) -> np.ndarray:
    """Rows of an odd factor and an offset, on 32 bits."""
    draw = np.random.default_rng(6).integers(0, 1 << 31, (n, 2), dtype=np.int64)
    return np.stack([2 * draw[:, 0] + 1, draw[:, 1]], axis=1).astype(np.uint32)


def _mixed(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    return h * p[0] + p[1]


class Index:
    """MinHash values of items, partitioned by shingle length and size, and their exact shingles.

    Items of fewer than k words are one shingle of all their words. A partition's windows are two blocks of as many shingles
    as its largest item has: each run of that length lies whole in a window, so the windows are short however long the
    document, and an item in one has a resemblance of a fifth at least. Items of fewer distinct shingles, at most half a
    block, are looked up by each shingle's own hash instead.
    """

    def __init__(self, items: list[tuple[int, str]], k: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES):
        self.threshold, self.factors = threshold, _permutations(hashes)
        self.items, self.parts, self.short = {}, {}, {}
        short: dict[int, list] = {}
        parts: dict[tuple[int, int], list] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            n = min(k, len(words))
            h = np.unique(shingle_hashes(words, n))
            self.items[name] = (n, h, frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
            block = max(4, 1 << math.ceil(math.log2(max(len(words) - n + 1, 1))))
            if 2 * len(h) <= block:
                short.setdefault(n, []).extend((x, name) for x in h.tolist())
            else:
                parts.setdefault((n, block), []).append(name)
        for n, own in short.items():
            own.sort()
            value = np.array([x for x, _ in own], np.uint64)
            low = np.zeros(1 << 16, bool)
            low[value & np.uint64(0xFFFF)] = True
            self.short[n] = (value, [name for _, name in own], low)
        for key, names in parts.items():
            tables = []
            for p in self.factors:
                value = np.array([_mixed(_upper(self.items[x][1]), p).min() for x in names], np.uint32)
                by = np.argsort(value, kind="stable")
                low = np.zeros(1 << 16, bool)
                low[value & np.uint32(0xFFFF)] = True
                tables.append((value[by], by, low))
            self.parts[key] = (names, tables)

    def candidates(self, docs: list[list[bytes]]) -> list[set[int]]:
        """Each document's candidate items; the windows run over all documents' shingles, one after another."""
        out: list[set[int]] = [set() for _ in docs]
        for n in sorted({n for n, _ in self.parts} | set(self.short)):
            each = [shingle_hashes(w, n) for w in docs]
            ends = np.cumsum([len(h) for h in each])
            if not len(ends) or not ends[-1]:
                continue
            h = np.concatenate(each)
            if n in self.short:
                value, names, low = self.short[n]
                at = np.flatnonzero(low[h & np.uint64(0xFFFF)])
                left, right = np.searchsorted(value, h[at], "left"), np.searchsorted(value, h[at], "right")
                hit = left < right
                whose = np.searchsorted(ends, at[hit], "right")
                for d, x, y in zip(whose.tolist(), left[hit].tolist(), right[hit].tolist(), strict=True):
                    out[d].update(names[x:y])
            sizes = sorted(b for k, b in self.parts if k == n)
            if not sizes:
                continue
            h = _upper(h)
            h = np.concatenate([h, np.full(-len(h) % sizes[0], h[-1], np.uint32)])
            for i, p in enumerate(self.factors):
                least, size = _mixed(h, p), 1
                for block in sizes:
                    while size < block:
                        if size >= sizes[0] and len(least) % 2:
                            least = np.append(least, least[-1])
                        least, size = np.minimum(least[::2], least[1::2]), 2 * size
                    names, tables = self.parts[n, block]
                    value, by, low = tables[i]
                    window = np.minimum(least[:-1], least[1:]) if len(least) > 1 else least
                    at = np.flatnonzero(low[window & np.uint32(0xFFFF)])
                    if not len(at):
                        continue
                    left, right = np.searchsorted(value, window[at], "left"), np.searchsorted(value, window[at], "right")
                    for w, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True):
                        if x < y:
                            found = [names[j] for j in by[x:y].tolist()]
                            first, last = np.searchsorted(ends, [w * block, min((w + 2) * block, int(ends[-1])) - 1], "right")
                            for d in range(first, last + 1):
                                out[d].update(found)
        return out

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """Each text's (item, containment), by item, of the items whose shingles it has to the threshold at least."""
        docs = [words_of(t) for t in texts]
        out = []
        for words, names in zip(docs, self.candidates(docs), strict=True):
            own: dict[int, set] = {}
            found = []
            for name in sorted(names):
                n, _, shingles = self.items[name]
                if n not in own:
                    own[n] = {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
                share = len(shingles & own[n]) / len(shingles)
                if share >= self.threshold:
                    found.append((name, share))
            out.append(found)
        return out


def _upper(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32)


def find(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES, block: int = ITEMS_PER_BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) of documents that hold `threshold` of an item's distinct k-word shingles.

    Null and empty texts match nothing, nor do items without a word; items of one id count apart. Words are lower-cased in
    A-Z and parted by ASCII white space and marks.
    """
    ddl, parts = "doc_id long, item_id long, containment double", []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for index in _indexes(benchmark, k, threshold, hashes, block):

        def run(batches, index=index):
            names, own = index.value
            for b in batches:
                out = [[], [], []]
                docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                for x, y in common.slices(texts):
                    for doc, found in zip(docs[x:y], own.matches(texts[x:y]), strict=True):
                        for i, share in found:
                            for o, v in zip(out, (doc, names[i], share), strict=True):
                                o.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["doc_id", "item_id", "containment"])

        parts.append(common.map_arrow(rows, run, ddl))
    if not parts:
        return rows.sparkSession.createDataFrame([], ddl)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionAll(more)
    return out


def _indexes(benchmark: DataFrame, k: int, threshold: float, hashes: int, block: int):
    """Broadcast (item ids, index) of the benchmark, `block` items at a time."""
    items = iter(benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator())
    while some := [tuple(r) for _, r in zip(range(block), items, strict=False)]:
        yield benchmark.sparkSession.sparkContext.broadcast(([name for name, _ in some], Index([(i, text) for i, (_, text) in enumerate(some)], k, threshold, hashes)))


def clean(docs: DataFrame, benchmark: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES, block: int = ITEMS_PER_BLOCK, text_col: str = "text") -> DataFrame:
    """docs without the rows that find() would list, whatever their ids."""
    for index in _indexes(benchmark, k, threshold, hashes, block):

        def run(batches, index=index):
            for b in batches:
                texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
                yield b.filter(pa.array([not found for x, y in common.slices(texts) for found in index.value[1].matches(texts[x:y])], pa.bool_()))

        docs = common.map_arrow(docs, run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.round("containment", 6).alias("containment"))


def _sql_shingles(name: str, table: str, key: str) -> str:
    marks = r"[\x09-\x0D !-/:-@\[-`{-~]+"
    return f"""
{name}_w AS (SELECT {key}, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{marks}'), lambda x: x <> '') w FROM {table}),
{name} AS (SELECT DISTINCT {key}, array_to_string(w[i:i + 4], ' ') s FROM (SELECT {key}, w, unnest(range(1, len(w) - 3)) i FROM {name}_w))"""


ORACLE_SQL = f"""
WITH {_sql_shingles("items", "benchmark", "item_id")},
{_sql_shingles("docs", "documents", "doc_id")},
sizes AS (SELECT item_id, count(*) n FROM items GROUP BY item_id)
SELECT doc_id, item_id, round(count(*) / CAST(any_value(n) AS DOUBLE), 6) AS containment
FROM docs JOIN items USING (s) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)
"""
