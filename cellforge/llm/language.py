"""Language identification: known words by log frequency, other words by ever shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

#: Bounds of the training sample, in rows of each language, and of the words kept for each.
MAX_ROWS, MAX_WORDS = 3000, 20_000
ORDERS = (5, 4, 3, 2, 1)
#: Languages whose row counts are broadcast, at some 64 bytes each.
MAX_BROADCAST = 500_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters, of Unicode's categories L, in lower case; other numbers than digits, such as \u00b2, part them too."""
    words = _WORD.findall((text or "").lower())
    if not words or "".join(words).isalpha():
        return words
    return [own for w in words for own in "".join(c if c.isalpha() else " " for c in w).split()]


@dataclass
class Model:
    """langs, and the log frequencies of words and n-grams: each one's row, and a column a language."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    word_logs: np.ndarray
    gram_logs: np.ndarray

    def word(self, w: str) -> np.ndarray:
        """A word's scores: its own, or at each place those of the longest known n-gram that starts there, on average."""
        at = self.words.get(w)
        if at is not None:
            return self.word_logs[at]
        padded, get, rows = f" {w} ", self.grams.get, []
        for i in range(len(padded) - 1):
            for k in ORDERS:
                at = get(padded[i : i + k])
                if at is not None:
                    rows.append(at)
                    break
        return np.add.reduce(self.gram_logs[rows], axis=0, dtype=np.float64) / len(rows) if rows else np.zeros(len(self.langs))


class Scorer:
    """Whole texts against a model, with a bounded cache of word scores."""

    def __init__(self, model: Model, limit: int = 300_000):
        self.model, self.limit = model, limit
        self.table = np.zeros((limit, len(model.langs)), np.float32)
        self.places: dict[str, int] = {}

    def _place(self, w: str) -> int:
        at = self.places.get(w)
        if at is None:
            at = self.places[w] = len(self.places)
            if at >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[at] = self.model.word(w)
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        if len(self.places) > self.limit:
            self.places = {}
        at = list(map(self.places.get, words))
        if None in at:
            at = [self._place(w) if x is None else x for w, x in zip(words, at, strict=True)]
        total = self.table[at].sum(axis=0, dtype=np.float64)
        z = (total - total.max()) / math.sqrt(len(words))
        p = np.exp(z)
        best = int(total.argmax())
        return self.model.langs[best], float(p[best] / p.sum())


def _counts(batches):
    for b in batches:
        seen: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen[lang].update(words_of(text))
        langs, words, n = ([x for lang, own in seen.items() for x in cells(lang, own)] for cells in (lambda lang, own: [lang] * len(own), lambda lang, own: own, lambda lang, own: own.values()))
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "w", "n"])


def _logs(counts: np.ndarray, total: np.ndarray, max_words: int) -> np.ndarray:
    return np.log((counts + 0.5) / (total + 0.5 * max_words)).astype(np.float32)


def fit(rows: DataFrame, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS) -> Model:
    """Learn from rows (text, lang, key); null texts and languages are left out.

    About max_rows rows a language are read, by a hash of key and text, so that rows that repeat both are read together, and the
    max_words most frequent words kept of each, the lesser of equally frequent ones; n-grams are those of the kept words, a
    blank before and after, weighted by frequency. Without rows there is no language, and every text is `und`.
    """
    rows = rows.where("text is not null and lang is not null").select("text", "lang", "key")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    # a row a language; with very many of them both sides are shuffled
    part = rows.join(F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST else sizes, "lang").where(F.pmod(F.xxhash64("key", "text"), F.col("n")) < max_rows)
    words = common.map_arrow(part.select("lang", "text"), _counts, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    words = common.cut(words, "words")
    ranked = words.selectExpr("lang", "w", "n", "row_number() over (partition by lang order by n desc, w) as r").where(F.col("r") <= max_words)
    totals = {r.lang: r.n for r in words.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(totals)
    place = {x: i for i, x in enumerate(langs)}
    kept: dict[str, int] = {}
    grams: dict[str, int] = {}
    cells, parts = [], []
    for lang, w, n, _ in ranked.collect():
        i = place[lang]
        cells.append((kept.setdefault(w, len(kept)), i, n))
        padded = f" {w} "
        for k in ORDERS:
            for j in range(len(padded) - k + 1):
                parts += (grams.setdefault(padded[j : j + k], len(grams)), i, n)
    common.drop(words)

    def table(found, size: int) -> np.ndarray:
        out, found = np.zeros((size, len(langs))), np.array(found, np.int64).reshape(-1, 3)
        np.add.at(out, (found[:, 0], found[:, 1]), found[:, 2])
        return out

    counts, seen = table(cells, len(kept)), table(parts, len(grams))
    order = np.array([len(g) for g in grams], int)
    total = np.zeros((max(ORDERS) + 1, len(langs)))
    common_blank = grams.get(" ")
    if common_blank is not None:
        seen[common_blank] = 0
    np.add.at(total, order, seen)
    often = np.flatnonzero(seen.sum(axis=1) > 1).tolist()
    names = list(grams)
    n = np.array([totals[x] for x in langs], float)
    return Model(langs, kept, {names[g]: i for i, g in enumerate(often)}, _logs(counts, n, max_words), _logs(seen[often], total[order[often]], max_words))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; `und` with score 0 for null and empty texts and those without a letter.

    Of languages that tie, the first by name. Rows are scored alone, so repeated ones alike; no rows give none, and other
    columns, whatever their names, aren't read.
    """
    wide = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(wide.value)
        for b in batches:
            got = [scorer(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, lang_pred string, score double")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs.where(~held).select("text", "lang", F.col("doc_id").alias("key")))
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
