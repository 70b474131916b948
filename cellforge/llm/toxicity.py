"""Toxicity: a weighted finite-state grammar over clauses, its insults learned from labels."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellforge.llm import common

# Seed words of the grammar's classes, in English, German, French and Spanish.
INSULTS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb", "vermin", "filth", "trottel", "dummkopf", "abschaum", "versager", "widerlich", "wertlos", "crétin", "imbécile", "débile", "minable", "ordure", "abruti", "idiota", "imbécil", "estúpido", "estúpida", "basura", "escoria", "asqueroso", "asquerosa"]
THREATS = ["kill", "hurt", "destroy", "beat", "stab", "shoot", "burn", "crush", "strangle", "murder", "töten", "umbringen", "verletzen", "schlagen", "erschießen", "verbrennen", "tuer", "frapper", "détruire", "poignarder", "brûler", "étrangler", "matar", "golpear", "destruir", "apuñalar", "quemar", "estrangular"]
TARGETS = ["you", "your", "youre", "u", "he", "she", "they", "them", "him", "her", "these", "those", "people", "du", "dich", "dir", "ihr", "euch", "sie", "tu", "te", "toi", "vous", "ils", "elles", "tú", "ti", "usted", "ustedes", "ellos", "ellas"]
NEGATIONS = ["not", "no", "never", "isnt", "arent", "wasnt", "dont", "doesnt", "without", "nobody", "nicht", "kein", "keine", "nie", "ohne", "pas", "jamais", "sans", "nunca", "sin"]
REPORTS = ["said", "says", "told", "wrote", "claims", "claimed", "called", "quoted", "reported", "according", "sagte", "sagt", "schrieb", "behauptet", "laut", "dit", "écrit", "selon", "affirme", "dijo", "dice", "escribió", "según", "afirma"]
INTENTS = ["will", "shall", "gonna", "should", "ll", "must", "werde", "werden", "soll", "sollte", "muss", "vais", "va", "dois", "doit", "voy", "vamos", "debe", "deben"]
DEGREES = ["so", "such", "complete", "total", "utter", "very", "really", "damn", "völlig", "total", "sehr", "tellement", "vraiment", "totalement", "muy", "tan", "completamente"]
SEED_WEIGHT = 4.0
FACTORS = {"negated": 0.25, "reported": 0.5, "targeted": 1.25, "stressed": 1.25, "chained": 1.1, "struck": 2.5}

#: Bounds of the labelled sample that the lexicon and the calibration are fitted on, on average, and of the lexicon.
MAX_TOXIC, MAX_CLEAN, MAX_LEXICON = 4000, 8000, 5000

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
_ELIDED = re.compile(r"['\u2019](?=(?:s|t|m|d|re|ve|ll)\b)")
_PREFIX = range(3, 8)

KINDS = {"target": TARGETS, "negation": NEGATIONS, "report": REPORTS, "intent": INTENTS, "degree": DEGREES, "threat": THREATS}


def plain(text: str | None) -> str:
    """Lower case, with the apostrophes of contractions dropped: you're is one word, l'idiot two."""
    text = (text or "").lower()
    return _ELIDED.sub("", text) if "'" in text or "\u2019" in text else text


# ---- the grammar -------------------------------------------------------------------------------------------------------
# A letter is a word's class and the marks that machines have written on it; a machine maps (state, class, marks) to (state,
# marks to add). The first two accept insults and threats; those behind them read what these write.


def insult_machine(state, kind, marks):
    """Accepts an insult, stressed behind a word of degree and chained behind another insult. States: the word before."""
    if kind == "insult":
        return 2, {"insult"} | ({"stressed"} if state == 1 else {"chained"} if state == 2 else set())
    return (1 if kind == "degree" else 0), set()


def threat_machine(state, kind, marks):
    """Accepts target, intent, verb (you will burn) at the verb, and intent, verb, target (will burn you) at the target.

    States: words left to wait after a target, an intent, and a verb that an intent came before.
    """
    target, intent, verb = (max(0, x - 1) for x in state)
    if kind == "target":
        return (7, intent, 0), {"struck"} if verb else set()
    if kind == "intent":
        return (target, 4, verb), set()
    if kind == "threat" and intent:
        return ((0, 0, 0), {"struck"}) if target else ((0, 0, 4), set())
    return (target, intent, verb), set()


ACCEPTED = {"insult", "struck"}


def after(trigger: str, span: int, mark: str):
    """A machine that marks what insult_machine and threat_machine accept within `span` words of a trigger."""

    def machine(state, kind, marks):
        return (span if kind == trigger else max(0, state - 1)), {mark} if state and marks & ACCEPTED else set()

    return machine


class Composed:
    """The composition of machines: each reads what those before it write. Product states are made as they are met."""

    def __init__(self, *machines):
        self.machines = [m for m, _ in machines]
        self.start = tuple(s for _, s in machines)
        self.table: dict = {}

    def __call__(self, states, kind, marks=frozenset()):
        key = states, kind, marks
        got = self.table.get(key)
        if got is None:
            now = []
            for machine, state in zip(self.machines, states, strict=True):
                state, more = machine(state, kind, marks)
                marks = marks | more
                now.append(state)
            got = self.table[key] = tuple(now), frozenset(marks)
        return got


FORWARD = Composed((insult_machine, 0), (threat_machine, (0, 0, 0)), (after("negation", 3, "negated"), 0), (after("report", 8, "reported"), 0), (after("target", 6, "targeted"), 0))
BACKWARD = Composed((after("target", 3, "targeted"), 0))


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings, and the score's logistic curve."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, SEED_WEIGHT))
    prefixes: dict[str, float] = field(default_factory=dict)
    curve: tuple[float, float, float] = (-3.0, 1.0, 0.5)

    def __post_init__(self):
        self.kinds = {w: kind for kind, words in KINDS.items() for w in words}
        self.threats = frozenset(THREATS)
        self.cache: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """The weight of a word's arc as an insult: its own, or that of its heaviest known beginning; 0 if none."""
        got = self.cache.get(word)
        if got is None:
            got = max(self.words.get(word, 0.0), *(self.prefixes.get(word[:n], 0.0) for n in _PREFIX if n <= len(word)), 0.0)
            if len(self.cache) >= 50_000:
                self.cache.clear()
            self.cache[word] = got
        return got

    def clause(self, words: list[str]) -> float:
        """The weight of the grammar's matches in a clause: each accepted letter's, by the marks that it bears."""
        weights = [self.weight(w) for w in words]
        kinds = ["insult" if x else self.kinds.get(w, "other") for w, x in zip(words, weights, strict=True)]
        if "insult" not in kinds and "threat" not in kinds:
            return 0.0
        marks, state = [], FORWARD.start
        for kind in kinds:
            state, own = FORWARD(state, kind)
            marks.append(own)
        state, total = BACKWARD.start, 0.0
        for kind, w, own in zip(kinds[::-1], weights[::-1], marks[::-1], strict=True):
            state, own = BACKWARD(state, kind, own)
            if own & ACCEPTED:
                total += (w or SEED_WEIGHT) * math.prod(FACTORS[m] for m in own if m in FACTORS)
        return total

    def clauses(self, text: str | None) -> list[float]:
        """The weights of the text's clauses that the grammar matches; texts without an insult or a threat's verb have none."""
        text = plain(text)
        words = _WORD.findall(text)
        cached = list(map(self.cache.get, words))
        if None in cached:
            cached = [self.weight(w) if x is None else x for w, x in zip(words, cached, strict=True)]
        if not any(cached) and self.threats.isdisjoint(words):
            return []
        return [x for c in _CLAUSE.split(text) if (x := self.clause(_WORD.findall(c)))]

    def features(self, text: str | None) -> tuple[float, float]:
        found = self.clauses(text)
        return (math.log1p(sum(found)), max(found, default=0.0))

    def score(self, text: str | None) -> float:
        a, b = self.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _near_copy(words: list[str]) -> int:
    """One minimum over the word triples: copies with few edits mostly share it."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(words) - 2))), default=0)


def _toxic_features(batches):
    for b in batches:
        names, copies = [], []
        for text in b.column(0).to_pylist():
            words = _WORD.findall(plain(text))
            own = {f"w{w}" for w in words if len(w) > 2} | {f"p{w[:n]}" for w in words for n in _PREFIX if n <= len(w)}
            names += own
            copies += [_near_copy(words)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(copies, pa.int64())], names=["feature", "copy"])


def _clean_counts(wanted: set[str]):
    def run(batches):
        seen = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                words = set(_WORD.findall(plain(text)))
                seen.update(({f"w{w}" for w in words} | {f"p{w[:n]}" for w in words for n in _PREFIX if n <= len(w)}) & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["feature", "n"])

    return run


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows at most, by a hash of the text, so that a run repeats."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit(1), "text", "key"), F.lit(n)) < most)


def fit(rows: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_lexicon: int = MAX_LEXICON) -> Lexicon:
    """Learn the insults and the score's curve from rows (text, label, key); null texts and labels but 0 and 1 are left out.

    A word, or a beginning of three to seven letters, is an insult if far more toxic than clean texts have it: near copies
    count once, so that what only one much-copied text has is none. A beginning counts if half as many texts again have it as
    have any one word of it. Without labels of both kinds, as of an empty table, the
    seeds stand alone. Rows that repeat a text and key are sampled together; of equal odds, shorter and then lesser words win.
    """
    rows = rows.where("text is not null and label in (0, 1)").select("text", F.col("label").cast("int").alias("label"), "key")
    toxic, clean = (common.cut(_sample(rows.where(F.col("label") == y), most), "labels") for y, most in ((1, max_toxic), (0, max_clean)))
    seen = common.cut(common.map_arrow(toxic.select("text"), _toxic_features, "feature string, copy long").groupBy("feature", "copy").agg(F.lit(1).alias("one")), "features")
    kinds, misses = seen.select(F.countDistinct("copy")).first()[0], clean.count()
    lexicon = Lexicon()
    if not kinds or not misses:
        return lexicon
    least = max(4, kinds // 200)
    found = dict(seen.groupBy("feature").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "feature").limit(40 * max_lexicon).collect())
    counts = dict(common.map_arrow(clean.select("text"), _clean_counts(set(found)), "feature string, n long").groupBy("feature").agg(F.sum("n")).collect())
    odds = {f: math.log((n + 0.5) / (kinds + 1)) - math.log((counts.get(f, 0) + 0.5) / (misses + 1)) for f, n in found.items()}
    most: dict[str, int] = {}
    for f, n in found.items():
        for k in _PREFIX if f[0] == "w" else ():
            most[f"p{f[1 : k + 1]}"] = max(most.get(f"p{f[1 : k + 1]}", 0), n)
    # a beginning that one word alone makes up says no more than the word
    odds = {f: x for f, x in odds.items() if f[0] == "w" or 2 * found[f] >= 3 * most.get(f, 0)}
    kept = sorted((f for f, x in odds.items() if x >= 3.0), key=lambda f: (-odds[f], len(f), f))[:max_lexicon]
    for f in kept:
        into = lexicon.words if f[0] == "w" else lexicon.prefixes
        into[f[1:]] = max(into.get(f[1:], 0.0), min(odds[f], 8.0))
    lexicon.curve = _curve(lexicon, toxic, clean)
    return lexicon


def _features(lexicon: Lexicon, label: int):
    def run(batches):
        for b in batches:
            x = [lexicon.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), pa.array([label] * len(x), pa.int64())], names=["a", "b", "y"])

    return run


def _curve(lexicon: Lexicon, toxic: DataFrame, clean: DataFrame) -> tuple[float, float, float]:
    """Logistic regression on the sample's clause features, by Newton steps with a small ridge."""
    ddl = "a double, b double, y long"
    rows = common.map_arrow(toxic.select("text"), _features(lexicon, 1), ddl).unionAll(common.map_arrow(clean.select("text"), _features(lexicon, 0), ddl)).collect()
    x = np.array([(1.0, r.a, r.b) for r in rows])
    y = np.array([r.y for r in rows], float)
    w, ridge = np.array([-3.0, 1.0, 0.5]), np.diag([0.01, 0.1, 0.1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-6 * np.eye(3)
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge @ w)
    return tuple(w.tolist())


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", column: str = "score") -> DataFrame:
    """docs with a column `column` double, 0 to 1, in the place of any of that name, whatever its case.

    Null and empty texts score as texts without a match. Every row is scored alone: repeated rows alike, no rows give none.
    """
    fields = T.StructType([*common.replaced(docs.schema, column), T.StructField(column, T.DoubleType())])

    def run(batches):
        for b in batches:
            got = pa.array([lexicon.score(t) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()], pa.float64())
            cols, names = common.without(b, column)
            yield pa.RecordBatch.from_arrays([*cols, got], names=[*names, column])

    return common.map_arrow(docs, run, fields)


def fit_tables(spark: SparkSession, sf_dir: str) -> Lexicon:
    """A lexicon from documents and labels, of rows whose crc32(doc_id) mod 3 isn't 1.

    The labels are sampled to the lexicon's bounds first, so that few texts are joined to them.
    """
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    labels = labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    some = [common.cut(_sample(labels.where(F.col("label") == y).select("doc_id", "label", F.lit("").alias("text"), F.col("doc_id").alias("key")), most), "sample") for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    learn = docs.join(F.broadcast(some[0].unionAll(some[1]).select("doc_id", "label")), "doc_id")
    return fit(common.cut(learn.select("text", "label", F.col("doc_id").alias("key")), "learn"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit_tables(spark, sf_dir))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
