"""Personal data: base patterns, and a linear-chain CRF over the word shapes of all tokens for what they miss."""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellforge.llm import common
from cellforge.llm.pii_table import LINES

#: Kinds of the base patterns, and those that the chain alone finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "iban", "name")

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Where the first digit of a run fails, so do the others: no retries within a run, thus linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping matches, each found from its @ sign in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start; ends are exclusive, in code points."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    ips, cards = [], []
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            # leading zeros don't count; the length comes first, as int() refuses very long digit strings
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                ips.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(("card", m.start(), m.end()))
    out += ips + cards
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the chain -----------------------------------------------------------------------------------------------------------
# Every token of a text, what white space parts, is one of the chain's. A token's features are those of its own, and those that
# it lends the token behind it and the one ahead of it.

_NAME = ALL_KINDS.index("name")
TAGS = ("O", *(f"{b}-{k}" for k in ALL_KINDS for b in "BI"))
# Words that tell of personal data near them.
CUES = frozenset("phone tel telefon call mobile fax card visa amex mail email contact ip host iban name mr mrs ms dr dear herr frau madame monsieur señor señora token secret password passwd key api_key apikey access_token private_key bearer commit sha1 checksum version order id uuid".split())
_NAMED = frozenset("name mr mrs ms dr dear herr frau madame monsieur señor señora".split())
_SECRET = re.compile(r"(?i)(?:\w*(?:token|secret|passw|api_?key|_key)\w*)[:=]")
_LONGEST = 64  # characters of a token that its shape looks at from either end
_TRIM = ".,;:!?\"'`|*#&%$<>"


def _shape(word: str) -> str:
    return "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in word)


def _letters(core: str) -> str:
    return "lower" if core.islower() else "upper" if core.isupper() and len(core) > 1 else "title" if core.istitle() else "letters"


#: Places ahead of a token that its features count for: its own, the next, the one before, the next but one.
SHIFTS = (0, 1, -1, 2)


def token_features(w: str) -> tuple[list[str], ...]:
    """Features of a token for each of SHIFTS."""
    core = w.strip(_TRIM)
    cue = core.lower().strip("()[]=")
    cue = cue if cue in CUES else ""
    if core.isalpha():
        kind = _letters(core)
        stop = "." if w[-1:] in ".!?" else ""
        return ["word", f"word={kind}", f"cue={cue}"], [f"<{kind}{stop}", f"<cue={cue}"], [f">{kind}", f">cue={cue}"], [f"<<cue={cue}"]
    shape = _shape(core if len(core) <= 2 * _LONGEST else core[:_LONGEST] + core[-_LONGEST:])
    short = re.sub(r"(.)\1+", r"\1", shape)[:16]
    digits = "".join(c for c in core if "0" <= c <= "9")
    bare = re.sub(r"^[\w-]+[:=][\"']?", "", core)
    mixed = len(bare) >= 16 and bool(digits) and any(c.isalpha() for c in bare) and not re.search(r"[/@?&(){}\[\]|<>]", bare)
    mark = shape if len(shape) <= 3 else ""
    own = [f"short={short}", f"shape={shape}" if len(shape) <= 20 else "long", f"digits={min(len(digits), 20)}", f"mark={mark}"]
    own += [name for name, true in (("luhn", 13 <= len(digits) <= 19 and luhn(digits)), ("at", _at(core)), ("mixed", mixed), ("hex", mixed and re.fullmatch("[0-9a-fA-F]+", bare)), ("case", mixed and not bare.isupper() and not bare.islower()), ("known", re.match(r"AKIA[0-9A-Z]{12}|gh[pousr]_\w{20}|sk-\w{20}|eyJ[\w-]+\.|xox[bap]-", bare)), ("assigned", _SECRET.match(core)), ("dotted", _ip(core)), ("iban", re.match(r"[A-Z]{2}[0-9]{2}(?:$|[0-9A-Z]{10,30}$)", core)), ("checked", _iban(core))) if true]
    return [*own, f"cue={cue}"], [f"<{short[:6]}", f"<mark={mark}", f"<cue={cue}"], [f">{short[:6]}", f">mark={mark}"], [f"<<cue={cue}"]


def _at(text: str) -> bool:
    return bool(re.search(r"[^\s@]@[^\s@]|\w[(\[{]at[)\]}]\w", text, re.IGNORECASE)) and "." in text


def _ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts)


def _iban(text: str) -> bool:
    own = text.replace(" ", "")
    if not 15 <= len(own) <= 34 or not re.fullmatch(r"[A-Z]{2}[0-9]{2}[0-9A-Z]+", own):
        return False
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


_MARKED = re.compile(r"\{(%s) ((?:[^{}]|\{at\})*)\}" % "|".join(ALL_KINDS))
#: A line is read this many times, all digits but a checked number's drawn anew but for the first.
TURNS = 4


@functools.lru_cache(maxsize=1)
def training_table(turns: int = TURNS, seed: int = 11) -> tuple[tuple[tuple[str, str], ...], ...]:
    """The labelled lines as rows of (token, tag), read `turns` times with other digits, and marks behind some tokens."""
    rng, out = np.random.default_rng(seed), []
    for turn in range(turns):
        for line in LINES:
            row, at = [], 0
            for m in [*_MARKED.finditer(line), None]:
                before = line[at : m.start()] if m else line[at:]
                glued = before and not before[-1].isspace() and m  # what stands before the span in its first token
                words = before.split()
                head = words.pop() if glued and words else ""
                if row and at and not before[:1].isspace() and words:
                    row[-1] = (row[-1][0] + words.pop(0), row[-1][1])
                elif row and at and head and not before[:1].isspace():
                    row[-1], head = (row[-1][0] + head, row[-1][1]), ""
                row += [(w, "O") for w in words]
                if m:
                    kind, text = m[1], m[2]
                    if turn and kind not in ("card", "iban", "ip"):
                        text = re.sub("[0-9]", lambda _: str(rng.integers(10)), text)
                    own = text.split()
                    row += [((head if not i else "") + w, f"{'I' if i else 'B'}-{kind}") for i, w in enumerate(own)]
                    at = m.end()
            if turn:
                row = [(w if t != "O" else re.sub("[0-9]", lambda _: str(rng.integers(10)), w), t) for w, t in row]
                k = int(rng.integers(len(row)))
                row[k] = (row[k][0] + str(rng.choice([".", ",", "!!", "###", "&&&"])), row[k][1])
            out.append(tuple(row))
    return tuple(out)


class Chain:
    """Weights of a linear-chain CRF: of (feature, tag) and (tag, tag). What is before and after a text has tag O.

    Tokens' weights are kept in a bounded table, a row for each of SHIFTS.
    """

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray, limit: int = 50_000):
        self.names, self.emit, self.move, self.limit = names, emit, move, limit
        # what a tag can win at most over O by its neighbours' tags
        gain = (move - move[:, :1]).max(axis=0) + (move - move[:1]).max(axis=1)
        self.gain = gain[1:]
        self._empty()

    def _empty(self) -> None:
        self.places: dict[str, int] = {"": 0}
        self.table = np.zeros((1024, len(SHIFTS), len(TAGS)))
        self.classes: dict[tuple, int] = {((),) * len(SHIFTS): 0}
        self.plain: dict[tuple, int] = {}

    def _place(self, w: str) -> int:
        """The row of a token's weights; tokens of like features share one."""
        core = w.strip(_TRIM)
        plain = core.isalpha() and core.lower() not in CUES
        key = (_letters(core), w[-1:] in ".!?") if plain else w
        at = self.plain.get(key) if plain else None
        if at is None:
            own = tuple(tuple(sorted(i for f in fs if (i := self.names.get(f)) is not None)) for fs in token_features(w))
            at = self.classes.get(own)
            if at is None:
                at = self.classes[own] = len(self.classes)
                if at >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                for k, fs in enumerate(own):
                    self.table[at, k] = self.emit[list(fs)].sum(axis=0)
            if plain:
                self.plain[key] = at
        self.places[w] = at
        return at

    def scores(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(token, tag) scores of all texts' tokens, one after another, each text behind two tokens of no features; the
        texts' places. Unknown features weigh nothing."""
        if len(self.places) > self.limit:
            self._empty()
        get, rows = self.places.get, [0, 0]
        starts = []
        for words in texts:
            starts.append(len(rows))
            at = list(map(get, words))
            if None in at:
                at = [self._place(w) if x is None else x for w, x in zip(words, at, strict=True)]
            rows += at
            rows += [0, 0]
        rows = np.array(rows)
        out = self.table[rows, 0]
        for k, shift in enumerate(SHIFTS):
            if shift > 0:
                out[shift:] += self.table[rows[:-shift], k]
            elif shift:
                out[:shift] += self.table[rows[-shift:], k]
        gaps = np.array([0, *(s + len(w) for s, w in zip(starts, texts, strict=True))])
        out[gaps, 1:] = out[gaps + 1, 1:] = -np.inf
        return out, np.array(starts)

    def decode(self, texts: list[list[str]], cut: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The best tags of all tokens, as scores() lays them out, and the texts' places.

        A token that is O in any best path, whatever the tags beside it, as O's lead is more than all that its neighbours' tags
        can give another, cuts the chain in two; the rest is decoded by Viterbi, chains of like length a step at a time.
        """
        e, starts = self.scores(texts)
        sure = (e[:, :1] - e[:, 1:] > (self.gain if cut else np.inf)).all(axis=1)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], sure, [True]]).astype(np.int8)))
        first, size = edge[::2], np.diff(edge)[::2]
        tags = np.zeros(len(e), np.int8)
        by = np.argsort(size, kind="stable")
        at = 0
        while at < len(by):
            n = int(size[by[at]])
            end = int(np.searchsorted(size[by], 2 * n, "right"))
            end = max(at + 1, min(end, at + 65536 // n))
            own = by[at:end]
            for f, row in zip(first[own].tolist(), self.viterbi(e, first[own], size[own]), strict=True):
                tags[f : f + len(row)] = row
            at = end
        return tags, starts

    def viterbi(self, e: np.ndarray, first: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The best tags of chains of e's rows, between tokens that are O, all a step at a time."""
        n, steps = len(first), int(size.max())
        best, back = self.move[0] + e[first], np.zeros((n, steps, len(TAGS)), np.int8)
        for t in range(1, steps):
            live = np.flatnonzero(size > t)
            through = best[live][:, :, None] + self.move
            back[live, t] = through.argmax(axis=1)
            best[live] = through.max(axis=1) + e[first[live] + t]
        tag = (best + self.move[:, 0]).argmax(axis=1)
        out = np.zeros((n, steps), np.int8)
        for t in range(steps - 1, -1, -1):
            live = size > t
            out[live, t] = tag[live]
            tag = np.where(live, back[np.arange(n), t, tag], tag)
        return [row[:s] for row, s in zip(out, size.tolist(), strict=True)]


def fit(table=None, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-5, move_ridge: float = 1e-2) -> Chain:
    """Maximum likelihood by forward-backward and Adam, the whole table a step."""
    table = training_table() if table is None else table
    cells: dict[tuple[int, int], list[str]] = {}
    for i, row in enumerate(table):
        for t, (w, _) in enumerate(row):
            for shift, fs in zip(SHIFTS, token_features(w), strict=True):
                if 0 <= t + shift < len(row):
                    cells.setdefault((i, t + shift), []).extend(fs)
    names = {f: i for i, f in enumerate(sorted({f for fs in cells.values() for f in fs}))}
    size = np.array([len(row) for row in table])
    n, steps, tags = len(table), int(size.max()), len(TAGS)
    gold = np.zeros((n, steps), int)
    for i, row in enumerate(table):
        gold[i, : len(row)] = [TAGS.index(t) for _, t in row]
    live = np.arange(steps) < size[:, None]
    where = np.array([(i * steps + t, names[f]) for (i, t), fs in cells.items() for f in fs])
    order = np.argsort(where[:, 0], kind="stable")
    where = where[order]
    by_name = np.argsort(where[:, 1], kind="stable")
    cell, cell_at = np.unique(where[:, 0], return_index=True)
    name_at = np.searchsorted(where[by_name, 1], np.arange(len(names)))
    emit, move = np.zeros((len(names), tags)), np.zeros((tags, tags))
    one, two = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    hot = np.eye(tags)[gold] * live[..., None]
    seen = np.zeros((tags, tags))
    np.add.at(seen, (np.concatenate([np.zeros(n, int), gold[:, :-1][live[:, 1:]]]), np.concatenate([gold[:, 0], gold[:, 1:][live[:, 1:]]])), 1.0)
    np.add.at(seen, (gold[np.arange(n), size - 1], 0), 1.0)
    last = np.arange(steps) == size[:, None] - 1
    for k in range(1, rounds + 1):
        e = np.zeros((n * steps, tags))
        e[cell] = np.add.reduceat(emit[where[:, 1]], cell_at, axis=0)
        e = e.reshape(n, steps, tags)
        e, m = np.exp(e - e.max(axis=2, keepdims=True)), np.exp(move - move.max())
        # sums of paths, scaled to 1 at each place
        fore, aft = np.zeros_like(e), np.zeros_like(e)
        for t in range(steps):
            fore[:, t] = ((fore[:, t - 1] @ m) if t else m[0]) * e[:, t]
            fore[:, t] /= fore[:, t].sum(axis=1, keepdims=True)
        for t in range(steps - 1, -1, -1):
            on = (aft[:, t + 1] * e[:, t + 1]) @ m.T if t + 1 < steps else 0.0
            aft[:, t] = np.where(last[:, t, None], m[:, 0], on)
            aft[:, t] /= np.maximum(aft[:, t].sum(axis=1, keepdims=True), 1e-300)
        p = fore * aft
        p = p / np.maximum(p.sum(axis=2, keepdims=True), 1e-300) * live[..., None]
        gap = (hot - p).reshape(-1, tags)
        g_emit = np.add.reduceat(gap[where[by_name, 0]], name_at, axis=0)
        right = aft[:, 1:] * e[:, 1:]
        total = np.einsum("nta,ab,ntb->nt", fore[:, :-1], m, right, optimize=True)
        share = np.where(live[:, 1:], 1 / np.maximum(total, 1e-300), 0.0)
        g_move = seen - m * np.einsum("nta,nt,ntb->ab", fore[:, :-1], share, right, optimize=True)
        g_move[0] -= p[:, 0].sum(axis=0)
        g_move[:, 0] -= p[np.arange(n), size - 1].sum(axis=0)
        for w, g, a, b, small in zip((emit, move), (g_emit, g_move), one, two, (ridge, move_ridge), strict=True):
            g = g / n - small * w
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w += rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return Chain(names, emit, move)


def _valid(kind: str, text: str) -> bool:
    digits = "".join(c for c in text if "0" <= c <= "9")
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "email":
        return _at(text)
    if kind == "secret":
        return len(text) >= 12 and bool(digits) and any(c.isalpha() for c in text)
    if kind == "iban":
        return _iban(text)
    if kind == "name":
        return len(text) > 1 and all(w[0].isupper() and w.isalpha() for w in re.split(r"[\s.-]+", text) if w)
    return _ip(text)


def _bounds(kind: str, text: str, s: int, e: int) -> tuple[int, int]:
    """A span without what an assignment puts ahead of it, and without marks at its ends."""
    if kind == "secret" and (m := re.match(r"[\"']?[\w-]+[:=](?=[^=])", text[s:e])):
        s += m.end()
    while s < e and not (text[s].isalnum() or text[s] in "+("):
        s += 1
    while e > s and not (text[e - 1].isalnum() or text[e - 1] == ")" and "(" in text[s:e]):
        e -= 1
    return s, e


def _read(chain: Chain, texts: list[str], cut: bool = True) -> list[list[tuple[str, int, int]]]:
    """The chain's spans of each text."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    words = [t.split() for t in texts]
    tags, starts = chain.decode(words, cut)
    hit = np.flatnonzero(tags)
    whose = np.searchsorted(starts, hit, "right") - 1
    for n in np.unique(whose).tolist():
        places = [m.span() for m in re.finditer(r"\S+", texts[n])]
        own = tags[starts[n] : starts[n] + len(words[n])].tolist()
        i = 0
        while i < len(own):
            kind, j = (own[i] - 1) // 2, i + 1
            while own[i] and j < len(own) and own[j] == 2 * kind + 2:
                j += 1
            if own[i]:
                s, e = _bounds(ALL_KINDS[kind], texts[n], places[i][0], places[j - 1][1])
                told = kind != _NAME or any(w.lower().strip(_TRIM) in _NAMED for w in words[n][max(0, i - 2) : i])
                if s < e and told and _valid(ALL_KINDS[kind], texts[n][s:e]):
                    out[n].append((ALL_KINDS[kind], s, e))
            i = j
    return out


def find_spans(chain: Chain, texts: list[str | None]) -> list[list[tuple[str, int, int, bool]]]:
    """(kind, start, end, base) of each text, by kind and start: all base spans, and those of the chain that touch none."""
    texts = [t or "" for t in texts]
    out: list[list[tuple[str, int, int, bool]]] = []
    for x, y in common.slices(texts, 1 << 18):
        for base, more in zip([base_spans(t) for t in texts[x:y]], _read(chain, texts[x:y]), strict=True):
            own = [(*found, True) for found in base]
            taken = sorted((s, e) for _, s, e in base)
            for kind, s, e in more:
                if not any(s < b and a < e for a, b in taken):
                    own.append((kind, s, e, False))
            out.append(sorted(own, key=lambda f: (ALL_KINDS.index(f[0]), f[1])))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def detect(docs: DataFrame, chain: Chain | None = None, text_col: str = "text", column: str = "spans") -> DataFrame:
    """docs with a column of spans (kind, start, end, base) of the whole text, in the place of any of that name.

    Null and empty texts have none. Rows are read alone, so repeated ones alike; no rows give none. Of paths that tie, the one
    with the earlier tags wins.
    """
    model = fit() if chain is None else chain

    def run(batches):
        for b in batches:
            got = find_spans(model, b.column(b.schema.get_field_index(text_col)).to_pylist())
            spans = pa.array([[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in own] for own in got], _ARROW)
            cols, names = common.without(b, column)
            yield pa.RecordBatch.from_arrays([*cols, spans], names=[*names, column])

    return common.map_arrow(docs, run, T.StructType([*common.replaced(docs.schema, column), T.StructField(column, SPANS)]))


def redact(docs: DataFrame, chain: Chain | None = None, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, and their lengths in code points to match.

    Texts without any, and null ones, stay as they are, lengths too. Of spans that overlap, the first names the place and the
    others what they add. Repeated rows are redacted alike; no rows give none.
    """
    model = fit() if chain is None else chain
    names = docs.columns

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            texts = b.column(at).to_pylist()
            new = []
            for text, spans in zip(texts, find_spans(model, texts), strict=True):
                parts, done = [], 0
                for kind, s, e, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
                    if s < done:  # inside or across the span before: only what it adds goes
                        done = max(done, e)
                        continue
                    parts += [text[done:s], f"[{kind.upper()}]"]
                    done = e
                new.append(text if text is None or not spans else "".join([*parts, text[done:]]))
            cols = list(b.columns)
            cols[at] = pa.array(new, cols[at].type)
            if length_col in names:
                k = b.schema.get_field_index(length_col)
                old = cols[k].to_pylist()
                cols[k] = pa.array([n if x == y else len(y) for n, x, y in zip(old, texts, new, strict=True)], cols[k].type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return common.map_arrow(docs, run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    base = F.filter("spans", lambda x: x["base"])
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [F.size(F.array_remove(kinds, k)).alias(k) for k in KINDS]
    counts = [(F.size(base) - n).cast("long").alias(f"n_{k}") for k, n in zip(KINDS, counts, strict=True)]
    added = (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(F.concat_ws(",", F.transform(base, text)), 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", text)).alias("spans"), added)
