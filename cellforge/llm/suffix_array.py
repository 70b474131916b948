"""Repeated 200-byte strings: sampled anchors find candidates, a suffix array of each candidate group finds the starts."""

from __future__ import annotations

import functools
import hashlib
import os
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

LENGTH = 200
#: Bytes of a join's small side, arrays counted whole, up to which it is broadcast; beyond, both sides are shuffled.
BROADCAST_BYTES = 64 << 20
#: Contexts of an anchor whose suffixes one task sorts together; more are first halved and parted until no part has more.
TILE_CONTEXTS = 512
_ANCHOR, _GAP = b"\xff", b"\xfe"  # bytes that UTF-8 never has
_LOW = np.uint64((1 << 22) - 1)
_SEGMENT = 1 << 21


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of s, whose last element is smaller than all others, by linear grouping.

    Suffixes start in groups by first symbol. Groups are taken in descending order: each member's previous smaller suffix
    is found over the pointers of the groups above, and the suffixes so pointed at move, the more pointers the further
    back, into new groups right behind their own. Each group then holds the suffixes of one longest Lyndon prefix; an
    ascending sweep over the pointers puts every suffix in its place.
    """
    n = len(s)
    order = sorted(range(n), key=s.__getitem__)
    place = [0] * n
    group = [0] * n
    size = [0] * (n + 1)
    start, last = 0, None
    for k, i in enumerate(order):
        if s[i] != last:
            start, last = k, s[i]
        place[i] = k
        group[i] = start
        size[start] += 1
    prev = [-1] * n  # -1 is the last suffix, which is in the lowest group
    end = n
    while end > 0:
        g = group[order[end - 1]]
        members = order[g:end]
        end = g
        if len(members) > 1:
            members.sort()
        pointed: dict[int, int] = {}
        for i in members:
            p = i - 1
            while group[p] >= g and p >= 0:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        if not pointed:
            continue
        if len(pointed) == 1:
            levels = [list(pointed)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in pointed.items():
                by.setdefault(k, []).append(p)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:
                h = group[p]
                k = moved.get(h, 0) + 1
                moved[h] = k
                q = h + size[h] - k
                at = place[p]
                if at != q:
                    other = order[q]
                    order[at], place[other] = other, at
                    order[q], place[p] = p, q
            for h, k in moved.items():
                rest = size[h] - k
                if rest:
                    new = h + rest
                    size[h], size[new] = rest, k
                    for p in order[new : new + k]:
                        group[p] = new
    out = [-1] * n
    free = list(range(n))
    out[0] = n - 1
    done = [False] * n
    done[n - 1] = True
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = prev[j]
    return out


def _table() -> np.ndarray:
    return np.random.default_rng(200).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Sampler:
    """Anchors: every window of `length` bytes owns its leftmost substring of half that length with the least hash."""

    def __init__(self, length: int = LENGTH):
        base = 0x9E3779B97F4A7C15
        self.length, self.k = length, length // 2
        self.bytes, self.base, self.inverse = _table(), base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, buf: bytes):
        """(hash, place, first start, last start) of the anchors of buf; starts are those of the windows that own each."""
        for at in range(0, max(1, len(buf) - self.length + 1), _SEGMENT):
            part = buf[at : at + _SEGMENT + self.length - 1]
            if len(part) >= self.length:
                h, a, s, e = self._segment(part)
                yield h, a + at, s + at, e + at

    def _segment(self, buf: bytes):
        b, k, w = np.frombuffer(buf, np.uint8), self.k, self.length - self.k + 1
        if len(self.up) <= len(b):
            size = min(max(2 * len(b), 1 << 14), _SEGMENT + self.length) + 1
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.bytes[b] * self.up[: len(b)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: len(b) - k + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        reach, least = 1, low
        while 2 * reach <= w:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        n = len(low) - w + 1
        own = (np.minimum(least[:n], least[w - reach : w - reach + n]) & _LOW).astype(np.int64)
        s = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
        e = np.concatenate([s[1:] - 1, [n - 1]])
        return h[own[s]], own[s], s, e


def _anchors(length: int):
    names = ["doc_id", "key", "h", "c", "first", "owned", "lead"]

    def run(batches):
        sampler = Sampler(length)
        for b in batches:
            out = [[] for _ in names]
            for name, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buf = (text or "").encode("utf-8", "surrogatepass")
                for h, a, s, e in sampler(buf):
                    lead = a - s
                    c = [xxhash.xxh64_intdigest(buf[x : y + length], z) for x, y, z in zip(s.tolist(), e.tolist(), lead.tolist(), strict=True)]
                    for o, v in zip(out, (np.full(len(h), -1 if name is None else name), np.full(len(h), key), h.view(np.int64), np.array(c, np.uint64).view(np.int64), s, (e - s + 1).astype(np.int32), lead.astype(np.int32)), strict=True):
                        o.append(v)
                    if name is None:
                        out[0][-1] = None
            if out[2]:
                cols = [pa.array(np.concatenate(o)) for o in out[1:]]
                first = pa.concat_arrays([pa.array(v, pa.int64()) if v is not None else pa.nulls(len(w), pa.int64()) for v, w in zip(out[0], out[1], strict=True)])
                yield pa.RecordBatch.from_arrays([first, *cols], names=names)

    return run, "doc_id long, key long, h long, c long, first long, owned int, lead int"


def tile_starts(contexts: list[tuple], length: int, alone: bool = True):
    """(ranges, strings) of one tile of an anchor's contexts, by a suffix array over those whose anchor bytes are the same.

    contexts: (bytes, lead, owned): the anchor is at bytes[lead:lead + length // 2], and the strings of the first `owned`
    starts are asked for. ranges: (context, first, last) of starts whose string another context of the tile has too. strings,
    unless the tile is alone: each different string once, as (context, start, whether the tile has it once). A tile that is
    alone first trims each context to what it can share with any other.
    """
    k = length // 2
    by_anchor: dict[bytes, list[int]] = {}
    for c, (x, lead, _) in enumerate(contexts):
        by_anchor.setdefault(x[lead : lead + k], []).append(c)
    ranges, strings = [], []
    for own in by_anchor.values():
        if alone and len(own) < 2:
            continue
        classes = _classes([contexts[c] for c in own], length, alone)
        hits: list[list[int]] = [[] for _ in own]
        for members in classes:
            if len(members) > 1:
                for c, at in members:
                    hits[c].append(at)
            if not alone:
                c, at = members[0]
                strings.append((own[c], at, len(members) == 1))
        for c, found in zip(own, hits, strict=True):
            found.sort()
            begin = 0
            for i in range(1, len(found) + 1):
                if i == len(found) or found[i] != found[i - 1] + 1:
                    ranges.append((c, found[begin], found[i - 1]))
                    begin = i
    return ranges, strings


def _classes(contexts: list[tuple], length: int, trim: bool):
    """Lists of (context, start) of equal strings, in the strings' order, of contexts with the same anchor bytes."""
    k = length // 2
    reach = [[lead for _, lead, _ in contexts], [len(x) - lead - k for x, lead, _ in contexts]]
    if trim:
        sides = [[x[lead - 1 :: -1] if lead else b"" for x, lead, _ in contexts], [x[lead + k :] for x, lead, _ in contexts]]
        for n, side in enumerate(sides):
            reach[n] = best = [0] * len(contexts)
            by = sorted(range(len(contexts)), key=side.__getitem__)
            for i, j in pairwise(by):
                same = len(os.path.commonprefix((side[i], side[j])))
                best[i], best[j] = max(best[i], same), max(best[j], same)
    text, whose, rest = [], [], length - k
    size = rest + 1  # the anchor counts as one symbol
    for c, ((x, lead, owned), left, right) in enumerate(zip(contexts, *reach, strict=True)):
        if left + right >= rest:
            text.append(x[lead - left : lead] + _ANCHOR + x[lead + k : lead + k + right] + _GAP)
            shift = lead - left
            whose.append((c, shift, min(left, left + right - rest, owned - 1 - shift)))
    if not text or trim and len(text) < 2:
        return
    s = b"".join(text)
    owner = np.repeat(np.arange(len(text)), [len(x) for x in text])
    begins = np.concatenate([[0], np.cumsum([len(x) for x in text])])
    offset = np.arange(len(s)) - begins[owner]
    fits = np.append(offset <= np.array([w[2] for w in whose])[owner], False).tolist()
    before, members = b"", []
    for p in suffix_array([*s, -1]):
        if fits[p]:
            now = s[p : p + size]
            if now != before:
                if members:
                    yield members
                before, members = now, []
            c, shift, _ = whose[owner[p]]
            members.append((c, int(offset[p]) + shift))
    if members:
        yield members


_SORTED = ["doc_id", "key", "first", "last"]


def _sort_groups(length: int):
    def flush(rows, out):
        ranges, _ = tile_starts([(r[3], r[4], r[5]) for r in rows], length)
        for c, first, last in ranges:
            doc, key, at, _, _, _, copies = rows[c]
            if copies == 1:
                for o, v in zip(out, (doc, key, at + first, at + last), strict=True):
                    o.append(v)

    def run(batches):
        now, rows, out = None, [], [[] for _ in _SORTED]
        for b in batches:
            for h, part, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (h, part) != now:
                    flush(rows, out)
                    now, rows = (h, part), []
                    if len(out[0]) >= 1 << 14:
                        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=_SORTED)
                        out = [[] for _ in _SORTED]
                rows.append(row)
        flush(rows, out)
        yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], names=_SORTED)

    return run, "doc_id long, key long, first long, last long"


def _contexts(length: int):
    def run(batches):
        for b in batches:
            out = [[] for _ in range(8)]
            for doc, key, text, marks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buf = (text or "").encode("utf-8", "surrogatepass")
                for m in marks:
                    x = buf[m["first"] : m["first"] + m["owned"] + length - 1]
                    for o, v in zip(out, (m["h"], doc, key, m["first"], x, m["lead"], m["owned"], m["copies"]), strict=True):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["h", "doc_id", "key", "first", "x", "lead", "owned", "copies"])

    return run, "h long, doc_id long, key long, first long, x binary, lead int, owned int, copies long"


def _by_doc(docs: DataFrame, other: DataFrame, how: str, array: str, each: int) -> DataFrame:
    """docs joined to rows of (doc_id, key, array); those are broadcast only if all arrays, at `each` bytes an item, are small."""
    o = other.withColumnsRenamed({"doc_id": "o_doc", "key": "o_key"})
    size = other.agg(F.sum(F.size(array) * each + 64)).first()[0] or 0
    o = F.broadcast(o) if size <= BROADCAST_BYTES else o
    return docs.join(o, (docs["key"] == o["o_key"]) & docs["doc_id"].eqNullSafe(o["o_doc"]), how).drop("o_doc", "o_key")


def _merge(batches):
    for b in batches:
        merged = []
        for spans in b.column(2).to_pylist():
            own = []
            for s in sorted((x["first"], x["last"]) for x in spans):
                if own and s[0] <= own[-1][1] + 1:
                    own[-1][1] = max(own[-1][1], s[1])
                else:
                    own.append(list(s))
            merged.append([x for s in own for x in s])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, pa.list_(pa.int64()))], names=["doc_id", "key", "starts"])


_CONTEXT = ["doc_id", "key", "first", "x", "lead", "owned", "copies"]


def _halves(contexts: DataFrame, length: int) -> DataFrame:
    """Each context as two, of the starts that have from `low` to `high` bytes ahead of the anchor, for either half of its range.

    Two that share a string of such a half have the same `low` bytes ahead of the anchor and the same behind it that a string
    with `high` ahead has left: their part is a hash of those. Each keeps only the bytes that its own starts' strings cover.
    """
    k = length // 2
    rest = length - k
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    each = contexts.withColumn("half", F.explode(F.array(F.struct(F.col("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high")))))
    each = each.withColumns({"low": F.col("half.low"), "high": F.col("half.high")})
    each = each.withColumns({"most": F.least("high", "lead"), "least": F.expr("greatest(low, lead - owned + 1)")}).where("least <= most")
    each = each.withColumns({"first": F.expr("first + lead - most"), "x": F.expr(f"substring(x, lead - most + 1, most - least + {length})")})
    each = each.withColumn("part", F.expr(f"xxhash64(low, high, substring(x, most - low + 1, low + {k} + {rest} - high))"))
    return each.withColumns({"lead": F.col("most"), "owned": F.expr("most - least + 1")}).select("h", "part", "low", "high", *_CONTEXT)


def _narrow(contexts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(ranges, parts) of contexts of anchors that have many: starts found on the way, and parts with `n`, their contexts.

    Contexts are halved and parted until no part has more than TILE_CONTEXTS different ones. Of equal ones all starts are
    found, and one goes on, for others to meet; parts of one context, or of none that occurs once, are done. Larger parts than
    TILE_CONTEXTS are halved in their turn. A half of one start is all of its string, so halving ends.
    """
    ranges, parts = [], []
    now = contexts.withColumns({"low": F.lit(0), "high": F.lit(length - length // 2)})
    same = ["h", "part", "low", "high", "x", "lead", "owned"]
    while not now.isEmpty():
        halves = common.cut(_halves(now, length), "halves")
        classes = halves.groupBy(*same).agg(F.sum("copies").alias("copies"), F.min(F.struct("doc_id", "key", "first")).alias("r"))
        classes = common.cut(classes.select(*same, "copies", "r.doc_id", "r.key", "r.first"), "halved")
        found = halves.where("copies = 1").join(classes.where("copies > 1").select(*same), same, "left_semi")
        ranges.append(common.cut(found.select("doc_id", "key", "first", (F.col("first") + F.col("owned") - 1).alias("last")), "equal"))
        common.drop(halves)
        sizes = classes.groupBy("h", "part").agg(F.count("*").alias("n"), F.sum((F.col("copies") == 1).cast("long")).alias("single"))
        parts.append(common.cut(classes.join(sizes.where("n > 1 and single > 0").select("h", "part", "n"), ["h", "part"]), "parts"))
        common.drop(classes)
        now = parts[-1].where((F.col("n") > TILE_CONTEXTS) & (F.col("low") < F.col("high"))).select("h", "low", "high", *_CONTEXT)
    return ranges, parts


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, key, starts): ranges of starts, flat and ascending, whose `length`-byte strings start elsewhere too.

    docs: doc_id, key, text. Every such string owns an anchor by content alone, so two equal strings own equal ones.
    Anchors that occur once are dropped after a count with partial sums. An anchor with all that it owns is a context: one
    that occurs again, by 128 bits of hash, needs nothing more; the others of the same anchor meet in suffix arrays. Contexts
    of anchors with many are first halved and parted by what stands ahead and behind, until no part has many.
    No rows, and strings that are all different, give no ranges; rows that repeat a doc_id and text are one row each.
    """
    run, ddl = _anchors(length)
    anchors = common.cut(common.map_arrow(docs.select("doc_id", "key", "text"), run, ddl), "anchors")
    twice = common.cut(anchors.groupBy("h").count().where("count > 1").select("h"), "twice")
    rows = common.cut(anchors.join(twice, "h"), "rows")
    common.drop(anchors)
    common.drop(twice)
    rep = F.min(F.struct("doc_id", "key", "first", "owned", "lead")).alias("r")
    classes = common.cut(rows.groupBy("h", "c").agg(F.count("*").alias("copies"), rep), "classes")
    some = classes.groupBy("h").agg(F.count("*").alias("contexts"), F.sum((F.col("copies") == 1).cast("long")).alias("single"))
    some = common.cut(some.where("contexts > 1 and single > 0").select("h", (F.col("contexts") > TILE_CONTEXTS).alias("many")), "some")
    whole = rows.join(classes.where("copies > 1").select("h", "c"), ["h", "c"])
    whole = common.cut(whole.select("doc_id", "key", "first", (F.col("first") + F.col("owned") - 1).alias("last")), "whole")
    common.drop(rows)
    marks = classes.join(some, "h").select("r.doc_id", "r.key", F.struct("h", "r.first", "r.owned", "r.lead", "copies").alias("m"))
    marks = common.cut(marks.groupBy("doc_id", "key").agg(F.collect_list("m").alias("marks")), "marks")
    common.drop(classes)
    run, ddl = _contexts(length)
    found = common.map_arrow(_by_doc(docs, marks, "inner", "marks", 48).select("doc_id", "key", "text", "marks"), run, ddl)
    # rows that repeat a doc_id and text give a context once each
    found = common.cut(found.dropDuplicates(["h", "doc_id", "key", "first"]).join(some, "h").select("h", "many", *_CONTEXT), "contexts")
    ranges, parts = _narrow(found.where("many").drop("many"), length)
    groups = [found.where("not many").withColumn("part", F.lit(0).cast("long")), *(p.where(F.col("n") <= TILE_CONTEXTS) for p in parts)]
    groups = functools.reduce(DataFrame.unionAll, [g.select("h", "part", *_CONTEXT) for g in groups])
    ordered = groups.repartition("h", "part").sortWithinPartitions("h", "part")
    run, ddl = _sort_groups(length)
    read = [whole, *ranges, common.cut(common.map_arrow(ordered, run, ddl), "sorted")]
    for t in (found, marks, some, *parts):
        common.drop(t)
    spans = functools.reduce(DataFrame.unionAll, read).distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = common.cut(common.map_arrow(spans, _merge, "doc_id long, key long, starts array<long>"), "starts")
    for t in read:
        common.drop(t)
    return out


def _remove(length: int, keep_text: bool):
    def run(batches):
        for b in batches:
            out = [[], [], [], [], [], [], []]
            for doc, text, starts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                buf = (text or "").encode("utf-8", "surrogatepass")
                kept, at, gone, runs = [], 0, 0, []
                for s, e in zip((starts or [])[::2], (starts or [])[1::2], strict=True):
                    e += length
                    if runs and s <= runs[-1][1]:
                        runs[-1][1] = e
                    else:
                        runs.append([s, e])
                for s, e in runs:
                    kept.append(buf[at:s])
                    gone, at = gone + e - s, e
                kept = b"".join([*kept, buf[at:]])
                row = (doc, len(buf), gone, len(runs), hashlib.sha256(kept).hexdigest(), [x for r in runs for x in r], kept if keep_text else None)
                for o, v in zip(out, row, strict=True):
                    o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Each row's bytes without those that a repeated `length`-byte string covers.

    Rows are doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (flat byte ranges), kept. Null and empty texts have no
    bytes. Rows that repeat a text repeat its strings, whatever their doc_id, so all of them lose those. Strings are judged on
    the input. No rows give none; other columns aren't read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    joined = _by_doc(docs, repeated_starts(docs, length), "left", "starts", 8)
    return common.map_arrow(joined.select("doc_id", "text", "starts"), *_remove(length, keep_text))


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(common.table(spark, sf_dir, "documents"), keep_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
