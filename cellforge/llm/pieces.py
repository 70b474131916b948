"""SentencePiece segmentations sampled without replacement: Gumbel top-k by a perturbed best-first search of the lattice."""

from __future__ import annotations

import functools
import gc
import heapq
import itertools
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellforge.llm import common

#: Samples of a text, and what a piece's score is divided by to give its log weight.
SAMPLES, TEMPERATURE = 2, 2000.0
SPACE = "▁"
_LETTERS, _MARKS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"!-/:-@\[-`{-~"
_UNIT = re.compile(rf"{SPACE}*+(?:[{_LETTERS}]++(?![^{_MARKS}{SPACE}\n])|[^{SPACE}\n]++)|\n|{SPACE}++")
_CROSSING = re.compile(rf"[{_LETTERS}][{_MARKS}]|[^{SPACE}]{SPACE}|\n")


#: Arcs that a vocabulary's lattices hold before they start anew, at some 25 bytes each; one slice of texts may need more.
ARCS = 1 << 21
_HALF = math.log(0.5)
#: Characters of a unit, and units left in a step, beyond and below which they are walked one by one rather than side by side.
_LONG, _FEW = 1 << 10, 4
#: Gumbel draws of 52 bits are from -3.7 to 36.8; log odds below a path's own within which its best splits are sought first.
_SPAN, _NEAR = 41.0, 60.0


def _places(units=()) -> defaultdict[str, int]:
    """Numbers of units in order of their first sight, these units first."""
    return defaultdict(itertools.count(len(units)).__next__, zip(units, range(len(units)), strict=True))


def _slot(key: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """The places of edges in the n-th table, whose size is a power of two."""
    odd = np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) % (1 << 64))
    return (key.astype(np.uint64) * odd >> np.uint64(65 - len(slots).bit_length())).astype(np.int64)


class Vocabulary:
    """Pieces of a SentencePiece model, and lattices of the units that no piece crosses, side by side in bounded arrays.

    A node is a character's place in a unit, a unit's end the first node of the next one. Arcs are by start node and end;
    ids below 0 are -1 - the code of a character without a piece, which stands for its bytes.
    """

    def __init__(self, path: str, temperature: float = TEMPERATURE, limit: int = ARCS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit = limit
        self.pieces: dict[str, int] = {}
        self.bytes = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        self.weights = np.zeros(sp.vocab_size())
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = i
                self.weights[i] = sp.get_score(i) / temperature
                self.surface.append(piece.encode())
        if any(map(_CROSSING.search, self.pieces)):
            raise ValueError("a piece crosses a unit")
        self.surfaces = np.array(self.surface, object)
        self.byte_weight = self.weights.min() - 1.0
        self.weights[self.bytes] = self.byte_weight
        self._trie()
        self._empty()

    def _trie(self) -> None:
        """The pieces' prefix tree: each node's edge (node << 21 | character) to it, and its piece or -1; nodes by their edge's hash.

        Edges whose slot in a table is another's are in the next one.
        """
        nodes: dict[str, int] = {"": 0}
        edges = []
        for p in sorted(self.pieces):
            for n in range(1, len(p) + 1):
                if p[:n] not in nodes:
                    nodes[p[:n]] = len(nodes)
                    edges.append((nodes[p[: n - 1]] << 21 | ord(p[n - 1]), nodes[p[:n]]))
        self.edges = np.full(len(nodes), -1, np.int64)
        self.edges[[n for _, n in edges]] = [k for k, _ in edges]
        left = np.arange(1, len(nodes), dtype=np.int32)
        self.slots = []
        while len(left):
            slots = np.zeros(4 << len(left).bit_length(), np.int32)
            at = _slot(self.edges[left], slots, len(self.slots))
            slots[at] = left
            left = left[slots[at] != left]
            self.slots.append(slots)
        self.roots = np.zeros(0x110000, np.int32)  # nodes of single characters; 0 for those that begin no piece
        for k, n in edges:
            if k < 1 << 21:
                self.roots[k] = n
        self.final = np.full(len(nodes), -1, np.int32)
        self.final[[nodes[p] for p in self.pieces]] = list(self.pieces.values())

    def _edge(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that edges lead to, and whether there are such edges."""
        target = self.slots[0][_slot(key, self.slots[0], 0)]
        known = self.edges[target] == key
        other = np.flatnonzero(~known & (target > 0))
        for n, slots in enumerate(self.slots[1:], 1):
            own = key[other]
            target[other] = node = slots[_slot(own, slots, n)]
            known[other] = here = self.edges[node] == own
            other = other[~here & (node > 0)]
        return target, known

    def _empty(self, arcs: int = 1 << 12, nodes: int = 1 << 12, units: int = 1 << 10) -> None:
        self.places = _places()
        self.n_arcs = self.n_nodes = 0
        self.end, self.ids = np.empty(arcs, np.int32), np.empty(arcs, np.int32)
        self.logs, self.sums, self.others = np.empty(arcs), np.empty(arcs, np.float32), np.empty(nodes)
        self.first, self.closes = np.zeros(nodes + 1, np.int32), np.zeros(nodes + 1, bool)
        self.node0, self.stop, self.seen = np.empty(units, np.int32), np.empty(units, np.int32), np.zeros(units)

    def _renew(self) -> None:
        """Full arrays keep the units met most often, of those met again, in three quarters of their room; counts fade by a tenth."""
        units = len(self.places)
        node0, stop, seen = self.node0[:units], self.stop[:units], self.seen[:units]
        arcs = self.first[stop] - self.first[node0]
        best = np.argsort(-seen, kind="stable")
        best = best[: np.searchsorted(np.cumsum(arcs[best], dtype=np.int64), 3 * self.limit // 4, "right")]
        kept = np.sort(best[seen[best] >= 2])
        size, arcs = (stop - node0)[kept], arcs[kept]
        stops = np.cumsum(size, dtype=np.int32)
        back = node0[kept] - (stops - size)  # how far a unit's nodes go down
        of = np.repeat(np.arange(len(kept)), size)
        nodes = np.arange(len(of)) + back[of]
        count = np.diff(self.first[: self.n_nodes + 1])[nodes]
        a = np.arange(int(arcs.sum())) + np.repeat(self.first[node0[kept]] - (np.cumsum(arcs) - arcs), arcs)
        self.end[: len(a)] = self.end[a] - np.repeat(back, arcs)
        for old in (self.ids, self.logs, self.sums):
            old[: len(a)] = old[a]
        self.others[: len(nodes)] = self.others[nodes]
        self.first[0], self.first[1 : len(nodes) + 1] = 0, np.cumsum(count)
        self.closes[: self.n_nodes + 1] = False
        self.closes[stops] = True
        self.seen[: len(kept)] = 0.9 * seen[kept]
        self.node0[: len(kept)], self.stop[: len(kept)] = stops - size, stops
        self.n_arcs, self.n_nodes = len(a), len(nodes)
        names = list(self.places)
        self.places = _places([names[k] for k in kept.tolist()])

    def _arcs(self, texts: list[str]):
        """(start, end, id, log weight, arcs of each node) of all pieces in the texts, one after another, by start and end.

        The prefix tree is walked from all places at once, a character a step. A character without a piece is an arc of its
        bytes.
        """
        size = np.array([len(t) for t in texts])
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        rest = np.repeat(np.cumsum(size), size) - np.arange(len(code))
        count = np.zeros(len(code), np.int32)
        at, node, step, found = np.arange(len(code)), np.zeros(len(code), np.int64), 0, []
        while len(at):
            if step:
                key = node << 21 | code[at + step]
                target, known = self._edge(key)
            else:
                target = self.roots[code]
                known = target > 0
            step += 1
            piece = np.where(known, self.final[target], -1)
            own = np.flatnonzero(piece >= 0) if step > 1 else np.arange(len(at))
            ids = piece[own]
            if step == 1:
                bare = np.flatnonzero(ids < 0)
                ids[bare] = np.where(code[bare] < 128, self.bytes[np.minimum(code[bare], 127)], -1 - code[bare])
            where = at[own]
            found.append((where, step, ids, count[where]))
            count[where] += 1
            on = known & (rest[at] > step)
            at, node = at[on], target[on].astype(np.int64)
        first = np.cumsum(count) - count
        start = np.repeat(np.arange(len(code), dtype=np.int32), count)
        end, ids = np.empty(len(start), np.int32), np.empty(len(start), np.int32)
        for where, length, piece, rank in found:
            to = first[where] + rank
            end[to], ids[to] = where + length, piece
        w = self.weights.take(ids, mode="clip")
        bare = np.flatnonzero(ids < 0)
        c = -1 - ids[bare]
        w[bare] = self.byte_weight * (2.0 + (c > 0x7FF) + (c > 0xFFFF))
        return size, rest, start, end, ids, w, count

    def _add(self, new: list[str]) -> None:
        """Lattices of new units: an arc's probability is that of its piece given that a segmentation comes by its start,
        by the sums over all segmentations of the rest, taken a place from the end at a time over all units."""
        size, left, start, end, ids, w, count = self._arcs(new)
        nodes, arcs = len(left), len(start)
        # a unit's end has rest 0, though it is the next one's first node
        stops = np.cumsum(size)
        rest = np.zeros(nodes + 1)
        level = np.repeat(left, count)
        ends_unit = level == end - start
        first = np.append(0, np.cumsum(count, dtype=np.int64))
        long = size > _LONG
        by = np.arange(arcs) if not long.any() else np.flatnonzero(~np.repeat(long, size)[start])
        by = by[np.argsort(level[by].astype(np.uint16), kind="stable")]
        edges = np.append(np.flatnonzero(np.diff(level[by], prepend=-1)), len(by))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = by[x:y]
            at = start[own]
            here = w[own] + np.where(ends_unit[own], 0.0, rest[end[own]])
            head = np.flatnonzero(np.diff(at, prepend=-1))
            k = np.diff(np.append(head, y - x))
            top = np.maximum.reduceat(here, head)
            rest[at[head]] = total = top + np.log(np.add.reduceat(np.exp(here - np.repeat(top, k)), head))
            w[own] = here - np.repeat(total, k)
        for u in np.flatnonzero(long).tolist():
            self._weigh(w, end, first, int(stops[u] - size[u]), int(stops[u]))
        # running sums within a node; any draw ends at its last arc at the latest
        odds = np.exp(w)
        run = np.append(0.0, np.cumsum(odds))
        sums = run[1:] - np.repeat(run[first[:-1]], count)
        sums[first[1:] - 1] = 2.0
        # log probability of a node's arcs but that of over a half, by their own sum, so that none is lost to rounding
        most = np.flatnonzero(w > _HALF)
        odds[most] = 0.0
        with np.errstate(divide="ignore"):
            others = np.log(np.add.reduceat(odds, first[:-1]))
        low = np.flatnonzero((others < -600) & (count > 1))
        if len(low):
            rest = w.copy()
            rest[most] = -np.inf
            own = np.repeat(first[low] - np.append(0, np.cumsum(count[low])[:-1]), count[low]) + np.arange(int(count[low].sum()))
            head = np.append(0, np.cumsum(count[low])[:-1])
            top = np.maximum.reduceat(rest[own], head)
            others[low] = top + np.log(np.add.reduceat(np.exp(rest[own] - np.repeat(top, count[low])), head))
        a, n, u = self.n_arcs, self.n_nodes, len(self.places) - len(new)
        for name, used, more in (("end", a, arcs), ("ids", a, arcs), ("logs", a, arcs), ("sums", a, arcs), ("others", n, nodes), ("first", n, nodes + 1), ("closes", n, nodes + 1), ("node0", u, len(new)), ("stop", u, len(new)), ("seen", u, len(new))):
            old = getattr(self, name)
            if used + more > len(old):
                grown = np.zeros(max(2 * len(old), used + more), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        for old, own in ((self.end, end + n), (self.ids, ids), (self.logs, w), (self.sums, sums)):
            old[a : a + arcs] = own
        self.others[n : n + nodes] = others
        self.first[n : n + nodes + 1] = first + a
        self.closes[n + stops] = True
        self.node0[u : u + len(new)], self.stop[u : u + len(new)], self.seen[u : u + len(new)] = n + stops - size, n + stops, 0
        self.n_arcs, self.n_nodes = a + arcs, n + nodes

    @staticmethod
    def _weigh(w: np.ndarray, end: np.ndarray, first: np.ndarray, node: int, stop: int) -> None:
        """The same for one long unit alone, whose places would each be a step of few arcs."""
        x, y = int(first[node]), int(first[stop])
        weight, to, at = w[x:y].tolist(), (end[x:y] - node).tolist(), (first[node : stop + 1] - x).tolist()
        rest = [0.0] * (stop - node + 1)
        for i in range(stop - node - 1, -1, -1):
            here = [weight[a] + rest[to[a]] for a in range(at[i], at[i + 1])]
            top = max(here)
            rest[i] = total = top + math.log(sum(math.exp(h - top) for h in here))
            for a, h in zip(range(at[i], at[i + 1]), here, strict=True):
                weight[a] = h - total
        w[x:y] = weight

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's units; those of earlier calls don't hold any more, as full arrays make room."""
        if self.n_arcs > self.limit:
            self._renew()
        before, flat, ends, get = len(self.places), [], [], self.places.__getitem__
        for text in texts:
            if text:
                flat += map(get, _UNIT.findall(SPACE + text.replace(" ", SPACE)))
            ends.append(len(flat))
        flat = np.array(flat, np.int64)
        if len(self.places) > before:
            self._add(list(itertools.islice(reversed(self.places), len(self.places) - before))[::-1])
        self.seen[: len(self.places)] += np.bincount(flat, minlength=len(self.places))
        return np.split(flat, ends[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, the leading blank of the first dropped."""
        text = b"".join(self.surfaces[ids].tolist()).decode("utf-8", "surrogatepass")
        return text.replace(SPACE, " ").removeprefix(" ")

    def gives(self, ids: np.ndarray, ends: np.ndarray, texts: list[str]) -> list[bool]:
        """Whether the ids up to each end give these texts again, by the pieces' bytes unless a text holds their mark of a blank."""
        joined, start, out = b"".join, 0, []
        spelt = self.surfaces[ids].tolist()
        for text, end in zip(texts, ends.tolist(), strict=True):
            marked = (SPACE + text.replace(" ", SPACE)).encode("utf-8", "surrogatepass") if text and SPACE not in text else b""
            out.append(joined(spelt[start:end]) == marked or self.decode(ids[start:end]) == text)
            start = end
        return out


def _hash(*keys, x=np.uint64(0)):
    """A hash of whole-number keys, carried on from x, that of the keys before."""
    with np.errstate(over="ignore"):  # products are meant modulo 2**64
        for k in keys:
            x = x ^ np.asarray(k).astype(np.uint64)
            x *= np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
    return x


def _uniform(*keys, x=np.uint64(0)) -> np.ndarray:
    """Draws in (0, 1) by a hash of whole-number keys, so that each depends on its own keys only."""
    out = (_hash(*keys, x=x) >> np.uint64(12)).astype(np.float64)
    out += 0.5
    out *= 2.0**-52
    return out


def _gumbel_below(phi: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel about phi, given that it is at most top."""
    with np.errstate(over="ignore"):
        return phi - np.log(np.exp(phi - top) - np.log(u))


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))), which is x far below 0."""
    return x if x < -30 else math.log(-math.expm1(-math.exp(min(x, 700.0))))


class Lattices:
    """The units of some texts, over the vocabulary's arrays as they stand; only those last made of a vocabulary hold."""

    def __init__(self, vocabulary: Vocabulary, texts: list[str]):
        v = self.vocabulary = vocabulary
        self.docs = v.units(texts)
        self.end, self.ids, self.logs, self.sums, self.others = v.end, v.ids, v.logs, v.sums, v.others
        self.first, self.closes, self.node0, self.stop = v.first, v.closes, v.node0, v.stop

    def paths(self, units: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """One drawn path through each unit, all a step at a time: arcs in order of the units, their nodes, and how many each has.

        x: a hash for each unit, from which its draws are made.
        """
        stop, live, k = self.stop[units], np.arange(len(units)), np.zeros(len(units), np.int64)
        on = at < stop
        live, now, stop, own = live[on], at[on], stop[on], x[on]
        steps, nodes, whose, tails = [], [], [], []
        while len(live) > _FEW:
            draw = _uniform(len(steps), x=own)
            arc = self.first.take(now).astype(np.int64)
            todo = np.flatnonzero(draw >= self.sums.take(arc))
            some, high = arc.take(todo), draw.take(todo)
            while len(todo):
                some += 1
                on = high >= self.sums.take(some)
                arc[todo] = some
                todo, some, high = todo[on], some[on], high[on]
            steps.append(arc)
            nodes.append(now)
            whose.append(live)
            k[live] += 1
            now = self.end.take(arc)
            on = np.flatnonzero(now < stop)
            live, now, stop, own = live.take(on), now.take(on), stop.take(on), own.take(on)
        for u, at, end in zip(live.tolist(), now.tolist(), stop.tolist(), strict=True):
            tail = self._walk(at, end, x[u], len(steps))
            tails.append((u, int(k[u]), tail))
            k[u] += len(tail)
        out, at, start = np.empty(int(k.sum()), np.int64), np.empty(int(k.sum()), np.int64), np.cumsum(k) - k
        for i, (arc, node, own) in enumerate(zip(steps, nodes, whose, strict=True)):
            out[start[own] + i], at[start[own] + i] = arc, node
        for u, before, tail in tails:
            place = slice(start[u] + before, start[u] + before + len(tail))
            out[place], at[place] = np.array(tail, np.int64).reshape(-1, 2).T
        return out, at, k

    def _walk(self, at: int, stop: int, x: np.uint64, step: int) -> list[tuple[int, int]]:
        """Arcs and nodes of the rest of one unit's path, drawn as paths() does from this step on."""
        out, draws, item, first, end = [], [], self.sums.item, self.first.item, self.end.item
        while at < stop:
            if not draws:
                draws = _uniform(np.arange(step + len(out), step + len(out) + 256), x=x).tolist()[::-1]
            draw, arc = draws.pop(), first(at)
            while draw >= item(arc):
                arc += 1
            out.append((arc, at))
            at = end(arc)
        return out

    def piece_ids(self, arcs: np.ndarray) -> np.ndarray:
        return self.all_piece_ids([arcs])[0]

    def all_piece_ids(self, paths: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some paths, one after another, and where each path's end."""
        ids, ends = self.ids[np.concatenate(paths)], np.cumsum([len(p) for p in paths])
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            spelt = [self.vocabulary.bytes[list(chr(-1 - i).encode("utf-8", "surrogatepass"))] for i in ids[bare].tolist()]
            count = np.ones(len(ids), np.int64)
            count[bare] = [len(x) for x in spelt]
            after = np.append(0, np.cumsum(count))
            ids, first = np.repeat(ids, count), after[bare]
            ids[np.repeat(first - (np.cumsum(count[bare]) - count[bare]), count[bare]) + np.arange(int(count[bare].sum()))] = np.concatenate(spelt)
            ends = after[ends]
        return ids, ends

    def _spare(self, node: int, barred: tuple[int, ...]) -> float:
        """Log probability of a node's arcs but the barred ones."""
        own = [a for a in range(int(self.first[node]), int(self.first[node + 1])) if a not in barred]
        return float(np.logaddexp.reduce(self.logs[own])) if own else -math.inf

    def _branch(self, node: int, barred: tuple[int, ...], u: float) -> int:
        """An arc of the node that isn't barred, by probability."""
        own = [a for a in range(int(self.first[node]), int(self.first[node + 1])) if a not in barred]
        p = np.exp(self.logs[own] - self.logs[own].max()).cumsum()
        return own[min(int(np.searchsorted(p, u * p[-1], "right")), len(own) - 1)]

    def _left(self, todo: list, flat, at_node, logs, run, base, starts, ends, want: int):
        """(path, arc, log mass) of what is left by the first arc that differs, for all that can be among a path's `want` best.

        Masses are at most the odds of the path before, which sink along it, so most arcs of a long path are out of reach of
        any draw: draws differ by under _SPAN. Paths whose nearer arcs don't show that are looked at whole.
        """
        free = starts + np.array([t[2] for t in todo])
        before = run - logs
        some = np.flatnonzero(ends > starts)
        floor = np.full(len(todo), -math.inf)
        floor[some] = before[free[some]] - _NEAR
        whose = np.repeat(np.arange(len(todo)), ends - starts)
        late = np.arange(len(flat)) >= free[whose]
        while True:
            spare = np.flatnonzero(late & (before >= floor[whose]))
            own, node = logs[spare], at_node[spare]
            mass = self.others[node]
            less = np.flatnonzero(own <= _HALF)
            with np.errstate(divide="ignore"):
                mass[less] = np.log1p(-np.exp(own[less]))
            for (_, _, _, barred), at in zip(todo, free.tolist(), strict=True):
                if barred:
                    mass[np.searchsorted(spare, at)] = self._spare(int(at_node[at]), (*barred, int(flat[at])))
            kept = mass > -math.inf
            spare, mass = spare[kept], mass[kept]
            doc = whose[spare]
            phi = before[spare] - base[doc] + mass
            edges = np.searchsorted(doc, np.arange(len(todo) + 1)).tolist()
            wide = []
            for d in np.flatnonzero(floor > -math.inf).tolist():
                x = phi[edges[d] : edges[d + 1]]
                if len(x) < want or np.partition(x, -want)[-want] - _SPAN < floor[d] - base[d]:
                    wide.append(d)
            if not wide:
                return doc, spare, phi
            floor[wide] = -math.inf

    def sample(self, k: int, seeds: list[int]):
        """For each text, its k segmentations of largest perturbed log probability: (arcs, log probability, perturbed, log inclusion).

        The set of a text's segmentations is split best first. The largest of a set of log mass m is Gumbel about m, and one
        path, drawn by the arcs' probabilities, attains it; the rest splits into one set for each arc of the path, that
        shares the path before and takes another arc there, whose largest is Gumbel about its own mass, below the path's.
        A set's bound is attained, so sets pop in order of their best member, and each gives one new sample. The
        inclusion score is the odds of being among k draws given the bound of the best that is left. All texts take their
        next sample together.
        """
        seeds = np.array(seeds, np.uint64)
        first = -np.log(-np.log(_uniform(seeds, 1)))
        heaps = [[(-g, 0, None)] for g in first.tolist()]
        found: list[list] = [[] for _ in seeds]
        none = np.empty(0, np.int64)
        for r in range(k):
            todo, heads, tails, ats, marks = [], [], [], [], []
            begun = []
            for d, heap in enumerate(heaps):
                if not heap:
                    continue
                bound, _, task = heapq.heappop(heap)
                units = self.docs[d]
                if task is None:
                    head, nodes, at, fixed, barred, place = none, none, self.node0[units], 0, (), 0
                else:
                    before, nodes, fixed, barred = task
                    arc = self._branch(int(nodes[fixed]), barred, float(_uniform(seeds[d], 2, r)))
                    head, nodes = np.append(before[:fixed], arc), nodes[: fixed + 1]
                    place = int(self.closes[self.end[before[:fixed]]].sum())
                    at = self.node0[units[place:]]
                    at[0] = self.end[arc]
                todo.append((d, -bound, fixed, barred))
                heads.append(head)
                begun.append(nodes)
                tails.append(units[place:])
                ats.append(at)
                marks.append(np.arange(place, len(units)))
            if not todo:
                break
            whose = np.array([t[0] for t in todo])
            many = np.array([len(t) for t in tails])
            arcs, places, each = self.paths(np.concatenate(tails), np.concatenate(ats), _hash(np.concatenate(marks), 3 + r, x=np.repeat(_hash(seeds[whose]), many)))
            cuts = np.append(0, np.cumsum(each))[np.append(0, np.cumsum(many))].tolist()
            full = [np.concatenate([h, arcs[x:y]]) if len(h) else arcs[x:y] for h, x, y in zip(heads, cuts[:-1], cuts[1:], strict=True)]
            walked = [np.concatenate([h, places[x:y]]) if len(h) else places[x:y] for h, x, y in zip(begun, cuts[:-1], cuts[1:], strict=True)]
            sizes = np.array([len(f) for f in full])
            flat, at_node = (np.concatenate(full), np.concatenate(walked)) if r else (arcs, places)
            ends = np.cumsum(sizes)
            logs = self.logs[flat]
            run = np.cumsum(logs)
            base = np.append(0.0, run)[ends - sizes]
            # what is left of each set, by the first arc that differs
            starts = ends - sizes
            doc, spare, phi = self._left(todo, flat, at_node, logs, run, base, starts, ends, k - r)
            tops = np.array([t[1] for t in todo])
            below = _gumbel_below(phi, tops[doc], _uniform(spare - starts[doc], 1000 + r, x=_hash(seeds[whose])[doc]))
            edges = np.searchsorted(doc, np.arange(len(todo) + 1)).tolist()
            want = k - r
            for i, (d, g, fixed, barred) in enumerate(todo):
                path, e, n = full[i], int(ends[i]), int(sizes[i])
                found[d].append((path, float(run[e - 1] - base[i]) if n else 0.0, g))
                own = below[edges[i] : edges[i + 1]]
                best = [int(own.argmax())] if want == 1 and len(own) else np.argpartition(-own, want)[:want] if len(own) > want else range(len(own))
                for j in best:
                    at = int(spare[edges[i] + j]) - (e - n)
                    heapq.heappush(heaps[d], (-float(own[j]), r * (1 << 40) + at, (path, walked[i], at, (*(barred if at == fixed else ()), int(path[at])))))
        out = []
        for heap, own in zip(heaps, found, strict=True):
            left = -heap[0][0] if heap else -math.inf
            out.append([(a, w, g, _log_inclusion(w - left)) for a, w, g in own])
        return out


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str, temperature: float) -> Vocabulary:
    out = Vocabulary(path, temperature)
    gc.freeze()  # modules and pieces stay as long as the worker, so that collections needn't walk them
    return out


def sample(docs: DataFrame, model_path: str, k: int = SAMPLES, temperature: float = TEMPERATURE, seed: int = 5, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sample, n_ids, log_prob, perturbed, log_inclusion, ids_crc32, decoded[, ids]) of k distinct segmentations a row.

    A text with fewer segmentations has as many rows; null and empty texts have one without ids. Draws depend on the seed,
    doc_id and text alone, so repeated rows repeat their samples. decoded: the ids give the text again. Weights are those of the
    model's pieces, its scores over `temperature`, normalised over each text's segmentations.
    """

    def run(batches):
        vocabulary = _vocabulary(model_path, temperature)
        for b in batches:
            names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            for x, y in common.slices(texts, 1 << 18):
                lattices = Lattices(vocabulary, texts[x:y])
                seeds = [xxhash.xxh64_intdigest(f"{seed}:{n}:".encode() + t.encode("utf-8", "surrogatepass")) for n, t in zip(names[x:y], texts[x:y], strict=True)]
                out = [(n, t, r, *s) for n, t, found in zip(names[x:y], texts[x:y], lattices.sample(k, seeds), strict=True) for r, s in enumerate(found)]
                doc, own, rank, paths, weight, perturbed, inclusion = map(list, zip(*out, strict=True))
                ids, ends = lattices.all_piece_ids(paths)
                offsets, raw = np.append(0, ends), memoryview(ids.astype("<i4", copy=False)).cast("B")
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(offsets.tolist())]
                columns = (doc, rank, np.diff(offsets), weight, perturbed, inclusion, sums, vocabulary.gives(ids, ends, own))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
                cols = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids)))
                fields = ["doc_id", "sample", "n_ids", "log_prob", "perturbed", "log_inclusion", "ids_crc32", "decoded", "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=fields[: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ddl = "doc_id long, sample int, n_ids long, log_prob double, perturbed double, log_inclusion double, ids_crc32 long, decoded boolean" + ", ids array<int>" * keep_ids
    return common.map_arrow(rows, run, ddl)


def decode(rows: DataFrame, model_path: str, temperature: float = TEMPERATURE, ids_col: str = "ids", column: str = "text") -> DataFrame:
    """rows with a column of the text of their piece ids, in the place of any of that name; null ids give null."""

    def run(batches):
        vocabulary = _vocabulary(model_path, temperature)
        for b in batches:
            texts = [None if x is None else vocabulary.decode(np.array(x, np.int64)) for x in b.column(b.schema.get_field_index(ids_col)).to_pylist()]
            cols, names = common.without(b, column)
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], names=[*names, column])

    return common.map_arrow(rows, run, T.StructType([*common.replaced(rows.schema, column), T.StructField(column, T.StringType())]))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document, as piece ids, with their scores and checksum."""
    import public_tokenizers

    return sample(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
