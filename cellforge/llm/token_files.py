"""Token ids as Simple-8b shards: encode, write, read back, decode."""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellforge.llm import common

BLOCK = 128
#: Simple-8b selectors as (ids in a word, bits of each); selector 0 is the escape: the next word is one raw id.
SELECTORS = [(1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
COUNT = np.array([n for n, _ in SELECTORS])
#: Bits of the ids that most vocabularies have.
_WIDTHS = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, words in each block of 128 ids uint16); any uint64 id fits, those of over 60 bits as escapes."""
    ids = np.asarray(ids, dtype=np.uint64)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return np.empty(0, np.uint64), np.empty(0, np.uint16)
    v = np.zeros((blocks, BLOCK), np.uint64)
    v.reshape(-1)[: len(ids)] = ids
    size = np.full(blocks, BLOCK)
    size[-1] = len(ids) - BLOCK * (blocks - 1)
    width = np.zeros((blocks, 2 * BLOCK), np.uint8)
    most = int(ids.max())
    if most < len(_WIDTHS):
        width[:, :BLOCK] = _WIDTHS.take(v.view(np.int64))
    elif most < 1 << 53:
        width[:, :BLOCK] = np.frexp(v.astype(np.float64))[1]
    else:
        top = v.copy()
        while top.any():
            width[:, :BLOCK] += top > 0
            top >>= np.uint64(1)
    span, reach = {1: width}, 1
    while 2 * reach <= BLOCK:
        nxt = span[reach].copy()
        np.maximum(nxt[:, :-reach], span[reach][:, reach:], out=nxt[:, :-reach])
        reach *= 2
        span[reach] = nxt
    sel = np.zeros((blocks, BLOCK), np.uint8)
    for s in range(15, 0, -1):
        n, w = SELECTORS[s]
        p = 1 << (n.bit_length() - 1)
        most = np.maximum(span[p][:, :BLOCK], span[p][:, n - p : n - p + BLOCK])
        np.copyto(sel, s, where=most <= w)
    # All blocks take their next word in step, so a loop runs over the words of the longest block only.
    sel, take, slots = sel.reshape(-1), COUNT[sel].reshape(-1), np.zeros(blocks, np.int64)
    at, live, rows, starts, places = np.arange(blocks) * BLOCK, np.arange(blocks), [], [], []
    stop = at + size
    while len(live):
        now = at[live]
        rows.append(live)
        starts.append(now)
        places.append(slots[live])
        slots[live] += 1 + (sel[now] == 0)
        now = now + take[now]
        at[live] = now
        live = live[now < stop[live]]
    row, start, place = map(np.concatenate, (rows, starts, places))
    kind = sel[start]
    place += (np.cumsum(slots) - slots)[row]
    words = np.zeros(int(slots.sum()), np.uint64)
    # Ids beyond the end of a block are zero for its last word.
    flat = np.concatenate([v, np.zeros_like(v)], axis=1).reshape(-1)
    start += row * BLOCK
    for s in np.unique(kind).tolist():
        k = np.flatnonzero(kind == s)
        n, w = SELECTORS[s]
        if s == 0:
            words[place[k] + 1] = flat[start[k]]
            continue
        word, at = np.full(len(k), s, np.uint64), start[k]
        for j in range(n if w else 0):
            word |= flat[at] << np.uint64(4 + w * j)
            at += 1
        words[place[k]] = word
    return words, slots.astype(np.uint16)


def unpack(words: np.ndarray, block_words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of pack()."""
    if not n:
        return np.empty(0, np.uint64)
    # the last word of a block may have room beyond it, 59 places at most in words that hold any bits
    row = 2 * BLOCK
    out = np.zeros(-(-n // BLOCK) * row, np.uint64)
    words = np.asarray(words, np.uint64)
    first = np.concatenate([[0], np.cumsum(block_words.astype(np.int64))])
    block = np.repeat(np.arange(len(block_words)), block_words)
    kind = (words & np.uint64(15)).astype(np.int64)
    # A raw word that follows an escape can look like any selector: only blocks that hold a selector 0 may have one.
    count = COUNT[kind]
    for b in np.unique(block[kind == 0]).tolist():
        i = first[b]
        while i < first[b + 1]:
            if kind[i] == 0:
                kind[i + 1], count[i], count[i + 1] = -1, 0, 1
                i += 1
            i += 1
    before = np.cumsum(count) - count
    start = row * block + before - before[first[block]]
    for s in np.unique(kind).tolist():
        k = np.flatnonzero(kind == s)
        if s == -1:
            out[start[k]] = words[k]
            continue
        m, w = SELECTORS[s]
        if s == 0 or not w:
            continue
        mask = np.uint64((1 << w) - 1)
        own, at = words[k] >> np.uint64(4), start[k]
        for _ in range(m):
            out[at] = own & mask
            own >>= np.uint64(w)
            at += 1
    return out.reshape(-1, row)[:, :BLOCK].reshape(-1)[:n]


_WHITE = [chr(c) for c in (*range(9, 14), *range(28, 32), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_ASCII_WHITE = [c for c in _WHITE if c.isascii()]
_SAFE = re.compile(r"(?<=\S)(?= \S)")


#: A word of Latin letters with what ASCII marks follow it, apostrophes aside: these are two parts for the pattern.
_WORD = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")


_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


#: Packs few ids as native unsigned 32-bit integers, by how many they are.
_PACKED = [struct.Struct(f"={n}I").pack for n in range(32)]


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class UnitEncoder:
    """Byte-level BPE of whole texts through a bounded cache of what lies between safe boundaries.

    A boundary before a blank that stands between two characters that aren't white space is one for the vocabulary's own
    splitting pattern too, so the ids of a text are those of its parts; each new part is encoded by the library, words and
    the marks after them apart. A special token in a text is its one id, as by the library's defaults, and what stands before
    and after it are texts of their own. The cache has two generations: full, the newer becomes the older.
    """

    def __init__(self, path: str, limit: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("an added token takes more than its own text")
        self.added = {t.content: array("I", [i]).tobytes() for i, t in added.items()}
        # the longest of those that begin at a place
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.model = self.tokenizer.model
        self.limit, self.new, self.old, self.letters = limit, {}, {}, _byte_letters()

    def parts(self, text: str) -> list[str]:
        white = [c for c in (_ASCII_WHITE if text.isascii() else _WHITE) if c in text]
        if "  " in text or any(c + " " in text or " " + c in text for c in white):
            return _SAFE.split(text)
        if "\0" in text:
            return _SAFE.split(text)
        cut = text.replace(" ", "\0 ")
        # a line feed between two characters that aren't white space is a part of its own
        if white == ["\n"] and "\n\n" not in text:
            cut = cut.replace("\n", "\0\n\0")
        return cut.split("\0")

    def _one(self, part: str) -> bytes:
        """Ids of one part of the pattern."""
        got = self.new.get(part)
        if got is None:
            got = self.old.get(part)
            self.new[part] = got = self._bpe(part) if got is None else got
        return got

    def _bpe(self, part: str) -> bytes:
        if part.isascii():
            mapped = part.replace(" ", self.letters[32])
        else:
            mapped = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(mapped)]
        return _PACKED[len(ids)](*ids) if len(ids) < len(_PACKED) else array("I", ids).tobytes()

    def _learn(self, part: str) -> bytes:
        got = self.old.get(part)
        if got is None:
            word = part.rstrip(_MARKS)
            if not (word.isascii() and (word.isalpha() or word[:1] == " " and word[1:].isalpha())):
                m = _WORD.fullmatch(part)
                word = m[1] if m else ""
            if not word:
                got = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
            elif len(word) == len(part):
                got = self._bpe(part)
            else:
                got = self._one(word) + self._one(part[len(word) :])
        self.new[part] = got
        return got

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        out = []
        for text in texts:
            if any(t in text for t in self.added):
                sections = self.split.split(text)
                out.append(b"".join(self.added[s] if i % 2 else self._plain(s) for i, s in enumerate(sections)))
            else:
                out.append(self._plain(text))
        return out

    def _plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        parts = self.parts(text) if text else []
        got, at = list(map(self.new.get, parts)), -1
        for _ in range(got.count(None)):
            at = got.index(None, at + 1)
            got[at] = self._learn(parts[at])
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        return b"".join(got)


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> UnitEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return UnitEncoder(path)


SHARD = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("block_words", pa.binary()), ("words", pa.binary())])
SHARD_DDL = "shard long, segment long, before long, n_ids long, doc_ids array<long>, n_tokens array<long>, block_words binary, words binary"


def encode(docs: DataFrame, tokenizer_path: str, end_id: int = 0, segment_ids: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard rows of docs in ascending doc_id order, ready to be written.

    A shard is a range of doc_ids, in segments of whole documents of about segment_ids ids. Each document ends with end_id.
    Null and empty texts have that id alone; null doc_ids come first; rows that repeat a doc_id are written each, by a hash of their text. `before` counts the
    ids of the shard before the segment, block_words the 64-bit words of each block of 128 ids.
    """

    def segment(shard, number, before, ids, names):
        each = [len(x) // 4 for x in ids]
        words, block_words = pack(np.frombuffer(b"".join(ids), "<u4"))
        row = [[shard], [number], [before], [sum(each)], [names], [each], [block_words.astype("<u2").tobytes()], [words.astype("<u8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, SHARD, strict=True)], schema=SHARD)

    def run(batches):
        encoder, shard = _encoder(tokenizer_path), TaskContext.get().partitionId()
        number = before = held = 0
        ids, names, end = [], [], np.array([end_id], "<u4").tobytes()
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = encoder.encode([text or ""])[0] + end
                ids.append(got)
                names.append(name)
                held += len(got) // 4
                if held >= segment_ids:
                    yield segment(shard, number, before, ids, names)
                    number, before, held, ids, names = number + 1, before + held, 0, [], []
        if ids:
            yield segment(shard, number, before, ids, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # rows of one doc_id by a hash of their text, so that every run gives the same order and many of them fall to several tasks
    order = ["doc_id", F.xxhash64("text"), "text"]
    return common.map_arrow(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order), run, SHARD_DDL)


def decode(shards: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of written shards; start counts the ids of all documents before it.

    Only one count a shard, thus as many as the writer had tasks, passes through the driver.
    """
    counts = sorted(shards.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts, total = [], 0
    for shard, n in counts:
        starts.append((shard, total))
        total += n

    def run(batches):
        for b in batches:
            out = [[], [], [], [], []]
            for r in b.to_pylist():
                ids = unpack(np.frombuffer(r["words"], "<u8"), np.frombuffer(r["block_words"], "<u2"), r["n_ids"])
                small, at = ids.astype("<u4"), 0
                for name, n in zip(r["doc_ids"], r["n_tokens"], strict=True):
                    own = ids[at : at + n]
                    for x, y in zip(out, (name, r["first"] + r["before"] + at, n, zlib.crc32(small[at : at + n]), own if keep_ids else None), strict=True):
                        x.append(y)
                    at += n
            cols = [pa.array(x, pa.int64()) for x in out[:4]] + ([pa.array([x.astype(np.int64) for x in out[4]], pa.list_(pa.int64()))] if keep_ids else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    first = F.broadcast(shards.sparkSession.createDataFrame(starts, "shard long, first long"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return common.map_arrow(shards.join(first, "shard"), run, ddl)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    return decode(common.cut(encode(docs, public_tokenizers.path("byte_bpe_50k.json")), "shards"), keep_ids=False)
