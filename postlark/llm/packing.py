"""Packs tokenised documents into sequences of a fixed capacity (best-two-fit).

A bin is filled greedily with the longest pieces that still fit. Then its
smallest piece is taken out if two unpacked pieces fill the larger gap better; of
equally good pairs that with the shortest longer piece goes in.

Only lengths matter, and there are at most `capacity` of them, so bins are
planned on the driver over a histogram of lengths: a pattern of lengths is
repeated for as long as the one-by-one algorithm would make the same choices.
The plan says which ranks of a length go to which sequences and offsets. A
piece's rank among those of its length is its rank in its own task plus the
number in earlier tasks, so no task ever sees all pieces of a length.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored
from .wordhash import slices

CAPACITY = 4096
END_ID = 1
_SLICE = 3 << 20  # bytes of text that are looked up together


def _byte_letters() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as it is, the rest from 256 on."""
    odd = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b)]
    return {b: 256 + i for i, b in enumerate(odd)}


#: Lower-case letters that are one code point, composed, and no longer in lower case.
_LETTERS = re.compile(r"[a-zß-öø-ÿа-яё]+")


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary drops white space and never joins what it separates, so a
    text's ids are those of its white-space-separated parts one after another.
    Parts repeat; those of up to 64 bytes are kept in two tables of at most `most`
    parts: when one is full it becomes the old one, and what is still met there
    moves on to the new one. A part of letters, with full stops and commas behind,
    is two units for the model at most and goes to it at once; others go through
    the tokenizer together, with a mark between them that is one token.
    """

    MARK = b"~"

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_file(path), most
        self.merge, self.letters = self.model.model, _byte_letters()
        self.held: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {b"": b""}
        ids = self.model.encode(self.MARK.decode(), add_special_tokens=False).ids
        self.mark = ids[0] if len(ids) == 1 else None

    def unit(self, text: str) -> bytes:
        """Ids of one run of letters or of symbols, in lower case."""
        return array("I", [t.id for t in self.merge.tokenize(text)]).tobytes()

    def plain(self, part: bytes) -> bytes | None:
        """Ids of letters with full stops and commas behind them; None for anything else.

        Only scripts of up to U+0530 whose letters are composed and keep one code
        point in lower case count as letters here.
        """
        core = part.rstrip(b".,")
        if core.isalpha():  # of ASCII
            ids = self.unit(core.decode().lower())
        else:
            text = core.decode("utf-8")
            if not _LETTERS.fullmatch(text):
                if not text.isalpha():
                    return None
                lower = "".join(c.lower() for c in text)
                if max(text) > "\u052f" or len(lower) != len(text) or not unicodedata.is_normalized("NFC", text):
                    return None
                text = lower
            ids = self.unit(text.encode().decode("latin-1").translate(self.letters))
        if len(core) == len(part):
            return ids
        tail = part[len(core) :]
        if tail not in self.tails:
            if len(self.tails) > 1000:
                self.tails = {b"": b""}
            self.tails[tail] = self.unit(tail.decode())
        return ids + self.tails[tail]

    def encode(self, parts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each part with its ids; parts are told apart by marks, those that may hold one go one by one."""
        alone, joined = [], []
        for p in parts:
            (alone if self.mark is None or self.MARK in p or not p.isascii() else joined).append(p)
        if joined:
            text = (b" " + self.MARK + b" ").join(joined).decode()
            ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(ids == self.mark).tolist(), len(ids)]
            if len(ends) == len(joined):
                raw, at = ids.tobytes(), 0
                for p, end in zip(joined, ends, strict=True):
                    yield p, raw[4 * at : 4 * end]
                    at = end + 1
            else:
                alone += joined
        texts = [p.decode("utf-8") for p in alone]
        for p, e in zip(alone, self.model.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            yield p, np.array(e.ids, "<u4").tobytes()

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        if len(self.held) > self.most:
            self.held, self.old = {}, self.held
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]  # special tokens are told by their case
        now: dict[bytes, bytes] = {}
        rest = []
        for w in set().union(*words).difference(self.held):
            if (ids := self.old.get(w)) is not None:
                self.held[w] = ids
            elif len(w) <= 64 and (ids := self.plain(w)) is not None:
                self.held[w] = ids
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            for w, ids in self.encode(rest[at : at + 4096]):
                (self.held if len(w) <= 64 else now)[w] = ids
        self.held.update(now)
        for ws in words:
            yield b"".join(map(self.held.__getitem__, ws))
        for w in now:
            del self.held[w]


_TOKENS: dict[str, Tokens] = {}  # of this worker, for all its tasks


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-two-fit over counts of lengths: (length, first rank, count, first sequence, offset).

    Ranks first, first + 1, ... of a length go to as many sequences from the first
    one on, at that offset.
    """
    used: Counter[int] = Counter()
    lengths = np.array(sorted(n for n, c in histogram.items() if c > 0), np.int64)
    counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
    listed = lengths.tolist()
    runs, sequence = [], 0
    while listed:
        greedy: Counter[int] = Counter()  # by place among the lengths
        gap, at = capacity, len(listed) - 1
        while at >= 0:
            n = listed[at]
            if take := min(gap // n, int(counts[at])):
                greedy[at] += take
                gap -= take * n
            at = min(at, bisect_right(listed, gap)) - 1
        final = Counter(greedy)
        if gap:
            least = min(greedy)
            small = listed[least]
            free = counts.copy()
            for i, n in greedy.items():
                free[i] -= n - (i == least)
            ok = np.flatnonzero(free > 0)
            pool, many = lengths[ok], free[ok] > 1
            a = pool[pool < gap + small]
            b = np.searchsorted(pool, np.minimum(a, gap + small - a), side="right") - 1
            b = np.where((b >= 0) & (pool[np.maximum(b, 0)] == a) & ~many[: len(a)], b - 1, b)
            sums = np.where(b >= 0, a + pool[np.maximum(b, 0)], 0)
            if len(a) and sums.max() > small:
                best = int(np.argmax(sums))
                final[least] -= 1
                final[int(ok[best])] += 1
                final[int(ok[b[best]])] += 1
                final = +final
        times = min((int(counts[i]) - max(greedy[i], n)) // n for i, n in final.items()) + 1
        offset = 0
        for i in sorted(final, reverse=True):
            n = listed[i]
            for _ in range(final[i]):
                runs.append((n, used[n], times, sequence, offset))
                used[n] += times
                offset += n
        sequence += times
        for i, n in final.items():
            counts[i] -= n * times
        if any(not counts[i] for i in final):
            lengths, counts = lengths[counts > 0], counts[counts > 0]
            listed = lengths.tolist()
    return runs


def pieces(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenises whole texts and cuts those over the capacity.

    Besides the piece: task and rank, its place among the pieces of its length in
    its task. A null or empty text has the end id alone.
    """
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type)] + [T.StructField(c, t) for c, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("task", T.IntegerType()), ("rank", T.LongType()))] + ([T.StructField("ids", T.BinaryType())] if with_ids else []))
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENS:
            _TOKENS[path] = Tokens(path)
        tokens = _TOKENS[path]
        task, ranks = TaskContext.get().partitionId(), Counter()
        for b in batches:
            for some in slices(b, "text", _SLICE):
                texts = some.column("text").cast(pa.large_binary()).to_pylist()
                of, rows = [], []
                for i, ids in enumerate(tokens.of([t or b"" for t in texts])):
                    ids += end
                    for k in range(0, len(ids), step):
                        part = ids[k : k + step]
                        n = len(part) // 4
                        of.append(i)
                        rows.append((k // step, k // 4, n, zlib.crc32(part), task, ranks[n], part))
                        ranks[n] += 1
                kinds = pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
                cols = [pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(schema) - 1], kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), *cols], names=schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, **options) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    Sequences are filled from offset 0 without gaps. Repeated rows and null ids
    are packed like any other; an empty table gives no rows. with_ids=True also
    returns each piece's ids (little-endian unsigned 32-bit).
    """
    cut = stored(pieces(docs, path, capacity=capacity, **options), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    held = docs.sparkSession.sparkContext.broadcast(np.array(runs, np.int64).reshape(-1, 5))
    placed = cut.join(bases.select("task", "length", "base"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    rest = [c for c in cut.columns if c not in ("task", "rank", "length")]
    schema = T.StructType([cut.schema[c] for c in rest] + [cut.schema["length"]] + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        keys = r[:, 0] << 48 | r[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), b.column("length"), pa.array(r[at, 3] + rank - r[at, 1]), pa.array(r[at, 4])], names=schema.names)

    return placed.select(*rest, "length", "rank").mapInArrow(place, schema)
