"""Phrase collocations: counts of all n-grams by language, scored against their parts.

All 1- to max_n-grams of the pieces of whole texts become rows and are added up by
language and phrase. A phrase of n words occurs at most as often as each part of it,
so from the second level on only n-grams are exploded whose first and last n - 1 words
may both have reached `least`; that is read from a bit set of hashes, where a collision
costs rows and changes no count. Parts of candidates have counts of `least` or more
themselves, so joins find them among the phrases that are left.

Within a slice of a batch n-grams are numbered word by word, exactly, and equal ones
become one row, so what is shuffled is one row a slice and phrase at most.

Null texts and texts without a word give nothing; a null language is `und`. Repeated
rows count each. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, partitions, stored
from .wordhash import LOWER, SPACE, U64, mix, shingles, slices, split

#: What ends a piece, and what stands between words of one.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BETWEEN = _ENDS.copy()
_BETWEEN[[0x20, 0x09]] = True
#: Bits of a set for each phrase in it, and the most that one has (32 MB).
_BITS_EACH, _MOST_BITS = 64, 1 << 28
_CHUNK = 1 << 16
#: Bytes of text whose n-grams are numbered at once.
_SLICE = 2 << 20
_COUNTED = "lang string, phrase string, f long"


def _of_lang(langs: list[str]) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], U64)


def _unique(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """A place of each different key, the number of each key, and how many there are."""
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number, len(first)


def _grams(part: pa.RecordBatch, n: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase and count of the n-grams of some texts whose parts are in bits; with n = 1 also all words, as phrase null."""
    words = split(part.column("text"), _BETWEEN, LOWER, hashed=bits is not None)
    size = words.ends - words.starts
    inside = LOWER[words.data[~_BETWEEN[words.data]]]
    texts = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(inside)])
    coded = texts.dictionary_encode()
    code, many = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    langs = pc.fill_null(part.column("lang"), "und").dictionary_encode()
    of_text = words.text_of()
    lang = langs.indices.to_numpy()[of_text].astype(np.int64)
    names = langs.dictionary
    if bits is None:
        at = np.arange(len(code))
    else:
        ended = np.cumsum(_ENDS[words.data])[words.starts] if len(size) else size
        i = np.arange(max(len(code) - n + 1, 0))
        whole = (of_text[i] == of_text[i + n - 1]) & (ended[i] == ended[i + n - 1])
        known = mix(shingles(words.hashes, n - 1) ^ _of_lang(names.to_pylist())[lang[: max(len(code) - n + 2, 0)]]) & U64(len(bits) * 8 - 1)
        held = (bits[(known >> U64(3)).astype(np.int64)] >> (known & U64(7)).astype(np.uint8)) & 1 > 0
        at = i[whole & held[i] & held[i + 1]]
    first, number, many_keys = _unique(lang[at] * many + code[at])
    for k in range(1, n):
        first, number, many_keys = _unique(number * many + code[at + k])
    f = np.bincount(number, minlength=many_keys).astype(np.int64)
    place = at[first]
    phrases = [coded.dictionary.take(pa.array(code[place + k])) for k in range(n)]
    phrase = phrases[0] if n == 1 else pc.binary_join_element_wise(*phrases, pa.scalar(" ", pa.large_string()))
    lang_of, phrase = names.take(pa.array(lang[place])), phrase.cast(pa.string())
    if n == 1:
        total = np.bincount(lang, minlength=len(names)).astype(np.int64)
        some = np.flatnonzero(total)
        lang_of = pa.concat_arrays([lang_of, names.take(pa.array(some))])
        phrase = pa.concat_arrays([phrase, pa.nulls(len(some), pa.string())])
        f = np.concatenate([f, total[some]])
    return pa.RecordBatch.from_arrays([lang_of, phrase, pa.array(f)], names=["lang", "phrase", "f"])


def _level(texts: DataFrame, n: int, bits: np.ndarray | None, least: int) -> DataFrame:
    """Counts of n-grams of `least` and more, and with n = 1 all words of a language, as phrase null."""
    held = None if bits is None else texts.sparkSession.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text", _SLICE):
                yield _grams(part, n, None if held is None else held.value)

    sums = texts.mapInArrow(count, _COUNTED).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return sums.where((F.col("f") >= least) | F.col("phrase").isNull()).withColumn("words", F.lit(n))


def _bits(level: DataFrame, n: int, count: int, most: int) -> np.ndarray:
    """The set of a level's phrases as bits; its size follows their number up to `most` bits."""
    size = max(min(most, 1 << (count * _BITS_EACH).bit_length()), 8 * _CHUNK)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "phrase"):
                words = split(part.column("phrase"), SPACE)
                langs = part.column("lang").dictionary_encode()
                h = shingles(words.hashes, n)[words.first[:-1]]
                at = np.unique((mix(h ^ _of_lang(langs.dictionary.to_pylist())[langs.indices.to_numpy()]) & U64(size - 1)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((at // (8 * _CHUNK)).astype(np.int32)), pa.array((at % (8 * _CHUNK)).astype(np.int32))], names=["chunk", "at"])

    def gather(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(8 * _CHUNK, bool)
        for b in batches:
            out[b.column("at").to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    placed = level.where("phrase IS NOT NULL").select("lang", "phrase").mapInArrow(place, "chunk int, at int").distinct()
    got = placed.groupBy("chunk").applyInArrow(gather, "chunk int, bits binary").toArrow()
    out = np.zeros(size // 8, np.uint8)
    for chunk, x in zip(got["chunk"].to_pylist(), got["bits"].to_pylist(), strict=True):
        out[chunk * _CHUNK : (chunk + 1) * _CHUNK] = np.frombuffer(x, np.uint8)
    return out


def frequent(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_n: int = 4, least: int = 30, most_bits: int = _MOST_BITS) -> list[DataFrame]:
    """For each n to max_n the stored phrases of n words with f >= least: lang, phrase, f, words; the caller discards them.

    The first also has a language's number of words, as phrase null.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL")
    levels: list[DataFrame] = []
    bits = None
    for n in range(1, max_n + 1):
        if n > 1:
            count = levels[-1].where("phrase IS NOT NULL").count()
            bits = _bits(levels[-1], n - 1, count, most_bits)
        levels.append(stored(_level(texts, n, bits, least), f"grams{n}"))
    return levels


def scored(levels: list[DataFrame]) -> DataFrame:
    """lang, phrase, words, a, l, r, n, score of all phrases of two words or more, by their lowest-scoring cut.

    The score is floor(2000000 * a / (l + r)), in decimals; of equal ones the first cut counts.
    """
    every = reduce(DataFrame.unionByName, levels).where("phrase IS NOT NULL").select("lang", "phrase", "f", "words")
    total = levels[0].where("phrase IS NULL").select("lang", F.col("f").alias("n"))
    ws = F.split("phrase", " ")
    cut = every.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.withColumns({"left": F.array_join(F.slice(ws, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(ws, F.col("k") + 1, F.col("words") - F.col("k")), " ")})
    of = lambda name, f: every.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    both = cut.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    score = F.expr("cast(a AS decimal(19, 0)) * cast(2000000 AS decimal(7, 0)) div (cast(l AS decimal(19, 0)) + cast(r AS decimal(19, 0)))")
    best = both.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score").join(total, "lang")


def _unabsorbed(levels: list[DataFrame], candidates: DataFrame, share: int) -> DataFrame:
    """Candidates without a phrase one word longer that holds them in `share` percent of their occurrences.

    A phrase longer by two words or more is no more frequent than one between, so one word is enough.
    """
    longer = reduce(DataFrame.unionByName, levels[2:], levels[-1].limit(0)).select("lang", "phrase", "f", "words")
    ws = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(ws, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(ws, F.lit(2), F.col("words") - 1), " "))
    most = longer.select("lang", "f", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    big = "cast(100 AS decimal(3, 0)) * cast(most AS decimal(19, 0)) >= cast(a AS decimal(19, 0)) * cast({} AS decimal(3, 0))"
    absorbed = candidates.select("lang", "phrase", "a").join(most, ["lang", "phrase"]).where(F.expr(big.format(share))).select("lang", "phrase")
    return candidates.join(absorbed, ["lang", "phrase"], "left_anti")


def mine(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_n: int = 4, least: int = 30, share: int = 80, top: int = 2000) -> DataFrame:
    """The first `top` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Ranked by score and a, both descending, and the phrase in byte order. A language's
    rows are ranked in blocks first, so no task holds more than its share of them.
    """
    levels = frequent(docs, text_col=text_col, lang_col=lang_col, max_n=max_n, least=least)
    left = _unabsorbed(levels, scored(levels), share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    blocks = partitions(docs.sparkSession)
    nth = F.row_number()
    some = left.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    some = some.withColumn("nth", nth.over(Window.partitionBy("lang", "block").orderBy(*order))).where(F.col("nth") <= top)
    best = some.withColumn("rank", nth.over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)  # of top * blocks rows
    out = stored(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    discard(*levels)
    return out
