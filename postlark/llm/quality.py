"""Quality classification by importance resampling over hashed n-grams.

Two generative models give the rate at which documents contain a hashed n-gram:
one of target text (documents labelled good), one of raw text (all documents).
A document's importance weight is the ratio of both over its distinct n-grams.
N-grams are all words of the whole text (A-Z lower-cased), all pairs of words that
follow each other, and the sliding pairs and triples of characters of each word
that has one outside ASCII, as scripts without blanks make one word of a sentence.
Runs of symbols and marks of how long words keep repeating are added to them.

N-grams are counted in two tables with independent hashes. One counts with the
smaller of its two log ratios, so what shares a bucket with it in one table does not
weigh. Log ratios compare rates, so they are alike at every size: they are smoothed
by `prior` documents, are 0 unless the counts differ by `least` standard deviations
(a likelihood-ratio test), and are shrunk towards 0 by `margin`, so the many n-grams
that both models agree on do not add up with length. What is rarer in target text is held against documents
labelled bad, if there are any: what no label covers, such as a group of unlabelled
copies, says nothing, and few labels among many documents do not weaken it. A
document's log weight is the sum; documents are drawn without replacement by
Gumbel top-k: log weight times `sharpness` plus Gumbel noise from a hash of id
and text. k is the effective size of the sample, the sum of the weights cut at
1, unless the caller gives it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, fresh, stored
from .wordhash import LOWER, NON_ALNUM, SPACE, U64, Words, mix, slices, split

#: Of each of two tables.
BUCKETS = 1 << 20
_CHUNK = 1024
#: Which labels are of target text, as SQL.
GOOD = "quality = 1 AND coalesce(toxic, 0) = 0"
#: Everything but symbols of ASCII.
_NOT_SYMBOL = ~NON_ALNUM | SPACE
_NOT_SYMBOL[[*range(0x00, 0x20), 0x7F]] = True
_CHARS = (2, 3)
_STREAKS = (4, 8, 16)
#: The bytes of a character by its first one.
_OF_LEAD = np.repeat(np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32), (0xC0, 0x20, 0x10, 0x10))


def _characters(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The characters, as their bytes, of words with one outside ASCII, and the word of each."""
    wide = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(words.data >= 0x80)])[np.stack([words.starts, words.ends])], axis=0)[0])
    lens = words.ends[wide] - words.starts[wide]
    at = np.arange(lens.sum()) + np.repeat(words.starts[wide] - np.cumsum(lens) + lens, lens)
    of = np.repeat(wide, lens)
    lead = (words.data[at] & 0xC0) != 0x80
    at, of = at[lead], of[lead]
    held = np.concatenate([LOWER[words.data], np.zeros(3, np.uint8)])
    four = np.ndarray((len(held) - 3,), np.dtype("<u4"), held, strides=(1,))[at]
    return (four & _OF_LEAD[words.data[at]]).astype(U64), of


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The text and the hash of each n-gram, repeated ones too."""
    words, symbols = split(column, NON_ALNUM, LOWER), split(column, _NOT_SYMBOL)
    of_word, of_symbol = words.text_of(), symbols.text_of()
    ofs, grams = [of_symbol], [mix(symbols.hashes)]
    h = words.hashes
    ofs.append(of_word)
    grams.append(h)
    near = np.flatnonzero(of_word[1:] == of_word[:-1])
    ofs.append(of_word[near])
    grams.append(mix(h[near] + mix(h[near + 1])))
    chars, of_char = _characters(words)
    for k in _CHARS:
        at = np.flatnonzero(of_char[k - 1 :] == of_char[: len(of_char) - k + 1])
        g = np.full(len(at), k, U64)
        for i in range(k):
            g = mix(g + chars[at + i])
        ofs.append(of_word[of_char[at]])
        grams.append(g)
    again = np.zeros(len(h), bool)
    for back in (1, 2):
        again[back:] |= (h[back:] == h[:-back]) & (of_word[back:] == of_word[:-back])
    streak = np.arange(len(h)) - np.maximum.accumulate(np.where(again, -1, np.arange(len(h)))) if len(h) else np.zeros(0, int)
    for k in _STREAKS:
        at = np.flatnonzero(streak == k)
        ofs.append(of_word[at])
        grams.append(np.full(len(at), k, U64))
    return np.concatenate(ofs), mix(np.concatenate(grams))


def _distinct(of: np.ndarray, grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's buckets in both tables (2 rows), once for an n-gram."""
    square = buckets * buckets
    both = np.sort(of.astype(np.int64) * square + (grams % U64(square)).astype(np.int64))
    both = both[np.diff(both, prepend=-1) != 0]
    pair = both % square
    return both // square, np.stack([pair % buckets, pair // buckets])


@dataclass(frozen=True)
class Ratios:
    """Log ratio of each bucket, target over raw; a row for each table."""

    log: np.ndarray
    sharpness: float
    seed: int


def _shrunk(a: np.ndarray, n_a: float, b: np.ndarray, n_b: float, prior: float, least: float, margin: float) -> np.ndarray:
    """The log ratio of the rates a / n_a and b / n_b, 0 where chance explains it."""
    log = np.log((a + prior) / (n_a + 2 * prior)) - np.log((b + prior) / (n_b + 2 * prior))
    rate = (a + b) / (n_a + n_b)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1)), 0)

    test = 2 * (part(a, n_a * rate) + part(b, n_b * rate) + part(n_a - a, n_a * (1 - rate)) + part(n_b - b, n_b * (1 - rate)))
    return np.where(test >= least * least, np.sign(log) * np.maximum(np.abs(log) - margin, 0), 0)


def _contrast(counts: np.ndarray, n: np.ndarray, prior: float, least: float, margin: float) -> np.ndarray:
    """Log ratios by counts of all, good and bad texts: over 0 of good to all, under 0 of good to bad."""
    raw, target, bad = counts
    if not n[1]:
        return np.zeros(len(raw))
    over = _shrunk(target, n[1], raw, n[0], prior, least, margin)
    under = _shrunk(target, n[1], bad, n[2], prior, least, margin) if n[2] else over
    return np.maximum(over, 0) + np.minimum(under, 0)


def fit(docs: DataFrame, labels: DataFrame, *, good: str = GOOD, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", most_labels: int = 400_000, buckets: int = BUCKETS, prior: float = 0.5, least: float = 4.0, margin: float = 2.0, sharpness: float = 12.0, seed: int = 5) -> Ratios:
    """Fits both models: raw text on all documents, target text on good labelled ones.

    At most most_labels labels are used, those with the smallest hash of their id,
    so what is broadcast is bounded. Counts are summed by chunks of buckets on the
    executors; only log ratios other than 0 reach the driver.
    Labels with null ids are left out; an id with different labels counts as bad.
    Without a good label every document weighs the same.
    """
    rows = labels.select(F.col(label_id).cast("long").alias("id"), F.coalesce(F.expr(good), F.lit(False)).alias("good")).where("id IS NOT NULL")
    drawn = rows.groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(most_labels).toArrow().sort_by("id")
    size = min(_CHUNK, 2 * buckets)
    held = docs.sparkSession.sparkContext.broadcast((drawn["id"].to_numpy(), drawn["good"].to_numpy()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, is_good = held.value
        counts, n = np.zeros((3, 2 * buckets), np.int32), np.zeros(3, np.int64)
        for b in batches:
            for part in slices(b, "text"):
                ids = part.column("id").to_numpy(zero_copy_only=False)
                at = np.minimum(np.searchsorted(known, ids), max(len(known) - 1, 0))
                label = np.where(known[at] == ids, np.where(is_good[at], 1, 2), 0) if len(known) else np.zeros(len(ids), int)
                of, bucket = _distinct(*_grams(part.column("text")), buckets)
                for kind in range(3):  # all, good, bad
                    n[kind] += len(ids) if kind == 0 else int((label == kind).sum())
                    mine = bucket if kind == 0 else bucket[:, label[of] == kind]
                    for t in range(2):
                        counts[kind, t * buckets : (t + 1) * buckets] += np.bincount(mine[t], minlength=buckets).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["chunk", "counts"])
        for a in range(0, 2 * buckets, size):
            if counts[0, a : a + size].any():
                yield pa.RecordBatch.from_arrays([pa.array([a // size], pa.int32()), pa.array([counts[:, a : a + size].tobytes()], pa.binary())], names=["chunk", "counts"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62))).alias("id"), F.col(text_col).cast("string").alias("text"))
    sums = stored(texts.mapInArrow(count, "chunk int, counts binary"), "counts")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_task = np.zeros(3, np.int64)
        for b in batches:
            of_task += sum((np.frombuffer(x.as_buffer(), np.int64) for x in b.column(0)), np.zeros(3, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in of_task], names=["a", "g", "b"])

    n = np.array(sums.where("chunk = -1").select("counts").mapInArrow(total, "a long, g long, b long").agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in "agb")).first(), float)

    def contrast(key: tuple[pa.Scalar], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((3, size), np.int64)
        for b in batches:
            for x in b.column("counts"):
                got += np.frombuffer(x.as_buffer(), np.int32).reshape(3, size)
        log = _contrast(got.astype(float), n, prior, least, margin)
        at = np.flatnonzero(log)
        yield pa.RecordBatch.from_arrays([pa.array((key[0].as_py() * size + at).astype(np.int32)), pa.array(log[at])], names=["bucket", "log"])

    found = sums.where("chunk >= 0").groupBy("chunk").applyInArrow(contrast, "bucket int, log double").toArrow()
    discard(sums)
    log = np.zeros(2 * buckets)
    log[found["bucket"].to_numpy()] = found["log"].to_numpy()
    return Ratios(log.astype(np.float32).reshape(2, buckets), sharpness, seed)


def score(docs: DataFrame, ratios: Ratios, *, keep: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds to the columns `keep`: log_weight and gumbel_key (what top-k sorts by).

    Null and empty texts have no n-gram and weight 0. Equal rows get equal keys. Where
    `keep` has one of the new names, the new one gets underscores in front.
    """
    held = docs.sparkSession.sparkContext.broadcast(ratios)
    noise = F.xxhash64(F.lit(ratios.seed), F.col(id_col), F.col(text_col))
    rows = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), noise.alias("noise"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(rows.schema.fields[:-2] + [T.StructField("log_weight", T.DoubleType()), T.StructField("gumbel_key", T.DoubleType())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = held.value
        for b in batches:
            for part in slices(b, "text"):
                of, grams = _grams(part.column("text"))
                n_buckets = r.log.shape[1]
                some = np.flatnonzero(r.log[0][(grams % U64(n_buckets)).astype(np.int64)])
                of, (first, second) = _distinct(of[some], grams[some], n_buckets)
                x, y = r.log[0][first], r.log[1][second]
                of_both = np.where(x * y > 0, np.where(np.abs(x) < np.abs(y), x, y), 0)
                w = np.bincount(of, of_both.astype(np.float64), minlength=part.num_rows).astype(np.float64)  # integers where none has an n-gram
                u = (mix(part.column("noise").to_numpy().view(U64)) >> U64(11)).astype(np.float64) + 0.5
                key = r.sharpness * w - np.log(-np.log(u / 2.0**53))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(w), pa.array(key)], names=schema.names)

    return rows.mapInArrow(weigh, schema).toDF(*keep, *fresh(keep, "log_weight", "gumbel_key"))


def _ordered(key: Column) -> Column:
    """A long that sorts as the double does, the largest double first."""
    return F.floor(-key * F.lit(float(1 << 40))).cast("long")


def threshold(keys: DataFrame, k: int, *, digit_bits: int = 16) -> int:
    """The ordered key of the k-th largest gumbel_key, by counting digits.

    Each of four passes counts one digit of the keys that still matter, so at most
    2^16 counts reach the driver.
    """
    ordered = keys.select(_ordered(F.col("gumbel_key")).bitwiseXOR(F.lit(-(1 << 63))).alias("o"))
    prefix, left = 0, k
    for shift in range(64 - digit_bits, -1, -digit_bits):
        digit = F.shiftrightunsigned("o", shift)
        rows = ordered.where(F.shiftrightunsigned("o", shift + digit_bits) == prefix) if shift + digit_bits < 64 else ordered
        for r in sorted(rows.groupBy((digit.bitwiseAND((1 << digit_bits) - 1)).alias("d")).count().collect()):
            if r["count"] >= left:
                prefix = prefix << digit_bits | r.d
                break
            left -= r["count"]
    return prefix - (1 << 63)


def resample(docs: DataFrame, ratios: Ratios, *, k: int | None = None, keep: dict[str, Column], **columns: str) -> DataFrame:
    """Every row with log_weight, gumbel_key and selected, the Gumbel top-k.

    Rows whose key ties with the k-th are all selected. An empty table gives no rows.
    Where `keep` has one of the new names, the new one gets underscores in front.
    """
    weight, key, chosen = fresh(keep, "log_weight", "gumbel_key", "selected")
    scored = stored(score(docs, ratios, keep=keep, **columns), "scored")
    keys = scored.select(F.col(weight).alias("log_weight"), F.col(key).alias("gumbel_key"))
    if k is None:
        k = round(keys.agg(F.sum(F.least(F.lit(1.0), F.exp(F.col("log_weight") * ratios.sharpness)))).first()[0] or 0)
    cut = threshold(keys, k) if k > 0 else None
    out = scored.withColumn(chosen, _ordered(F.col(key)) <= F.lit(cut).cast("long") if cut is not None else F.lit(False))
    out.stored_at = scored.stored_at
    return out


def select(docs: DataFrame, ratios: Ratios, *, k: int | None = None, **columns: str) -> DataFrame:
    """The rows of docs that resample() selects, with their columns, whatever these are called.

    Rows are scored twice: once to find the k-th key, when keys alone are stored, and
    again as they are read, so that texts are neither stored nor shuffled.
    """
    keys = resample(docs, ratios, k=k, keep={}, **columns)
    last = keys.where("selected").agg(F.max(_ordered(F.col("gumbel_key")))).first()[0]
    discard(keys)
    scored = score(docs, ratios, keep={c: F.col(f"`{c}`") for c in docs.columns}, **columns)
    key = scored.columns[-1]
    return scored.where(_ordered(F.col(f"`{key}`")) <= F.lit(last).cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))
