"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram (n = 3: a letter
with both neighbours, word ends count as a blank letter) is the product of its
letters' vectors, each permuted by its place. A text is the sum of its n-grams'
vectors, a language the sum of its training texts. A text's language is the
prototype with the largest cosine.

Sums are linear, so training first counts n-grams by language (pre-aggregated
in each task) and then bundles each distinct n-gram once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh
from .wordhash import U64, mix

UNKNOWN = "und"
_BITS = 21  # of a code point


class Letters:
    """Code points that are letters, and their random vectors."""

    _is: np.ndarray | None = None

    def __init__(self, dim: int, seed: int):
        self.dim, self.seed = dim, seed
        if Letters._is is None:
            Letters._is = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def vectors(self, points: np.ndarray) -> np.ndarray:
        """A row of +1 and -1 for each code point, from a hash of it and the seed."""
        words = np.arange(self.dim // 64, dtype=U64)
        bits = mix(mix(points.astype(U64) + (U64(self.seed) << U64(32)))[:, None] + words[None, :])
        return (np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) << 1) - 1

    def grams(self, keys: np.ndarray) -> np.ndarray:
        """Vectors of n-grams: rho^2(first) * rho(middle) * last, rho a rotation."""
        mask = (1 << _BITS) - 1
        out = None
        for place in range(3):
            part = self.vectors((keys >> (_BITS * (2 - place))) & mask)
            part = np.roll(part, 2 - place, axis=1)
            out = part if out is None else out * part
        return out

    def keys(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram around each letter, and where each text's n-grams begin."""
        points = np.frombuffer("\n".join(t.lower() if t else "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter((len(t.lower()) if t else 0 for t in texts), np.int64, len(texts))
        held = np.zeros(len(points) + 2, np.int64)
        is_letter = Letters._is[points]
        held[1:-1] = np.where(is_letter, points, 0)
        at = np.flatnonzero(is_letter) + 1
        keys = (held[at - 1] << (2 * _BITS)) | (held[at] << _BITS) | held[at + 1]
        ends = np.cumsum(lens + 1)
        return keys, np.concatenate([[0], np.searchsorted(at - 1, ends - 1)]) if len(texts) else np.zeros(1, np.int64)


class Table:
    """Vectors of the n-grams seen so far; beyond `most` it starts anew."""

    def __init__(self, letters: Letters, most: int = 1 << 16):
        self.letters, self.most = letters, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.int64)
        self.slots = np.zeros(0, np.int64)
        self.rows = np.zeros((0, self.letters.dim), np.int8)

    def rows_of(self, keys: np.ndarray) -> np.ndarray:
        """Places in self.rows of distinct, sorted keys."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        new = keys if not len(self.keys) else keys[self.keys[at] != keys]
        if len(new):
            if len(self.keys) + len(new) > self.most:
                self.clear()
                new = keys
            slots = len(self.rows) + np.arange(len(new))
            self.rows = np.concatenate([self.rows, self.letters.grams(new)])
            at = np.searchsorted(self.keys, new)
            self.keys, self.slots = np.insert(self.keys, at, new), np.insert(self.slots, at, slots)
            at = np.searchsorted(self.keys, keys)
        return self.slots[at]


def _texts(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in parts of bounded length, with the place of the first."""
    part, size, at = [], 0, 0
    for i, t in enumerate(batch.column("text").to_pylist()):
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


@dataclass(frozen=True)
class Profiles:
    """Prototypes of unit length, a row for each language in sorted order."""

    langs: tuple[str, ...]
    rows: np.ndarray
    seed: int

    @property
    def dim(self) -> int:
        return self.rows.shape[1]


def fit(df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dim: int = 1024, seed: int = 7, most_langs: int = 4096) -> Profiles:
    """Learns a prototype for each non-null value of lang_col from all rows of df.

    What reaches the driver is dim sums for each language; more languages than
    most_langs are refused, so it is bounded.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = Letters(dim, seed), {}
        for b in batches:
            langs = b.column("lang").to_pylist()
            for at, texts in _texts(b):
                keys, first = letters.keys(texts)
                names = np.array(langs[at : at + len(texts)], dtype=object)
                of = np.repeat(np.arange(len(texts)), np.diff(first))
                for lang in set(names):
                    k, n = np.unique(keys[(names == lang)[of]], return_counts=True)
                    c = held.setdefault(lang, Counter())
                    for x, y in zip(k.tolist(), n.tolist(), strict=True):
                        c[x] += y
            if sum(map(len, held.values())) > 1 << 20:
                yield from out(held)
                held = {}
        yield from out(held)

    def out(held: dict) -> Iterator[pa.RecordBatch]:
        for lang, c in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(c), pa.string()), "gram": pa.array(c.keys(), pa.int64()), "n": pa.array(c.values(), pa.int64())})

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, sums = Letters(dim, seed), {}
        for b in batches:
            names = np.array(b.column(0).to_pylist(), dtype=object)
            keys, n = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for at in range(0, len(names), 4096):
                rows = letters.grams(keys[at : at + 4096]).astype(np.float64)
                for lang in set(names[at : at + 4096]):
                    here = names[at : at + 4096] == lang
                    sums[lang] = sums.get(lang, 0) + n[at : at + 4096][here] @ rows[here]
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * dim), "i": pa.array(np.arange(dim, dtype=np.int32)), "v": pa.array(v.astype(np.int64))})

    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    grams = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = grams.mapInArrow(bundle, "lang string, i int, v long").groupBy("lang", "i").agg(F.sum("v").alias("v")).limit(most_langs * dim + 1).toPandas()
    if len(found) > most_langs * dim:
        raise ValueError(f"more than {most_langs} languages")
    langs = tuple(sorted(set(found["lang"])))
    m = np.zeros((len(langs), dim))
    m[found["lang"].map({x: k for k, x in enumerate(langs)}).to_numpy(int), found["i"].to_numpy(int)] = found["v"].to_numpy(float)
    return Profiles(langs, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300), seed)


def predict(df: DataFrame, profiles: Profiles, *, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score (the cosine, 0 where it is below) to the columns `keep`.

    Whole texts are read. A null text, or one without a letter, is "und" with
    score 0; so is every text if nothing was learned. Of languages with equal
    cosines the first in sorted order wins. One row for each row of df, whatever its
    id. Where `keep` has one of the new names, the new one gets underscores in front.
    """
    held = df.sparkSession.sparkContext.broadcast(profiles)
    names_out = [*keep, *fresh(keep, "lang_pred", "score")]
    kept = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType(kept.schema.fields[:-1] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        letters = Letters(p.dim, p.seed)
        table = Table(letters)
        for b in batches:
            names, scores = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            for at, texts in _texts(b) if p.langs else ():
                keys, first = letters.keys(texts)
                for i in range(len(texts)):
                    if first[i] < first[i + 1]:
                        k, n = np.unique(keys[first[i] : first[i + 1]], return_counts=True)
                        v = np.zeros(p.dim)
                        for j in range(0, len(k), 8192):
                            places = table.rows_of(k[j : j + 8192])
                            v += n[j : j + 8192].astype(np.float32) @ table.rows[places].astype(np.float32)
                        cos = p.rows @ v / max(np.linalg.norm(v), 1e-300)
                        best = int(np.argmax(cos))
                        names[at + i], scores[at + i] = p.langs[best], min(1.0, max(0.0, cos[best]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(names, pa.string()), pa.array(scores)], names=schema.names)

    return kept.mapInArrow(judged, schema).toDF(*names_out)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is in the fold that nothing is learned from; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
