"""Column functions for identities, subjects, bodies, categories and tokens.

Only nfkc(), redact_json() and plain_sizes() are Python, over Arrow batches.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

NUL = "\x00"
CHUNK_CHARS = 2400
#: What a trim strips, white space of all scripts and byte order marks; \x85 is none of it.
_BLANK = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_BLANKS = "".join(c for c in map(chr, range(0x10000)) if re.match(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{m[1]:0>4}", _BLANK), c))  # the same, one by one

#: Latin letters with accents and their base letters, by Unicode decomposition.
_ACCENTED = [c for c in map(chr, range(0xC0, 0x250)) if len(d := unicodedata.normalize("NFD", c)) > 1 and d[0].isascii()]
_BASES = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def make_id(*parts: Column) -> Column:
    """The first 24 hex digits of SHA-256 over the parts joined by NUL; null counts as empty."""
    held = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(NUL, *held), 256), 1, 24)


def trim(c: Column) -> Column:
    """Strips all white space, no-break spaces and byte order marks."""
    return F.btrim(c, F.lit(_BLANKS))


def normalize_subject(c: Column) -> Column:
    """Without marks of replies and forwards (fixed values), trimmed, in lower case."""
    return F.lower(trim(F.regexp_replace(c, rf"(?i)^(?:(?:re|fw|fwd){_BLANK}*:{_BLANK}*)+", "")))


def normalize_category(c: Column) -> Column:
    """Trimmed, in lower case, without the prefixes (fixed values) that providers give."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "^category[_-]", ""), "^label[_-]", "")


def categories(*arrays: Column) -> Column:
    """Distinct normalized categories in first-seen order; blanks and nulls drop out."""
    parts = [F.coalesce(a, F.array().cast("array<string>")) for a in arrays]
    return F.array_distinct(F.filter(F.transform(F.concat(*parts), normalize_category), lambda x: x != ""))


def _quote_at(lines: Column) -> Column:
    """Index from 0 of the first line that opens a quotation; null if none does."""
    opens = F.transform(lines, lambda x: trim(x).rlike(r"(?i)^(?:On .+ wrote:|>|[- ]*Original Message[- ]*$)"))
    at = F.array_position(opens, True)
    return F.when(at > 0, at.cast("int") - 1)


def split_quoted(c: Column) -> tuple[Column, Column]:
    """The latest text, as it is, and the quoted rest of a body, in lines; both trimmed.

    Lines are looked at where a body has what each opening of a quotation has.
    """
    may = c.contains(">") | c.rlike(r"(?i)wrote:|original message")
    raw = F.split(c, "\n")
    lines = F.transform(raw, lambda x: F.regexp_replace(x, r"\r\z", ""))
    at = F.coalesce(_quote_at(lines), F.size(lines))
    latest = F.array_join(F.slice(raw, F.lit(1), at), "\n")
    quoted = F.array_join(F.slice(lines, at + 1, F.greatest(F.size(lines) - at, F.lit(0))), "\n")
    return F.when(may, trim(latest)).otherwise(trim(c)), F.when(may, trim(quoted)).when(c.isNotNull(), "")


def split_text(c: Column, size: int = CHUNK_CHARS) -> Column:
    """Paragraphs cut into pieces of at most `size` characters, trimmed, without empty ones.

    White space with two line feeds or more separates paragraphs. A separator is looked for by
    its first line feed, which is fast, so a paragraph may keep blanks at its end.
    """
    ended = lambda p: F.when(F.substring(p, -1, 1).rlike(_BLANK), F.rtrim(p, F.lit(_BLANKS))).otherwise(p)
    paras = F.filter(F.transform(F.split(trim(c), rf"\n{_BLANK}*\n{_BLANK}*"), ended), lambda p: p != "")
    cut = lambda p: F.transform(F.sequence(F.lit(0), ((F.char_length(p) - 1) / size).cast("int")), lambda i: trim(F.substring(p, i * size + 1, F.lit(size))))
    pieces = F.flatten(F.transform(paras, lambda p: F.when(F.char_length(p) <= size, F.array(p)).otherwise(cut(p))))
    return F.filter(pieces, lambda p: p != "")


def snippet(c: Column, query: str, size: int = 240) -> Column:
    """About `size` characters of a text, from 60 before the first place of the whole query."""
    held = trim(c)
    start = F.greatest(F.locate(query.lower(), F.lower(held)) - 60, F.lit(1))
    return F.when(F.char_length(held) <= size, held).otherwise(F.substring(held, start, F.lit(size)))


#: The scripts that select an analyzer.
SCRIPTS = {"ko": r"[\x{ac00}-\x{d7a3}]", "ja": r"[\x{3040}-\x{30ff}]", "zh": r"[\x{4e00}-\x{9fff}]", "ar": r"[\x{0600}-\x{06ff}]"}
_FIXED = tuple(SCRIPTS)


def languages(c: Column) -> Column:
    """Analyzer languages whose script occurs in a text."""
    return F.array_compact(F.array(*(F.when(c.rlike(p), F.lit(k)) for k, p in SCRIPTS.items())))


def fold(c: Column) -> Column:
    """Lower case without Latin accents and combining marks."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), "".join(_ACCENTED), _BASES)


def tokens(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"([\p{L}\p{N}\p{Co}]+)"), F.lit(1))


#: Latin letters and general punctuation, in which each character is folded by itself; other texts are no plain ones.
_PLAIN = ((0, 0x250), (0x2000, 0x2070))


def plain(c: Column) -> Column:
    """Whether plain_tokens() gives what tokens() does of a text; true for null."""
    odd = (F.octet_length(c) > F.char_length(c)) & c.rlike("[^" + "".join(rf"\x{{{a:x}}}-\x{{{b - 1:x}}}" for a, b in _PLAIN) + "]")
    return ~F.coalesce(odd, F.lit(False))


def languages_of(c: Column, plain: Column) -> Column:
    """languages() of a text of which is known whether it is plain; the fixed scripts have no plain character."""
    return F.array_compact(F.array(*(F.when(~plain & c.rlike(p) if k in _FIXED else c.rlike(p), F.lit(k)) for k, p in SCRIPTS.items())))


def _folded() -> np.ndarray:
    """By code point the one that fold() makes of a plain character, or 0 where no token has it."""
    out = np.zeros(_PLAIN[-1][1], np.uint16)
    bases = dict(zip(map(ord, _ACCENTED), _BASES, strict=True))
    for c in (c for a, b in _PLAIN for c in range(a, b)):
        one = "".join(x for x in chr(c).lower() if unicodedata.category(x) != "Mn").translate(bases)
        if unicodedata.category(one)[0] in "LN":
            out[c] = ord(one)
    return out


_FOLDED = _folded()


def _plain_starts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of tokens of each plain text, the folded characters of all texts, and in which of these a token starts."""
    held = pc.fill_null(texts.cast(pa.string()), "")
    at = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1, held.offset * 4) if len(held) else np.zeros(1, np.int32)
    if at[0] == at[-1]:
        return np.zeros(len(held), np.int64), np.zeros(0, np.uint16), np.zeros(0, bool)
    data = held.buffers()[2].slice(int(at[0]), int(at[-1] - at[0]))
    chars, edges = np.frombuffer(data, np.uint8), at.astype(np.int64) - at[0]
    if chars.max() >= 0x80:
        chars = np.frombuffer(str(data, "utf-8").encode("utf-32-le"), np.uint32)
        edges = np.append(0, np.cumsum(pc.utf8_length(held).to_numpy(), dtype=np.int64))
    folded = _FOLDED.take(chars)
    inner = folded != 0
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    begins = edges[:-1][edges[:-1] < edges[1:]]
    first[begins] = inner[begins]
    return np.diff(np.searchsorted(np.flatnonzero(first), edges)), folded, first


def plain_tokens(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of tokens of each plain text, and the tokens of all one after another, as tokens() makes them; null has none.

    The characters of all texts are looked up at once, so these should be those of a slice of a batch.
    """
    counts, folded, first = _plain_starts(texts)
    inner = folded != 0
    kept = folded[inner]
    offsets = np.append(np.flatnonzero(first[inner]), len(kept))
    if not len(kept) or kept.max() < 0x80:
        raw = kept.astype(np.uint8).tobytes()
    else:
        raw = kept.astype("<u2").tobytes().decode("utf-16-le").encode()
        offsets = np.append(0, np.cumsum(1 + (kept >= 0x80) + (kept >= 0x800).astype(np.int64)))[offsets]
    return counts, pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))


_SLICE = 128  # texts whose characters are looked up at once


@F.arrow_udf(LongType())
def plain_sizes(*columns: pa.Array) -> pa.Array:
    """The number of tokens of plain texts of several columns together; a text that repeats in a slice is looked at once."""
    out = np.zeros(len(columns[0]), np.int64)
    for at in range(0, len(out), _SLICE):
        for c in columns:
            some = pc.fill_null(c.slice(at, _SLICE), "").dictionary_encode()
            out[at : at + _SLICE] += _plain_starts(some.dictionary)[0][some.indices.to_numpy()]
    return pa.array(out)


@F.pandas_udf(StringType())
def nfkc(c: pd.Series) -> pd.Series:
    """Compatibility composition; texts of ASCII alone are returned as they are."""
    return c.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def tokens_arabic(c: Column) -> Column:
    """Arabic words, each also without one prefix (fixed values)."""
    words = F.regexp_extract_all(F.lower(nfkc(c)), F.lit(r"([\x{0600}-\x{06ff}]+)"), F.lit(1))
    both = F.flatten(F.transform(words, lambda w: F.array(w, F.regexp_replace(w, "^(?:وال|فال|بال|كال|ال|لل|و|ف|ب|ك|ل)", ""))))
    return F.filter(both, lambda w: w != "")


def tokens_cjk(c: Column) -> Column:
    """Runs of letters and digits as they are, without segmentation."""
    return F.regexp_extract_all(nfkc(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\x{30fc}"


def tokens_pairs(c: Column) -> Column:
    """Words of texts in which Chinese and Japanese stand without blanks.

    A run of their characters gives every two that follow each other, so that a word is
    found inside a sentence without a dictionary; a character by itself is a token, and
    so is a run of other letters and digits.
    """
    runs = F.regexp_extract_all(nfkc(c), F.lit(rf"([{_UNSPACED}]+|[\p{{L}}\p{{N}}&&[^{_UNSPACED}]]+)"), F.lit(1))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda r: F.when((F.char_length(r) > 1) & r.rlike(f"^[{_UNSPACED}]"), pairs(r)).otherwise(F.array(r))))


#: Analyzers by language, without dictionaries: Korean is folded.
ANALYZERS = {"ko": lambda c: F.transform(tokens_cjk(c), F.lower), "ja": tokens_pairs, "zh": tokens_pairs, "ar": tokens_arabic}
#: Languages in which the tokens of a query's word must follow each other.
PHRASED = ("ja", "zh")


def register_analyzer(lang: str, pattern: str, analyze: Callable[[Column], Column]) -> None:
    """Makes known how texts with a character that `pattern` matches are analyzed; indexes made before are stale."""
    if lang in SCRIPTS or lang == "all":
        raise ValueError(f"{lang} has an analyzer")
    SCRIPTS[lang], ANALYZERS[lang] = pattern, analyze


#: What diagnostics must not show.
REDACTIONS = (
    (r"(?iu)([?&](?:token|password|secret|key)=)[^&\s]+", "$1[REDACTED]"),
    (r"(?iu)(?<![?&])\b(?:token|password|secret|key|credential)\s*[=:]\s*[^,\s]+", "[REDACTED]"),
    (r"(?iu)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", "[EMAIL]"),
)


def redact(c: Column) -> Column:
    for pattern, to in REDACTIONS:
        c = F.regexp_replace(c, pattern, to)
    return c


_HIDDEN = tuple((re.compile(pattern.replace("(?iu)", ""), re.I), re.sub(r"\$(\d)", r"\\\1", to)) for pattern, to in REDACTIONS)
_SECRET = re.compile("password|secret|token|credential", re.I)  # names of members, fixed values


def redacted(value):
    """A value of parsed JSON: texts as redact() does, members with a secret's name hidden, at any depth."""
    if isinstance(value, str):
        for pattern, to in _HIDDEN:
            value = pattern.sub(to, value)
        return value
    if isinstance(value, list):
        return [redacted(x) for x in value]
    if isinstance(value, dict):
        return {k: "[REDACTED]" if _SECRET.search(k) else redacted(x) for k, x in value.items()}
    return value


@F.pandas_udf(StringType())
def redact_json(c: pd.Series) -> pd.Series:
    """redacted() of JSON texts; what is no JSON is redacted as a text, null stays."""

    def one(x):
        try:
            return json.dumps(redacted(json.loads(x)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return redacted(x)

    return c.map(lambda x: None if x is None else one(x))
