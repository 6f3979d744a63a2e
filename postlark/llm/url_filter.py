"""URL filter: allow and block rules, then a weighted vocabulary.

An Aho-Corasick automaton finds every vocabulary term of a lower-cased url in
one pass. A hit counts where no letter or digit touches it. One strict term, or
`soft_limit` distinct soft terms, reject the url. Rules go before that: the
longest rule that fits decides.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOWER = {i: i + 32 for i in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
STRICT = ("adult", "casino", "escort", "porn", "viagra", "xxx")
SOFT = ("ads", "bet", "bets", "cheap", "farm", "free", "pills", "spam", "track", "win")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    cut = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:cut]


class Filter:
    def __init__(self, rules: Iterable[Rule], strict: Iterable[str], soft: Iterable[str], soft_limit: int):
        self.by_host: dict[str, list[Rule]] = defaultdict(list)
        for r in rules:
            self.by_host[r.host].append(r)
        self.soft_limit = soft_limit
        self.words = ahocorasick.Automaton()
        for kind, terms in ((False, soft), (True, strict)):  # a term in both is strict
            for term in terms:
                self.words.add_word(term, (term, kind))
        if len(self.words):
            self.words.make_automaton()

    def rule(self, host: str, path: str) -> Rule | None:
        best, at = None, 0
        while host and at >= 0:
            for r in self.by_host.get(host[at:], ()):
                if path.startswith(r.path) and (best is None or (len(r.text), r.text) > (len(best.text), best.text)):
                    best = r
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand alone in url."""
        text, found = url.translate(_LOWER), (set(), set())
        if len(self.words):
            for end, (term, strict) in self.words.iter(text):
                a, b = end - len(term), end + 1
                if not (a >= 0 and _alnum(text[a])) and not (b < len(text) and _alnum(text[b])):
                    found[0 if strict else 1].add(term)
        return found

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, int, int]:
        host, path = split_url(url)
        strict, soft = self.hits(url or "")
        rule = self.rule(host, path)
        bad = bool(strict) or len(soft) >= self.soft_limit
        return host, path, rule and rule.text, rule.action if rule else ("block" if bad else "allow"), len(strict), len(soft)


def _alnum(c: str) -> bool:
    return "a" <= c <= "z" or "0" <= c <= "9"


def vocabulary(df: DataFrame, *, term_col: str = "term", strict_col: str = "strict", most: int = 2_000_000) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table, A-Z lower-cased, for filter_urls().

    Every task holds the automaton, so more than `most` distinct terms are refused.
    Null and empty terms count nothing; a term in both kinds is strict.
    """
    low = F.translate(F.col(term_col), "".join(map(chr, _LOWER)), "".join(map(chr, _LOWER.values())))
    rows = df.select(low.alias("term"), F.coalesce(F.col(strict_col).cast("boolean"), F.lit(False)).alias("strict")).where("term != ''")
    got = rows.groupBy("term").agg(F.max("strict").alias("strict")).limit(most + 1).toArrow().sort_by("term")
    if got.num_rows > most:
        raise ValueError(f"more than {most} terms")
    pick = lambda wanted: tuple(t for t, s in zip(got["term"].to_pylist(), got["strict"].to_pylist(), strict=True) if s == wanted)
    return pick(True), pick(False)


def filter_urls(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: Iterable[Rule] = RULES, strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT, soft_limit: int = 2) -> DataFrame:
    """Judges each row's url: host, path, rule, verdict and counts of hits.

    One output row for each input row, in one pass without a shuffle. A null or
    malformed url has an empty host and path, fits no rule and is judged by the
    vocabulary alone (null: allow). Null ids and repeated rows pass through;
    other columns are not read, so their names cannot clash.
    """
    args = (tuple(rules), tuple(strict), tuple(soft), soft_limit)
    id_type = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField(id_col, id_type)]
        + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]
        + [T.StructField(c, T.IntegerType()) for c in ("n_strict", "n_soft")]
    )

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Filter(*args)
        for b in batches:
            rows = [f.judge(u) for u in b.column(1).to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string()] * 4 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=schema.names)

    return df.select(F.col(id_col), F.col(url_col).cast("string")).mapInArrow(judged, schema)
