"""Inverted index with positions, BM25, exact vector top-k and rank fusion."""

from __future__ import annotations

import hashlib
import inspect
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from math import ceil, inf, log
from operator import add, and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.operators import archive
from postlark.streaming.ingest import Change, Segment, Snapshots

K1, B, IDF_FLOOR, RRF = 1.2, 0.75, 1e-6, 60
_ROWS = 256  # whose tokens are sorted at once
_GAP = 1 << 40  # between positions of two columns, so that no phrase spans them
Analyzer = Callable[[Column], Column]


@dataclass(frozen=True)
class Filters:
    """Conjunctive filters over hits; account, mailbox, thread and dates compare as text."""

    account: str | None = None
    mailbox: str | None = None
    thread: str | None = None
    sender: str | None = None
    to: str | None = None
    after: str | None = None
    before: str | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        for c, v in (("account_id", self.account), ("mailbox", self.mailbox), ("thread_id", self.thread)):
            out = out if v is None else out & (F.col(c) == v)
        if self.sender is not None:
            out &= F.lower("from_address") == self.sender.lower()
        if self.to is not None:
            out &= F.exists("to_addresses", lambda x: F.lower(x) == self.to.lower())
        if self.after is not None:
            out &= F.col("date") >= self.after
        if self.before is not None:
            out &= F.col("date") <= self.before
        return out


def _placed(column: str, base: int, analyze: Analyzer) -> Column:
    return F.transform(analyze(F.coalesce(F.col(column), F.lit(""))), lambda t, i: F.struct(t.alias("term"), (i.cast("long") + base).alias("pos")))


def _parts(columns: Sequence[str], analyze: Analyzer) -> list[Column]:
    """What _by_term() takes of rows besides their key: `ts`, tokens with their places, and texts that it takes apart itself."""
    placed = F.concat(*(_placed(c, n * _GAP, analyze) for n, c in enumerate(columns)))
    if analyze is not T.tokens:
        return [placed.alias("ts")]
    own = reduce(and_, (T.plain(F.col(c)) for c in columns))
    return [F.when(~own, placed).alias("ts"), *(F.when(own, F.col(c).cast("string")).alias(f"_{n}") for n, c in enumerate(columns))]


def _by_term(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tokens of each row (key and _parts()), put together by term."""
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            b = whole.slice(at, _ROWS)
            every = np.arange(b.num_rows)
            size = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_numpy()
            flat = b.column(1).flatten()
            rows, places, terms, codes = [np.repeat(every, size)], [flat.field("pos").to_numpy()], [flat.field("term")], [np.arange(len(flat))]
            for n, column in enumerate(b.columns[2:]):
                text = pc.fill_null(column, "").dictionary_encode()  # a text that repeats is taken apart once
                held, tokens = T.plain_tokens(text.dictionary)
                each = text.indices.to_numpy()
                many = held[each]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rows.append(np.repeat(every, many))
                places.append(within + n * _GAP)
                codes.append(sum(map(len, terms)) + np.repeat((np.cumsum(held) - held)[each], many) + within)
                terms.append(tokens)
            term = pa.concat_arrays(terms).dictionary_encode()
            row, pos, code = np.concatenate(rows), np.concatenate(places), term.indices.to_numpy()[np.concatenate(codes)]
            dl = np.bincount(row, minlength=b.num_rows)
            by = row * max(1, len(term.dictionary)) + code
            order = np.argsort(by, kind="stable")  # places of a row come in order
            row, code, by = row[order], code[order], by[order]
            new = np.ones(len(row), bool)
            new[1:] = by[1:] != by[:-1]
            first = np.flatnonzero(new)
            ends = np.append(first, len(row))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pos[order]))
            of = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([b.column(0).take(of), pa.array(dl[row[first]], pa.int32()), term.dictionary.take(pa.array(code[first])), pa.array(np.diff(ends), pa.int64()), positions], [b.schema.names[0], "dl", "term", "tf", "positions"])


def postings(docs: DataFrame, columns: Sequence[str] = ("text",), key: str = "chunk_id", analyze: Analyzer = T.tokens) -> DataFrame:
    """term, key, tf, dl and positions, a row for each term of a row of docs.

    All tokens of a row are in it, so they are put together in Arrow batches; nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, *_parts(columns, analyze)).mapInArrow(_by_term, f"`{key}` {kind}, dl int, term string, tf long, positions array<long>")


def lengths(docs: DataFrame, columns: Sequence[str] = ("text",), key: str = "chunk_id", analyze: Analyzer = T.tokens) -> DataFrame:
    n = sum((F.size(analyze(F.coalesce(F.col(c), F.lit("")))) for c in columns), F.lit(0))
    return docs.select(key, n.alias("dl"))


def corpus(docs: DataFrame, columns: Sequence[str] = ("text",), key: str = "chunk_id", analyze: Analyzer = T.tokens) -> DataFrame:
    """One row: n documents and their average length."""
    return lengths(docs, columns, key, analyze).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def phrases(spark: SparkSession, query: str, analyze: Analyzer = T.tokens) -> list[list[str]]:
    """The tokens of each word of a query; words without a token are left out."""
    words = query.split()
    if not words:
        raise ValueError("empty query")
    held = spark.range(1).select(F.array(*(analyze(F.lit(w)) for w in words)).alias("ts")).first()[0]
    return [ts for ts in held if ts]


def bm25(index: DataFrame, stats: DataFrame, query: str | Sequence[Sequence[str]], key: str = "chunk_id", known: Sequence[int] | None = None) -> DataFrame:
    """key and score (higher is better) of rows with every phrase of the query.

    Only postings of the query's terms are read. Positions are compared for phrases of
    several tokens alone. `known` is the number of rows with each phrase, for an index that
    holds only some of them. What is broadcast is one row a phrase, and the one row of stats.
    """
    wanted = phrases(index.sparkSession, query) if isinstance(query, str) else query
    lists = []
    for n, words in enumerate(wanted):
        hits = index.where(F.col("term").isin(*words))
        if len(words) == 1:
            tf = hits.select(key, "dl", "tf")
        else:
            places = F.map_from_arrays(F.array(*(F.lit(w) for w in dict.fromkeys(words))), F.array(*(F.array(*(F.lit(i) for i, x in enumerate(words) if x == w)) for w in dict.fromkeys(words))))
            starts = hits.select(key, "dl", F.explode("positions").alias("p"), places[F.col("term")].alias("at")).select(key, "dl", "p", F.explode("at").alias("i"))
            whole = starts.groupBy(key, "dl", (F.col("p") - F.col("i")).alias("at")).agg(F.count("*").alias("have")).where(F.col("have") == len(words))
            tf = whole.groupBy(key, "dl").agg(F.count("*").alias("tf"))
        lists.append(tf.select(F.lit(n).alias("phrase"), key, "dl", "tf"))
    if not lists:
        return index.where(F.lit(False)).select(key, F.lit(0.0).alias("score"))
    tf = lists[0]
    for more in lists[1:]:
        tf = tf.unionByName(more)
    df = tf.groupBy("phrase").agg(F.count("*").alias("df"))
    if known is not None:
        df = index.sparkSession.createDataFrame(list(enumerate(known)), "phrase int, df long")
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(F.broadcast(df), "phrase").join(F.broadcast(stats))  # one row a phrase; one row
    return scored.groupBy(key).agg(F.sum(weight).alias("score"), F.count("*").alias("have")).where(F.col("have") == len(lists)).drop("have")


def top(scored: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best by score to nine places, ties to the smaller key, with ranks from 1."""
    best = scored.orderBy(F.round("score", 9).desc(), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.round("score", 9).desc(), key)))  # over k rows


def cosine_top(vectors: DataFrame, query: Sequence[float], k: int, key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """Exact cosine top-k; every task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    size = F.sqrt(dot(v, v) * float(sum(float(x) ** 2 for x in query)))
    return top(vectors.where(size > 0).select(key, (dot(v, q) / size).alias("score")), k, key)


def fuse(lists: Sequence[DataFrame], k: int, key: str = "chunk_id") -> DataFrame:
    """Reciprocal rank fusion of ranked lists."""
    both = lists[0].select(key, "rank")
    for more in lists[1:]:
        both = both.unionByName(more.select(key, "rank"))
    return top(both.groupBy(key).agg(F.sum(1 / (RRF + F.col("rank"))).alias("score")), k, key)


#: What an entry of the index shows and filters by, besides what is searched.
SHOWN = ("message_id", "thread_id", "account_id", "mailbox", "subject", "from_address", "to_addresses", "date")
#: Fields of an entry, each a column of its own for phrases.
FIELDS = ("subject", "from_address", "to_text", "thread_subject", "text")
ENTRIES, POSTINGS, DELETED, STATS, BLOCKS = INDEX = ("entries", "postings", "deleted", "stats", "blocks")
#: Tokens of a step of a segment's size, and of a file of a merged one; postings that are sorted at once;
#: segments of one size that are merged.
_PART, _TASK, _RUN, _MERGE = 1 << 16, 1 << 22, 1 << 20, 8
#: Classes of lengths and of hashes that make the blocks of a list; postings from which a list's blocks
#: are worth choosing; postings for each wanted hit that are read first.
_LENGTHS, _HASHES, _LONG, _FIRST = 32, 16, 1 << 17, 8


def _version() -> str:
    """A digest of what makes tokens; an index by others is stale."""
    made = [inspect.getsource(f) for f in (T.fold, T.tokens, T.nfkc.func, T.tokens_arabic, T.tokens_cjk, T.tokens_pairs, T.languages)]
    held = [str(T.SCRIPTS), sorted(T.ANALYZERS), T._BASES, unicodedata.unidata_version]
    return hashlib.sha256(repr((made, held, _LENGTHS, _HASHES, "runs")).encode()).hexdigest()[:16]


VERSION = _version()


def entries(chunked: DataFrame, messages: DataFrame) -> DataFrame:
    """A row for each chunk with its text and what its message is searched and filtered by, as it is now."""
    m = messages.select(*SHOWN, F.concat_ws(" ", "to_addresses").alias("to_text"), T.normalize_subject(F.coalesce("subject", F.lit(""))).alias("thread_subject"))
    return chunked.select("chunk_id", "message_id", "section", "ordinal", "text", "content_hash").join(m, "message_id")


def pieces(messages: DataFrame) -> DataFrame:
    """The chunks of messages with all columns that entries() gives; narrow, so that no text is shuffled."""
    m = messages.withColumns({"to_text": F.concat_ws(" ", "to_addresses"), "thread_subject": T.normalize_subject(F.coalesce("subject", F.lit("")))})
    also = [c for c in (*SHOWN, "to_text", "thread_subject") if c not in ("message_id", "thread_id", "account_id", "mailbox")]
    return archive.chunks(m, also)


def shown(chunked: DataFrame) -> DataFrame:
    """entries() of what pieces() gives."""
    return chunked.select("message_id", "chunk_id", "section", "ordinal", "text", "content_hash", *(c for c in SHOWN if c != "message_id"), "to_text", "thread_subject", *(c for c in ("lens",) if c in chunked.columns))


def measured(held: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Entries with `lens`: the number of their tokens in the list for all scripts, and in that of each language that occurs."""
    size = lambda analyze, own: reduce(add, (F.size(analyze(own(c))) for c in fields))
    plain = reduce(and_, (T.plain(F.col(c)) for c in fields))
    out = held.withColumn("_plain", plain)  # columns of their own, so that a text is looked at once
    out = out.withColumn("_langs", T.languages_of(F.concat_ws(" ", *fields), F.col("_plain")))
    few = T.plain_sizes(*(F.when(F.col("_plain"), F.col(c)) for c in fields)).cast("int")
    counts = {"all": F.when(F.col("_plain"), few).otherwise(size(T.tokens, lambda c: F.coalesce(F.col(c), F.lit(""))))}
    own = lambda c: F.when(F.size("_langs") > 0, F.coalesce(F.col(c), F.lit("")))  # noqa: E731  (one for all languages, so that its nfkc() is)
    for lang, analyze in T.ANALYZERS.items():
        counts[lang] = F.when(F.array_contains("_langs", lang), size(analyze, own)).otherwise(0)
    out = out.withColumns({f"_n_{lang}": n for lang, n in counts.items()})
    each = F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(f"_n_{lang}").alias("dl")) for lang in counts))
    lens = F.map_from_entries(F.filter(each, lambda x: (x["lang"] == "all") | (x["dl"] > 0)))
    return out.withColumn("lens", lens).drop("_langs", "_plain", *(f"_n_{lang}" for lang in counts))


def _sums(held: DataFrame) -> DataFrame:
    """lang, n and tokens of measured entries."""
    return held.select(F.explode("lens").alias("lang", "dl")).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("dl").cast("long")).alias("tokens"))


def _least_tf(score: float, idf: float, size: float) -> int:
    """The smallest tf with a score, where a posting is at least so long."""
    share = score / (idf * (K1 + 1))
    return 1 if share <= 0 else max(1, ceil(size * share / (1 - share) - 1e-6))


def _block(dl: np.ndarray, deal: np.ndarray) -> np.ndarray:
    """The blocks of postings: entries of about one length, dealt by a hash; the same in the lists of all terms."""
    of_length = np.minimum(np.floor(np.log2(dl + 1) * 2), _LENGTHS - 1)
    return (of_length * _HASHES + deal).astype(np.int32)


def _bounds(rows: DataFrame) -> DataFrame:
    """lang, term, block, n, tf, dl: of long lists the number, the largest tf and the smallest dl of each block's postings."""
    many = rows.groupBy("lang", "term").count().where(F.col("count") >= _LONG).select("lang", "term")
    mine = rows.select("lang", "term", "block", "tf", "dl").join(F.broadcast(many), ["lang", "term"], "left_semi")  # a row for _LONG postings at most
    return mine.groupBy("lang", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl"))


_POSTING = "chunk_id string, dl int, term string, tf long, positions array<long>, block int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in runs of at least _RUN rows (the last one is shorter), each sorted by term, block and tf."""
    held: list[pa.RecordBatch] = []
    n = 0

    def run() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()  # a run is there once as it came or as one chunk, and sorted in parts
        t = t.combine_chunks()
        term = t["term"].combine_chunks().dictionary_encode()
        place = np.empty(len(term.dictionary), np.int64)
        place[pc.sort_indices(term.dictionary).to_numpy()] = np.arange(len(place))
        order = np.lexsort((t["tf"].to_numpy(), place[term.indices.to_numpy()] * (_LENGTHS * _HASHES) + t["block"].to_numpy()))
        for at in range(0, len(order), 1 << 16):
            yield from t.take(pa.array(order[at : at + (1 << 16)])).to_batches()

    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= _RUN:
            yield from run()
            held, n = [], 0
    if held:
        yield from run()


def _sorted_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of the postings of rows with a key (chunk_id and deal, its hash) and _parts()."""

    def flat() -> Iterator[pa.RecordBatch]:
        for b in _by_term(batches):
            of = b.column(0)
            block = _block(b.column(1).to_numpy(), of.field("deal").to_numpy())
            yield pa.RecordBatch.from_arrays([of.field("chunk_id"), *b.columns[1:], pa.array(block)], [*"chunk_id dl term tf positions block".split()])

    return _runs(flat())


def _sorted_list(docs: DataFrame, fields: Sequence[str], analyze: Analyzer = T.tokens) -> DataFrame:
    of = F.struct("chunk_id", F.pmod(F.xxhash64("chunk_id"), F.lit(_HASHES)).alias("deal"))
    return docs.select(of.alias("of"), *_parts(fields, analyze)).mapInArrow(_sorted_postings, _POSTING)


def _lists(held: DataFrame, fields: Sequence[str], langs: Iterable[str]) -> dict[str, DataFrame]:
    """The sorted list of each language of measured entries."""
    mine = lambda lang: _sorted_list(held.where(F.map_contains_key("lens", F.lit(lang))), fields, T.ANALYZERS[lang])
    return {lang: _sorted_list(held, fields) if lang == "all" else mine(lang) for lang in sorted({"all", *langs})}


def _size(tokens: int) -> int:
    """The size of a segment, as a power of two; segments of one size are merged."""
    return 1 << max(0, min(12, (tokens // _PART).bit_length()))


def _laid(into: Snapshots, lists: Mapping[str, DataFrame], tokens: int, merged: Sequence[str] = (), number: int | None = None) -> Segment:
    """Postings by language as a segment that is written, in files of sorted runs, of which a search reads the pages of its terms.

    A file has the postings of its task's chunks, so nothing is shuffled, no task sorts more
    than a run at once, and a chunk's id is in a file's dictionary instead of in each posting.
    """
    return into.laid(POSTINGS, "lang", lists, Segment(None, ("lang",), tuple(merged), _size(tokens), number))


def changes(into: Snapshots, version: int, new: DataFrame | None, gone: DataFrame | None, fields: Sequence[str] = FIELDS) -> dict[str, DataFrame | Change | Segment]:
    """What an index becomes with new entries, and without the chunks `gone` (chunk_id), as tables of the next version.

    Postings of new entries make a segment. Chunks that go, or come anew, are noted as
    deleted up to the segments there are; statistics are the old ones with and without them.
    New entries with `lens`, as measured() gives them, are read several times, so they should be stored.
    """
    spark = into.spark
    old = into.read(STATS, version)
    tables: dict[str, DataFrame | Change | Segment] = {}
    came = held = None
    if new is not None:
        came = held = new if "lens" in new.columns else into.staged(measured(new, fields))
    out = [x.select("chunk_id") for x in (gone, held) if x is not None]
    left = None
    if old is not None and out:
        ids = into.staged(reduce(DataFrame.union, out).distinct())
        left = into.read(ENTRIES, version, near=ids).join(ids, "chunk_id", "left_semi")
        tables[DELETED] = Change(("chunk_id",), left.select("chunk_id", F.lit(version).cast("long").alias("upto")))
        tables[ENTRIES] = Change(("chunk_id",), came, ids, as_read=True)
    elif came is not None:
        tables[ENTRIES] = Change(("chunk_id",), came, as_read=True)
    sums = [] if old is None else [old.select("lang", "n", "tokens")]
    fresh = [] if came is None else _sums(came.select("lens")).collect()  # a row a language
    sums += [] if came is None else [spark.createDataFrame(fresh, "lang string, n long, tokens long")]
    sums += [] if left is None else [_sums(left).select("lang", (-F.col("n")).alias("n"), (-F.col("tokens")).alias("tokens"))]
    if sums:
        added = reduce(DataFrame.unionByName, sums).groupBy("lang").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).where("n > 0 OR lang = 'all'")
        rows = [(r.lang, r.n, r.tokens, VERSION, list(fields)) for r in added.collect()]  # a row a language
        tables[STATS] = spark.createDataFrame(rows or [("all", 0, 0, VERSION, list(fields))], "lang string, n long, tokens long, version string, fields array<string>").coalesce(1)
    if came is not None:
        tables[POSTINGS] = _laid(into, _lists(came, fields, [r.lang for r in fresh]), sum(r.tokens for r in fresh))
        tables[BLOCKS] = Segment(_bounds(tables[POSTINGS].rows), ("lang",))
    return tables


def current(into: Snapshots, version: int) -> bool:
    """Whether an archive's index can follow it: there is one by these analyzers, or nothing to index yet."""
    held = into.read(STATS, version)
    if held is None:
        return into.read("chunks", version) is None
    return held.where(F.col("version") != VERSION).isEmpty()


def merge_segments(into: Snapshots, fan: int = _MERGE) -> int:
    """Publishes the archive with `fan` segments or more of one size as one, without what was deleted; the version.

    Sizes are alike if their parts are equal in number, so each posting is rewritten a
    logarithmic number of times. When all segments become one, nothing is deleted any more,
    and postings are made of the entries there are, without a shuffle, where these analyzers
    made the index; else those of deleted chunks are left out by a join.
    """
    version = into.version()
    held = into.manifest(version).get(POSTINGS, {"parts": []})["parts"]
    tiers: dict[int, list[dict]] = {}
    for p in held:
        tiers.setdefault(p["note"], []).append(p)
    for note, some in sorted(tiers.items()):
        if len(some) < fan:
            continue
        segs = [p["path"].rsplit("=", 1)[1] for p in some]
        numbers = [p["segment"] for p in some]
        index = Index.of(into, version)
        live = index.postings.where(F.col("seg").isin(*segs))
        bounds = [p["path"].rsplit("=", 1)[1] for p in into.manifest(version).get(BLOCKS, {"parts": []})["parts"] if p["segment"] in numbers]
        tokens = index.stats.agg(F.sum("tokens")).first()[0] if len(some) == len(held) else note * _PART * len(some)
        stats = into.read(STATS, version).collect()  # a row a language
        langs = [r.lang for r in stats]
        fields = next((r.fields for r in stats if "fields" in r), None)
        one = lambda lang: live.where(F.col("lang") == lang).select("chunk_id", "dl", "term", "tf", "positions", "block").coalesce(max(1, -(-(tokens or 0) // _TASK))).mapInArrow(_runs, _POSTING)
        anew = len(some) == len(held) and fields and current(into, version)
        laid = _laid(into, _lists(index.entries, fields, langs) if anew else {lang: one(lang) for lang in langs}, tokens or 0, segs, max(numbers))
        tables = {POSTINGS: laid, BLOCKS: Segment(_bounds(laid.rows), ("lang",), tuple(bounds), number=max(numbers))}
        into.publish(tables | ({DELETED: into.read(DELETED, version).limit(0)} if len(some) == len(held) and into.read(DELETED, version) is not None else {}), version + 1)
        return merge_segments(into, fan)
    return version


@dataclass(frozen=True)
class Index:
    """An index in an archive's tables: entries in buckets of chunk_id, live postings by language, statistics of each list, bounds of long lists' blocks."""

    into: Snapshots
    version: int
    entries: DataFrame
    postings: DataFrame
    stats: DataFrame
    blocks: DataFrame | None = None

    @staticmethod
    def write(held: DataFrame, path: str, fields: Sequence[str] = FIELDS) -> None:
        """Builds the index of entries() below path, a new folder."""
        into = Snapshots(held.sparkSession, path)
        into.publish(changes(into, 0, held, None, fields))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Index:
        return cls.of(Snapshots(spark, path))

    @classmethod
    def of(cls, into: Snapshots, version: int | None = None) -> Index:
        """The index of an archive's version; postings of chunks deleted since their segment came are left out."""
        v = into.version() if version is None else version
        stats = into.read(STATS, v)
        if stats is None:
            raise ValueError("there is no keyword index; repair the archive")
        posts = into.read(POSTINGS, v)
        if posts is None:
            posts = into.spark.createDataFrame([], "chunk_id string, dl int, term string, tf long, positions array<long>, block int, seg string, lang string")
        gone = into.read(DELETED, v)
        if gone is not None and into.manifest(v)[DELETED]["parts"]:
            gone = gone.select(F.col("chunk_id").alias("_gone"), "upto")
            posts = posts.join(gone, (F.col("chunk_id") == F.col("_gone")) & (F.substring_index("seg", "-", 1).cast("long") <= F.col("upto")), "left_anti")
        avg = F.try_divide(F.col("tokens"), F.col("n")).alias("avgdl")
        return cls(into, v, into.read(ENTRIES, v), posts, stats.select("lang", "n", "tokens", avg, "version"), into.read(BLOCKS, v))

    def of_list(self, lang: str) -> DataFrame:
        return self.postings.where(F.col("lang") == lang)

    def of_terms(self, lang: str, terms: Sequence[str]) -> DataFrame:
        """Postings of a list of some terms; of files, which are sorted in runs, Parquet reads the pages that hold them."""
        return self.of_list(lang).where(F.col("term").isin(*terms))

    def reading(self, lang: str, wanted: list[list[str]], k: int, filters: Filters | None = None) -> tuple[DataFrame, list[int] | None]:
        """Postings among which the k best of a list are, and the number of rows with each word, where not all are among them.

        A posting scores at most what the largest tf and the smallest dl of its block do. Blocks
        of the highest sums of these are read first. Then, of each block, postings are read whose
        tf is large enough to reach the k-th score found if all other words score their most.
        Phrases need all postings, as their number is not known. What the driver gets is a row
        for each block, of which a list has 512 a segment at most, and k scores.
        """
        terms = sorted({w for ws in wanted for w in ws})
        read = self.of_terms(lang, terms)
        if self.blocks is None or not wanted or any(len(ws) > 1 for ws in wanted):
            return read, None
        number = F.substring_index("seg", "-", 1).cast("long").alias("segment")
        held = self.blocks.where((F.col("lang") == lang) & F.col("term").isin(*terms)).select(number, "term", "block", "n", "tf", "dl").collect()
        if not held:
            return read, None
        long: dict[str, set[int]] = defaultdict(set)
        for r in held:
            long[r.term].add(r.segment)
        known = reduce(or_, ((F.col("term") == t) & F.col("segment").isin(*segs) for t, segs in long.items()))
        held += read.select("*", number).where(~known).groupBy("segment", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl")).collect()
        have = dict.fromkeys(terms, 0)
        if self.into.manifest(self.version).get(DELETED, {"parts": []})["parts"]:
            have |= {r.term: r["count"] for r in read.groupBy("term").count().collect()}
        else:
            for r in held:
                have[r.term] += r.n
        n, avgdl = self.stats.where(F.col("lang") == lang).select("n", "avgdl").first()
        words = [ws[0] for ws in wanted]
        counts = [have[w] for w in words]
        idf = {t: words.count(t) * max(log((n - m + 0.5) / (m + 0.5)), 0) or words.count(t) * IDF_FLOOR for t, m in have.items()}
        blocks: dict[tuple[int, int], dict[str, tuple]] = defaultdict(dict)  # word to rows, highest score, and what tf is added to
        for r in held:
            size = K1 * ((1 - B) + B * r.dl / avgdl)
            blocks[r.segment, r.block][r.term] = r.n, idf[r.term] * r.tf * (K1 + 1) / (r.tf + size), size
        best = sorted(((sum(x[1] for x in of.values()), at) for at, of in blocks.items() if len(of) == len(terms)), reverse=True)
        rows = accumulate(min(x[0] for x in blocks[at].values()) for _, at in best)
        cut = next((i + 1 for i, m in enumerate(rows) if m >= _FIRST * k), len(best))
        first = self._in(read, ((at, t, 1) for _, at in best[:cut] for t in terms))
        if cut == len(best):
            return first, counts
        found = top(self._scored(first, lang, wanted, filters, counts), k).select("score").collect()
        least = min(r.score for r in found) - 2e-9 if len(found) == k else -inf
        return self._in(read, ((at, t, _least_tf(least - most + x[1], idf[t], x[2])) for most, at in best if most >= least for t, x in blocks[at].items())), counts

    @staticmethod
    def _in(read: DataFrame, wanted: Iterable[tuple[tuple[int, int], str, int]]) -> DataFrame:
        """Postings of words in blocks, (segment, block), from a tf on; the files see a range of blocks."""
        by: dict[tuple[int, str, int], list[int]] = defaultdict(list)
        for (segment, block), term, tf in wanted:
            by[segment, term, tf].append(block)
        if not by:
            return read.where(F.lit(False))
        every = [b for bs in by.values() for b in bs]
        of = reduce(or_, (F.col("seg").startswith(f"{s}-") & (F.col("term") == t) & (F.col("tf") >= tf) & F.col("block").isin(*sorted(bs)) for (s, t, tf), bs in sorted(by.items())))
        return read.where(F.col("block").between(min(every), max(every)) & (F.col("tf") >= min(tf for _, _, tf in by)) & of)

    def _scored(self, read: DataFrame, lang: str, wanted: list[list[str]], filters: Filters | None, known: list[int] | None) -> DataFrame:
        scored = bm25(read, self.stats.where(F.col("lang") == lang).select("n", "avgdl"), wanted, known=known)
        if filters:
            scored = scored.join(self.entries.where(filters.predicate()).select("chunk_id"), "chunk_id", "left_semi")
        return scored

    def top(self, lang: str, wanted: list[list[str]], k: int, filters: Filters | None = None) -> DataFrame:
        """The k best of one list; statistics are of the whole list, filters apply before the limit."""
        read, known = self.reading(lang, wanted, k, filters)
        return top(self._scored(read, lang, wanted, filters, known), k)

    def keyword(self, query: str, k: int, filters: Filters | None = None) -> DataFrame:
        """Fused rank of the list for all scripts and of one for each language of the query."""
        spark = self.entries.sparkSession
        lists = [self.top("all", phrases(spark, query), 2 * k, filters)]
        langs = spark.range(1).select(T.languages(F.lit(query)).alias("ls")).first()[0]
        if langs and self.stats.where(F.col("version") != VERSION).count():
            raise ValueError("the index was made by other analyzers; rebuild it")
        for lang in langs:
            words = phrases(spark, query, T.ANALYZERS[lang])
            lists.append(self.top(lang, words if lang in T.PHRASED else [[w] for ws in words for w in ws], 2 * k, filters))
        return fuse(lists, k)

    def semantic(self, vector: Sequence[float], vectors: DataFrame, k: int, filters: Filters | None = None) -> DataFrame:
        """Exact cosine top-k of vectors (chunk_id, content_hash, vector) whose chunk still has that content."""
        live = self.entries.where(filters.predicate()) if filters else self.entries
        held = vectors.join(live.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_semi")
        return cosine_top(held, vector, k)

    def hits(self, ranked: DataFrame, query: str, mode: str) -> DataFrame:
        """Ranked chunks with what a hit shows, from the buckets that hold them; ranked has no more rows than were asked for."""
        ranked = self.into.spark.createDataFrame(ranked.select("chunk_id", "score", "rank").collect(), "chunk_id string, score double, rank int")
        out = self.into.read(ENTRIES, self.version, near=ranked).join(F.broadcast(ranked), "chunk_id")
        return out.select("chunk_id", *SHOWN, T.snippet(F.col("text"), query).alias("snippet"), "score", F.lit(mode).alias("mode"), "rank").orderBy("rank")

    def search(self, query: str, k: int = 10, mode: str = "bm25", filters: Filters | None = None, vectors: DataFrame | None = None, embed: Callable[[str], Sequence[float]] | None = None) -> DataFrame:
        """Hits of one search: bm25 (also keyword and fts), semantic or hybrid.

        Without vectors the semantic list is empty, so hybrid has the keyword list alone.
        An empty query or another mode is an error.
        """
        if not query.strip():
            raise ValueError("empty query")
        if k < 1:
            raise ValueError("a limit must be a positive integer")
        if mode in ("bm25", "keyword", "fts"):
            return self.hits(self.keyword(query, k, filters), query, "bm25")
        if mode not in ("semantic", "hybrid"):
            raise ValueError(f"unsupported mode {mode}")
        near = None
        if vectors is not None and embed is not None:
            near = self.semantic(embed(query), vectors, k if mode == "semantic" else 2 * k, filters)
        if mode == "semantic":
            return self.hits(near if near is not None else self.keyword(query, k).where(F.lit(False)), query, mode)
        lists = [self.keyword(query, 2 * k, filters), *([near] if near is not None else [])]
        return self.hits(fuse(lists, k), query, mode)
