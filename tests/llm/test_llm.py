"""The ten operators against brute force, and on nulls, ties and empty tables."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from postlark.llm import decontaminate as dec
from postlark.llm import queries as q
from postlark.llm import toolcalls

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text, rule=SPACES, low=True):
    return rule.findall(text.translate(LOW) if low else text) if text else []


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_decontaminate(docs, items):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        for k in range(max(len(w) - 9, 1)) if w else ():
            windows[tuple(w[k : k + 10])].add(str(i))
    sizes = {len(x) for x in windows}
    for d, t in docs:
        w, hit, found = words(t, ALNUM), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        yield d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def brute_join(docs):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    lead = {d: d for d in sets}

    def root(x):
        while lead[x] != x:
            x = lead[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                lead[y] = x
    return [(d, len(sets[d]), root(d)) for d in ids]


def brute_substrings(docs):
    first, held = {}, {}
    for d, t in sorted(docs):
        held[d] = w = words(t, low=False)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), d)
    for d, w in held.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < d:
                gone.update(range(k, k + 50))
        yield d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def pairs(spark, sf_dir, name):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


LONG = " ".join(f"w{i % 97}x{i}" for i in range(3000))
ODD = [
    (1, None), (2, ""), (3, "  \t\n"), (4, "One two"), (5, "one TWO"), (6, "a b c d e"), (7, "a b c d e"), (8, LONG), (9, LONG + " tail"),
    (10, "x " * 60 + LONG[:900]), (11, "ß é ü 漢字 !!!"), (12, "z " * 400), (13, "z " * 401),
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, [None, "en", "de"][i % 3], "s", len(t or "")) for i, t in ODD], DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, LONG[:200]), (2, "One, two!"), (3, None), (4, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (8, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "x", ""), (3, "http://A.com/EN/?q", ""), (4, "http://a.com/en/1", "é")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    nan = float("nan")
    spark.createDataFrame([(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [None, 1.0], 1), (100, [0.0, 2.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 0, "user", "c"), (3, 5, "assistant", "d")], "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "labels", "pages", "embeddings", "conversations"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(params=["sf", "odd"])
def some_dir(request, sf_dir, odd_dir):
    return {"sf": sf_dir, "odd": odd_dir}[request.param]


def test_decontamination(spark, some_dir):
    got = q.op2_decontamination(spark, some_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted(map(tuple, got)) == sorted(brute_decontaminate(pairs(spark, some_dir, "documents"), pairs(spark, some_dir, "benchmark")))


def test_decontamination_by_join(spark, some_dir):
    """More windows than a block: the join gives the rows of brute force, spans, ids and repeated rows included."""
    docs, items = (spark.read.parquet(f"{some_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    again = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = dec.decontaminate(again, items, block=0).select("doc_id", "n_words", dec.n_hit(), F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items"), 256), dec.n_hit() > 0).collect()
    want = list(brute_decontaminate([(r.doc_id, r.text) for r in again.collect()], pairs(spark, some_dir, "benchmark")))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert any(w[-1] for w in want)
    few, many = (dec.decontaminate(again, items, block=n) for n in (1 << 20, 0))
    assert few.schema.simpleString() == many.schema.simpleString()
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_ngram_join(spark, some_dir):
    got = q.op7_ngram_jaccard_join(spark, some_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_join(pairs(spark, some_dir, "documents"))


def test_substring_dedup(spark, some_dir):
    got = q.op10_substring_dedup(spark, some_dir).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(brute_substrings(pairs(spark, some_dir, "documents")))


def test_packing(spark, some_dir):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    rows = sorted(q.op3_best_fit_packing(spark, some_dir).collect(), key=lambda r: (r.doc_id, r.piece))
    want = []
    for d, t in sorted(pairs(spark, some_dir, "documents")):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k, s, len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096)) for c in [ids[s : s + 4096]]]
    assert [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows] == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 4096 + 1


def test_neighbours_recall(spark, sf_dir):
    import numpy as np

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = {r.vec_id: np.array(r.embedding, float) for r in rows}
    got = defaultdict(list)
    for r in q.op8_nearest_neighbours(spark, sf_dir).collect():
        got[r.query_id].append((r.rank, r.vec_id))
        assert r.score == pytest.approx(np.linalg.norm(x[r.query_id] - x[r.vec_id]), rel=1e-12)
    found = total = 0
    for k in x:
        if k % 100 == 0:
            near = sorted((np.linalg.norm(x[k] - v), j) for j, v in x.items() if j != k)[:10]
            found += len({j for _, j in near} & {j for _, j in got[k]})
            total += len(near)
    assert found >= 0.9 * total


def test_neighbours_leave_out_bad_vectors(spark, odd_dir):
    assert sorted((r.query_id, r.rank, r.vec_id) for r in q.op8_nearest_neighbours(spark, odd_dir).collect()) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]


def test_language_id_held_out(spark, sf_dir):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = [r for r in q.op1_language_id(spark, sf_dir).collect() if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.9 * len(out)


def test_language_of_no_letters_is_und(spark, odd_dir):
    got = {r.doc_id: r.lang_pred for r in q.op1_language_id(spark, odd_dir).collect()}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert q.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_odd_rows(spark, odd_dir, name):
    assert q.QUERIES[name](spark, odd_dir).count() > 0


def test_toolcalls_order_and_status(spark):
    text = lambda *calls: '{"tool_calls":[' + ",".join(calls) + "]}"
    rows = [
        (1, 0, "assistant", text('{"id":"b","name":"f","arguments":{"y":2,"x":"s"},"after":["a"]}', '{"id":"a","name":"f","arguments":{"x":"t"}}')),
        (1, 1, "tool", '{"tool_call_id":"a","content":"ok"}'),
        (2, 0, "assistant", text('{"id":"a","name":"f","arguments":{"x":1,"z":0},"after":["b"]}', '{"id":"b","name":"f","arguments":{"x":"t"},"after":["a"]}')),
        (2, 1, "tool", '{"tool_call_id":"q","content":"?"}'),
        (3, 0, "assistant", text('{"id":"a","name":"f","arguments":{"x":1,"z":0}}', '{"id":"b","name":"nope","arguments":{}}', '{"id":"c","name":"f","arguments":[1]}')),
        (4, 0, "user", "plain"),
    ]
    calls, results = toolcalls.from_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.call_id): r for r in toolcalls.link(calls, results, {"f": {"x": ("string", True), "y": ("integer", False)}}).collect()}
    assert {k: (r.level, r.status) for k, r in got.items()} == {
        (1, "a"): (0, "linked"), (1, "b"): (1, "unanswered"), (2, "a"): (None, "cyclic"), (2, "b"): (None, "cyclic"), (2, "q"): (0, "orphan"),
        (3, "a"): (0, "invalid"), (3, "b"): (0, "invalid"), (3, "c"): (0, "invalid"),
    }
    assert got[1, "b"].json == '{"arguments":{"x":"s","y":2},"id":"b","name":"f"}'
    assert got[3, "a"].errors == ["x is not string", "unknown z"]


def test_pipeline(spark, sf_dir):
    """run() against the stages' brute-force versions on what the quality stage keeps."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality_classifier(spark, docs, sf_dir).select("doc_id", "text").collect()
    left = {d for d, _, c in brute_join([tuple(r) for r in kept]) if d == c}
    one = {r.doc_id: r.text for r in kept if r.doc_id in left}
    cut = {d: (n, g, h) for d, n, g, h in brute_substrings(list(one.items()))}
    out = corpus_pipeline.substring_dedup_stage(spark, docs.where(docs.doc_id.isin(*left)), sf_dir).select("doc_id", "text").collect()
    assert all(sha(" ".join(words(r.text, low=False))) == cut[r.doc_id][2] for r in out)
    clean = {d for d, *_, bad in brute_decontaminate([tuple(r) for r in out], pairs(spark, sf_dir, "benchmark")) if not bad}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == clean
