"""The archive's operators on small fixtures, and its queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from postlark.functions import text as T
from postlark.functions.embed import hash_vector
from postlark.operators import archive, search, semantic
from postlark.plans import mail
from postlark.sources import envelopes
from postlark.sources.mail_files import gmail_labels, html_text, read_mail, scan, split_mbox
from postlark.streaming.ingest import Snapshots, stream

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def held(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


FAST = ["ids_make_id", "quoted_split", "chunk_split", "sync_merge_snapshot", "dedup_first_wins", "reconcile_released", "identity_violations", "archive_revision", "bm25_phrase", "vector_topk", "semantic_health", "semantic_index_plan", "import_vectors", "multilingual_rrf", "envelopes_to_read", "lang_detect", "tokenize_arabic", "thread_messages", "thread_context", "hybrid_rrf", "attachments_list", "mbox_split"]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = mail.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    want = duck.execute(f"select {', '.join(cols)} from ({mail.SQL[name]})").fetchall()
    assert held(df.select(*cols).collect()) == held(want)


def test_entry_has_rows(spark, sf_dir):
    assert mail.search_bm25_rrf(spark, sf_dir).count() > 0


def test_empty_query_is_an_error(spark):
    docs = spark.createDataFrame([("a", "x y")], "chunk_id string, text string")
    with pytest.raises(ValueError, match="empty query"):
        search.bm25(search.postings(docs), search.corpus(docs), "  ")


def test_phrase_stays_in_one_column(spark):
    docs = spark.createDataFrame([("1", "a b", "c"), ("2", "b", "c a"), ("3", None, "b c")], "chunk_id string, subject string, text string")
    index = search.postings(docs, ("subject", "text"))
    got = search.bm25(index, search.corpus(docs, ("subject", "text")), "b@c")
    assert [r.chunk_id for r in got.collect()] == ["3"]


def test_diff_counts(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "provider_key string, normalized_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "provider_key string, normalized_hash string")
    assert archive.changes(archive.diff(old, new)).first().asDict() == {"added": 1, "updated": 1, "unchanged": 1}


def test_mbox_rules():
    assert split_mbox(b"junk\nFrom a\n") is None
    assert split_mbox(b"") == []
    got = split_mbox(b"\xef\xbb\xbfFrom a\nS: 1\n\nx\nFrom y\n>>From z\n\nFrom b\nS: 2\n\n")
    assert [r for _, r in got] == [b"S: 1\n\nx\nFrom y\n>From z\n", b"S: 2\n"]


def test_mail_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.mbox").write_bytes(mail.MBOX)
    (tmp_path / "in/b.eml").write_bytes(b"no headers here")
    rows = read_mail(scan(spark, str(tmp_path / "in"))).collect()
    assert sorted(r.subject or "" for r in rows) == ["", "One", "Two"]
    assert sum(r.error is not None for r in rows) == 1


def test_envelopes_to_messages(spark):
    rows = [
        ('{"id":7,"message-id":"m1","from":{"email":"a@x.com"},"to":["b@x.com",{"email":"c@x.com"},{}],"subject":"S","in-reply-to":["p","q"],"labels":["l",1],"date":"2024-01-01"}',),
        ('{"uid":"u2","from":["d@x.com","e@x.com"],"to":"f@x.com","cc":{"email":"g@x.com"},"snippet":"short"}',),
        ('{"message-id":"m3","from":5,"to":null,"body":"long","snippet":"short"}',),
        ("no json",),
        (None,),
    ]
    got = envelopes.messages(spark.createDataFrame(rows, "value string"), "a", "INBOX").collect()
    assert [(r.provider_key, r.message_id, r.in_reply_to, r.from_address, r.to_addresses, r.cc_addresses, r.text, r.labels) for r in got[:3]] == [
        ("7", "m1", "p", "a@x.com", ["b@x.com", "c@x.com"], [], "", ["l", "1"]),
        ("u2", None, None, "d@x.com", ["f@x.com"], ["g@x.com"], "short", []),
        ("m3", "m3", None, "", [], [], "long", []),
    ]
    assert [r.date for r in got[:2]] == ["2024-01-01", envelopes.EPOCH]
    assert [r.provider_key for r in got[3:]] == [None, None]


def test_fixture_files(spark, tmp_path):
    (tmp_path / "f.json").write_text('[{"accountId":"a","providerKey":"k","to":["x"],\n"attachments":[{"name":"n","mimeType":"text/plain"}]},{}]')
    got = envelopes.read_fixtures(spark, str(tmp_path / "f.json")).collect()
    assert [(r.providerKey, r.to, r.attachments and r.attachments[0].name) for r in got] == [("k", ["x"], "n"), (None, None, None)]


def test_vector_snapshot(spark):
    old = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 1.0])], "chunk_id string, vector array<double>")
    new = spark.createDataFrame([("b", [3.0, 4.0])], "chunk_id string, vector array<double>")
    assert sorted((r.chunk_id, r.vector) for r in semantic.upsert(old, new, 2).collect()) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    with pytest.raises(Exception, match="wrong dimension: b"):
        semantic.upsert(old, new, 3).collect()
    with pytest.raises(ValueError, match="rebuild"):
        semantic.Identity("p", "m", 2).require(semantic.Identity("p", "m", 3))


def test_health_of_nothing(spark):
    none = spark.createDataFrame([], "chunk_id string, content_hash string")
    one = spark.createDataFrame([("a", "h")], "chunk_id string, content_hash string")
    me = semantic.Identity("p", "m", 2)
    assert semantic.health(none, none, None, me).first().status == "missing"
    assert semantic.health(one, none, None, me).first().status == "never-completed"


def test_html_text():
    assert html_text("<p>a <b>b</b></p><script>x</script><p>&amp;c") == "a b\n&c"
    assert html_text(None) == ""


def test_hash_vector_has_length_one():
    assert abs(sum(x * x for x in hash_vector("one two")) - 1) < 1e-9
    assert sum(hash_vector("")) == 1


def test_stream_merges_batches_once(spark, tmp_path):
    schema = "id int, text string"
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), into := Snapshots(spark, str(tmp_path / "out")), ["id"], str(tmp_path / "cp")).awaitTermination()
        assert into.version() == i + 1
    assert sorted(tuple(r) for r in into.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert into.upsert(spark.createDataFrame([(9, "z")], schema), ["id"], 1, str(tmp_path / "cp")) == 2


def test_streams_and_publishing_by_hand_keep_every_row(spark, tmp_path):
    schema = "id int, text string"
    into = Snapshots(spark, str(tmp_path / "out"))
    for name, rows in (("a", [(1, "a")]), ("b", [(2, "b")])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
        stream(spark.readStream.schema(schema).parquet(str(tmp_path / name)), into, ["id"], str(tmp_path / f"cp-{name}")).awaitTermination()
    into.publish(into.read().union(spark.createDataFrame([(3, "c")], schema)))
    spark.createDataFrame([(4, "d"), (4, "e")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    stream(spark.readStream.schema(schema).parquet(str(tmp_path / "a")), into, ["id"], str(tmp_path / "cp-a")).awaitTermination()
    assert sorted(tuple(r) for r in into.read().collect()) == [(1, "a"), (2, "b"), (3, "c"), (4, "e")]
    with pytest.raises(RuntimeError, match="another writer"):
        into.publish(into.read(), 2)


def test_text_rules(spark):
    def of(f, *texts):
        return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(f(F.col("t"))).collect()]

    assert of(T.trim, "\u3000\u2003a\u00a0b\u202f\ufeff", "\x85a") == ["a\u00a0b", "\x85a"]
    assert of(lambda c: T.split_quoted(c)[0], "a\r\nb\r\n\r\nOn Tue, x wrote:\r\n> q") == ["a\r\nb"]
    assert of(lambda c: T.split_quoted(c)[1], "a\r\n> q\r\n> r") == ["> q\n> r"]
    assert of(T.split_text, " a \n\u3000\n b\nc \n\n\n", "", "x" * 2400 + " y") == [["a", "b\nc"], [], ["x" * 2400, "y"]]
    assert of(T.languages, "\ud7a3", "\ud7b0") == [["ko"], []]
    assert of(T.ANALYZERS["ko"], "ＡＢ계약") == [["ab계약"]] and of(T.ANALYZERS["ja"], "ｶﾅ") == [["カナ"]]
    assert of(T.tokens_arabic, "\ufedf\ufe8e") == [["لا", "ا"]]
    assert of(T.redact_json, '{"a":["x@y.zz",{"apiToken":"s","n":1}],"b":"key=1, ok"}', "token: t", None) == ['{"a":["[EMAIL]",{"apiToken":"[REDACTED]","n":1}],"b":"[REDACTED], ok"}', "[REDACTED]", None]
    assert gmail_labels('Inbox,category  Promotions ,"a, \\"b\\"", ') == ["Inbox", "CATEGORY_PROMOTIONS", 'a, \\"b\\"']


def test_pairs_of_characters(spark, monkeypatch):
    of = lambda *texts: [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.tokens_pairs(F.col("t"))).collect()]
    assert of("请确认合同 v2", "契約の更新。", "契", "コーヒー", "A1契約B", "", "ab 12") == [["请确", "确认", "认合", "合同", "v2"], ["契約", "約の", "の更", "更新"], ["契"], ["コー", "ーヒ", "ヒー"], ["A1", "契約", "B"], [], ["ab", "12"]]
    assert of(None) == [None]
    with pytest.raises(ValueError, match="has an analyzer"):
        T.register_analyzer("ko", "x", T.tokens)
    monkeypatch.setattr(T, "SCRIPTS", dict(T.SCRIPTS))
    monkeypatch.setattr(T, "ANALYZERS", dict(T.ANALYZERS))
    before = search._version()
    T.register_analyzer("th", r"[\x{0e00}-\x{0e7f}]", T.tokens)
    assert search._version() != before
    assert spark.range(1).select(T.languages(F.lit("\u0e01 \u5951"))).first()[0] == ["zh", "th"]


def test_words_inside_sentences(spark, tmp_path):
    """Pairs must follow each other in Chinese and Japanese."""
    rows = [("1", "请确认合同更新条件。"), ("2", "同合"), ("3", "契約の更新を確認してください。"), ("4", "更新と契約")]
    held = spark.createDataFrame(rows, "chunk_id string, text string").withColumns({c: F.lit("") for c in search.SHOWN if c != "to_addresses"} | {"to_addresses": F.array(F.lit("")), "content_hash": F.lit("")})
    search.Index.write(held, str(tmp_path / "i"), ("text",))
    index = search.Index.read(spark, str(tmp_path / "i"))
    found = lambda q: {r.chunk_id for r in index.search(q).collect()}
    assert found("合同") == {"1"} and found("更新") == {"1", "3", "4"} and found("契約の更新") == {"3"} and found("契約 更新") == {"3", "4"}


def test_postings_by_term(spark):
    docs = spark.createDataFrame([("1", "b a b"), ("2", None), ("3", ""), ("4", "a")], "chunk_id string, text string")
    got = sorted((r.chunk_id, r.term, r.tf, r.dl, r.positions) for r in search.postings(docs).collect())
    assert got == [("1", "a", 1, 3, [1]), ("1", "b", 2, 3, [0, 2]), ("4", "a", 1, 1, [0])]
    assert search.postings(docs.limit(0)).count() == 0


def test_index_of_nothing(spark, tmp_path):
    text = spark.createDataFrame([], "chunk_id string, text string, content_hash string, to_addresses array<string>")
    search.Index.write(text.withColumns({c: F.lit("") for c in search.SHOWN if c != "to_addresses"}), str(tmp_path / "i"), ("text",))
    index = search.Index.read(spark, str(tmp_path / "i"))
    assert index.search("word", 3).count() == 0 and index.stats.first().n == 0
    with pytest.raises(ValueError, match="positive"):
        index.search("word", 0)
