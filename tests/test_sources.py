"""Folders with what cannot be listed, strict reading, pages of envelopes, older layouts, output."""

import json
import os

import pytest

from postlark.operators import maintain, semantic
from postlark.sources import envelopes
from postlark.sources.mail_files import SCHEMA, strict
from postlark.sources.walk import resolve_root, walk
from postlark.streaming.ingest import Snapshots


def test_walk(spark, tmp_path):
    root = tmp_path / "mail box"
    for name in ("a.eml", "deep/er/b.MBOX", "In.mbox/mbox", "mbox", "deep/c.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    os.symlink(root, root / "deep/loop")
    os.symlink(root / "a.eml", root / "deep/d.eml")
    roots = {"r": resolve_root(spark, str(root)), "one": resolve_root(spark, str(root / "a.eml")), "gone": "file:/no/such/folder"}
    got = {(r.root_key, r.rel_path, r.kind, r["size"]) for r in walk(spark, roots).collect()}
    files = {("r", n, "file", 5) for n in ("a.eml", "deep/er/b.MBOX", "In.mbox/mbox", "deep/d.eml")}
    assert got == files | {("one", "a.eml", "file", 5), ("gone", "", "unlisted", None)}
    assert walk(spark, {}).count() == 0
    with pytest.raises(ValueError, match="root of mail files cannot be read"):
        resolve_root(spark, "/no/such/folder")


def test_strict(spark):
    rows = spark.createDataFrame([{"path": "p", "label": "a", "subject": "s"}], SCHEMA)
    assert strict(rows).count() == 1
    with pytest.raises(Exception, match="b: malformed"):
        strict(rows.unionByName(spark.createDataFrame([{"path": "p", "label": "b", "error": "malformed"}], SCHEMA))).collect()


def test_pages_of_envelopes(spark):
    rows = [(1, '{"envelopes":[{"id":1},{"id":"2"}]}'), (2, '[{"id":3}]'), (3, "[]"), (4, '{"id":9}'), (5, "no"), (6, None)]
    got = envelopes.messages(envelopes.unpack(spark.createDataFrame(rows, "page int, value string")), "a", "i")
    assert sorted((r.page, r.provider_key) for r in got.collect()) == [(1, "1"), (1, "2"), (2, "3")]


def test_older_layouts_and_dropped_tables(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    store.publish({"a": spark.createDataFrame([(1, "x")], "id int, own string"), "b": spark.createDataFrame([(1,)], "n int")})
    assert store.migrate({"a": "id long, labels array<string>", "none": "id int"}) == 2
    assert store.migrate({"a": "id long, labels array<string>"}) == 2
    assert [tuple(r) for r in store.read("a").select("id", "own", "labels").collect()] == [(1, "x", None)] and store.read("b").count() == 1
    assert store.publish({}, drop=("a",)) == 3 and store.read("a") is None and store.read("b").count() == 1
    assert store.publish({}, drop=("b",)) == 4 and store.read("b") is None


def test_vectors_leave(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "v"))
    held = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, vector array<double>")
    assert [r.chunk_id for r in semantic.delete(held, held.where("chunk_id = 'a'")).collect()] == ["b"]
    store.publish({maintain.VECTORS: held})
    maintain.drop_vectors(store)
    assert store.read(maintain.VECTORS) is None and maintain.held_identity(store) is None


def test_output(spark):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert maintain.as_json(rows).first().value == '{"a":1,"b":null}'
    assert json.loads(maintain.diagnosis(ValueError("token=abc of x@y.zz"))) == {"error": "[REDACTED] of [EMAIL]", "kind": "ValueError"}
