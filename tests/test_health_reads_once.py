"""The cases of semantic_health read chunks that are cut once."""

import duckdb

from postlark.plans import mail


def test_texts_are_read_once(spark, sf_dir):
    got = mail.QUERIES["semantic_health"](spark, sf_dir)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    names = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({mail.SQL['semantic_health']})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want)
