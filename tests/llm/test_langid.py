"""Hyperdimensional profiles against plain sums of plain products."""

import numpy as np

from postlark.llm import langid

ROWS = [
    (1, "Das ist der Hund, und das ist gut.", "de"), (2, "the dog and the cat", "en"), (3, "ça c'est très bien", "fr"), (4, "der die das", "de"),
    (5, "of the and the", "en"), (6, "un chien très gros", "fr"), (7, None, "de"), (8, "12 !!", "en"), (9, "the the the", None), (10, "漢字 かな", "ja"), (11, "", "fr"),
]


def brute(rows, dim, seed):
    """Prototypes and each text's cosines, one n-gram at a time."""
    letters = langid.Letters(dim, seed)
    blank = lambda c: c if c.isalpha() else "\0"

    def bundled(text):
        low, total = (text or "").lower(), np.zeros(dim)
        for i, c in enumerate(low):
            if c.isalpha():
                gram = [blank(low[i - 1]) if i else "\0", c, blank(low[i + 1]) if i + 1 < len(low) else "\0"]
                v = [letters.vectors(np.array([ord(x)]))[0].astype(float) for x in gram]
                total += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return total

    sums = {}
    for _, text, lang in rows:
        if lang is not None and text is not None:
            sums[lang] = sums.get(lang, 0) + bundled(text)
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    for key, text, _ in rows:
        v = bundled(text)
        if not v.any():
            yield key, "und", 0.0
        else:
            cos = {k: float(u @ v / np.linalg.norm(v)) for k, u in unit.items()}
            best = max(sorted(cos), key=lambda k: cos[k])
            yield key, best, min(1.0, max(0.0, cos[best]))


def test_profiles_against_brute_force(spark):
    rows = [*ROWS, *((100 + i, f"{t} {t}", lang) for i, t, lang in ROWS if t and lang)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r.doc_id: r for r in langid.predict(df, langid.fit(df, dim=128, seed=3), keep={"doc_id": df.doc_id}).collect()}
    want = list(brute(rows, 128, 3))
    assert len(got) == len(want)
    for key, lang, score in want:
        assert got[key].lang_pred == lang
        assert abs(got[key].score - score) < 1e-5
