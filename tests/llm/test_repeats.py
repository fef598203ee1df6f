import hashlib
import re
from collections import Counter

from episodic.llm import repeats

from .data import documents, empty


def passage(k, n):
    return " ".join(f"p{k}x{i}" for i in range(n))


EXTRA = [(50, "head " + passage(1, 35) + " tail", "en", "s", 1), (51, passage(1, 35), "en", "s", 1), (52, passage(2, 34) + " a", "en", "s", 1), (53, passage(2, 34) + " b", "en", "s", 1),
         (54, "tick " * 60, "en", "s", 1), (55, passage(3, 80) + "\n\n" + "x y z " + passage(3, 80), "en", "s", 1), (56, "A " + passage(4, 50).upper(), "en", "s", 1), (57, passage(4, 50), "en", "s", 1)]


def brute(rows, window=35):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i:i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small(spark):
    docs = documents(spark, EXTRA)
    got = sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert repeats.digest(empty(spark)).count() == 0


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_cover_and_extra_columns(spark):
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_clashing_names(spark):
    docs = documents(spark, EXTRA).selectExpr("*", "1 as found", "2 as d", "3 as n_words", "4 as kept", "5 as h", "6 as `row`")
    got = repeats.remove_repeats(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "n_removed"} - {"text"})
    assert {(r.found, r.d, r.h, r.row) for r in got.collect()} == {(1, 2, 5, 6)} and got.agg({"n_words": "max"}).first()[0] > 6000


def test_null_ids(spark):
    rows = [(None, passage(f"own{i}", 40 + i % 30) if i % 2 else f"y{i} " + passage("all", 40) + f" z{i}", "en", "s", 1) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((tuple(r) for r in repeats.digest(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
