import math
import random
import re
from collections import Counter

import duckdb
import pytest

from episodic.llm import lexical

from .data import documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    held = [(d, Counter(terms(t)), len(terms(t))) for d, t in docs if terms(t)]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        out += [(item, r, None if d == math.inf else d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def same(got):
    return sorted((tuple(r) for r in got.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "one two THREE one"), (2, None), (3, ""), (None, "w1 w2 w3"), (4, "Ünïcode null id"), (4, "Ünïcode null id"), (5, "absent here"), (6, "same")]


def test_small(spark):
    docs, items = documents(spark), spark.createDataFrame(ITEMS, "item_id long, text string")
    for k in (1, 3, 10):
        assert same(lexical.search(docs, items, k)) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS, k)
    assert lexical.search(empty(spark), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    clash = lexical.search(docs.selectExpr("*", "1 as uid", "2 as n", "3 as score", "4 as terms"), items.selectExpr("*", "1 as iid", "2 as term", "3 as q"))
    assert same(clash) == brute([(r.doc_id, r.text) for r in docs.collect()], ITEMS)


@pytest.mark.parametrize("broadcast", [True, False])
def test_random_ties(spark, monkeypatch, broadcast):
    """Few words, many ties and repeats, one word in nearly every document; also with nothing broadcast."""
    if not broadcast:
        monkeypatch.setattr(lexical, "_small", lambda df, size: df)
        monkeypatch.setattr(lexical.decontamination, "BROADCAST_BYTES", 0)
    rng = random.Random(4)
    word = lambda: f"t{min(int(rng.paretovariate(0.7)), 60)}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(400)] + [(400 + i, "t1 t2 t9") for i in range(50)]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(25)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert same(got) == brute(docs, items)


def test_thresholds_cut(spark):
    """Phase 2 leaves out most documents that hold only common words."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["the", "of", "and"]) for _ in range(20)) + (f" rare{i % 40}" if i < 200 else "")) for i in range(3000)]
    items = [(k, f"the rare{k} of rare{k + 1}") for k in range(5)]
    index = lexical.Index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert lexical.candidates(index, lexical.bounds(index)).selectExpr("sum(size(iids))").first()[0] < 200


def test_table(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = lexical.digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    want = con.sql(f"select item_id, rank, doc_id, score from ({lexical.ORACLE})").fetchall()
    assert same(got) == sorted(want, key=repr) and dict(got.dtypes)["rank"] == "int"
