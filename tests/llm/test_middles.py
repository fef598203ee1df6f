import hashlib
import random
import re

import duckdb
import pytest

from episodic.llm import middles
from pyspark.sql import functions as F

from .data import documents, empty


def brute(doc_id, text):
    text = text or ""
    u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, x = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    return (doc_id, n, "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}") if h[3] % 100 < 20 else (doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}")


def hashed(r):
    return (*r[:5], hashlib.sha256(r[5].encode()).hexdigest())


EXTRA = [(k, t, "en", "s", 1) for k, t in enumerate(["<P", "a<P>b", "x<<S>", "<", "<P<S<M", "ab<M>", "Zz<", "1<P2>", "é<S>é", "a" * 40, "<" * 40, "𝔘" * 33, "abc def\r\n\tghi <Q> </P>", "<P" * 30, "x" * 15 + "<P>", "x" * 14 + "<P>", "x" * 13 + "<S> tail"], 100)]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1 << 16])
def test_small(spark, chunk):
    docs = documents(spark, EXTRA).filter("length(text) < 3000 or text is null or doc_id = 5")
    got = sorted((tuple(r)[:6] for r in middles.digest(docs, chunk).collect()), key=repr)
    assert got == sorted((hashed(brute(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert middles.digest(empty(spark)).count() == 0


def test_functions_compose():
    rng = random.Random(3)
    table = {}
    for state in range(4):
        for ch in "aP<>. ":
            letter = ch in "aP"
            end = middles.LT if ch == "<" else middles.MARK if ch == "P" and state == middles.LT else middles.RUN if letter else middles.OUT
            table[state, ch] = end, int(not letter or state not in (middles.RUN, middles.MARK)), ch == ">" and state == middles.MARK

    def walk(text, state):
        units, found = 0, False
        for ch in text:
            state, k, hit = table[state, ch]
            units, found = units + k, found or hit
        return state, units, found

    for _ in range(500):
        text = "".join(rng.choice("aP<>. ") for _ in range(rng.randrange(12)))
        cut = rng.randint(0, len(text))
        whole = middles.compose(middles.Chunk(text[:cut]).function(), middles.Chunk(text[cut:]).function())
        assert [tuple(x) for x in zip(*whole, strict=True)] == [walk(text, s) for s in range(4)]
        assert tuple(map(list, whole)) == tuple(map(list, middles.Chunk(text).function()))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = middles.digest(docs)
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.sql(middles.ORACLE).fetchall(), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert out.join(docs, "doc_id").filter(F.sha2(F.coalesce("text", F.lit("")), 256) != F.col("restored_sha256")).count() == 0


def test_giant(spark):
    rng = random.Random(5)
    text = "".join(rng.choice(["ab", "C", " ", "<", ">", "ü", "\n", "word"]) for _ in range(400_000))
    docs = spark.createDataFrame([(3, text), (3, text), (None, text + "!"), (9, text + "<M>")], "doc_id long, text string").selectExpr("*", "7 as n", "8 as chunk", "9 as `draw`")
    got = middles.examples(docs)
    assert sorted(got.columns) == sorted(["doc_id", "n", "chunk", "draw", "form", "prefix_chars", "middle_chars", "output"])
    rows = got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()
    assert sorted((hashed(tuple(r)) for r in rows), key=repr) == sorted((hashed(brute(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert {(r.chunk, r.draw) for r in got.collect()} == {(8, 9)}
