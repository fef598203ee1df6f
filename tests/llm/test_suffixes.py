import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from episodic.llm import suffixes

from .data import documents, empty


def brute(rows, width=200):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(b[i:i + width] for b in texts for i in range(len(b) - width + 1))
    out = []
    for (doc, _), b in zip(rows, texts, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if count[b[i:i + width]] > 1:
                gone[i:i + width] = True
        runs = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
        out.append((doc, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def letters(seed, n, of="abcdefgh "):
    rng = random.Random(seed)
    return "".join(rng.choice(of) for _ in range(n))


EXTRA = [(50, "head" + letters(1, 200) + "tail", "en", "s", 1), (51, letters(1, 200), "en", "s", 1), (52, letters(2, 199) + "a", "en", "s", 1), (53, letters(2, 199) + "b", "en", "s", 1),
         (54, "tick " * 160, "en", "s", 1), (55, letters(3, 900) + "\n\nx y z " + letters(3, 900), "en", "s", 1), (56, "z" * 5000, "en", "s", 1), (57, "z" * 201, "en", "s", 1), (58, "y" * 200, "en", "s", 1),
         (59, "\x00" * 250 + "q", "en", "s", 1), (60, "é" * 101, "en", "s", 1), (61, "x" + "é" * 100, "en", "s", 1), *((70 + i, f"{i}" + letters(4, 2500) + letters(100 + i, 300) + letters(5, 700), "en", "s", 1) for i in range(40))]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_small(spark):
    docs = documents(spark, EXTRA)
    assert rows(suffixes.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert suffixes.digest(empty(spark)).count() == 0


@pytest.mark.parametrize("width", [30, 37, 53, 90])
def test_low_entropy(spark, width):
    """Two letters, so that words, names and neighbours tie everywhere; every residue of the cover meets every other."""
    data = [(i, letters(i % 7, 40 + i, "ab") + letters(i, 150, "ab") + "ab" * (i % 90)) for i in range(120)]
    got = suffixes.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), width).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)")
    assert rows(got) == brute(data, width)


def test_steps():
    cover = suffixes.COVER
    assert {(a - b) % suffixes.PERIOD for a in cover for b in cover} == set(range(suffixes.PERIOD))
    for width in range(30, 300):
        rounds = suffixes.steps(width)
        for before, step in zip(rounds, rounds[1:-2]):
            assert all(k % suffixes.PERIOD == 0 for k in step.shifts) and step.shifts[1] <= before.depth and step.shifts[2] <= step.shifts[1] + before.depth and step.shifts[2] + before.depth == step.depth
        assert width - 16 <= rounds[-1].depth <= width - suffixes.PERIOD + 1
    assert suffixes.steps(200)[-1].depth == 192


def test_suffix_array_alone(spark, monkeypatch):
    """The array over whole pieces, no candidates chosen before, in several groups."""
    data = [letters(i % 5, 300) + letters(50 + i, 200) + letters(i % 3, 250) for i in range(60)]
    pieces = spark.createDataFrame([(i * 7 - 90, i, False, i % 4, i % 7, d.encode()) for i, d in enumerate(data)], "k1 long, k2 long, many boolean, least long, phase long, piece binary")
    monkeypatch.setattr(suffixes, "GROUP", 5000)
    got = {r.k2: sum(b - a for a, b in zip(r.begins, r.ends, strict=True)) for r in suffixes.repeated_spans(pieces).collect()}
    assert got == {r[0]: r[2] for r in brute(list(enumerate(data)))}


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(suffixes.digest(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_slices(spark):
    """Repeats across the borders of slices, in texts longer than several."""
    a, b = letters(8, 700_000), letters(9, 300_000)
    docs = spark.createDataFrame([(1, a), (2, b + a[200_000:600_000]), (3, "z" * 600_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed, got[3].n_removed) == (400_000, 1, 400_000, 600_000) and bytes(got[2].kept) == b.encode()


def test_clashing_names(spark):
    docs = documents(spark, EXTRA).selectExpr("*", "1 as found", "2 as d", "3 as n_bytes", "4 as kept", "5 as g", "6 as `row`", "7 as spans")
    got = suffixes.remove_repeats(docs)
    assert sorted(got.columns) == sorted({*docs.columns, "n_removed", "n_spans"} - {"text"})
    assert {(r.found, r.d, r.g, r.row, r.spans) for r in got.collect()} == {(1, 2, 5, 6, 7)}


def test_frequent_grams(spark, monkeypatch):
    """Grams with more suffixes than a task compares go through the array that is dealt by ranges, others and copies do not."""
    data = [(i, letters(i % 40, 120) + letters(1000, 180) + letters(500 + i % 25, 120) + letters(2000 + i // 2, 260)) for i in range(120)] + [(200, "ab" * 700), (201, "c" + "ab" * 700)]
    monkeypatch.setattr(suffixes, "MOST", 12)
    monkeypatch.setattr(suffixes, "BLOCK", 7)
    monkeypatch.setattr(suffixes, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10"))
    sizes, whole = [], suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda pieces, width: sizes.append(pieces.count()) or whole(pieces, width))
    try:
        assert rows(suffixes.digest(spark.createDataFrame(data, "doc_id long, text string"))) == brute(data)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert sizes[0] > 12


def test_array_is_sparse(spark):
    """About one suffix in thirty enters the array, and copies within a slice enter once."""
    text = pa.array([letters(1, 20_000) * 2 + "z" * 9000])
    places = np.arange(48_000).tolist()
    batch = pa.RecordBatch.from_arrays([text.cast(pa.binary()), pa.array([places]), pa.array([1])], ["text", "grams", "d"])
    out = pa.Table.from_batches(list(suffixes._suffixes(["d"], 200)(iter([batch]))))
    assert 400 < len(out) < 1000
    assert sum(len(p) // 4 for p in out.column("places").to_pylist()) > 9000 + 1.8 * 600
