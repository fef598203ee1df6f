import numpy as np

from episodic.llm import decontamination as d

from .data import documents, empty


def longest(item, text, free_i, free_j, least):
    best = None
    for a in range(len(item)):
        for b in range(len(text)):
            k = 0
            while a + k < len(item) and b + k < len(text) and item[a + k] == text[b + k] and free_i[a + k] and free_j[b + k]:
                k += 1
            if k >= least and (best is None or k > best[0]):
                best = (k, a, b)
    return best


def brute(item, text, least=5):
    """Plain greedy string tiling: coverage of the item."""
    least = min(least, len(item))
    free_i, free_j, total = [True] * len(item), [True] * len(text), 0
    while best := longest(item, text, free_i, free_j, least):
        k, a, b = best
        free_i[a:a + k] = [False] * k
        free_j[b:b + k] = [False] * k
        total += k
    return total / len(item)


def test_tiling_against_plain_search():
    rng = np.random.default_rng(0)
    for k in range(150):
        item = [b"w%d" % x for x in rng.integers(0, 12 if k % 2 else 3, rng.integers(1, 30))]
        cut = int(rng.integers(0, len(item)))
        text = [b"w%d" % x for x in rng.integers(0, 12, 20)] + item[cut:] + [b"gap"] + item[:cut] + [b"w%d" % x for x in rng.integers(0, 4, 20)]
        assert d.coverage(item, text) == brute(item, text), (item, text)
    assert d.coverage([b"a"] * 40, [b"a"] * 2_000_000) == 1.0 and d.coverage([b"a", b"b"] * 10, [b"c"] * 1000 + [b"a", b"b"] * 7) == 0.7


def test_bit_map(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(-2**63, 2**63 - 1, 5000)
    found = d._bit_map(spark.createDataFrame([(int(x),) for x in h], "h long"), 5000)
    assert found[(h & (len(found) - 1))].all() and found.sum() == len(np.unique(h & (len(found) - 1)))


def test_reordered_and_clean(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, a + " " + b), (2, None), (3, "tiny item"), (4, "!!")], "item_id long, text string")
    docs = documents(spark, [(70, f"x {b.upper()}, y {a} z", "en", "s", 1), (71, " ".join(a.split()[:10]), "en", "s", 1), (72, "a tiny item here", "en", "s", 1)])
    got = {r.doc_id: r for r in d.digest(docs, bench).collect()}
    assert got[70].contaminated and got[70].coverage == 1.0 and got[70]["items"] == [1]
    assert not got[71].contaminated and got[72]["items"] == [3]
    assert d.digest(docs, bench).count() == docs.count()
    assert d.clean(docs, bench).columns == docs.columns
    assert not any(r.contaminated for r in d.digest(docs, bench.limit(0)).collect()) and d.digest(empty(spark), bench).count() == 0


def test_table_against_plain_tiling(spark, sf):
    """Every hit of the table and no other: items that share no run of five words with a document are not tiled."""
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet").collect(), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    grams = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    items = [(b.item_id, d.tokens(b.text)) for b in bench]
    items = [(i, w, grams(w, min(5, len(w)))) for i, w in items if w]
    want = set()
    for r in docs:
        words = d.tokens(r.text)
        mine = {n: grams(words, n) for n in range(1, 6)}
        for i, w, g in items:
            if len(g & mine[min(5, len(w))]) * 5 >= 0.5 * len(w) and d.coverage(w, words) >= 0.5:
                want.add((r.doc_id, i))
    got = {(r.doc_id, i) for r in d.digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")).collect() for i in r["items"]}
    assert got == want and len(want) >= 3


def test_shuffled_seeds_and_clashing_names(spark, sf, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = sorted(map(tuple, d.digest(docs, bench).collect()), key=repr)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    assert sorted(map(tuple, d.digest(docs, bench).collect()), key=repr) == want
    more = documents(spark).selectExpr("*", "1 as hits", "2 as h", "3 as items", "4 as item_id")
    assert d.clean(more, bench).columns == more.columns and {r.hits for r in d.clean(more, bench).collect()} == {1}
    assert d.scan(more, bench).columns == more.columns and d.scan(more, bench).count() == more.count()


def test_periodic_texts(monkeypatch):
    """Against plain tiling, with pieces and periods so small that both are cut everywhere; then a long one in bounded memory and time."""
    import tracemalloc
    rng = np.random.default_rng(2)
    with monkeypatch.context() as m:
        m.setattr(d, "PIECE", 16)
        for k in range(200):
            p = int(rng.integers(1, 6))
            motif = [b"w%d" % x for x in rng.integers(0, 4, p)]
            item = ((motif * 12)[int(rng.integers(0, 3)):][:int(rng.integers(4, 16))] + [b"w%d" % x for x in rng.integers(0, 6, int(rng.integers(0, 8)))])
            text = motif * int(rng.integers(20, 70)) + [b"w%d" % x for x in rng.integers(0, 6, 10)] + item[5:] + motif * int(rng.integers(0, 30))
            assert d.coverage(item, text) == brute(item, text), (item, text)
    words = np.array([1, 2] * 500_000)
    assert len(d._without_periods(words, 400, 5)) < 5000
    item = [b"ha", b"ho"] * 150 + [b"x%d" % i for i in range(100)]
    tracemalloc.start()
    assert d.coverage(item, [b"ha", b"ho"] * 1_000_000) == 0.75
    mixed = sum(([b"ha", b"ho"] * 400 + [b"gap%d" % i] for i in range(100)), [])
    assert d.coverage(item, mixed) == 0.75
    assert tracemalloc.get_traced_memory()[1] < 700 << 20
    tracemalloc.stop()
