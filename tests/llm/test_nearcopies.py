import random
import re

from episodic.llm import nearcopies

from .data import documents, empty


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Ids of the documents that stay; rows are (id, text) with distinct ids."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = {}
    for i, (doc, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc)
    return sorted(min(g) for g in groups.values())


def variants():
    rng = random.Random(5)
    out = []
    for base in range(6):
        words = [f"b{base}w{rng.randrange(400)}" for _ in range(rng.randint(8, 300))]
        for _ in range(12):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 40))):
                copy[rng.randrange(len(copy))] = "edit"
            out.append(" ".join(copy))
    return [(2000 + i, t, "en", "s", 1) for i, t in enumerate(out)]


def test_small(spark):
    rows = [(r[0] + 10_000 * (i % 2), *r[1:]) for i, r in enumerate(variants())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == brute([(r[0], r[1]) for r in rows])


def test_odd_rows(spark):
    got = nearcopies.keep_one(documents(spark)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == [-5, 3, 5, 7, 7, 9]  # 1 and 2 share 11 of 13 shingles with -5
    assert sum(r.doc_id is None for r in got) == 1 and nearcopies.keep_one(empty(spark)).count() == 0


def test_large_bucket(spark, monkeypatch):
    words = [f"x{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:60], f"own{i}", *words[60:]]), "en", "s", 1) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in nearcopies.keep_one(docs).collect()] == [0]


def test_borderline_pairs_of_long_texts(spark):
    rng, rows, want = random.Random(8), [], []
    for k in range(30):  # 2000 shingles in the union of each pair
        both = 1600 if k % 2 else 1599
        words = [f"p{k}w{rng.randrange(10**9)}" for _ in range(both + 4)]
        tails = [[f"p{k}{side}{i}" for i in range(201)] for side in "ab"]
        left, right = words + tails[0][:200], words + tails[1][: 2000 - both - 200]
        rows += [(2 * k, " ".join(left), "en", "s", 1), (2 * k + 1, " ".join(right), "en", "s", 1)]
        want += [2 * k] if k % 2 else [2 * k, 2 * k + 1]
    sets = [shingle_set(r[1]) for r in rows]
    assert {len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)} == {0.8, 1599 / 2000}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == want


def test_repeated_run(spark):
    rng, rows = random.Random(9), []
    for k in range(20):
        text = " ".join(f"r{rng.randrange(10**9)}" for _ in range(1000))
        rows += [(2 * k, text, "en", "s", 1), (2 * k + 1, text + " ha" * 250, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == list(range(0, 40, 2))


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_null_ids(spark):
    rows = [(None, f"own{i} " * 2 + " ".join(f"t{i}x{j}" for j in range(8)), "en", "s", 1) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.text for r in nearcopies.keep_one(docs).collect()} == {r[1] for r in rows}


def test_cells_of_a_large_bucket(spark, monkeypatch):
    """Many classes share min-hashes but fall into several groups, some not similar to the bucket's first class."""
    monkeypatch.setattr(nearcopies, "CELL", 16)
    rng, rows = random.Random(3), []
    shared = [f"s{i}" for i in range(60)]
    for g in range(12):
        own = [f"g{g}w{i}" for i in range(60)]
        for _ in range(15):
            words = [*shared, *own]
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(60, 120)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words), "en", "s", 1))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in nearcopies.keep_one(docs).collect()) == brute([(r[0], r[1]) for r in sorted(rows)])


def test_clashing_names(spark):
    docs = documents(spark).selectExpr("*", "1 as d", "2 as cid", "3 as `row`", "4 as first")
    got = nearcopies.keep_one(docs)
    assert got.columns == docs.columns and {(r.d, r.cid, r.row, r.first) for r in got.collect()} == {(1, 2, 3, 4)}
