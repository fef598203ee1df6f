import re

import numpy as np
import pytest
import xxhash

from episodic.llm import components, simhash

from .data import documents, empty

EXTRA = [(200 + i, "alpha beta gamma delta " * 9 + f"word{i // 3}", "en", "s", 1) for i in range(12)] + [(300, "SAME", "en", "s", 1), (301, "two words", "en", "s", 1)]


def brute(rows, width=3, radius=2):
    fps = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((r[0], f"{fps[i]:016x}", least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def test_small(spark):
    docs = documents(spark, EXTRA)
    got = sorted((tuple(r) for r in simhash.digest(docs).collect()), key=repr)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.digest(empty(spark)).count() == 0


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert sorted((tuple(r) for r in simhash.digest(docs).collect()), key=repr) == brute([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("n", [1, 63, 64, 65, 300])
@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_sliced_distance(n, radius):
    rng = np.random.default_rng(n * 10 + radius)
    fp = rng.integers(0, 2**64, n, np.uint64)
    for i in range(0, n, 2):  # half of them near the first
        flips = rng.choice(64, rng.integers(0, 10), replace=False)
        fp[i] = fp[0] ^ np.uint64(sum(1 << int(b) for b in flips))
    want = np.array([(int(x) ^ int(fp[0])).bit_count() <= radius for x in fp])
    assert (simhash.within(simhash._planes(fp), int(fp[0]), radius, n) == want).all()


@pytest.mark.parametrize("small,split", [(64, 8192), (1, 8192), (1, 2)])
def test_buckets_keep_components(monkeypatch, small, split):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 6, np.uint64)
    fp = np.unique([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(20, rng.integers(0, 4), replace=False))) for b in base for _ in range(40)])

    def parts(pairs):
        root = {int(x): int(x) for x in fp}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[find(max(a, b))] = find(min(a, b))
        out = {}
        for x in root:
            out.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, out.values()))

    got = [(int(x), int(y)) for a, b in simhash.bucket_links(fp, np.array([0]), 2) for x, y in zip(a, b, strict=True)]
    every = [(int(a), int(b)) for a in fp for b in fp if a < b and (int(a) ^ int(b)).bit_count() <= 2]
    assert parts(got) == parts(every)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {k: 100 for k in range(101, 160)}
