from collections import Counter, defaultdict

from episodic.llm import mixing

from .data import documents, empty


def level(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Shares the budget by weight again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full = {}
    while True:
        rest = {s: weight[s] for s in names if s not in full}
        left = share * sum(sizes.values()) - sum(full.values())
        target = {s: left * w / sum(rest.values()) for s, w in rest.items()}
        over = {s: cap * sizes[s] for s in rest if target[s] > cap * sizes[s]}
        if not over:
            return target | full
        full |= over


def check(rows):
    sizes = Counter()
    by = defaultdict(list)
    for r in rows:
        sizes[r.source] += r.size
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.places)
    want = level(sizes)
    for s, rs in by.items():
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in rs)
        assert abs(sum(r.taken for r in rs) - want[s]) <= 0.5 + 1e-6


def test_targets_and_quotas(spark):
    docs = documents(spark)
    rows = mixing.mix(docs, block_words=50, shard_words=3000).collect()
    assert len(rows) == docs.count()
    check(rows)
    again = mixing.mix(docs.repartition(3), block_words=50, shard_words=3000).collect()
    assert sorted((repr(r[:9]) for r in rows)) == sorted((repr(r[:9]) for r in again))


def test_whole_table(spark, sf):
    rows = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"), block_words=256, shard_words=20000).collect()
    check(rows)
    shards = Counter()
    for r in rows:
        for p in r.places:
            shards[p.shard] += p.words
    assert len(shards) == 8 and max(shards.values()) < 2.5 * min(shards.values())  # equal numbers of blocks, which are small here


def test_tree_keeps_quotas_and_halves(spark):
    quotas = spark.createDataFrame([(1, 40), (2, 7), (3, 0), (4, 18)], "sid int, n long")
    got = mixing.split_quotas(quotas, 2, 5).collect()
    total, per = Counter(), Counter()
    for r in got:
        total[r.sid] += r.n
        per[r.shard] += r.n
    assert total == {1: 40, 2: 7, 4: 18} and max(per.values()) - min(per.values()) <= 1


def test_written_shards(spark, tmp_path):
    docs = documents(spark)
    mixed = mixing.mix(docs, block_words=50, shard_words=3000)
    mixing.write_shards(docs, mixed, str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    words = sum(len(r.text.split()) for r in out.filter("doc_id in (5, 6)").collect())
    assert words == sum(r.taken for r in mixed.filter("doc_id in (5, 6)").collect())


def test_empty(spark):
    assert mixing.digest(empty(spark)).count() == 0
