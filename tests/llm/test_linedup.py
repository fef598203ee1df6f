import random

from pyspark.sql import functions as F

from episodic.llm import linedup

from .data import SCHEMA, documents, empty

WORDS = [f"v{i}" for i in range(60)]


def noisy(seed=3):
    rng, out = random.Random(seed), []
    bases = [rng.sample(WORDS, rng.randint(1, 30)) for _ in range(12)]
    for doc in range(40):
        lines = []
        for _ in range(rng.randint(0, 8)):
            line = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice(WORDS)
            rng.shuffle(line)
            lines.append(" ".join(line) if rng.random() > 0.1 else " \t ")
        out.append((1000 + doc, "\n".join(lines), "en", "s", 1))
    return out


def brute(rows):
    """Removed lines of each document: {(doc, text): places}."""
    key = lambda r: (r[0] is None, r[0] or 0, linedup_tag[r[1] or ""])
    seen, out = [], {}
    for doc, text in sorted(set(rows), key=key):
        gone = []
        for i, line in enumerate((text or "").split("\n")):
            words = frozenset(line.split())
            if not words:
                continue
            if any(len(words & w) * 5 >= 4 * len(words | w) for w in seen):
                gone.append(i)
            seen.append(words)
        out[doc, text] = gone
    return out


linedup_tag = {}


def check(docs, rows):
    for r in linedup.keyed(docs).select("text", "t", "u").collect():
        linedup_tag[r.text or ""] = (r.t, r.u)
    want = brute([(r.doc_id, r.text) for r in rows])
    joined = linedup.remove_similar_lines(docs.withColumn("old", linedup.F.col("text"))).collect()
    assert len(joined) == len(rows)
    for r in joined:
        gone = want[r.doc_id, r.old]
        assert sorted(r.removed) == gone, (r.doc_id, r.removed, gone)
        assert r.text == (None if r.old is None else "\n".join(x for i, x in enumerate(r.old.split("\n")) if i not in gone))


def test_small(spark):
    docs = documents(spark, noisy())
    check(docs, docs.collect())
    assert linedup.digest(empty(spark)).count() == 0


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(docs, docs.collect())


def test_null_ids(spark):
    rows = [(None, f"only line of {i}\nsame in all {i // 2}" if i % 3 else f"only line of {i}", "en", "s", 1) for i in range(3000)]
    check(documents(spark, rows).filter("doc_id is null"), documents(spark, rows).filter("doc_id is null").collect())


def test_long_lines(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**9)}" for _ in range(80_000)]
    other = [*base[:40_000], *(f"x{i}" for i in range(40_000))]
    near = [*base[:78_000], *(f"y{i}" for i in range(2000))]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, other, near, base[::-1]))]
    got = {r.doc_id: r.removed for r in linedup.remove_similar_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: [], 1: [], 2: [0], 3: [0]}


def test_many_near_copies(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):  # chains too: not all of them are similar to the first
        words = list(base)
        for _ in range(i // 10):
            words[rng.randrange(200)] = f"o{rng.randrange(10**6)}"
        rows.append((i, " ".join(words) + "\n" + " ".join(words[:90]), "en", "s", 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    check(docs, docs.collect())


def test_many_lines(spark):
    rows = [(1, "\n".join(f"line {i} of many {i * 7}" for i in range(60_000)), "en", "s", 1), (2, "line 5 of many 35\nown words here now", "en", "s", 1)]
    got = {r.doc_id: (r.n_lines, len(r.removed)) for r in linedup.remove_similar_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (60_000, 0), 2: (2, 1)}


def test_clashing_names(spark):
    docs = documents(spark).selectExpr("*", "5 as d", "6 as t", "7 as row", "8 as `a.b`", "9 as n_lines", "'x' as at", "0 as list")
    got = linedup.remove_similar_lines(docs)
    assert got.columns == [*docs.columns, "removed"]
    assert {(r.d, r.t, r.row, r["a.b"], r.at, r.list) for r in got.collect()} == {(5, 6, 7, 8, "x", 0)}


def test_shared_rare_word(spark):
    """Lines that share a word too late for any partner are dropped before they meet each other."""
    rows = [(1, "\n".join(f"zq{i} posted on forum page" for i in range(3000)), "en", "s", 1), (2, "zq7 posted on forum page now\nposted on forum page", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: sorted(r.removed) for r in linedup.remove_similar_lines(docs).collect()}
    assert got == {1: [], 2: [0, 1]}
    side = lambda s: {"key": F.shiftleft(f"n{s}", 16).bitwiseOR(F.col(f"p{s}")), "far": F.lit(None).cast("long"), "b0": F.lit(0).cast("long"), "b1": F.lit(0).cast("long")}.__getitem__
    lengths = spark.range(1, 14).select(F.col("id").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("p"))
    cases = lengths.toDF("n1", "p1").join(lengths.toDF("n2", "p2"), F.abs(F.col("n1") - F.col("n2")) < 20)
    x, y = side(1), side(2)
    both = (linedup._n(y) * 4 <= linedup._reach(x)) & (linedup._n(x) * 4 <= linedup._reach(y))
    assert cases.count() == 91 ** 2 and cases.filter(linedup._near(x, y) != both).count() == 0


def test_partner_far_back(spark):
    """A line whose only similar line stands behind more than a dozen others of its word, none of them near it, goes too."""
    pairs = [[f"{w}{i}" for w in "abc"] for i in range(22)]
    both = [(f"zz {' '.join(p)}", f"{' '.join(reversed(p))} zz") for p in pairs]
    common = " ".join(w for p in pairs for w in p * 60)
    lines = [common, both[0][0], both[0][1], both[1][0], *(x for b in both[2:] for x in b), both[1][1]]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(lines)], SCHEMA)
    check(docs, docs.collect())


def test_measured_postings(spark):
    """The join's narrow postings pass and fail as whole ones, and give back key and far, for lines of any length."""
    lengths = spark.createDataFrame([(n,) for n in (1, 2, 9, 88, 89, 100, 111, 65_534, 65_535, 65_536, 80_000)], "n long")
    posts = lengths.select("n", F.explode(F.array(*(F.lit(p).cast("long") for p in (0, 1, 9, 17, 13_000, 15_999)))).alias("p")).filter("p < n")
    posts = posts.select(F.lit(7).cast("long").alias("token"), (F.col("n") * 20_000 + F.col("p")).alias("line"), F.xxhash64("n").alias("b0"), F.lit(0).cast("long").alias("b1"), "n", "p")
    posts = posts.withColumns({"b0": F.col("b0").bitwiseAND(255), "key": linedup._key(F.col("token"), F.col("n"), F.col("p")), "far": linedup._far(F.col("n"), F.col("p"))})
    whole = posts.drop("n", "p")
    back = linedup._packed(linedup._measured(whole, ["line"])).select(*whole.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    both = linedup._measured(whole, ["line"]).join(whole.select("line", "key", "far"), "line")
    pairs, x, y = both.alias("x").join(both.alias("y")), linedup._side("x"), linedup._side("y")
    assert pairs.count() > 1000 and pairs.filter(linedup._near(x, y)).count() > 100
    assert pairs.filter(linedup._near(x, y) != linedup._near_measured(x, y)).count() == 0
