import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from episodic.llm import quality

from .data import documents, empty

EXTRA = [(60, "a b c d e f g h i " * 3, "en", "s", 1), (61, "#$% <x> | & *\nsame line\nsame line\n \n \nsame line", "en", "s", 1), (62, "x " * 25, "en", "s", 1), (63, "é b c 𝔘", "en", "s", 1)]


def brute(doc, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + 8))
    return doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(words) < 20 or 100 * len(hit) > 30 * len(words)


def test_base(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for docs in (documents(spark, EXTRA), spark.read.parquet(f"{sf}/documents.parquet")):
        got = quality.digest(docs, labels).collect()
        assert sorted((tuple(r)[:7] for r in got), key=repr) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert not any(r.kept and r.base_failed for r in got)
    assert quality.digest(empty(spark), labels.limit(0)).count() == 0


def test_bound():
    assert abs(quality.binomial_at_most(0, 100, 0.02) - 0.98**100) < 1e-12
    assert quality.binomial_at_most(5, 5, 0.5) == 1.0
    assert abs(quality.binomial_at_most(2, 4, 0.5) - 11 / 16) < 1e-12


def corpus(spark, good, bad):
    good_text, junk = "plain words that differ from each other in many small ways today {} and tomorrow we walk along a river bank near old trees", "THIS!! {} IS# $$$ %%% ***"
    rows = [(i, good_text.format(i), "en" if i % 2 else None, "s", 1) for i in range(good)] + [(10_000 + i, junk.format(i) + " JUNK## $$ %%" * 5, "en", "s", 1) for i in range(bad)]
    labels = [(r[0], int(r[0] < 10_000), 0) for r in rows] + [(None, 1, 0), (3, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_certified_cutoffs_reject_junk_only(spark):
    docs, labels = corpus(spark, 1600, 100)
    got = quality.digest(docs, labels).collect()
    assert all(r.kept for r in got if r.doc_id < 10_000) and not any(r.kept for r in got if r.doc_id >= 10_000)
    kept = quality.filter_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 1600


def test_too_few_labels_reject_nothing(spark):
    docs, labels = corpus(spark, 60, 10)
    assert all(r.kept or r.base_failed for r in quality.digest(docs, labels).collect())


def test_small_language_keeps_its_good_documents(spark):
    docs, labels = corpus(spark, 3200, 0)
    letters = "abcdefghijklmnopqrstuvwxyz"
    junk = [(10_000 + i, " ".join(f"JUNK{w}##" for w in letters) + f" {i}", "en", "s", 1) for i in range(300)]
    capitals = " ".join(f"DONAUDAMPFSCHIFF{w.upper()}" for w in letters)
    more = [(20_000 + i, f"{capitals} {i}", "xx", "s", 1) for i in range(12)] + [(30_000 + i, f"{capitals} {i}", "yy", "s", 1) for i in range(5)]
    docs = docs.union(spark.createDataFrame(junk + more, docs.schema))
    labels = labels.union(spark.createDataFrame([(r[0], int(r[2] == "xx"), 0) for r in junk + more if r[2] != "yy"], labels.schema))
    kept = {r.doc_id for r in quality.filter_documents(docs, labels).select("doc_id").collect()}
    assert {r[0] for r in more} <= kept and not any(10_000 <= i < 20_000 for i in kept)


def test_more_than_200_languages_are_tested(spark):
    stats = spark.range(202 * 1300).selectExpr("id doc_id", "concat('l', id % 202) lang", "100L n_words", "500L word_chars", "if(id < 202 * 100, 300L, 0L) n_symbols",
                                               "0L n_dup_lines", "0L n_repeat_words", "1L n_lines", "2L n_capitals", "90L n_distinct")
    labels = stats.selectExpr("doc_id", "int(n_symbols = 0) quality", "0 toxic")
    assert len(quality.choose(stats, labels)) == 202


def test_repeated_labels_count_once(spark):
    docs, labels = corpus(spark, 60, 10)
    many = labels
    for _ in range(5):
        many = many.union(labels)
    assert all(r.kept or r.base_failed for r in quality.digest(docs, many).collect())  # 360 label rows, but 60 documents: too few to certify anything
    stats = quality.measured(docs, ["doc_id", "lang"])
    assert quality.choose(stats, many) == quality.choose(stats, labels) == {}


def test_guarantee_by_simulation(spark):
    """40 strata with known distributions: the true share of good documents lost stays below alpha in all of them."""
    rng, rows, rates = random.Random(12), [], {}
    for s in range(40):
        rates[f"l{s}"] = mean = rng.choice((0.01, 0.02, 0.04, 0.06))
        for _ in range(1400):
            good = rng.random() < 0.8
            rows.append((len(rows), f"l{s}", 100, 500, int(100 * rng.expovariate(1 / (mean if good else 10 * mean))), 0, 0, 1, 2, 90, int(good)))
    frame = spark.createDataFrame(rows, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_distinct long, quality int")
    cuts = quality.choose(frame.drop("quality"), frame.select("doc_id", "quality", F.lit(0).alias("toxic")))
    lost = {s: math.exp(-math.ceil(100 * c["symbols"] + 1e-9) / 100 / rates[s]) for s, c in cuts.items() if "symbols" in c}
    assert len(lost) > 10 and max(lost.values()) < 0.02
