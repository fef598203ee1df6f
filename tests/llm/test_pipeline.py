from collections import Counter, defaultdict

from episodic.llm import decontamination, linedup, quality

from .test_linedup import brute as line_brute
from .test_linedup import linedup_tag
from .test_mixing import level
from .test_nearcopies import brute as near_brute
from .test_quality import brute as quality_brute


def test_stages_against_brute_force(spark, sf, tmp_path):
    import corpus_pipeline

    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((docs.collect(), out.collect()))
        if k < 4:
            assert out.columns == columns
        docs = out
    ids = lambda rows: sorted(r.doc_id for r in rows)
    # Quality rules: the base by brute force, and beyond it only what the certified cutoffs reject.
    before, after = kept[0]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    cuts = quality.choose(quality.measured(spark.createDataFrame(before), ["doc_id", "lang"]), labels)
    failed = {r.doc_id for r in before if quality_brute(r.doc_id, r.text)[6]}
    assert not set(ids(after)) & failed
    assert bool(set(ids(before)) - failed - set(ids(after))) <= bool(cuts)
    # Line dedup: the stage's own output, line by line.
    before, after = kept[1]
    for r in linedup.keyed(spark.createDataFrame(before)).select("text", "t", "u").collect():
        linedup_tag[r.text or ""] = (r.t, r.u)
    gone = line_brute([(r.doc_id, r.text) for r in before])
    new = {r.doc_id: r for r in after}
    assert ids(before) == ids(after)
    for r in before:
        text = "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in gone[r.doc_id, r.text])
        assert new[r.doc_id].text == text and new[r.doc_id].n_chars == len(text) and new[r.doc_id].source == r.source
    before, after = kept[2]
    assert ids(after) == near_brute([(r.doc_id, r.text) for r in before])
    # Decontamination: every document that covers an item goes, and no other.
    before, after = kept[3]
    items = [w for w in (decontamination.tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()) if w]
    dirty = {r.doc_id for r in before if any(set(w) & set(t) and decontamination.coverage(w, t) >= 0.5 for t in [decontamination.tokens(r.text)] for w in items)}
    assert set(ids(before)) - set(ids(after)) == dirty
    # Mixing: targets from the sizes, words taken meet them, no document beyond twice its size, every row is of its input.
    before, after = kept[4]
    size = {r.doc_id: len(r.text.split()) for r in before}
    per, taken = Counter(), defaultdict(int)
    for r in before:
        per[r.source] += size[r.doc_id]
    want = level(per)
    for r in after:
        assert r["size"] == size[r.doc_id] and 0 < r.taken <= 2 * r["size"] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - t) <= 0.5 + 1e-6 for s, t in want.items()) and len(ids(after)) == len(set(ids(after)))


def test_run(spark, sf):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf).count() > 50


def test_mix_of_repeated_rows(spark, sf):
    import corpus_pipeline

    rows = [(1, "ten words " * 5, "en", source, 50) for source in ["a"] * 30 + [None] * 10]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mix(spark, docs, sf).collect()
    for source in ("a", None):
        mine = [r for r in got if r.source == source]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and all(0 < r.taken <= 20 for r in mine)
