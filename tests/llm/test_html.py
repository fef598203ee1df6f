import random
import time

import numpy as np

from episodic.llm import html

from .layouts import pages

FRAME = ('<html><head><title>t &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li><li><a href="/y">other</a></li></ul></nav>'
         '<!-- <p>no</p> --><div class="ad">buy now</div><article><h1>Head&eacute; line</h1>{}</article><footer>&copy; somebody</footer></body></html>')


def test_blocks():
    found = html.blocks('<p>one <b>two</b>\n three<br>four &lt;x&gt;<p class="A b">five<a href="q>r">six</a></p>tail<script>no</script> end<')
    assert [t for _, t, _ in found] == ["one two three", "four <x>", "fivesix", "tail end<"]
    assert found[2][0].tokens()[-3:] == ["p", ".a", ".b"] and found[2][2] == 3
    assert html.blocks(None) == [] and html.blocks("<<<>") and html.blocks("<!-- open") == []
    assert len(html.blocks("<p>x</p>" * 30000)) == 30000


def test_broken_markup_takes_linear_time():
    n = 300_000
    for text in ("<a " * n, "<a '" * n, '<a "' * n + ">", "<p " * n + "<b>", "<div>" * n + "</b>" * n, "<b>" * n + "<p>x" * n, "<!-- " * n, "<script>" * n, "</script" * n, "<a b='x>" * n, "&" * n, "<" * n):
        began = time.time()
        html.blocks(text)
        assert time.time() - began < 20, text[:10]


def test_held_out_accuracy():
    pages, ys = html.labelled(300, seed=77, plain=False)
    got = html.trained().predict(pages)
    assert np.mean(np.concatenate(got) == np.concatenate(ys).astype(bool)) > 0.98
    assert all((a == b).all() for a, b in zip(got, html.trained().predict(pages, cells=7), strict=True))


def test_gradients():
    rng, model = np.random.default_rng(0), html.Model(1)
    x, mask = html._padded([rng.standard_normal((k, html.INPUT)).astype(np.float32) for k in (3, 5)])
    y = (rng.random(mask.shape) > 0.5).astype(np.float32)
    _, g = model.gradients(x, mask, y)
    for name, at in (("Uf", (1, 5)), ("Wb", (7, 30)), ("bf", (40,)), ("v", (3,))):
        old = model.p[name][at]
        sides = []
        for step in (1e-2, -1e-2):
            model.p[name][at] = old + step
            sides.append(model.gradients(x, mask, y)[0])
        model.p[name][at] = old
        assert abs((sides[0] - sides[1]) / 2e-2 - g[name][at]) < 2e-3


def test_pages(spark):
    page = FRAME.format("<p><b>Short.<br><p>A longer  paragraph\n of text, with several words in it.</p><p>Last one.</p>")
    frame = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (1, "u", page)], "page_id long, url string, html string")
    got = html.digest(frame).collect()
    want = "Headé line\nShort.\nA longer paragraph of text, with several words in it.\nLast one."
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, want, len(want)), (1, want, len(want)), (0, want, len(want)), (2, "", 0), (3, "", 0)])
    assert html.digest(frame.limit(0)).count() == 0


def test_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html.digest(rows).collect()}
    for r in rows.collect():
        assert got[r.page_id] == "\n".join(t for path, t, _ in html.blocks(r.html) if "article" in path.tokens())


def test_layouts_vary():
    rng = random.Random(1)
    assert len({html.page(rng)[0][:60] for _ in range(50)}) > 20


def test_held_out_layouts(spark):
    """Pages without <article>, read as a whole."""
    rng, rows = random.Random(99), []
    while len(rows) < 80:
        text, main = html.page(rng)
        if "<article" not in text:
            rows.append((len(rows), text, main))
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame([r[:2] for r in rows], "page_id long, html string")).collect()}
    right = sum(len(set(got[i]) & main) for i, _, main in rows)
    assert right > 0.97 * sum(len(main) for _, _, main in rows) and right > 0.97 * sum(len({t for t in x if t}) for x in got.values())  # lines may be repeated


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "<p>x</p>", "old", 7)], "page_id long, html string, text string, row int")
    got = html.extract(frame)
    assert got.columns == ["page_id", "text", "row"] and got.first().row == 7 and got.first().text != "old"


def test_hand_written_layouts(spark):
    """Layouts and names that the training pages do not have: precision and recall of blocks, and nothing lost whole."""
    made = pages()
    got = html.extract(spark.createDataFrame([(i, h) for i, (h, _) in enumerate(made)], "page_id long, html string")).collect()
    kept = {r.page_id: [t for t in r.text.split("\n") if t] for r in got}
    right = {i: len(set(kept[i]) & set(want)) for i, (_, want) in enumerate(made)}
    found, wanted = sum(map(len, kept.values())), sum(len(want) for _, want in made)
    assert len(made) >= 30 and sum(right.values()) >= 0.9 * wanted and sum(right.values()) >= 0.9 * found, (sum(right.values()), wanted, found)
    assert all(right[i] >= 4 for i in right), [(i, kept[i]) for i in right if right[i] < 4]


def test_deep_paths():
    """A path of any depth is read whole, in time that grows with the page."""
    began = time.time()
    found = html.blocks("<div class=menu>" + "<div>" * 100_000 + "<p>deep")
    assert found[0][0].plus | found[0][0].minus == html.blocks("<div class=menu><div><p>x")[0][0].plus | html.blocks("<div class=menu><div><p>x")[0][0].minus and time.time() - began < 10


def test_work_per_block(monkeypatch):
    """Inputs are worked out for blocks, not for the padding between pages of other lengths; closing the innermost element looks at no other."""
    model, seen, whole = html.Model(3), [], html.Model._inputs
    monkeypatch.setattr(html.Model, "_inputs", lambda self, x, d: seen.append(x.size // html.INPUT) or whole(self, x, d))
    pages = [html.blocks("<p>one two.</p>" * n) for n in (1, 7, 40)]
    assert [len(k) for k in model.predict(pages)] == [1, 7, 40]
    assert seen == [48, 48]
    monkeypatch.setattr(html.Counter, "subtract", None)
    assert len(html.blocks("<div><p>a<b>b</b></p><p title='>'>c</p></div>")) == 2
