import re
import textwrap

from episodic.llm import licenses

from .data import SCHEMA, documents, empty

EXTRA = [
    (80, "Released UNDER the MIT license. cc-by-nc, cc by nc; CC BY NC", "en", "s", 1), (81, "underthe mit license apache license version 20", "en", "s", 1),
    (82, "x\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in it without restriction\ny", "en", "s", 1),
    (83, "Permission is hereby granted, free of charge\nto any person obtaining a copy of this software and associated documentation files", "en", "s", 1),
    (84, "Apache License, Version 2.0 é apache license version 2", "en", "s", 1),
]


def brute(doc, text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words = re.findall(word, low)
    hits = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    held, block = {}, []
    for line in [*low.split("\n"), ""]:
        if have := re.findall(word, line):
            block += have
            continue
        for label, said, needs, bars in licenses.TEMPLATES:
            mine = licenses.word_list(said)
            ws, pairs, size = set(mine), set(zip(mine, mine[1:], strict=False)), len(mine) + max(4, len(mine) // 2)
            if len(ws & set(block)) / len(ws) < 0.8 - 1e-12:
                continue
            for i in (i for i, x in enumerate(zip(block, block[1:], strict=False)) if x in pairs):
                start = max(0, i - len(mine) // 2 - 1)
                window, wide = block[i:i + size], block[start:i + size]
                found = [j for j, x in enumerate(zip(window, window[1:], strict=False)) if x in pairs]
                spread = [start + j for j, x in enumerate(zip(wide, wide[1:], strict=False)) if x in pairs]
                passage = block[max(0, start - 3, spread[0] - 3):spread[-1] + 2]
                nots = [sum(w in licenses.NEGATIONS for w in x) for x in (passage, mine)]
                share = len(ws & set(wide)) / len(ws)
                if share >= 0.8 - 1e-12 and len(pairs & {(window[j], window[j + 1]) for j in found}) * 2 >= len(pairs) and set(needs.split()) <= set(wide) and not set(bars.split()) & set(wide) and nots[0] <= nots[1]:
                    held[label] = max(share, held.get(label, 0))
        block = []
    base = sorted({x for _, x in hits})
    return (doc, len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(base), ",".join(sorted(set(base) | set(held))), 1.0 if hits else max(held.values(), default=0.0))


def test_against_plain_search(spark, sf):
    for docs in (documents(spark, EXTRA), spark.read.parquet(f"{sf}/documents.parquet")):
        got = sorted((tuple(r) for r in licenses.digest(docs).collect()), key=repr)
        assert got == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)
    got = {r.doc_id: r for r in licenses.digest(documents(spark, EXTRA)).collect()}
    assert got[82].labels == "mit" and got[82].n_base == 0 and got[83].labels == "" and got[80].base_labels == "cc-by-nc,mit"
    assert licenses.digest(empty(spark)).count() == 0


def test_wrapped_notices(spark):
    rows = []
    for i, (label, text, _, _) in enumerate(licenses.TEMPLATES):
        for k, (mark, width) in enumerate((("", 72), (" * ", 60), ("# ", 40), ("// ", 20))):
            body = "\n".join(mark + x for x in textwrap.wrap(text, width))
            rows.append((100 * i + k, f"def before\n\n{body}\r\n{mark}\r\n{mark}other words", label, "s", 1))
        half = " ".join(text.split()[: len(text.split()) // 2])
        rows.append((100 * i + 50, half + "\n\n" + text[len(half):], "", "s", 1))
    got = {r.doc_id: r.labels.split(",") for r in licenses.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    for r in rows:
        assert r[2] in got[r[0]] if r[2] else not {"isc", "bsl-1", "lgpl", "mpl-2"} & set(got[r[0]]), (r, got[r[0]])


def test_licenses_that_differ_by_one_word(spark):
    text = "This work is licensed under the {} {} International License."
    cc = {"cc-by": "Creative Commons Attribution 4.0", "cc-by-nc": "Creative Commons Attribution-NonCommercial 4.0", "cc-by-sa": "Creative Commons Attribution-ShareAlike 4.0", "cc-by-nc-nd": "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"}
    rows = [(i, text.format(name, ""), label, "s", 1) for i, (label, name) in enumerate(cc.items())]
    rows += [(50, licenses.TEMPLATES[[t[0] for t in licenses.TEMPLATES].index("agpl-3")][1], "agpl-3", "s", 1), (51, "M\u0130T license, under the M\u0130T license", "", "s", 1)]
    got = {r.doc_id: r.labels for r in licenses.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: r[2] for r in rows}


def test_own_templates_and_clashing_names(spark):
    docs = documents(spark, [(90, "all rights belong to the harbour office", "en", "s", 1)]).selectExpr("*", "1 as held", "2 as places", "3 as token", "4 as words", "5 as n_words", "6 as `row`")
    got = licenses.scan(docs, (("harbour", "rights of the harbour office", "harbour", ""),))
    assert got.columns == docs.columns
    assert [(h.label, h.containment) for r in got.filter("doc_id = 90").collect() for h in r.held] == [("harbour", 0.8)]
    assert {(r.token, r.words, r.row) for r in got.collect()} == {(3, 4, 6)}
    assert got.count() == docs.count()


FALSE = [
    "The general public may view this old work. Version 3 of the gnu statue is under repair; nobody is licensed to enter, no license needed.",
    "This work is not licensed under the GNU General Public License, version 3", "This work was never licensed under the GNU General Public License, version 2, they say",
    "This work isn't licensed under the Creative Commons Attribution 4.0 International License", "This software is not released under the terms of the MIT license",
    "Nothing here is free and no one has unencumbered it: this software is released when the public asks, into no domain of ours and of the state",
]


def test_prose_and_negation(spark):
    """Words of a notice spread over prose, and notices that are denied, have no label; the longer the paragraph, no surer."""
    filler = " ".join(f"filler{i} the work of version 3 public" for i in range(400))
    rows = [(i, f"{a}{text}{b}", "", "s", 1) for i, (text, a, b) in enumerate((t, a, b) for t in FALSE for a, b in (("", ""), (filler + " ", ""), ("", " " + filler)))]
    rows += [(100, filler + " This work is licensed under the GNU General Public License, version 3. It is not for sale. " + filler, "gpl-3", "s", 1),
             (101, "It is not old. It was drawn in June by hand. This work is licensed under the GNU General Public License, version 3", "gpl-3", "s", 1)]
    got = {r.doc_id: r.labels for r in licenses.digest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {r[0]: r[2] for r in rows}
