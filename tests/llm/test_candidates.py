"""Of op12: what repeats for less than the width does not reach the suffix array."""

from episodic.llm import suffixes

from .test_suffixes import letters


def test_short_repeats_go_first(spark, monkeypatch):
    data = [(i, letters(i, 300) + letters(1000, 170) + letters(200 + i, 300)) for i in range(30)]
    sizes, whole = [], suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda pieces, width: sizes.append(pieces.count()) or whole(pieces, width))
    assert {r.n_removed for r in suffixes.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()} == {0}
    assert sizes == [0]
