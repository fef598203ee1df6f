import hashlib

from episodic.llm import chat

ROWS = [(1, 0, "system", "be [kind]"), (1, 1, "user", "a\\b <|end|> <"), (1, 2, "assistant", "|end|> \\ <|text|>"), (1, 3, "user", "x"), (1, 4, "assistant", ""),
        (1, 5, "user", "left over"), (2, 0, "user", None), (3, 0, None, "odd"), (3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (None, 1, "assistant", "é𝔘"), (4, None, "assistant", "z" * 20000)]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_round_trip(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest(frame).collect()}
    by = {}
    for c, t, r, x in [*ROWS, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(turns), digest("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (g.loss_chars, g.loss_sha256) == (len(loss), digest(loss))


def test_examples(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").withColumn("extra", chat.F.lit(1))
    got = [r for r in chat.examples(frame).orderBy("conv_id", "example").collect() if r.conv_id == 1]
    assert len(got) == 3 and got[2].loss_start == got[2].loss_end == 0
    assert got[0].text[got[0].loss_start:got[0].loss_end] == "|end|> \\\\ <\\|text|>"
    assert got[1].text.startswith(got[0].text) and got[0].text.count("<|end|>") == 3
    assert chat.examples(frame.limit(0)).count() == 0
