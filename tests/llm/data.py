"""Small documents with the cases that every operator has to bear."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    long_text = " ".join(f"w{i % 977}" for i in range(6000))
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    return [
        (1, base + " sixteen seventeen", "en", "b", 10), (2, base + " sixteen seventeen", "en", "b", 10),
        (3, "", "en", "a", 0), (4, None, None, None, None), (5, long_text, "de", "a", 5), (6, long_text + " tail", "de", "c", 5),
        (None, "null id \n null id", "fr", "a", 3), (7, "same", "en", "b", 4), (7, "same", "en", "b", 4), (7, "other text", "en", "b", 4),
        (8, "\n\n \t", "en", "é", 1), (9, "Ünïcode wörds 𝔘 end", "en", "é", 1), (-5, base, "en", "", 0),
    ]


def documents(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
