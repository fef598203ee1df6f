"""Line dedup by an exact set-similarity join.

A line is a set of words (as they stand, split at white space). It is removed if an earlier
line anywhere has a Jaccard similarity of 4/5 or more with it; earlier is by doc_id (null
last), then place in the text, and an earlier line counts even if it is removed itself. Lines
without words always stay. The rest of the text is joined as before.

1. Words are ordered by rarity: the words of all texts are counted by hash in ``COUNTERS``
   counters (131 072; a rare word is only ever taken for a more frequent one). Words of one
   level stand by their hash, so the order is total.
2. Equal lines form a class; only the first line of a class takes part below, later ones go.
3. Prefix filter: of n words, the first n - ceil(4n/5) + 1 in the order are posted. Similar lines
   share their first common word, and both post it. Length filter: 4/5 <= n/m <= 5/4. Positional
   filter: the shared word and what follows it must suffice for the overlap. Parity maps of the
   words (64 bits, 128 for lines of more than ``WIDE`` words) bound the symmetric difference from below. Postings that
   no length and place of the same word can pass with go first, in one pass over the word's postings; a semi-join
   keeps those that pass with any partner.
4. Each line that is left is compared, word by word, with the earlier partner whose parity map is
   nearest, of the first and the last ``NEAR`` in each posting. Lines that this does not settle are compared
   with every earlier partner they have, so the choice of step 4 decides only how much is left.

So a group of thousands of similar lines gives one pair for each of its lines; all pairs are made
only for lines that pass all filters and are not similar to their nearest partner. Each line's
text is sent once for each pair, whatever the number of words it shares, so lines of any length
pass. Postings tell words apart by hashes (a chance match costs a comparison), comparisons by the
words themselves. Null text has no lines. Rows that repeat doc_id and text are one document, and
each keeps the same lines. An empty table gives an empty result. Columns of the input are passed
on; those named as an output (n_lines, removed) are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import SPACES, checkpoint, key_columns, keyed, setting, shuffle_partitions, stored, text_of, unpacked

COUNTERS = 1 << 17
WIDE = 88  # lines of more words have a second parity map
NEAR = 4
LISTS = 1 << 14  # lists of lines that a task gathers before it sorts them
AT_BITS, SHORT = 20, 0xFFFF
WORD = r"[^ \t-\r]"


def _hashed(word: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(word), 8)


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x, by.cast("int"))


def _odd(line: Column) -> Column:
    """Whether a line has white space other than plain spaces."""
    return reduce(or_, (F.contains(line, F.lit(c)) for c in "\t\v\f\r"))


def _parts(line: Column, odd: bool = True) -> Column:
    """A line split at white space, by plain spaces where it has no other, which is faster; some parts may be empty.
    odd: whether any line has other white space."""
    plain = F.split(line, " ")
    return F.when(_odd(line), F.split(line, SPACES)).otherwise(plain) if odd else plain


def line_words(line: Column) -> Column:
    """``words_of`` a line."""
    return F.array_remove(_parts(line), "")


def rarity(texts: DataFrame, odd: bool = True) -> list[int]:
    """Levels 0..126 of all counters; they grow with the number of words counted there."""
    half = COUNTERS // 2
    lines = texts.select(F.explode(F.split(text_of(), "\n")).alias("said"))
    words = lines.select(F.explode(_parts(F.col("said"), odd)).alias("w")).filter("w <> ''").select(_hashed(F.col("w")).alias("h"))
    # Two counters a row: half as many groups fit Spark's faster hash table.
    upper = F.shiftright(F.col("h").bitwiseAND(half), half.bit_length() - 1)
    counts = words.groupBy(F.col("h").bitwiseAND(half - 1).cast("int").alias("k")).agg(F.count("*").alias("all"), F.sum(upper).alias("upper"))
    level = lambda count: F.least(F.lit(126), F.floor(3 * F.log2(1 + count))).cast("int")
    levels = [0] * COUNTERS
    for k, low, high in counts.select("k", level(F.col("all") - F.col("upper")), level(F.col("upper"))).collect():
        levels[k], levels[k + half] = low, high
    return levels


def word_hashes(line: Column, odd: bool = True) -> Column:
    """The distinct words of a line as numbers; its empty parts go."""
    return F.array_except(F.transform(_parts(line, odd), _hashed), F.array(_hashed(F.lit(""))))


def ordered_words(hashes: Column, levels: list[int]) -> Column:
    """``word_hashes`` as numbers that sort from rare to frequent."""
    table = _literal(levels)
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(F.get(table, h.bitwiseAND(COUNTERS - 1).cast("int")), 56).bitwiseOR(h)))


def _literal(numbers: list[int]) -> Column:
    """An array that is folded to a literal."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _parity(words: Column) -> Column:
    """64 parities of the words."""
    one = F.lit(1).cast("long")
    return _xor(words, lambda w: _shifted(one, w.bitwiseAND(63)))


def _upper_parity(words: Column) -> Column:
    """Those of the words in the upper half alone."""
    bits = _literal([0] * 64 + [1 << i for i in range(63)] + [-1 << 63])
    return _xor(words, lambda w: F.get(bits, w.bitwiseAND(127).cast("int")))


def _xor(words: Column, bit: Callable) -> Column:
    return F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(bit(w))), F.lit(0).cast("long"))


def _postings(lines: DataFrame, ids: list[str]) -> DataFrame:
    """One row for each word of each line's (n, words) prefix: token, key (token, words, place), b0, ids, b1, far (words, place of very long lines)."""
    words = F.col("words")
    lines = lines.withColumns({"b0": _parity(words), "b1": F.when(F.col("n") > WIDE, _upper_parity(words)).otherwise(F.lit(0).cast("long"))})
    prefix = F.slice("words", 1, F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1)
    rows = lines.select(*ids, "n", "b0", "b1", F.posexplode_outer(prefix).alias("place", "w"))
    n, place = (F.col(c).cast("long") for c in ("n", "place"))
    token = F.shiftleft(F.shiftright("w", 18), 32)
    # Few columns, what changes from row to row side by side: less to shuffle.
    return rows.select(F.shiftright(token, 32).alias("token"), _key(F.shiftright(token, 32), n, place).alias("key"), "b0", *ids, "b1", _far(n, place).alias("far"))


def _key(token: Column, n: Column, place: Column) -> Column:
    return F.shiftleft(token, 32).bitwiseOR(F.shiftleft(F.least(n, F.lit(SHORT)), 16)).bitwiseOR(F.least(place, F.lit(SHORT)))


def _far(n: Column, place: Column) -> Column:
    return F.when(n >= SHORT, F.shiftleft(n, 32).bitwiseOR(place))


def _n(p: Callable) -> Column:
    return F.coalesce(F.shiftright(p("far"), 32), F.shiftright(p("key"), 16).bitwiseAND(SHORT))


def _place(p: Callable) -> Column:
    return F.coalesce(p("far").bitwiseAND(0xFFFFFFFF), p("key").bitwiseAND(SHORT))


def _apart(x: Callable, y: Callable, wide: Callable = lambda p: _n(p) > WIDE) -> Column:
    """Words that are in only one of two lines, at least."""
    b0, b1 = (x(b).bitwiseXOR(y(b)) for b in ("b0", "b1"))
    return F.when(wide(x) & wide(y), F.bit_count(b0.bitwiseXOR(b1)) + F.bit_count(b1)).otherwise(F.bit_count(b0))


def _reach(p: Callable) -> Column:
    """Four times the most words that a partner may have: length and positional filters of both sides hold if and only if
    each line has no more words than the other reaches."""
    return _n(p) * 5 - _place(p) * 9


def _meets(posted: DataFrame) -> DataFrame:
    """Postings whose token has another posting and, in some posting each, few enough words and reach enough."""
    token = W.partitionBy("token")
    met = posted.withColumns({"of": F.count("*").over(token), "shortest": F.min("n4").over(token), "furthest": F.max("reach").over(token)})
    return met.filter((F.col("of") > 1) & (F.col("shortest") <= F.col("reach")) & (F.col("n4") <= F.col("furthest"))).drop("of", "shortest", "furthest")


def _measured(posted: DataFrame, ids: list[str]) -> DataFrame:
    """Postings with n4, four times their words, and reach in place of key and far; never null, else Spark would filter nulls
    on one side of the join alone."""
    zero = F.lit(0).cast("long")
    return posted.select("token", F.coalesce(_n(F.col) * 4, zero).alias("n4"), F.coalesce(_reach(F.col), zero).alias("reach"), "b0", *ids, "b1")


def _packed(measured: DataFrame) -> DataFrame:
    """Adds key and far to ``_measured`` postings."""
    n = F.shiftright("n4", 2)
    place = F.expr("((n4 >> 2) * 5 - reach) div 9")
    return measured.withColumns({"key": _key(F.col("token"), n, place), "far": _far(n, place)})


def _near_measured(x: Callable, y: Callable) -> Column:
    """``_near`` for ``_measured`` postings: most pairs fail at the first comparisons, which need no arithmetic."""
    return (y("n4") <= x("reach")) & (x("n4") <= y("reach")) & (_apart(x, y, lambda p: p("n4") > 4 * WIDE) * 36 <= x("n4") + y("n4"))


def _near(x: Callable, y: Callable) -> Column:
    """Whether postings of one token may belong to similar lines."""
    n, m = _n(x), _n(y)
    return ((n * 5 >= m * 4) & (m * 5 >= n * 4) & (_apart(x, y) * 9 <= n + m)
            & (F.least(n - _place(x), m - _place(y)) * 9 >= (n + m) * 4))


def _side(name: str) -> Callable:
    return lambda c: F.col(f"{name}.{c}")


def _before(a: list[Column], b: list[Column]) -> Column:
    out = a[-1] < b[-1]
    for x, y in reversed(list(zip(a[:-1], b[:-1], strict=True))):
        out = (x < y) | ((x == y) & out)
    return out


def _same_token(x: Callable, y: Callable) -> Column:
    return F.shiftright(x("key"), 32) == F.shiftright(y("key"), 32)


def remove_similar_lines(df: DataFrame) -> DataFrame:
    """The columns of ``df``, text without the lines removed, and n_lines, removed (places of removed lines, from 0)."""
    with setting(df.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(LISTS)):
        return _remove_similar_lines(df)


def _remove_similar_lines(df: DataFrame) -> DataFrame:
    n = shuffle_partitions(df.sparkSession)
    keys = key_columns(df)
    docs = keyed(df).select("row", "text", *keys)
    texts = docs.repartition(n, *keys)
    split = F.split(text_of(), "\n", -1)
    lines = docs.select(*keys, F.posexplode(split).alias("at", "said")).filter(F.col("said").rlike(WORD))
    lines = lines.withColumn("at", F.col("at").cast("long")).groupBy(F.xxhash64("said").alias("c1"), F.xxhash64("said", F.lit(1)).alias("c2"))
    # A line is named by one number where ids and places are small enough, else by its keys and place.
    odd = F.max(_odd(F.col("said"))).alias("odd")
    numbered = F.shiftleft("d", AT_BITS).bitwiseOR(F.col("at")).alias("line")
    low, high = docs.agg(F.min("d"), F.max("d")).first()
    one = keys == ["d"] and low is not None and low >= 0 and high < 1 << (62 - AT_BITS)
    if one:  # the least of numbers is found without a sort, the least of structs is not
        first = checkpoint(lines.agg(F.min(numbered).alias("line"), F.max("at").alias("most"), odd))
        one = (first.agg(F.max("most")).first()[0] or 0) < 1 << AT_BITS
    if not one:
        first = checkpoint(lines.agg(F.min(F.struct(*keys, "at")).alias("p"), odd).select("p.*", "odd"))
    odd = bool(first.agg(F.max("odd")).first()[0])
    levels = rarity(docs, odd)
    ids = ["line"] if one else [*keys, "at"]
    named = lambda at: [F.shiftleft("d", AT_BITS).bitwiseOR(at).alias("line")] if one else [*map(F.col, keys), at.alias("at")]

    def located(frame: DataFrame) -> DataFrame:
        """Adds keys and at for the line named by ``ids``."""
        return frame.withColumns({"d": F.shiftright("line", AT_BITS), "at": F.col("line").bitwiseAND((1 << AT_BITS) - 1)}) if one else frame

    first = located(first).select(*keys, "at")

    def by_text(frame: DataFrame, *more: str) -> DataFrame:
        """Rows with keys and at gathered for each document: keys, list."""
        return frame.groupBy(*keys).agg(F.collect_list(F.struct("at", *more)).alias("list"))

    def said(lists: DataFrame) -> DataFrame:
        """The rows of the lists again, with ids and ``said``, the text of the line ``at``."""
        # Zero, but it reads every column: so all uses of the texts want the same columns and Spark shuffles them once.
        zero = F.pmod(F.xxhash64("row"), F.lit(1)).cast("int")
        # A generator keeps the split of the text apart, so it is made once and not for each line.
        whole = texts.join(lists.hint("shuffle_hash"), keys).select(*keys, "list", zero.alias("zero"), F.explode_outer(F.array(split)).alias("parts"))
        each = F.transform("list", lambda x: F.struct(x.alias("x"), F.get("parts", x["at"].cast("int") + F.col("zero")).alias("said")))
        rows = whole.select(*keys, F.explode_outer(each).alias("y")).select(*keys, "y.x.*", "y.said")
        return rows.select("*", *(named(F.col("at")) if one else []))

    x, y = _side("x"), _side("y")
    # The hashes are used twice, so they are made (and freed of repeats) by compiled code, not within the function that looks up levels.
    worded = said(by_text(first)).select(*ids, word_hashes(F.col("said"), odd).alias("hashes"))
    posted = _postings(worded.select(*ids, F.size("hashes").alias("n"), ordered_words(F.col("hashes"), levels).alias("words")), ids)
    # Dealt by hand, without nulls: so both sides of the join read one shuffle, though only one of them has windows.
    posted = posted.filter(reduce(and_, (F.col(c).isNotNull() for c in ["token", *(ids if one else [])]))).repartition(n, "token")
    posted = _measured(posted, ids)
    maybe = _meets(posted).alias("x").join(posted.alias("y"), (x("token") == y("token")) & _near_measured(x, y) & reduce(or_, (x(c) != y(c) for c in ids)), "left_semi")
    maybe = _packed(maybe)
    # The nearest of the last partners before each posting and of the first one.
    post = ["key", "b0", "b1", "far"]
    order, line = W.partitionBy("token").orderBy(*ids), F.struct(*post, *ids)
    past = F.concat(F.collect_list(line).over(order.rowsBetween(-NEAR, -1)), F.array(F.first(line).over(order)))
    maybe = maybe.withColumn("past", F.filter(past, lambda p: reduce(or_, (p[c] != F.col(c) for c in ids))))
    near = F.transform(F.filter("past", lambda p: _near(F.col, lambda c: p[c])), lambda p: F.struct(_apart(F.col, lambda c: p[c]).alias("apart"), *(p[c].alias(f"y_{c}") for c in ids)))
    maybe = located(maybe.select(*post, *ids, F.array_min(near).alias("best"))).repartition(n, *keys)
    maybe = maybe.groupBy(*keys, "at").agg(F.collect_list(F.struct(*post)).alias("posts"), F.min("best").alias("best"))
    # A finer parity map of other hash bits, for step 4.
    lines = said(by_text(maybe, "posts", "best")).withColumn("words", F.array_distinct(F.transform(line_words(F.col("said")), lambda w: F.xxhash64(w, F.lit(1)))))
    lines = stored(lines.select(*ids, "said", "posts", "best", _parity(F.col("words")).alias("f0"), _upper_parity(F.col("words")).alias("f1")))

    def similar(pairs: DataFrame) -> DataFrame:
        """The ids of pairs (ids, said, y_ids) whose lines are similar."""
        other = lines.select(*(F.col(c).alias(f"z_{c}") for c in ids), F.col("said").alias("other"))
        both = pairs.join(other, reduce(and_, (F.col(f"y_{c}") == F.col(f"z_{c}") for c in ids)))
        sets = F.struct(F.array_distinct(line_words(F.col("said"))).alias("a"), F.array_distinct(line_words(F.col("other"))).alias("b"))
        sets = both.select(*ids, F.explode_outer(F.array(sets)).alias("s"))
        return sets.filter(F.size(F.array_intersect("s.a", "s.b")) * 9 >= (F.size("s.a") + F.size("s.b")) * 4).select(*ids)

    y_ids = [f"y_{c}" for c in ids]
    nearest = lines.filter("best is not null").select(*ids, "said", *(f"best.{c}" for c in y_ids))
    settled = checkpoint(similar(nearest))
    # Partners of what is still open are held against the finer parity map before they make a pair.
    spread = lambda rows: rows.select(*ids, "f0", "f1", F.explode("posts").alias("p")).select(*ids, "f0", "f1", "p.*")
    posts, open_ = spread(lines), spread(lines.join(settled, ids, "left_anti"))
    f0, f1 = (x(f).bitwiseXOR(y(f)) for f in ("f0", "f1"))
    finer = (F.bit_count(f0.bitwiseXOR(f1)) + F.bit_count(f1)) * 9 <= _n(x) + _n(y)
    rest = open_.alias("x").join(posts.alias("y"), _same_token(x, y) & _before([y(c) for c in ids], [x(c) for c in ids]) & _near(x, y) & finer)
    rest = rest.select(*(x(c) for c in ids), *(y(c).alias(f"y_{c}") for c in ids)).distinct().join(nearest.select(*ids, *y_ids), [*ids, *y_ids], "left_anti")
    gone = settled.union(similar(rest.join(lines.select(*ids, "said"), ids)).distinct())
    gone = located(gone).select(*keys, "at")
    stay = by_text(first.join(gone, [*keys, "at"], "left_anti"))
    stay = stay.select(*keys, F.transform("list", lambda p: p["at"].cast("int")).alias("stay"))
    none = F.array().cast("array<int>")
    whole = texts.join(stay.hint("shuffle_hash"), keys, "left").select("row", "text", F.coalesce("stay", none).alias("stay"), F.explode_outer(F.array(split)).alias("parts"))
    places = F.sequence(F.lit(0), F.size("parts") - 1)
    # What stays has words, so only the other lines are looked at.
    whole = whole.withColumn("removed", F.filter(F.array_except(places, "stay"), lambda i: F.get("parts", i).rlike(WORD)))
    left = F.array_join(F.transform(F.array_except(places, "removed"), lambda i: F.get("parts", i)), "\n")
    return whole.select(*unpacked(df.columns, text=F.when(F.size("removed") > 0, left).otherwise(F.col("text")), n_lines=F.size("stay") + F.size("removed"), removed="removed"))


def digest(df: DataFrame) -> DataFrame:
    out = remove_similar_lines(df.select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed", F.sha2(text_of(), 256).alias("kept_sha256"))
