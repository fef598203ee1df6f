"""Quality rules with risk-controlled thresholds.

Seven rules compare a statistic of the text with a cutoff. Labelled documents are split by a
hash of their id. One half proposes cutoffs: for each stratum (language) and rule the cutoff of
a fixed grid that rejects most bad documents, where a good one that is rejected weighs 20 bad
ones. The other half is the holdout: the verdict of all rules together is tested at three
levels of strictness, and a level is certified for a stratum if the exact binomial test rejects
"false rejections are ``alpha`` or more" at ``delta``, divided by all tests made (Bonferroni).
The strictest certified level is used. A stratum that certifies none of its own takes the
cutoffs proposed by all strata together, if they pass the same test on its own holdout; if not,
the method rejects nothing there. Strata whose holdout is too small to pass any test, whatever
it shows, are not tested and lose nothing. So with probability 1 - delta no stratum loses
``alpha`` of its good documents to the rules, as far as its labels are drawn like its documents.

Statistics and label counts cover whole texts and all documents; the driver gets counts for
each stratum, rule and grid step only. Null text has no words and fails the base; a null
language is a stratum like any other, and one without labels loses nothing. Repeated rows each get a
verdict. Of repeated labels one counts, and a document with labels of both kinds counts as good;
labels of ids that several rows share are not used, so no label is counted twice. Empty tables give
an empty result. ``filter_documents`` passes all columns on; ``judge`` replaces those named as a statistic.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, checkpoint, covered, packed, rolling, small_batches, unpacked

#: Fixed values of the base.
SYMBOLS = re.compile(rb"[#*$%&|<>]")
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
#: rule -> (statistic as SQL over the base columns, grid from strict to lenient); values above the cutoff are rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.2, 2.0)),
    "repeats": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3)),
    "lines": ("n_dup_lines / n_lines", (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75)),
    "capitals": ("n_capitals / word_chars", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7)),
    "long_words": ("word_chars / n_words", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0)),
    "short_words": ("-word_chars / n_words", (-4.5, -4.2, -4.0, -3.7, -3.4, -3.0, -2.5)),
    "sameness": ("1 - n_distinct / n_words", (0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8)),
}
POOLED, NULL = "\0all", "\0null"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_distinct long"
_NOT_CAPITAL = bytes(set(range(256)) - set(range(65, 91)))
_SPACE = b" \t\n\x0b\x0c\r"


def statistics(text: str | None, memo: WordHashes) -> tuple[int, ...]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip(_SPACE)]
    repeated = 0
    if len(words) > REPEAT_WINDOW:
        h = rolling(memo.of(words), REPEAT_WINDOW)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            hit = np.append(same, False) | np.append(False, same)
            repeated = int(covered(order[hit], REPEAT_WINDOW, len(words)).sum())
    chars = len(text or "") - sum(data.count(bytes([c])) for c in _SPACE)
    return (len(words), chars, len(SYMBOLS.findall(data)), len(lines) - len(set(lines)), repeated, len(lines), len(data.translate(None, _NOT_CAPITAL)), len(set(words)))


def measured(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of df and the statistics of its texts."""
    small_batches(df.sparkSession)
    source = df.select(*keep) if text in keep else df.select(*keep, F.col(text).cast("string").alias("__text"))
    at = keep.index(text) if text in keep else len(keep)
    names = [x.split()[0] for x in BASE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            rows = np.array([statistics(t.as_py(), memo) for t in batch.column(at)], np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *(pa.array(rows[:, i]) for i in range(len(names)))], [*keep, *names])

    return source.mapInArrow(run, StructType([*source.schema[:len(keep)], *(StructField(name, LongType()) for name in names)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _value(rule: str) -> Column:
    return F.coalesce(F.expr(re.sub(r"/ (\w+)", r"/ nullif(\1, 0)", RULES[rule][0])), F.lit(-1e9))


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p)."""
    if k >= n:
        return 1.0
    total, log_p, log_q = 0.0, math.log(p), math.log1p(-p)
    for i in range(k, -1, -1):
        term = math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q)
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, total)


def _rejected(cuts: dict[str, dict[str, float]], stratum: Column) -> Column:
    """True where any rule's cutoff of the stratum is exceeded; a stratum without cutoffs loses nothing."""
    out = F.lit(False)
    for rule in RULES:
        own = [(s, c[rule]) for s, c in cuts.items() if rule in c]
        if own:
            cut = F.create_map(*(F.lit(x) for p in own for x in p))[F.coalesce(stratum, F.lit(NULL))]
            out = out | F.coalesce(_value(rule) > cut.cast("double"), F.lit(False))
    return out


def choose(stats: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, weight: float = 20.0, levels: int = 3) -> dict[str, dict[str, float]]:
    """Certified cutoffs for each stratum: {stratum: {rule: cutoff}}."""
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"))
    one = stats.join(known, F.col("doc_id") == F.col("_id")).withColumn("_rows", F.count("*").over(W.partitionBy("doc_id")))
    seen = checkpoint(one.filter((F.col("_rows") == 1) & ~base_failed()).withColumn("half", half).withColumn("stratum", F.coalesce(F.col(stratum).cast("string"), F.lit(NULL))))
    hold = seen.filter("half = 1 and quality = 1")
    # A holdout that would not pass one test even without a false rejection is not tested; which these are depends on sizes only.
    able = sorted(r[0] for r in hold.groupBy("stratum").count().collect() if binomial_at_most(0, r[1], alpha) <= delta / levels)
    seen = seen.withColumn("stratum", F.when(F.col("stratum").isin(*able), F.col("stratum")) if able else F.lit(None).cast("string"))
    steps = [F.struct(F.lit(rule).alias("rule"), sum(((_value(rule) > c).cast("int") for c in grid), F.lit(0)).alias("step")) for rule, (_, grid) in RULES.items()]
    counts = seen.filter("half = 0").select("stratum", "quality", F.explode(F.array(*steps)).alias("x")).groupBy("stratum", "quality", "x.rule", "x.step").count().collect()
    tally: dict = defaultdict(Counter)
    for r in counts:
        for s in {POOLED, r.stratum} - {None}:
            tally[s, r.rule, r.quality][r.step] += r["count"]
    proposed: dict[str, dict[str, int]] = {}
    for s in [POOLED, *able]:
        chosen = {}
        for rule, (_, grid) in RULES.items():
            good, bad = tally[s, rule, 1], tally[s, rule, 0]
            gain = lambda i, good=good, bad=bad: sum(v for k, v in bad.items() if k > i) - weight * sum(v for k, v in good.items() if k > i)
            best = max(range(len(grid)), key=lambda i: (gain(i), i))  # of equal steps the most lenient
            if gain(best) > 0:
                chosen[rule] = best
        if chosen:
            proposed[s] = chosen
    cut = lambda chosen, level: {r: RULES[r][1][min(i + level, len(RULES[r][1]) - 1)] for r, i in chosen.items()}
    pooled = proposed.pop(POOLED, {})
    tests, done = levels * max(1, len(proposed) + (len(able) if pooled else 0)), {}
    own = [F.sum(_rejected({s: cut(c, level) for s, c in proposed.items()}, F.col("stratum")).cast("long")).alias(f"own{level}") for level in range(levels)]
    all_ = [F.sum(_rejected({s: cut(pooled, level) for s in able}, F.col("stratum")).cast("long")).alias(f"all{level}") for level in range(levels)]
    for r in hold.filter(F.col("stratum").isin(*able)).groupBy("stratum").agg(F.count("*").alias("n"), *own, *all_).collect() if able else []:
        for name, chosen in (("own", proposed.get(r.stratum)), ("all", pooled)):
            passed = [level for level in range(levels) if chosen and binomial_at_most(r[f"{name}{level}"], r.n, alpha) <= delta / tests]
            if passed:
                done[r.stratum] = cut(chosen, passed[0])
                break
    return done


def judge(df: DataFrame, labels: DataFrame, keep: list[str], stratum: str = "lang") -> DataFrame:
    """``keep`` columns, statistics, base_failed, kept."""
    made = {*(x.split()[0] for x in BASE.split(", ")), "base_failed", "kept"}
    keep = [c for c in keep if c not in made]
    named = keep if "doc_id" in keep else ["doc_id", *keep]
    named = named if stratum in named else [*named, stratum]
    stats = checkpoint(measured(df, named))
    cuts = choose(stats, labels, stratum)
    bad = _rejected(cuts, F.col(stratum).cast("string"))
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~(F.col("base_failed") | bad))


def filter_documents(df: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``df`` that are kept, with their columns; texts are judged twice rather than shuffled."""
    docs = packed(df, doc_id=F.col("doc_id"), stratum=F.col(stratum).cast("string"))
    stats = measured(docs, ["doc_id", "stratum"])
    cuts = choose(checkpoint(stats.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")), labels, "stratum")
    full = measured(docs, ["row", "text", "stratum"])
    return full.filter(~(base_failed() | _rejected(cuts, F.col("stratum")))).select(*unpacked(df.columns))


def digest(df: DataFrame, labels: DataFrame) -> DataFrame:
    return judge(df, labels, ["doc_id", "lang"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
