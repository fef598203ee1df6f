"""Secret scans through an incremental ledger of content-addressed blobs.

Every version of a text is addressed by the SHA-256 of its content. A pair of blob and
rule version is scanned once, ever: the ledger keeps one row for each pair, clean pairs
included, and a later run scans only pairs it does not hold. Findings are joined back
from blobs to all rows (paths) that carry the content.

Null text counts as empty. Equal texts share a blob, whatever their ids; rows with null or
repeated ids each get their blob's findings. An empty table gives an empty result. Columns of the
input are passed on; those named ``blob`` or ``found`` are replaced. A text of any length is
matched in one piece, in time that grows with its length.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, packed, text_of, unpacked


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int
    least: int  # characters the group must have; shorter matches are dropped


#: The base kinds. A maximal run of at least n characters is found by {n,} as by
#: finding all runs and dropping the short ones, so hex and access carry their length inside.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds beyond the base. None repeats a group, which Java matches by recursion, and none can start again inside its own run.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    Rule("jwt", 1, r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 0),
)
RULES = BASE_RULES + EXTRA_RULES
SPANS = "array<struct<start:bigint,end:bigint>>"
RUN = 128


def spans_of(text: Column, rule: Rule) -> Column:
    """Leftmost non-overlapping matches of a rule as (start, end) in code points.

    split() gives what lies between the matches and regexp_extract_all() the matches, so
    running lengths give their places.
    """
    between = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    matched = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    kept = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    steps = F.zip_with(F.slice(between, 1, F.size(matched)), F.zip_with(matched, kept, lambda n, k: F.struct(n.alias("n"), k.alias("k"))),
                       lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["k"].alias("k")))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x["gap"] + x["n"])
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / RUN).cast("int")), lambda b: F.struct(add(F.slice(xs, b * RUN + 1, RUN)).alias("gap"), F.lit(0).cast("long").alias("n")))

    def place(xs: Column, sums: Column, x: Column, i: Column) -> Column:
        block = (i / RUN).cast("int")
        start = add(F.slice(sums, 1, block)) + add(F.slice(xs, block * RUN + 1, i - block * RUN)) + x["gap"]
        return F.when(x["k"], F.struct(start.alias("start"), (start + x["n"]).alias("end")))

    # Sums of whole runs and sums within one keep a text of very many matches from quadratic time.
    placed = _let(steps, lambda xs: _let(blocks(xs), lambda sums: F.array_compact(F.transform(xs, lambda x, i: place(xs, sums, x, i)))))
    return F.when(text.rlike(rule.pattern), placed).otherwise(F.array().cast(SPANS))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def versions(df: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each version of a path: path, blob."""
    return df.select(F.col(path).alias("path"), F.sha2(text_of(text), 256).alias("blob"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("rule"), F.lit(0).alias("version"), F.array().cast(SPANS).alias("spans"))


def update(df: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The ledger with the rows of pairs added that it does not hold; only those are scanned."""
    return ledger.unionByName(scan(df, ledger, rules, text))


def blobs(df: DataFrame, text: str = "text") -> DataFrame:
    """One row for each distinct content: blob, text. Copies are combined before the shuffle."""
    body = df.select(F.sha2(text_of(text), 256).alias("blob"), text_of(text).alias("text"))
    return body.groupBy("blob").agg(F.first("text").alias("text"))


def scan(df: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (blob, rule, version, spans) for pairs that ``ledger`` does not hold."""
    body = blobs(df, text)
    if ledger is None:
        body = body.withColumn("done", F.array().cast("array<string>"))
    else:
        held = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
        body = body.join(held, "blob", "left").withColumn("done", F.coalesce("done", F.array().cast("array<string>")))
    pairs = [
        F.when(~F.array_contains("done", f"{r.name}:{r.version}"),
               F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r).alias("spans")))
        for r in rules
    ]
    return body.select("blob", F.explode(F.array_compact(F.array(*pairs))).alias("p")).select("blob", "p.*")


def findings(df: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``df`` with ``blob`` and ``found``: all spans of the current rule versions, by start, then rule."""
    order = {r.name: i for i, r in enumerate(rules)}
    now = F.col("rule").isin(*order) & F.concat_ws(":", "rule", "version").isin(*(f"{r.name}:{r.version}" for r in rules))
    rank = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    each = ledger.filter((F.size("spans") > 0) & now).groupBy("blob").agg(F.collect_set(F.struct("rule", "spans")).alias("by_rule"))
    each = each.select("blob", F.array_sort(F.flatten(F.transform("by_rule", lambda r: F.transform(
        r["spans"], lambda s: F.struct(s["start"].alias("start"), rank[r["rule"]].alias("rank"), s["end"].alias("end"), r["rule"].alias("rule")))))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,rule:string>>")
    each = checkpoint(each)  # a side of its own: so Spark can split a blob that very many rows share
    rows = packed(df, text, blob=F.sha2(text_of(text), 256)).join(each, "blob", "left")
    return rows.select(*unpacked(df.columns, text, blob="blob", found=F.coalesce("found", empty)))


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(df: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans."""
    found = findings(df.select("doc_id", "text"), update(df, empty_ledger(df.sparkSession)))
    base = F.filter("found", lambda s: s["rule"].isin(*(r.name for r in BASE_RULES)))
    count = lambda kind: F.size(F.filter("found", lambda s: s["rule"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), "blob")
