"""Ranked lexical search by three-phase uniform thresholds (TPUT) over term-partitioned postings.

Terms are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A posting of a term
holds a document and its score there; lists are sorted by falling score and dealt over the
partitions by ranges of (term, score), so that the list of a common term spans many of them.

1. The first ``heads`` entries of every list (``k`` at least) are fetched, and the documents in them are scored exactly. An
   item's k-th best of those bounds its k-th best score from below: tau.
2. One threshold holds for all lists of an item: the largest T for which entries below T, or a
   list's best where that is less, cannot sum to tau (at least tau / m in m lists). A document that
   reaches tau has an entry of T or more; all such entries are fetched, dealt by document, and
   with a cap for every list where a document was not fetched their sum bounds it from above.
3. Documents whose bound reaches tau are looked up in the table of documents and scored exactly.

Nothing is cut but what cannot reach tau, so the ranking is that of scoring every document. Only
terms that some item holds are indexed, found behind a bit map of bounded size; items and lists
are broadcast up to a checked number of bytes and shuffled beyond. Tables stand in the shared folder.

Null and empty texts have no terms: such documents are not counted, such items have no rows. Every
row is a document (an item) of its own, also where ids are null or repeat; of equal scores the
smaller doc_id comes first, a null one last. Empty tables give an empty result. Further columns are
not looked at. A long text is one row: a task holds its terms and their numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from . import decontamination
from .common import shuffle_partitions, small_batches, stored
from .decontamination import _bit_map, _small, tokens

K, HEADS = 10, 50


def _hash(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 7)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, item, t.decode("utf-8", "replace"), _hash(t), q) for i, item, text in zip(*(batch.column(c).to_pylist() for c in ("iid", "item_id", "text")), strict=True) for t, q in Counter(tokens(text)).items()]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(np.array(cols[3], np.uint64).view(np.int64)), pa.array(cols[4], pa.int64())],
                                         ["iid", "item_id", "term", "h", "q"])


class _Asked(dict):
    """Memo of which terms the bit map has, emptied when it grows past its bound."""

    def __init__(self, bit_map: np.ndarray):
        self.bit_map, self.mask = bit_map, len(bit_map) - 1

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= 200_000:
            self.clear()
        value = self[term] = bool(self.bit_map[_hash(term) & self.mask])
        return value


def _counted(bits) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(bits.value)
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column("text"):
                words = tokens(text.as_py())
                own = Counter(filter(asked.__getitem__, words))
                n.append(len(words))
                terms.append([t.decode("utf-8", "replace") for t in own])
                counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    return run


class Index:
    """Postings of the terms that some item holds. Tables: ``docs`` (uid, doc_id, length, terms, counts), ``lists``
    (tid, term, w, best), ``asked`` (iid, item_id, tid, q) and ``postings`` (tid, uid, s), the last sorted by term and falling score."""

    def __init__(self, docs: DataFrame, items: DataFrame):
        spark = docs.sparkSession
        small_batches(spark)
        rows = items.select(F.monotonically_increasing_id().alias("iid"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
        asked = stored(rows.mapInArrow(_asked, "iid long, item_id long, term string, h long, q long"))
        terms = asked.select("term", "h").distinct()
        bits = spark.sparkContext.broadcast(_bit_map(terms, terms.count()))
        counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted(bits), "doc_id long, n long, terms array<string>, counts array<long>")
        seen = stored(counted.filter("n > 0").withColumn("uid", F.monotonically_increasing_id()))
        self.n_docs, self.n_terms = seen.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # In decimals, as n times N may pass 64 bits on the way; the quotient does not.
        part = F.expr(f"cast(div(cast(75 * n as decimal(38, 0)) * {self.n_docs}, {max(self.n_terms, 1)}) as long)")
        self.docs = seen.withColumn("length", F.lit(25) + part).drop("n")
        df = self.pairs(self.docs).groupBy("term").agg(F.count("*").alias("df"), F.max(self.share()).alias("best"))
        weight = F.floor(F.lit(1000) * F.log(F.lit(2.0 * self.n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
        lists = df.join(_small(terms.select("term"), F.lit(64) + F.octet_length("term")), "term").select(F.monotonically_increasing_id().alias("tid"), "term", weight.alias("w"), "best").filter("w > 0")
        self.lists = stored(lists.withColumn("best", F.col("w") * F.col("best")))
        self.asked = stored(asked.join(self.small_lists("term", "tid", "best"), "term").select("iid", "item_id", "tid", "q", "best"))
        listed = self.scored(self.pairs(self.docs)).filter("s > 0").select("tid", "uid", "s")
        order = ["tid", F.desc("s"), "uid"]
        self.postings = stored(listed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order))

    @staticmethod
    def pairs(docs: DataFrame, *more: str) -> DataFrame:
        return docs.select(*more, "uid", "length", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select(*more, "uid", "length", "p.terms", "p.counts").toDF(*more, "uid", "length", "term", "tf")

    @staticmethod
    def share() -> Column:
        return F.expr("div(1000000000 * tf, 1000 * tf + 8 * length)")

    def small_lists(self, *columns: str) -> DataFrame:
        return _small(self.lists.select(*columns), F.lit(48) + (F.octet_length("term") if "term" in columns else F.lit(0)))

    def scored(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.small_lists("term", "tid", "w"), "term").withColumn("s", F.col("w") * self.share())

    def looked_up(self, found: DataFrame, tau: DataFrame | None = None) -> DataFrame:
        """Exact scores of documents for the items in ``found`` (uid, iids), those below an item's bound in ``tau`` (iid, kth) left out: iid, item_id, uid, doc_id, score.

        Items and their terms go to every task up to ``BROADCAST_BYTES``, and are joined beyond.
        """
        docs = self.docs.join(found, "uid")
        bytes_of = lambda df, size: df.agg(F.sum(size.cast("long"))).first()[0] or 0
        if bytes_of(self.asked, F.lit(48)) + bytes_of(self.lists, F.lit(96) + F.octet_length("term")) <= decontamination.BROADCAST_BYTES:
            rows = self.lists.select("tid", "term", "w").collect(), self.asked.select("iid", "item_id", "tid", "q").collect(), tau.collect() if tau else []
            sent = self.asked.sparkSession.sparkContext.broadcast(_Sent(*rows))
            return docs.mapInArrow(_scores(sent), "iid long, item_id long, uid long, doc_id long, score long")
        pairs = self.pairs(docs.withColumn("iid", F.explode("iids")), "iid", "doc_id")
        mine = self.scored(pairs).join(self.asked, ["iid", "tid"])
        scored = mine.groupBy("iid", "uid").agg(F.first("item_id").alias("item_id"), F.first("doc_id").alias("doc_id"), F.sum(F.col("q") * F.col("s")).alias("score"))
        return scored if tau is None else scored.join(tau, "iid", "left").filter("kth is null or score >= kth").drop("kth")


class _Sent:
    """Items and their terms as arrays: the terms' numbers and weights, and for each item its terms behind one another."""

    def __init__(self, lists: list, asked: list, tau: list):
        self.of = {r.term: k for k, r in enumerate(lists)}
        self.w = np.array([r.w for r in lists], np.int64)
        by_tid = {r.tid: k for k, r in enumerate(lists)}
        asked = sorted(asked, key=lambda r: r.iid)
        self.at, self.q = np.array([by_tid[r.tid] for r in asked], np.int64), np.array([r.q for r in asked], np.int64)
        iids = np.array([r.iid for r in asked], np.int64)
        self.iids, self.start, self.n = np.unique(iids, return_index=True, return_counts=True)
        self.items = [asked[k].item_id for k in self.start]
        least = {r.iid: r.kth for r in tau}
        self.tau = np.array([least.get(i, 0) for i in self.iids.tolist()], np.int64)

    def score(self, dense: np.ndarray, iids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.iids, iids)
        n = self.n[row]
        first = np.cumsum(n) - n
        at = np.repeat(self.start[row] - first, n) + np.arange(n.sum())
        score = np.add.reduceat(dense[self.at[at]] * self.q[at], first)
        good = score >= self.tau[row]
        return row[good], score[good]


def _scores(sent) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        dense = np.zeros(len(items.w), np.int64)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for uid, doc, length, terms, counts, iids in zip(*(batch.column(c) for c in ("uid", "doc_id", "length", "terms", "counts", "iids")), strict=True):
                known = [(items.of[t], c) for t, c in zip(terms.as_py(), counts.as_py(), strict=True) if t in items.of]
                if not known or not len(iids.values):
                    continue
                k, tf = np.array(known, np.int64).T
                dense[k] = items.w[k] * (1_000_000_000 * tf // (1000 * tf + 8 * length.as_py()))
                row, score = items.score(dense, iids.values.to_numpy(zero_copy_only=False))
                dense[k] = 0
                for c, v in zip(out, (items.iids[row], [items.items[r] for r in row], [uid.as_py()] * len(row), [doc.as_py()] * len(row), score), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["iid", "item_id", "uid", "doc_id", "score"])

    return run


def _per_document(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("uid").agg(F.collect_list("iid").alias("iids"))


def bounds(index: Index, k: int = K, heads: int = HEADS) -> DataFrame:
    """Phase 1: for items with k scored documents the k-th best of them, iid and kth."""
    head = index.postings.withColumn("_r", F.row_number().over(W.partitionBy("tid").orderBy(F.desc("s"), "uid"))).filter(F.col("_r") <= max(k, heads))
    first = stored(_per_document(head.join(_small(index.asked, F.lit(64)), "tid").select("iid", "uid").distinct()))
    scored = index.looked_up(_small(first, F.lit(48) + 8 * F.size("iids")))
    rank = F.row_number().over(W.partitionBy("iid").orderBy(F.desc("score"), "uid"))
    return stored(scored.withColumn("_r", rank).filter(F.col("_r") == k).select("iid", F.col("score").alias("kth")))


def candidates(index: Index, tau: DataFrame) -> DataFrame:
    """Phase 2: rows uid, iids of all documents that can reach an item's bound in ``tau``."""
    best = F.col("q") * F.col("best")
    # With the lists by rising best, T is the largest of (tau - best of the first j) / (m - j).
    by_best = W.partitionBy("iid").orderBy(best, "tid")
    rest = F.count("*").over(W.partitionBy("iid")) - F.row_number().over(by_best) + 1
    need = F.expr("div(tau - before + rest - 1, rest)")
    lists = index.asked.join(tau, "iid", "left").withColumns({"tau": F.coalesce("kth", F.lit(0)), "before": F.sum(best).over(by_best) - best, "rest": rest}).withColumn("need", F.greatest(need, F.lit(0)))
    lists = lists.withColumn("need", F.max("need").over(W.partitionBy("iid")))
    cap = F.least(best, F.greatest(F.col("need") - 1, F.lit(0)))
    asked = stored(lists.select("iid", "tid", "q", "need", cap.alias("cap"), (F.col("tau") - F.sum(cap).over(W.partitionBy("iid"))).alias("over")))
    # A posting is fetched if any item asks for it; dealt by document, the sums of its items need no further exchange.
    least = asked.groupBy("tid").agg(F.min(F.expr("div(need + q - 1, q)")).alias("least"))
    fetched = index.postings.join(_small(least, F.lit(32)), "tid").filter("s >= least").select("tid", "uid", "s").repartition(shuffle_partitions(index.postings.sparkSession), "uid")
    mine = fetched.join(_small(asked, F.lit(80)), "tid").filter(F.col("q") * F.col("s") >= F.col("need"))
    sums = mine.groupBy("uid", "iid").agg(F.sum(F.col("q") * F.col("s") - F.col("cap")).alias("part"), F.first("over").alias("over"))
    return _per_document(sums.filter(F.col("part") >= F.col("over")))


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    index = Index(docs, items)
    best = W.partitionBy("iid").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "uid")
    tau = bounds(index, k)
    ranked = index.looked_up(candidates(index, tau), tau).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return search(docs.select("doc_id", "text"), benchmark.select("item_id", "text"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
with docs as (select doc_id, row_number() over () as uid, {_TERMS} as terms from documents),
held as (select doc_id, uid, terms, len(terms)::bigint as n from docs where len(terms) > 0),
sums as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from held),
tf as (select uid, any_value(doc_id) as doc_id, any_value(n) as n, term, count(*)::bigint as tf from (select uid, doc_id, n, unnest(terms) as term from held) group by uid, term),
w as (select term, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from tf, sums group by term),
s as (select uid, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))) as s from tf join w using (term), sums),
items as (select item_id, row_number() over () as iid, unnest({_TERMS}) as term from benchmark),
q as (select iid, any_value(item_id) as item_id, term, count(*) as q from items group by iid, term),
scores as (select iid, any_value(item_id) as item_id, uid, any_value(doc_id) as doc_id, sum(q * s)::bigint as score from q join s using (term) group by iid, uid),
ranked as (select *, row_number() over (partition by iid order by score desc, doc_id nulls last, uid)::int as rank from scores where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10"""
