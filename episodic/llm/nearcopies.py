"""Near-duplicate documents: one document of each group stays.

Two documents are near copies if their sets of five-word shingles (A-Z lower-cased) have a
Jaccard similarity of 0.8 or more. Documents with equal sets form one class, so what is compared
are classes. Candidates share one of eight min-hashes of their shingles: a pair at 0.8 misses all
eight with a chance of 0.2**8. They are compared by SimHash fingerprints of 256 bits over the
distinct shingles: at a similarity of 0.8 about 40 bits differ (48 for four shingles), with a spread
of 6, at 0 about 128, and the radius is ``RADIUS``. What is left is verified on the whole shingle
sets, as 64-bit hashes, which are made again from the texts of these classes only.

1. In each bucket (band and min-hash) every class is compared with the first one that also has its
   next min-hash, so thousands of near copies give one pair each, in each band.
2. What is not in the bucket's largest component so far is then compared, in bit planes, with all
   others of its bucket. A bucket is dealt to cells of about ``CELL`` by ``CELL`` classes, so no bucket
   is gathered in one task. Classes that are near another one come back to their cells with their
   sets, and a cell gives a forest of verified links, never its pairs.

Groups are the components of the verified links; the document with the smallest id (null last)
stays. Null text counts as empty; all texts without words are one group, texts with fewer than
five words have one shingle. Of repeated rows one stays. An empty table stays empty. Columns of
the input are passed on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, checkpoint, keyed, shuffle_partitions, small_batches, stored, unpacked
from .components import components
from .simhash import _planes, fingerprint, shingle_hashes, within

WIDTH, SIMILARITY, RADIUS, CELL = 5, 0.8, 72, 512
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
PRINTS, CELL_KEY = ("f0", "f1", "f2", "f3"), ("band", "key", "i", "j")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints: list[list[int]] = [[] for _ in PRINTS]
        cid, n, mins = [], [], []
        for t in batch.column("text"):
            h = np.unique(shingle_hashes(t.as_py(), WIDTH))  # a set: one repeated shingle must not outweigh the text
            mixed = h[None, :] * _ODD[:, None]
            mixed ^= mixed >> np.uint64(31)
            for k, out in enumerate(prints):
                f = mixed[k] * np.uint64(0xD1B54A32D192ED03)
                out.append(fingerprint(f ^ (f >> np.uint64(29))))
            n.append(len(h))
            mins.append(mixed.min(axis=1).view(np.int64).tolist() if len(h) else [0] * len(_ODD))
            cid.append(int((mixed[0] * np.uint64(0xFF51AFD7ED558CCD) ^ (mixed[1] >> np.uint64(7))).sum(dtype=np.uint64)) if len(h) else 0)
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), *map(as_long, prints), as_long(cid), pa.array(n, pa.int32()), pa.array(mins, pa.list_(pa.int64()))],
                                         [*KEYS, *PRINTS, "cid", "n", "mins"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cid and the distinct shingle hashes in order."""
    for batch in batches:
        sets = pa.array([np.unique(shingle_hashes(t.as_py(), WIDTH)).tobytes() for t in batch.column("text")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("cid"), sets], ["cid", "shingles"])


def _may_be_similar(x: str, y: str) -> Column:
    n, m = F.col(f"{x}n"), F.col(f"{y}n")
    apart = reduce(add, (F.bit_count(F.col(f"{x}{f}").bitwiseXOR(F.col(f"{y}{f}"))) for f in PRINTS))
    return (F.least(n, m) >= SIMILARITY * F.greatest(n, m)) & (apart <= RADIUS)


def _each_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The whole cells of two rows or more, from rows sorted by cell."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            names = [batch.column(c).to_numpy() for c in CELL_KEY]
            edge = np.flatnonzero(reduce(or_, (c[1:] != c[:-1] for c in names))) + 1
            if held and any(held[-1].column(c)[-1].as_py() != v[0] for c, v in zip(CELL_KEY, names, strict=True)):
                edge = np.append(0, edge)
            for lo, hi in zip(np.append(0, edge), np.append(edge, batch.num_rows), strict=True):
                if hi in edge:
                    whole = pa.Table.from_batches([*held, batch.slice(lo, hi - lo)])
                    held = []
                    if whole.num_rows > 1:
                        yield whole
                elif hi > lo:
                    held.append(batch.slice(lo, hi - lo))
    if held and sum(b.num_rows for b in held) > 1:
        yield pa.Table.from_batches(held)


def _near(cell: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """For each open class of a cell: its row, and the mask of near classes that are not in its component."""
    open_, label, cid, n = (cell.column(c).to_numpy() for c in ("open", "label", "cid", "n"))
    prints = [cell.column(f).to_numpy().view(np.uint64) for f in PRINTS]
    planes = np.concatenate([_planes(p) for p in prints])
    for i in np.flatnonzero(open_):
        query = sum(int(p[i]) << 64 * k for k, p in enumerate(prints))
        near = within(planes, query, RADIUS, len(cid))
        near &= (label != label[i]) & (np.minimum(n, n[i]) >= SIMILARITY * np.maximum(n, n[i])) & (~open_ | (cid < cid[i]))
        if near.any():
            yield int(i), near


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each cell that are near another one."""
    for cell in _each_cell(batches):
        hit = np.zeros(cell.num_rows, bool)
        for i, near in _near(cell):
            hit |= near
            hit[i] = True
        if hit.any():
            yield from cell.filter(pa.array(hit)).to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links (a, b) of each cell that join components which nothing else in the cell has joined yet."""
    for cell in _each_cell(batches):
        cid, label = (cell.column(c).to_pylist() for c in ("cid", "label"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in cell.column("shingles")]
        root: dict[int, int] = {}

        def find(x: int, root=root) -> int:
            while x in root:
                x = root[x]
            return x

        out = []
        for i, near in _near(cell):
            for j in np.flatnonzero(near).tolist():
                x, y = find(label[i]), find(label[j])
                if x != y and similarity(sets[i], sets[j]) >= SIMILARITY:
                    root[x] = y
                    out.append((cid[i], cid[j]))
        if out:
            a, b = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose sets are similar."""
    for batch in batches:
        sets = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("x", "y"))
        good = pa.array([similarity(x, y) >= SIMILARITY for x, y in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])


def links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes that make their components. docs: keys and text."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)

    def shingles(ids: DataFrame) -> DataFrame:
        """cid, shingles of some classes."""
        wanted = ids.distinct().join(classes.select("cid", "first.*"), "cid")
        texts = docs.select(*KEYS, "text").join(wanted, list(KEYS)).dropDuplicates(list(KEYS))
        return stored(texts.select("cid", "text").mapInArrow(_whole_sets, "cid long, shingles binary"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = checkpoint(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        sets = shingles(pairs.select(F.explode(F.array("a", "b")).alias("cid")))
        both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("y")), "b")
        return checkpoint(both.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long"))

    rows = classes.select("cid", "n", *PRINTS, "mins", F.posexplode("mins").alias("band", "key"))
    rows = rows.withColumn("next", F.get("mins", (F.col("band") + 1) % len(_ODD))).drop("mins")
    met = checkpoint(rows.join(rows.groupBy("band", "key").agg(F.count("*").alias("rows")).filter("rows > 1"), ["band", "key"]))
    some = ["band", "key", "next"]
    first = met.groupBy(*some).agg(F.min(F.struct("cid", "n", *PRINTS)).alias("y"), F.count("*").alias("_rows")).filter("_rows > 1")
    first = first.select(*some, F.col("y.cid").alias("y_cid"), F.col("y.n").alias("y_n"), *(F.col(f"y.{f}").alias(f"y_{f}") for f in PRINTS))
    edges = verified(met.join(first, some).filter((F.col("cid") != F.col("y_cid")) & _may_be_similar("", "y_")).select(F.col("cid").alias("a"), F.col("y_cid").alias("b")))
    root = components(edges).select(F.col("a").alias("cid"), F.col("b").alias("_root"))
    named = checkpoint(met.drop("next").join(root, "cid", "left").withColumn("label", F.coalesce("_root", "cid")).drop("_root"))
    sizes = named.groupBy("band", "key", "label").agg(F.count("*").alias("_n"))
    top = sizes.groupBy("band", "key").agg(F.max(F.struct("_n", "label"))["label"].alias("_top"), (F.sum("_n") - F.max("_n")).alias("open_rows")).filter("open_rows > 0")
    dealt = named.join(top, ["band", "key"]).withColumn("open", F.col("label") != F.col("_top"))
    part = lambda seed, many: F.pmod(F.xxhash64("cid", F.lit(seed)), F.ceil(F.col(many) / CELL)).cast("int")
    every = lambda many: F.sequence(F.lit(0), (F.ceil(F.col(many) / CELL) - 1).cast("int"))
    # As one of all, a class goes to its column of cells; an open one also goes to its row of them, where it is the query.
    all_ = dealt.withColumn("j", part(1, "rows")).withColumn("i", F.explode(every("open_rows"))).withColumn("open", F.col("open") & (F.col("i") == part(2, "open_rows")))
    queries = dealt.filter("open").withColumn("i", part(2, "open_rows")).withColumn("j", F.explode(every("rows"))).filter(F.col("j") != part(1, "rows"))
    fields = [*CELL_KEY, "cid", "n", "label", "open", *PRINTS]
    in_cells = lambda rows: rows.repartition(n, *CELL_KEY).sortWithinPartitions(*CELL_KEY)
    cells = in_cells(all_.select(*fields).unionByName(queries.select(*fields)))
    maybe = checkpoint(cells.mapInArrow(_flagged, cells.schema))
    more = in_cells(maybe.join(shingles(maybe.select("cid")), "cid")).mapInArrow(_linked, "a long, b long")
    return edges.union(checkpoint(more))


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without all but one document of each group of near copies."""
    small_batches(df.sparkSession)
    docs = keyed(df)
    prints = ", ".join(f"{f} long" for f in PRINTS)
    base = docs.select(*KEYS, "text").mapInArrow(_sketched, f"d long, t long, u long, {prints}, cid long, n int, mins array<long>")
    firsts = [F.first(c).alias(c) for c in (*PRINTS, "n", "mins")]
    classes = stored(base.groupBy("cid").agg(F.min(F.struct(*KEYS)).alias("first"), *firsts))
    root = components(links(docs, classes))
    named = classes.join(root, F.col("cid") == F.col("a"), "left").select(F.coalesce("b", "cid").alias("root"), "first")
    stay = checkpoint(named.groupBy("root").agg(F.min("first").alias("first")).select("first.*"))
    return docs.join(stay, list(KEYS)).dropDuplicates(list(KEYS)).select(*unpacked(df.columns))
