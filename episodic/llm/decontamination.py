"""Benchmark decontamination by greedy string tiling.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Runs of five words
(fewer where an item is shorter) that a document shares with a benchmark item are its seeds. Seeds
on one diagonal join to maximal matches; the longest (of equal ones the first in the item, then
in the text) is marked in both texts again and again, cut down where parts of it are marked
already, until no unmarked match of the least length is left. The marked share of the item is its
coverage, whatever order its passages stand in; a document is contaminated if any item is covered
by ``threshold`` or more.

1. Rolling Karp-Rabin hashes of all runs of the items make a table of seeds, and a bit map of
   bounded size that is sent to all tasks. Tasks hash the runs of their documents and send on those
   the bit map has.
2. Seeds of documents and items are joined by hash: the items' side is broadcast up to
   ``BROADCAST_BYTES`` and shuffled beyond. For each document and item the seeds' places in
   the item bound its coverage from above, and pairs that cannot reach the threshold go.
3. For what is left the texts are joined and tiled on the words themselves.

Null texts have no words; items without words match nothing. Rows with null or repeated ids keep
their own verdicts. Empty tables: no document is contaminated. A long text is hashed in one piece
and matched in pieces of ``PIECE`` words, so the seeds in memory are at most item x piece; of a
repetition with a period of up to ``PERIOD`` words no more is read than can change the coverage.
Columns of the input are passed on; one named ``hits`` is replaced by ``scan``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WordHashes, checkpoint, key_columns, keyed, rolling, small_batches, unpacked

TILE, THRESHOLD = 5, 0.5
PIECE, PERIOD = 1 << 15, 64  # long texts are matched in pieces of so many words; repetitions up to this period are cut short first
BROADCAST_BYTES = 32 << 20
MAP_BITS = (20, 25)  # the bit map has 2**20 to 2**25 places, a byte each
HITS = "array<struct<item_id:bigint,coverage:double>>"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def tile(i: np.ndarray, j: np.ndarray, length: np.ndarray, width: int, n_item: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling from maximal matches (place in item, place in text, length): tiles (item place, text place, length)."""
    heap = list(zip((-length).tolist(), i.tolist(), j.tolist(), strict=True))
    heapq.heapify(heap)
    in_item, in_text, tiles = np.zeros(n_item, bool), set(), []
    while heap and not in_item.all():
        n, a, b = heapq.heappop(heap)
        free = [k for k in range(-n) if not in_item[a + k] and b + k not in in_text]
        if len(free) == -n:
            in_item[a:a - n] = True
            in_text.update(range(b, b - n))
            tiles.append((a, b, -n))
            continue
        runs = np.split(np.array(free, int), np.flatnonzero(np.diff(free) != 1) + 1) if free else []
        for run in runs:
            if len(run) >= width:
                heapq.heappush(heap, (-len(run), a + int(run[0]), b + int(run[0])))
    return tiles


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the runs of ``width`` words, equal where the runs are equal; -1 with an unknown word (-1) in the run."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    known = np.ones(n, bool)
    for k in range(width):
        known &= words[k:k + n] >= 0
    at, out = np.flatnonzero(known), np.full(n, -1, np.int64)
    number, base = words[at], int(words.max()) + 1
    for k in range(1, width):
        number = np.unique(number * base + words[at + k], return_inverse=True)[1] if len(at) else number
    out[at] = number
    return out


def _without_periods(words: np.ndarray, n: int, width: int) -> np.ndarray:
    """The text with long repetitions of up to ``PERIOD`` words cut short by whole periods, in their middle.

    Tiles are at most n / width and mark n words; each leaves less than a period and a tile unused
    beside it, so what stays of a repetition holds every tile that the whole of it could.
    """
    for p in range(1, PERIOD + 1):
        keep = 4 * (n + p) + 2 * n * (p + width) // width
        same = np.concatenate([[False], words[p:] == words[:-p], [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        long = edge[1::2] - edge[::2] > keep
        if long.any():
            stay = np.ones(len(words), bool)
            for a, b in zip(edge[::2][long].tolist(), edge[1::2][long].tolist(), strict=True):
                stay[a + keep // 2:a + keep // 2 + (b - a - keep) // p * p] = False
            words = words[stay]
    return words


def _runs(item: np.ndarray, text: np.ndarray, width: int, before: int, size: int, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal matches that begin in the first ``size`` words of a piece of text that stands at ``at`` behind the word ``before``: place in item, in text, length."""
    n = len(item)
    grams = _grams(np.concatenate([item, [-1], text]), width)
    a, b = grams[:n - width + 1], grams[n + 1:]
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    many = np.where(b >= 0, hi - lo, 0)
    j = np.repeat(np.arange(len(b)), many)
    i = order[np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return i, j, i
    new = np.flatnonzero(np.append(True, (np.diff(j - i) != 0) | (np.diff(i) != 1)))
    length = np.diff(np.append(new, len(i))) + width - 1
    i, j = i[new], j[new]
    own = (j < size) & ~((j == 0) & (i > 0) & (item[i - 1] == before) & (at > 0))
    return i[own], j[own] + at, length[own]


def coverage(item: list[bytes], text: list[bytes], width: int = TILE) -> float:
    """Share of the item's words that greedy string tiling marks; words are compared as they are."""
    n, width = len(item), min(width, len(item))
    if not n:
        return 0.0
    ids: dict[bytes, int] = {}
    mine = np.array([ids.setdefault(w, len(ids)) for w in item], np.int64)
    other = np.fromiter((ids.get(w, -1) for w in text), np.int64, len(text))
    if len(other):  # runs of words the item does not have count as one
        other = other[np.append(True, (other[1:] >= 0) | (other[:-1] >= 0))]
    if len(other) > PIECE:
        other = _without_periods(other, n, width)
    runs = [_runs(mine, other[k:k + PIECE + n], width, min(k, 1) and other[k - 1], PIECE, k) for k in range(0, len(other), PIECE)]
    i, j, length = (np.concatenate(x) for x in zip(*runs, strict=True)) if runs else (np.empty(0, np.int64),) * 3
    return sum(t[2] for t in tile(i, j, length, width, n)) / n if len(i) else 0.0


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        memo = WordHashes()
        columns: list[list] = [[], [], [], [], [], []]
        for item, mark, text in zip(*(batch.column(c).to_pylist() for c in ("item_id", "mark", "text")), strict=True):
            words = tokens(text)
            width = min(TILE, len(words))
            h = rolling(memo.of(words), width) if words else np.empty(0, np.uint64)
            for c, v in zip(columns, (h.view(np.int64), np.arange(len(h)), [item] * len(h), [mark] * len(h), [width] * len(h), [len(words)] * len(h)), strict=True):
                c.extend(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "at", "item_id", "mark", "width", "n"])


def _bit_map(seeds: DataFrame, rows: int) -> np.ndarray:
    """Bits of the seeds' hashes; its size follows their number within bounds."""
    bits = max(MAP_BITS[0], min(MAP_BITS[1], (16 * rows).bit_length()))
    place = F.col("h").bitwiseAND((1 << bits) - 1)
    parts = seeds.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("v")).collect()
    out = np.zeros(1 << bits, bool)
    for r in parts:  # bucket k holds the places from 32768 * (k - 1) + 1 on
        part = np.unpackbits(np.frombuffer(bytes(r.v), np.uint8), bitorder="little").astype(bool)
        lo = 32768 * (r.k - 1) + 1 if r.k > 0 else 0
        out[lo:lo + len(part)] |= part[:max(0, len(out) - lo)]
    return out


def _small(df: DataFrame, size: Column) -> DataFrame:
    """``df`` marked for broadcast where its rows, of ``size`` bytes each, are at most ``BROADCAST_BYTES``; beyond that as it is."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def contaminated(docs: DataFrame, keys: list[str], benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows keys, hits: the items that a document (keys, text) covers by ``threshold`` or more."""
    spark = docs.sparkSession
    items = checkpoint(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"), F.col("text").cast("string").alias("text")).dropDuplicates(["item_id", "mark"]))
    seeds = checkpoint(items.mapInArrow(_item_seeds, "h long, at long, item_id long, mark long, width long, n long"))
    rows, widths = seeds.agg(F.count("*"), F.collect_set("width")).first()
    bits = spark.sparkContext.broadcast((_bit_map(seeds, rows), sorted(widths)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (bit_map, wanted) = WordHashes(), bits.value
        mask = np.uint64(len(bit_map) - 1)
        for batch in batches:
            row, hashes = [], []
            for k, text in enumerate(batch.column("text")):
                h = memo.of(tokens(text.as_py()))
                for width in wanted:
                    r = rolling(h, width)
                    r = np.unique(r[bit_map[(r & mask).astype(np.int64)]])
                    if len(r):
                        row.append(np.full(len(r), k))
                        hashes.append(r)
            if row:
                at = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), pa.array(np.concatenate(hashes).view(np.int64))], [*keys, "h"])

    schema = StructType([*(docs.schema[k] for k in keys), StructField("h", LongType())])
    met = docs.select(*keys, "text").mapInArrow(found, schema).join(_small(seeds, F.lit(64)), "h")
    places = met.groupBy(*keys, "item_id", "mark").agg(F.sort_array(F.collect_set("at")).alias("places"), F.first("width").alias("width"), F.first("n").alias("n"))
    span = lambda x, i: F.coalesce(F.least(F.col("width"), F.get("places", i + 1) - x), F.col("width"))
    most = F.aggregate(F.transform("places", span), F.lit(0).cast("long"), lambda s, x: s + x)
    maybe = checkpoint(places.filter(most >= threshold * F.col("n")).select(*keys, "item_id", "mark"))
    same = maybe["item_id"].eqNullSafe(items["item_id"]) & (maybe["mark"] == items["mark"])
    pairs = maybe.join(items, same).select(*keys, F.struct(items["item_id"], items["text"]).alias("item")).groupBy(*keys).agg(F.collect_list("item").alias("items"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for text, some in zip(batch.column("text").to_pylist(), batch.column("items").to_pylist(), strict=True):
                words = tokens(text)
                shares = ((x["item_id"], coverage(tokens(x["text"]), words)) for x in some)
                hits.append([{"item_id": i, "coverage": c} for i, c in shares if c >= threshold])
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.array(hits, kind)], [*keys, "hits"])

    weight = 64 + F.aggregate("items", F.lit(0).cast("long"), lambda s, x: s + 48 + F.coalesce(F.octet_length(x["text"]), F.lit(0)))
    texts = docs.select(*keys, "text").join(_small(checkpoint(pairs), weight), keys).dropDuplicates(keys)
    return texts.select(*keys, "text", "items").mapInArrow(tiled, ", ".join([*(f"{k} long" for k in keys), f"hits {HITS}"])).filter(F.size("hits") > 0)


def scan(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The columns of ``df`` and ``hits``: array of (item_id, coverage) of the items it covers."""
    small_batches(df.sparkSession)
    docs, keys = keyed(df), key_columns(df)
    found = _small(checkpoint(contaminated(docs, keys, benchmark, threshold)), 64 + 32 * F.size("hits"))
    rows = docs.join(found, keys, "left")
    return rows.select(*unpacked(df.columns, hits=F.coalesce("hits", F.array().cast(HITS))))


def clean(df: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that no benchmark item contaminates."""
    small_batches(df.sparkSession)
    docs, keys = keyed(df), key_columns(df)
    found = checkpoint(contaminated(docs, keys, benchmark, threshold).select(*keys))
    return docs.join(_small(found, F.lit(64)), keys, "left_anti").select(*unpacked(df.columns))


def digest(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document: doc_id, contaminated, coverage (the largest), items (sorted ids)."""
    out = scan(df.select("doc_id", "text"), benchmark)
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.coalesce(F.array_max(F.transform("hits", lambda h: h["coverage"])), F.lit(0.0)).alias("coverage"),
                      F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("items"))
