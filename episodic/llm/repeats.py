"""Substring dedup with difference-cover anchors.

With the difference cover {0, 1, 4, 14, 16} modulo 21, any two places i and j have an offset d
below 21 at which i + d and j + d are both places of the cover. So if two windows of 35 words
are equal, they hold an equal anchor of 15 words that starts at a cover place in both. Anchors
are hashed at cover places only (5 of 21), and an anchor found twice extends to the windows
around it: those, and only those, are hashed over all 35 words and looked up in turn.

A task counts its own anchors (windows) before the shuffle and sends each hash once, so a
passage that a third of all documents share reaches a reducer once for each task. The texts
are shuffled once, and both joins use that exchange. Hashes have 64 bits; a wrong removal takes
a chance match of an anchor and of a window around it.

Every word of a window whose word sequence starts anywhere else, in the same text included, is
removed; windows are judged on the input. Null text has no words. Shorter texts are kept whole.
Rows that repeat id and text repeat each other's windows. An empty table gives an empty result.
Columns of the input that are named as an output (n_words, n_removed, kept) are replaced. A long
text is hashed in one piece: a task holds its words and one hash for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WordHashes, covered, key_columns, keyed, rolling, shuffle_partitions, small_batches, split_words, unpacked

WINDOW, PERIOD, COVER = 35, 21, (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
FLUSH = 1_000_000
TWICE = 1 << 62  # bit of ``at`` for places whose hash its task has seen twice; below it the place


def _combined(keys: list[str], h: np.ndarray, at: np.ndarray, *ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row under each hash; further places are known to repeat and go out under a key of their own.

    Rows stay in the order of the documents, which lets the shuffle's compression find equal ids.
    """
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    first, twice = np.zeros(len(h), bool), np.zeros(len(h), bool)
    first[order] = new
    twice[order] = np.repeat(np.diff(np.append(np.flatnonzero(new), len(h))) > 1, np.diff(np.append(np.flatnonzero(new), len(h))))
    own = np.zeros(len(h), np.uint64)
    for x in ids:
        own = (own + x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    own = (own + at.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    key = np.where(first, h, own ^ (own >> np.uint64(31)))
    at = np.where(twice, at | TWICE, at)
    for i in range(0, len(h), 100_000):
        s = slice(i, i + 100_000)
        yield pa.RecordBatch.from_arrays([pa.array(key[s].view(np.int64)), *(pa.array(x[s]) for x in ids), pa.array(at[s])], ["h", *keys, "at"])


def _hashed(pick, keys: list[str]) -> object:
    """A function for mapInArrow: hashes of the places that pick(word hashes, batch, row) gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            texts, ids = batch.column("text"), [batch.column(k) for k in keys]
            for row in range(batch.num_rows):
                words = split_words(texts[row].as_py())
                if len(words) < WINDOW:
                    continue
                h, at = pick(memo.of(words), batch, row)
                if len(at):
                    held.append((h, at.astype(np.int64), *(np.full(len(at), x[row].as_py(), np.int64) for x in ids)))
                    size += len(at)
                if size >= FLUSH:
                    yield from _combined(keys, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from _combined(keys, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _anchors(hashes: np.ndarray, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(hashes) - ANCHOR + 1)
    at = at[np.isin(at % PERIOD, COVER)]
    return rolling(hashes, ANCHOR)[at], at


def _windows(hashes: np.ndarray, batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray]:
    found = batch.column("found")[row].values
    if found is None:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    anchors = np.unique(found.to_numpy(zero_copy_only=False)).astype(np.int64)
    near = covered(np.maximum(anchors - (PERIOD - 1), 0), PERIOD, len(hashes) - WINDOW + 1) if len(anchors) else np.zeros(0, bool)
    at = np.flatnonzero(near)
    return rolling(hashes, WINDOW)[at], at


def _repeated(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Places whose hash is there twice, gathered for each document: keys, found."""
    same = W.partitionBy("h")
    twice = hits.withColumns({"most": F.max("at").over(same), "rows": F.count(F.lit(1)).over(same)}).filter((F.col("rows") > 1) | (F.col("most") >= TWICE))
    twice = twice.select(*keys, F.col("at").bitwiseAND(TWICE - 1).cast("int").alias("at"))
    return twice.groupBy(*keys).agg(F.collect_list("at").alias("found"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        texts, found = batch.column("text"), batch.column("found")
        for row in range(batch.num_rows):
            words, hit = split_words(texts[row].as_py()), found[row].values
            gone = 0
            if hit is not None and len(hit):
                cover = covered(hit.to_numpy(zero_copy_only=False).astype(np.int64), WINDOW, len(words))
                gone = int(cover.sum())
                kept.append(b" ".join([w for w, c in zip(words, cover.tolist(), strict=True) if not c]).decode("utf-8", "surrogatepass"))
            else:
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            n_words.append(len(words))
            n_removed.append(gone)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["row", "n_words", "n_removed", "kept"])


def remove_repeats(df: DataFrame) -> DataFrame:
    """The columns of ``df`` without text, and n_words, n_removed, kept (the words left, joined by a space)."""
    small_batches(df.sparkSession)
    n = shuffle_partitions(df.sparkSession)
    keys = key_columns(df)  # where ids tell all rows apart, places are sent without the texts' hashes
    docs = keyed(df).select("row", "text", *keys)
    hits = ", ".join(f"{c} long" for c in ("h", *keys, "at"))
    texts = docs.repartition(n, *keys)
    anchors = docs.select(*keys, "text").mapInArrow(_hashed(_anchors, keys), hits)
    candidates = texts.join(_repeated(anchors, keys), keys)
    windows = candidates.mapInArrow(_hashed(_windows, keys), hits)
    schema = StructType([docs.schema["row"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    cut = texts.join(_repeated(windows, keys), keys, "left").select("row", "text", "found").mapInArrow(_cut, schema)
    return cut.select(*unpacked([c for c in df.columns if c != "text"], n_words="n_words", n_removed="n_removed", kept="kept"))


def digest(df: DataFrame) -> DataFrame:
    out = remove_repeats(df.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
