"""SimHash fingerprints and their comparison in bit planes.

Fingerprints are compared bit-sliced: bit k of many fingerprints stands in plane k, 64 of
them in a machine word. Planes are xored with the bits of the query, added up by carry-save
counters of a few planes, and a block is abandoned once every lane exceeds the radius.

Which fingerprints meet follows from the pigeonhole principle: with 64 bits in four blocks of
16, two fingerprints at most two bits apart agree on at least two blocks, so they share one of
six keys of 32 bits. A bucket that is still large is split by three segments of its other 32
bits, one of which must agree too. A bucket gives a spanning forest of its links, never all
pairs, and the forests are joined to components. Only fingerprints meet, each once, whatever
number of documents has it.

Null text counts as empty: fingerprint zero, linked like any other. Rows with null ids take
part; a component with null ids only has a null id. Rows with equal ids keep their own
fingerprints. An empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_partitions, small_batches, split_words
from .components import components

BITS = 64
SMALL, SPLIT = 64, 8192  # bucket sizes: pairs side by side up to SMALL, buckets split again from SPLIT


def shingles(words: list[bytes], width: int) -> list[bytes]:
    n = len(words)
    if n <= width:
        return [b" ".join(words)] if n else []
    if width == 3:
        return [a + b" " + b + b" " + c for a, b, c in zip(words, words[1:], words[2:], strict=False)]
    return [b" ".join(words[i:i + width]) for i in range(n - width + 1)]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of a text, A-Z lower-cased."""
    grams = shingles(split_words(text and text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")), width)
    return np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes."""
    count = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i:i + (1 << 16)])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0]) if len(hashes) else 0


def _planes(x: np.ndarray) -> np.ndarray:
    """(64, words) bit planes of fingerprints; lane i is bit i % 64 of word i // 64."""
    pad = np.zeros(-(-len(x) // 64) * 64, np.uint64)
    pad[: len(x)] = x
    bits = np.unpackbits(pad.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), bitorder="little")[:n].astype(bool)


def within(planes: np.ndarray, query: int, radius: int, n: int) -> np.ndarray:
    """Which of n lanes are at most ``radius`` bits from ``query``."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    counters = [np.zeros(planes.shape[1], np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(planes.shape[1], np.uint64)
    for k in range(len(planes)):
        carry = planes[k] ^ full if query >> k & 1 else planes[k].copy()
        for c in counters:
            c ^= carry
            carry &= ~c  # set where the counter was set and took the bit: it is clear now
        over |= carry
        if k % 8 == 7:
            above, equal = over.copy(), ~over
            for b in range(len(counters) - 1, -1, -1):
                if not radius >> b & 1:
                    above |= equal & counters[b]
                    equal &= ~counters[b]
                else:
                    equal &= counters[b]
            if (above == full).all():
                return np.zeros(n, bool)
    return _lanes(~above, n)


def _forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint of one bucket the first one of its component within the bucket."""
    n, planes = len(fp), _planes(fp)
    label, open_ = np.full(n, -1), np.ones(n, bool)
    for seed in range(n):
        if label[seed] >= 0:
            continue
        label[seed], open_[seed], queue = seed, False, [seed]
        while queue and open_.any():
            near = np.flatnonzero(within(planes, int(fp[queue.pop()]), radius, n) & open_)
            label[near], open_[near] = seed, False
            queue.extend(near.tolist())
    return label


def bucket_links(fp: np.ndarray, start: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (fingerprint, first of its component) in buckets that begin at ``start`` and end at the next one."""
    size = np.diff(np.append(start, len(fp)))
    bucket = np.repeat(np.arange(len(start)), size)
    small = size <= SMALL
    label = np.arange(len(fp))
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for step in range(1, int(size[small].max(initial=1))):
        a = np.flatnonzero((bucket[:-step] == bucket[step:]) & small[bucket[:-step]])
        if len(a):
            near = within(_planes(fp[a] ^ fp[a + step]), 0, radius, len(a))
            pairs.append((a[near], a[near] + step))
    if pairs:
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            least = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            if (new == label).all():
                break
            label = new
    moved = np.flatnonzero(label != np.arange(len(fp)))
    yield fp[moved], fp[label[moved]]
    for k in np.flatnonzero(~small):
        mine = fp[start[k]:start[k] + size[k]]
        if len(mine) <= SPLIT or radius > 2:
            first = _forest(mine, radius)
            yield mine, mine[first]
            continue
        same = np.bitwise_and.reduce(~(mine ^ mine[0]))  # bits that are alike in the whole bucket
        free = np.flatnonzero([not int(same) >> b & 1 for b in range(BITS)])
        for part in np.array_split(free, radius + 1):  # one of radius + 1 segments must agree
            mask = np.uint64(sum(1 << int(b) for b in part))
            order = np.argsort(mine & mask, kind="stable")
            key = (mine & mask)[order]
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(key)), strict=True):
                if hi - lo > 1:
                    group = mine[order[lo:hi]]
                    yield group, group[_forest(group, radius)]


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (a, b) between fingerprints of ``classes`` (column fp, distinct) that make their components."""
    if radius > 2:
        raise ValueError("the keys find all links up to a radius of 2")
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF) for k in range(4)]
    keys = [F.struct(F.lit(4 * i + j).alias("t"), (blocks[i] * 65536 + blocks[j]).alias("key")) for i in range(4) for j in range(i)]
    rows = classes.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.t", "k.key", "fp")
    rows = rows.repartition(shuffle_partitions(classes.sparkSession), "t", "key").sortWithinPartitions("t", "key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3

        def out(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(fp) < 2:
                return
            new = np.append(True, (t[1:] != t[:-1]) | (key[1:] != key[:-1]))
            for a, b in bucket_links(fp.view(np.uint64), np.flatnonzero(new), radius):
                real = a != b
                if real.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[real].view(np.int64)) for x in (a, b)], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
                t, key, _ = held
                last = np.flatnonzero((t != t[-1]) | (key != key[-1]))  # the bucket that is still open waits
                cut = last[-1] + 1 if len(last) else 0
                yield from out(*(h[:cut] for h in held))
                held = [h[cut:].copy() for h in held]
        yield from out(*held)

    return rows.mapInArrow(find, "a long, b long")


def fingerprints(df: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(shingle_hashes(t.as_py(), width)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    small_batches(df.sparkSession)
    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def groups(df: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """Rows doc_id, fp, component_id: the smallest doc_id among all fingerprints reachable by links."""
    docs = checkpoint(fingerprints(df, width))
    classes = checkpoint(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(classes.select("fp"), radius))
    named = classes.join(root, F.col("fp") == F.col("a"), "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = checkpoint(named.join(least, "root").select("fp", "component_id"))
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(df: DataFrame) -> DataFrame:
    return groups(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
