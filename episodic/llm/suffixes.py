"""Suffix-array dedup: bytes covered by a string of 200 bytes that starts anywhere else go.

1. The sample. A string of 200 bytes has 61 grams of 140 bytes; the leftmost one of least hash is its
   anchor. Equal strings have their anchors at one distance, so only suffixes that begin at an anchor
   enter the array, about one in 30, and of these only those whose gram's hash stands at two places
   or more (chance matches only add some).
2. The sparse suffix array. The sampled suffixes are sorted by their gram's hash and then their bytes,
   as far as the windows of the anchor reach, and with the bytes before them. Equal suffixes are one, with a
   mark that there were several. Two windows whose anchors lie ``o`` bytes behind their starts are equal if
   and only if the suffixes share ``width - o`` bytes and ``o`` bytes stand alike before them: the first follows from
   the prefixes that neighbours in the array share, the second from those of the reversed bytes
   in their own order. Neighbours are compared as bytes, never as hashes.
3. Grams that begin more than ``MOST`` different suffixes would not fit into one task. Their windows go, as pieces, through a
   suffix array by the difference cover {0, 1, 3} modulo 7, which is dealt by ranges. Sampled suffixes are
   sorted by triples of eight-byte words and named by rank; the string of names is named again in
   triples until names reach 192 bytes, and the last sort also compares whole windows. A suffix
   whose name is its own alone drops out, as no longer prefix of it can repeat; so the recursion
   ends at the depth asked for. Of seven neighbouring windows that repeat, one is sampled where its
   partner is, so what lies between two windows found is covered by them. The remaining suffixes,
   those before the first and behind the last, merge: by up to six leading bytes, the name behind
   them and the bytes up to 200. Any two windows have a shift below 7 that takes both to sampled
   places, so equal ones are neighbours in the order of that shift. Adjacent prefixes are compared
   as names and bytes, never as hashes.

The cover is counted in each piece from its anchor, so pieces that are alike sample the
same content. Sorts are dealt by ranges of the first part; a group of pieces (about ``GROUP`` bytes, alike where
they share their least hash) sends each triple once and gets its name back, so a triple that fills
a text reaches the sort once a group. Pieces and names
stand in the shared folder after every round.

A null text is empty. Matches never cross documents; windows are judged on the input; rows that repeat
id and text repeat each other. An empty table gives an empty result. A text is read in slices, its
bytes stand in one task; what a periodic text says again and again is sent once a slice. Columns of the input
named as an output (n_bytes, n_removed, n_spans, kept) are replaced, others are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import _BASE, _INVERSE, _powers, covered, key_columns, keyed, shuffle_partitions, small_batches, stored, unpacked
from .decontamination import _bit_map, _small
from .repeats import FLUSH, TWICE, _combined, _repeated

WIDTH = 200
SLICE = 1 << 18
GROUP = 2 << 20
MOST = 1 << 15  # different suffixes of one gram that a task compares
BLOCK = 1 << 14  # rows that are sent or compared at a time
PERIOD, COVER = 7, (0, 1, 3)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(0x94D049BB133111EB)


class Grams:
    """Hashes of all grams of a slice and the least hash of each window."""

    def __init__(self, width: int):
        self.width, self.gram = width, width * 7 // 10
        self.span = width - self.gram + 1
        self.up, self.down = _powers(_BASE, SLICE + width), _powers(_INVERSE, SLICE + width)

    def slices(self, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Start, gram hashes, least hash of each window and running sums, slice by slice."""
        for at in range(0, len(data) - self.width + 1, SLICE):
            part = data[at:at + SLICE + self.width - 1]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTES[part] * self.up[:len(part)], dtype=np.uint64, out=sums[1:])
            h = _spread((sums[self.gram:] - sums[:-self.gram]) * self.down[:len(part) - self.gram + 1])
            yield at, h, _least(h, self.span), sums

    def anchored(self, h: np.ndarray, least: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows of a slice with one anchor, for least hashes that stand at ``grams``: first windows, ends, places of the anchors."""
        begin = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
        n = np.diff(np.append(begin, len(least)))
        hit = np.isin(least[begin], h[grams])
        begin, n = begin[hit], n[hit]
        window = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        leftmost = lambda at: at + np.argmin(h[at[:, None] + np.arange(self.span)], axis=1)
        place = np.concatenate([np.empty(0, np.int64), *(leftmost(begin[i:i + BLOCK]) for i in range(0, len(begin), BLOCK))])
        place = np.repeat(place, n)
        late = np.flatnonzero(place < window)
        for i in range(0, len(late), BLOCK):
            x = late[i:i + BLOCK]
            place[x] = leftmost(window[x])
        new = np.ones(len(window), bool)
        new[1:] = (np.diff(window) != 1) | (np.diff(place) != 0)
        first = np.flatnonzero(new)
        return window[first], window[np.append(first[1:], len(window))[:len(first)] - 1] + 1, place[first]


def _spread(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(h: np.ndarray, span: int, pick=np.minimum) -> np.ndarray:
    """The least (or by ``pick`` the largest) of every ``span`` neighbours."""
    size = 1
    while size * 2 <= span:
        h, size = pick(h[:-size], h[size:]), size * 2
    return pick(h[:len(h) - span + size], h[span - size:]) if span > size else h


def _anchors(keys: list[str], width: int):
    """The places whose gram is the least of a window, as hash, keys and place; in each slice one of equal hashes, marked if there are more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, held, size = Grams(width), [], 0
        for batch in batches:
            ids = [batch.column(k) for k in keys]
            for row, text in enumerate(batch.column("text")):
                data = np.frombuffer(text.as_py() or b"", np.uint8)
                for at, h, least, _ in grams.slices(data):
                    top = _least(np.pad(least, grams.span - 1), grams.span, np.maximum)
                    value, first, count = np.unique(h[place := np.flatnonzero(top == h)], return_index=True, return_counts=True)
                    where = (at + place[first]).astype(np.int64)
                    held.append((value, np.where(count > 1, where | TWICE, where), *(np.full(len(value), x[row].as_py(), np.int64) for x in ids)))
                    size += len(value)
                if size >= FLUSH:
                    yield from _combined(keys, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from _combined(keys, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _gathered(data: np.ndarray, low: np.ndarray, n: np.ndarray, by: int = 1) -> pa.Array:
    """The n bytes from each place on, or (by -1) before it, read backwards."""
    ends = np.append(0, np.cumsum(n))
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n)
    flat = data[np.repeat(low, n) + at] if by > 0 else data[np.repeat(low, n) - 1 - at]
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat)])


def _matrix(of: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column as rows filled up with zeros, and their lengths."""
    ends = np.frombuffer(of.buffers()[1], np.int32)[of.offset:of.offset + len(of) + 1]
    n = np.diff(ends).astype(np.int64)
    out = np.zeros((len(of), width), np.uint8)
    if len(of) and ends[-1] > ends[0]:
        out[np.arange(width) < n[:, None]] = np.frombuffer(of.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    return out, n


def _alike(data: np.ndarray, low: np.ndarray, n: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The first row with the same bytes around its anchor, for each row of n bytes from ``low`` on: hashes propose, bytes decide."""
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    first = first[of]
    later = np.flatnonzero(first != np.arange(len(low)))
    for i in range(0, len(later), BLOCK):
        x = later[i:i + BLOCK]
        y = first[x]
        same = (n[x] == n[y]) & (place[x] - low[x] == place[y] - low[y])
        size = np.where(same, n[x], 0)
        a, b = (_matrix(_gathered(data, low[k], size), int(size.max(initial=1)))[0] for k in (x, y))
        first[x] = np.where(same & (a == b).all(axis=1), y, x)
    return first


def _suffixes(keys: list[str], width: int):
    """The sampled suffixes: hash of the gram, bytes from it on and before it (backwards), as far as its windows reach, keys, places; in each slice equal ones once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(width)
        for batch in batches:
            held: list[list[pa.Array]] = []
            for row, text in enumerate(batch.column("text")):
                found = np.unique(batch.column("grams")[row].values.to_numpy(zero_copy_only=False))
                ids = [batch.column(k)[row].as_py() for k in keys]
                for at, h, least, sums in grams.slices(data := np.frombuffer(text.as_py() or b"", np.uint8)):
                    own = found[(found >= at) & (found < at + len(h))] - at
                    if not len(own):
                        continue
                    part = data[at:at + len(sums) - 1]
                    start, end, place = grams.anchored(h, least, own)
                    n = end - start + width - 1
                    first = _alike(part, start, n, place, _spread((sums[start + n] - sums[start]) * grams.down[start]))
                    order = np.argsort(first, kind="stable")
                    one = np.flatnonzero(first == np.arange(len(first)))
                    count = np.bincount(first, minlength=len(first))[one]
                    ends = np.append(0, np.cumsum(count))
                    places = (at + place[order]).astype(np.int32)
                    for i in range(0, len(one), BLOCK):
                        x, e = one[i:i + BLOCK], ends[i:i + BLOCK + 1]
                        held.append([pa.array(h[place[x]].view(np.int64)), _gathered(part, place[x], start[x] + n[x] - place[x]), _gathered(part, place[x], place[x] - start[x], -1),
                                     *(pa.array(np.full(len(x), k, np.int64)) for k in ids),
                                     pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(((e - e[0]) * 4).astype(np.int32)), pa.py_buffer(places[e[0]:e[-1]])])])
                        if sum(len(y[0]) for y in held) >= BLOCK:
                            yield _joined(held, keys)
                            held = []
            if held:
                yield _joined(held, keys)

    return run


def _joined(held: list[list[pa.Array]], keys: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*held, strict=True)], ["h", "ahead", "behind", *keys, "places"])


def _prefix(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the row before it."""
    out = np.zeros(len(x), np.int64)
    if len(x) > 1:
        differ = x[1:] != x[:-1]
        out[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), x.shape[1]), np.minimum(n[1:], n[:-1]))
    return out


def _repeats(h: np.ndarray, a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, width: int) -> np.ndarray:
    """Of different sorted suffixes (n bytes a ahead, m bytes b behind): which windows, by the distance of the anchor, another one has too."""
    out = np.zeros((len(h), b.shape[1] + 1), bool)
    same = np.append(False, h[1:] == h[:-1])
    shared = np.where(same, _prefix(a, n), 0)
    # The bytes behind in their own order within a gram.
    words = np.zeros((len(h), -(-b.shape[1] // 8) * 8), np.uint8)
    words[:, :b.shape[1]] = b
    group = np.cumsum(~same)
    order = np.lexsort([m, *words.view(">u8").T[::-1], group])
    back = np.where(np.append(False, group[order][1:] == group[order][:-1]), _prefix(b[order], m[order]), 0)
    back[np.append(True, group[order][1:] != group[order][:-1])] = -1
    for o in range(out.shape[1]):
        here = np.flatnonzero((n >= width - o) & (m >= o))
        if len(here) < 2:
            continue
        ahead = np.cumsum(shared < width - o)[here]
        behind = np.empty(len(h), np.int64)
        behind[order] = np.cumsum(back < o)
        pair = ahead * (len(h) + 1) + behind[here]
        _, of, count = np.unique(pair, return_inverse=True, return_counts=True)
        out[here, o] = count[of] > 1
    return out


def _judge(keys: list[str], width: int, most: int, block: int):
    """From suffixes in order: keys, begin and end of what repeated windows cover. Pieces (k1, k2, many, least, phase, piece) that begin
    at ``begin``, of grams with more than ``most`` different suffixes, are not judged."""
    span = width - width * 7 // 10

    def covers(ids: list[np.ndarray], places: pa.Array, flags: np.ndarray) -> pa.RecordBatch:
        edge = np.diff(np.pad(flags.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, low), (_, high) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        ends = np.frombuffer(places.buffers()[1], np.int32)[places.offset:places.offset + len(places) + 1] // 4
        n = np.diff(ends)[row]
        at = np.frombuffer(places.buffers()[2], np.int32)[np.repeat(ends[row] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64) if len(row) else np.empty(0, np.int64)
        begin, end = at - np.repeat(high - 1, n), at + width - np.repeat(low, n)
        return _rows(keys, [np.repeat(x[row], n) for x in ids], begin, end)

    def pieces(t: pa.Table, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(len(t)):
            behind = t.column("behind")[i].as_py()
            piece = behind[::-1] + t.column("ahead")[i].as_py()
            at = np.frombuffer(t.column("places")[i].as_py(), np.int32).astype(np.int64)
            yield _rows(keys, [np.full(len(at), t.column(k)[i].as_py(), np.int64) for k in keys], at - len(behind), None, (piece, bool(many[i]) or len(at) > 1, t.column("h")[i].as_py(), len(behind) % PERIOD))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known, heavy, fresh = [], np.zeros(0, bool), None, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                fresh += len(batch)
            if not held or batch is not None and fresh < block:
                continue
            fresh = 0
            t = pa.Table.from_batches(held).combine_chunks()
            held, many = [], np.append(known, np.zeros(len(t) - len(known), bool))
            known = np.zeros(0, bool)
            h = t.column("h").to_numpy()
            if heavy is not None:
                k = int(np.argmax(np.append(h != heavy, True)))
                yield from pieces(t.slice(0, k), many[:k])
                t, h, many = t.slice(k).combine_chunks(), h[k:], many[k:]
                heavy = heavy if not len(h) else None
            if not len(h):
                continue
            column = lambda c: t.column(c).chunk(0)  # noqa: E731, B023
            (a, n), (b, m) = _matrix(column("ahead"), width), _matrix(column("behind"), span)
            ids = [t.column(k).to_numpy() for k in keys]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (n[1:] != n[:-1]) | (m[1:] != m[:-1]) | (a[1:] != a[:-1]).any(axis=1) | (b[1:] != b[:-1]).any(axis=1)))
            count = np.diff(np.append(first, len(h)))
            places = np.diff(np.frombuffer(column("places").buffers()[1], np.int32)[column("places").offset:column("places").offset + len(h) + 1]) // 4
            several = (count > 1) | np.logical_or.reduceat(many | (places > 1), first)
            # The last gram may go on in the next rows: one of each of its suffixes waits.
            last = len(h) if batch is None else int(np.flatnonzero(np.append(True, h[1:] != h[:-1]))[-1])
            done = int(np.searchsorted(first, last))
            o = np.arange(span + 1)
            flags = (o <= m[:, None]) & (o >= width - n[:, None])
            open_ = first[:done]
            flags[open_] &= several[:done, None]
            alone = np.append(True, h[open_][1:] != h[open_][:-1])
            mixed = np.flatnonzero(~(alone & np.append(alone[1:], True))) if done else np.empty(0, np.int64)
            if len(mixed):
                x = open_[mixed]
                flags[x] |= _repeats(h[x], a[x], n[x], b[x], m[x], width)
            wait = first[done:]
            flags[wait] = False
            yield covers(ids, column("places"), flags)
            if len(wait):
                rest, known = t.take(pa.array(wait)), several[done:]
                if len(wait) > most:
                    heavy = int(h[-1])
                    yield from pieces(rest, known)
                    known = np.zeros(0, bool)
                else:
                    held = rest.combine_chunks().to_batches()

    return run


def _rows(keys: list[str], ids: list[np.ndarray], begin: np.ndarray, end: np.ndarray | None, piece: tuple[bytes, bool, int, int] | None = None) -> pa.RecordBatch:
    n = len(begin)
    k = np.frombuffer(xxhash.xxh3_128_digest(piece[0]), np.int64).tolist() if piece else [None, None]
    rest = [*k, *(piece[1:] if piece else [None] * 3), piece and piece[0]]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(begin), pa.nulls(n, pa.int64()) if end is None else pa.array(end), *(pa.array([v] * n, kind) if piece else pa.nulls(n, kind) for v, kind in zip(rest, kinds, strict=True))],
                                      [*keys, "begin", "end", "k1", "k2", "many", "least", "phase", "piece"])


class Step(NamedTuple):
    """A sort: of sampled places by three shifted words or names (``kind`` words, names), of sampled windows (whole), or of the windows that a bit map asks for (ends)."""

    kind: str
    depth: int
    shifts: tuple[int, ...] = ()
    width: int = 0


def steps(width: int) -> list[Step]:
    """Rounds of naming, as deep as leaves room for every shift below the period; further shifts are multiples of it, so they stay in the sample."""
    depth, most = 24, width - PERIOD + 1
    if most < depth:
        raise ValueError(f"strings of at least {depth + PERIOD - 1} bytes")
    out = [Step("words", depth, (0, 8, 16))]
    while most - depth >= PERIOD:
        one = depth // PERIOD * PERIOD
        two = min((one + depth) // PERIOD, (most - depth) // PERIOD) * PERIOD
        out.append(Step("names", depth + two, (0, min(one, two), two)))
        depth += two
    return [*out, Step("whole", depth, width=width), Step("ends", depth, width=width)]


def _mixed(keys: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        out = (out ^ k.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


class Group:
    """The pieces of a group behind one another, in the order of their keys, with their names and the windows found so far."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks().sort_by([("k1", "ascending"), ("k2", "ascending")])
        pieces, names, found = (self.table.column(c).to_pylist() for c in ("piece", "names", "found"))
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.start = np.repeat(self.starts, self.lengths)
        self.left = self.start + np.repeat(self.lengths, self.lengths) - np.arange(len(self.data))
        self.many = np.repeat(np.array(self.table.column("many").to_pylist(), bool), self.lengths)
        self.found = None if found[0] is None else np.frombuffer(b"".join(found), bool)
        phase = np.repeat(self.table.column("phase").to_numpy(), self.lengths)
        self.residue = ((np.arange(len(self.data)) - self.start - phase) % PERIOD).astype(np.int8)
        self.names = None if names[0] is None else np.full(len(self.data), -1, np.int64)
        if self.names is not None:
            self.names[self.sampled()] = np.frombuffer(b"".join(names), np.int64)

    def sampled(self, d: int = 0) -> np.ndarray:
        return np.isin(np.arange(PERIOD) + d, [c + k * PERIOD for c in COVER for k in (0, 1)])[self.residue]

    def packed(self, places: Iterable[np.ndarray], n: int) -> np.ndarray:
        out = np.zeros(n, np.uint64)
        for at in places:
            out = (out << np.uint64(8)) | self.data[at].astype(np.uint64)
        return out

    def shifted(self, at: np.ndarray, d: int, step: Step) -> list[np.ndarray]:
        """Keys of windows in the order of shift d: the name d behind the start, the shift, the bytes before and behind it."""
        other = lambda ks: (at + k + (step.depth if k >= d else 0) for k in ks)
        n = step.width - step.depth
        return [self.names[at + d], np.full(len(at), d, np.int64), self.packed(other(range(min(n, 8))), len(at)).view(np.int64), self.packed(other(range(8, n)), len(at)).view(np.int64)]

    def windows(self, step: Step, mask: np.ndarray, shifts: range, asked: Callable | None = None) -> list[np.ndarray]:
        """Places and keys; each shift is picked (by ``asked`` of its keys' hashes) before the next is made."""
        parts = []
        for d in shifts:
            at = np.flatnonzero(mask & self.sampled(d))
            at = at[self.names[at + d] >= 0]
            part = [at, *self.shifted(at, d, step)]
            if asked is not None:
                here = np.flatnonzero(asked(_mixed(part[1:])))
                part = [x[here] for x in part]
            parts.append(part)
        return [np.concatenate(p) for p in zip(*parts, strict=True)]

    def open(self, step: Step) -> list[np.ndarray]:
        """The windows that are neither found nor between two that are, and cover no byte beside theirs."""
        window, here = self.left >= step.width, np.arange(len(self.data))
        known = (self.found | self.many) & window
        low = np.maximum.accumulate(np.where(known, here, -1))
        high = np.minimum.accumulate(np.where(known, here, len(here) * 2)[::-1])[::-1]
        between = (low >= self.start) & (high < here + self.left) & (high - low <= step.width)
        return self.windows(step, window & ~known & ~between, range(1, PERIOD))

    def keys(self, step: Step, bits: np.ndarray | None) -> list[np.ndarray]:
        """Places and the four parts of their keys."""
        if step.kind == "whole":
            return self.windows(step, self.left >= step.width, range(1))
        if step.kind == "ends":
            return self.windows(step, self.left >= step.width, range(1, PERIOD), lambda h: bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)])
        at = np.flatnonzero((self.left >= step.depth) & self.sampled())
        if step.kind == "words":
            keys = [(self.packed([at + k + j for j in range(8)], len(at)) ^ np.uint64(1 << 63)).view(np.int64) for k in step.shifts]
        else:
            for k in step.shifts:
                at = at[self.names[at + k] >= 0]
            keys = [self.names[at + k] for k in step.shifts]
        return [at, *keys, np.zeros(len(at), np.int64)]

    def slots(self, step: Step, bits: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Places in an order that brings equal keys together, whether a key is new there, and the keys."""
        at, *keys = self.keys(step, bits)
        order = np.argsort(_mixed(keys), kind="stable")
        at, keys = at[order], [k[order] for k in keys]
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        return at, new, *keys

    def named(self, names: pa.Table, step: Step, bits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and the names they got, -1 for none."""
        at, new, *_ = self.slots(step, bits)
        by_slot = np.full(int(new.sum()), -1, np.int64)
        by_slot[names.column("slot").to_numpy()] = names.column("name").to_numpy()
        return at, by_slot[np.cumsum(new) - 1]

    def cut(self, flat: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        """Values of all places, or of those of the mask, as bytes for each piece."""
        return pa.array([(flat[a:a + n] if mask is None else flat[a:a + n][mask[a:a + n]]).tobytes() for a, n in zip(self.starts, self.lengths, strict=True)], pa.binary())


def _columns(step: Step) -> list[str]:
    """The parts of a key: three, or four where more than eight bytes stand beside the name."""
    return ["a0", "a1", "a2", "a3"][:4 if step.width - step.depth > 8 else 3]


def _sent(step: Step, bits, bounds):
    """Each different key of a group: who (group and its number there), its bucket of first parts and whether it stands there twice, in one number, and its parts."""

    def run(table: pa.Table) -> pa.Table:
        group = Group(table)
        at, new, *keys = group.slots(step, bits and bits.value)
        first = np.flatnonzero(new)
        twice = np.diff(np.append(first, len(at))) > 1
        if len(first):
            twice |= np.logical_or.reduceat(group.many[at], first)
        who = (table.column("g")[0].as_py() << 32) + np.arange(len(first))
        bucket = np.searchsorted(bounds, keys[0][first], "right") << 1 | twice
        return pa.table({"who": pa.array(who), "bucket": pa.array(bucket), **{c: pa.array(x[first]) for c, x in zip(_columns(step), keys, strict=False)}})

    return run


def _named(step: Step):
    """From sorted keys: names by rank for the keys that stand twice, by the order of buckets and a count within."""

    def named(cols: list[np.ndarray], new: np.ndarray, name: int) -> pa.RecordBatch:
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(new)))
        good = np.repeat((count > 1) | np.logical_or.reduceat((cols[1] & 1).astype(bool), first), count)
        made = ((cols[1] >> 1 << 40) + name + np.cumsum(new))[good]
        return pa.RecordBatch.from_arrays([pa.array(cols[0][good] >> 32), pa.array(cols[0][good] & 0xFFFFFFFF), pa.array(made)], ["g", "slot", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = 0, None
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("who", "bucket", *_columns(step))]
            cols = cols if held is None else [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[2:]])
            last = int(np.flatnonzero(new)[-1])
            held = [c[last:] for c in cols]
            if last:
                yield named([c[:last] for c in cols], new[:last], name)
                name += int(new[:last].sum())
        if held is not None:
            new = np.zeros(len(held[0]), bool)
            new[0] = True
            yield named(held, new, name)

    return run


def _kept(step: Step):
    """The group with the names, or the windows found, of a step."""

    def run(pieces: pa.Table, names: pa.Table) -> pa.Table:
        group = Group(pieces)
        at, got = group.named(names, step, None)
        table = group.table.select(["g", "k1", "k2", "many", "phase", "piece"])
        if step.kind == "whole":
            found = np.zeros(len(group.data), bool)
            found[at[got >= 0]] = True
            return table.append_column("names", group.cut(group.names, group.sampled())).append_column("found", group.cut(found))
        out = np.full(len(group.data), -1, np.int64)
        out[at] = got
        return table.append_column("names", group.cut(out, group.sampled())).append_column("found", pa.nulls(len(table), pa.binary()))

    return run


def _asked(step: Step):
    def run(table: pa.Table) -> pa.Table:
        _, *keys = Group(table).open(step)
        return pa.table({"h": pa.array(np.unique(_mixed(keys)).view(np.int64))})

    return run


def _spans(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge[::2], edge[1::2]


def _judged(step: Step, bits):
    def run(pieces: pa.Table, names: pa.Table) -> pa.Table:
        group = Group(pieces)
        at, got = group.named(names, step, bits.value)
        repeated = (group.many | group.found) & (group.left >= step.width)
        repeated[at[got >= 0]] = True
        begins, ends = [], []
        for a, n in zip(group.starts, group.lengths, strict=True):
            x, y = _spans(covered(np.flatnonzero(repeated[a:a + n]), step.width, n))
            begins.append(x)
            ends.append(y)
        kind = pa.list_(pa.int64())
        return pa.table({"k1": group.table.column("k1"), "k2": group.table.column("k2"), "begins": pa.array(begins, kind), "ends": pa.array(ends, kind)})

    return run


def repeated_spans(pieces: DataFrame, width: int = WIDTH) -> DataFrame:
    """By the suffix array of the different pieces (k1, k2, many, least, phase, piece): k1, k2, begins, ends of what repeated windows cover."""
    spark = pieces.sparkSession
    size = pieces.agg(F.sum(F.octet_length("piece"))).first()[0] or 0
    if not size:
        return spark.createDataFrame([], "k1 long, k2 long, begins array<long>, ends array<long>")
    groups = -(-size // GROUP) or 1
    # Pieces with one least hash are mostly alike: in one group, they send what they share once. Many of them are split.
    parts = pieces.groupBy("least").agg(F.ceil(F.sum(F.octet_length("piece")) / GROUP).alias("parts")).filter("parts > 1")
    g = F.pmod(F.xxhash64("least", F.pmod("k1", F.coalesce("parts", F.lit(1)))), F.lit(groups))
    none = F.lit(None).cast("binary")
    now = stored(pieces.join(_small(parts, F.lit(32)), "least", "left").select(g.alias("g"), "k1", "k2", "many", "phase", "piece", none.alias("names"), none.alias("found")))
    bits, n = None, shuffle_partitions(spark)
    for step in steps(width):
        keys = _columns(step)
        row = ", ".join(f"{k} long" for k in ("who", "bucket", *keys))
        if step.kind == "ends":
            asked = stored(now.groupBy("g").applyInArrow(_asked(step), "h long"))
            bits = spark.sparkContext.broadcast(_bit_map(asked, asked.count()))
        # Buckets of first parts by quantiles over a few groups; a wrong guess makes them uneven, not the names wrong.
        some = now.filter(F.pmod(F.xxhash64("g"), F.lit(max(1, groups // 8))) == 0).groupBy("g").applyInArrow(_sent(step, bits, np.empty(0, np.int64)), row)
        at = [k / (4 * n) for k in range(1, 4 * n)]
        bounds = np.unique(np.array(some.agg(F.percentile_approx("a0", at, 10_000)).first()[0] or [], np.int64))
        sent = now.groupBy("g").applyInArrow(_sent(step, bits, bounds), row)
        dealt = sent.repartition(n, F.shiftright("bucket", 1)).sortWithinPartitions(F.shiftright("bucket", 1), *keys)
        names = dealt.mapInArrow(_named(step), "g long, slot long, name long")
        both = now.groupBy("g").cogroup(names.groupBy("g"))
        if step.kind == "ends":
            return stored(both.applyInArrow(_judged(step, bits), "k1 long, k2 long, begins array<long>, ends array<long>"), instead=now)
        now = stored(both.applyInArrow(_kept(step), "g long, k1 long, k2 long, many boolean, phase long, piece binary, names binary, found binary"), instead=now)
    raise AssertionError


def _merged(keys: list[str]):
    """Ranges of a text that touch or overlap as one, which leaves few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: tuple[list, list] = ([], [])
            for begins, ends in zip(batch.column("begins"), batch.column("ends"), strict=True):
                begin, end = np.sort(begins.values.to_numpy()), np.sort(ends.values.to_numpy())
                new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
                lists[0].append(begin[new])
                lists[1].append(end[np.append(new[1:] - 1, len(end) - 1)])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(x, pa.list_(pa.int32())) for x in lists)], [*keys, "begins", "ends"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        for text, begins, ends in zip(batch.column("text"), batch.column("begins"), batch.column("ends"), strict=True):
            text = text.as_py() or b""
            gone, runs = 0, 0
            if begins.is_valid:
                edge = np.zeros(len(text) + 1, np.int32)
                np.add.at(edge, begins.values.to_numpy(), 1)
                np.add.at(edge, ends.values.to_numpy(), -1)
                out = np.cumsum(edge[:-1]) > 0
                gone, runs = int(out.sum()), len(_spans(out)[0])
                text = np.frombuffer(text, np.uint8)[~out].tobytes()
            for c, v in zip(cols, (len(text) + gone, gone, runs, text), strict=True):
                c.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["row", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """The columns of ``df`` without text, and n_bytes, n_removed, n_spans (maximal removed runs), kept (the bytes left)."""
    small_batches(df.sparkSession)
    keys = key_columns(df)
    docs = keyed(df).select("row", F.col("text").cast("binary").alias("text"), *keys)
    long = docs.filter(F.octet_length("text") >= width).select(*keys, "text")
    ids = ", ".join(f"{k} long" for k in keys)
    hits = f"h long, {ids}, at long"
    twice = stored(_repeated(long.mapInArrow(_anchors(keys, width), hits), keys).withColumnRenamed("found", "grams"))
    sampled = long.join(_small(twice, F.lit(48) + 4 * F.size("grams")), keys).mapInArrow(_suffixes(keys, width), f"h long, ahead binary, behind binary, {ids}, places binary")
    order = sampled.repartition(shuffle_partitions(df.sparkSession), "h").sortWithinPartitions("h", "ahead", "behind")
    judged = stored(order.mapInArrow(_judge(keys, width, MOST, BLOCK), f"{ids}, begin long, end long, k1 long, k2 long, many boolean, least long, phase long, piece binary"), instead=twice)
    pieces = judged.filter("piece is not null")
    single = pieces.groupBy("k1", "k2").agg(((F.count("*") > 1) | F.max("many")).alias("many"), F.max("least").alias("least"), F.max("phase").alias("phase"), F.max("piece").alias("piece"))
    ranges = repeated_spans(single, width).filter(F.size("begins") > 0)
    more = pieces.select(*keys, "begin", "k1", "k2").join(_small(ranges, F.lit(64) + 16 * F.size("begins")), ["k1", "k2"])
    more = more.select(*keys, "begin", F.explode(F.arrays_zip("begins", "ends")).alias("x")).select(*keys, (F.col("begin") + F.col("x.begins")).alias("begin"), (F.col("begin") + F.col("x.ends")).alias("end"))
    spans = judged.filter("piece is null").select(*keys, "begin", "end").union(more)
    spans = spans.groupBy(*keys).agg(F.collect_list(F.col("begin").cast("int")).alias("begins"), F.collect_list(F.col("end").cast("int")).alias("ends"))
    spans = stored(spans.mapInArrow(_merged(keys), f"{ids}, begins array<int>, ends array<int>"), instead=judged)
    weight = F.lit(64) + 8 * F.size("begins")
    schema = StructType([docs.schema["row"], *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), StructField("kept", BinaryType())])
    cut = docs.join(_small(spans, weight), keys, "left").select("row", "text", "begins", "ends").mapInArrow(_cut, schema)
    return cut.select(*unpacked([c for c in df.columns if c != "text"], **{c: c for c in ("n_bytes", "n_removed", "n_spans", "kept")}))


def digest(df: DataFrame) -> DataFrame:
    out = remove_repeats(df.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
