"""Fill-in-the-middle examples by a parallel automaton scan.

A text is units: runs of letters A-Z, and every other code point by itself. An automaton of four
states reads it: OUT, RUN (inside letters), LT (after ``<``) and MARK (after ``<P``, ``<S`` or
``<M``). Texts beyond one chunk are cut into chunks, and the chunks are dealt over the tasks. Each
chunk emits its function: for every state it may be entered in, the state it ends in, the units
that begin in it, and whether a marker ends in it. Functions compose associatively, so the chunk
functions of a document give each chunk's entry state and first unit; a cut is then selected by
those counts, and only the chunk that holds it is searched for its place. A text of one chunk is a
chunk whose entry state is known: it needs no exchange. Results do not depend on the chunk's size.

The prefix ends after the smaller of two drawn units, the middle after the larger; draws are the
32-bit groups of the SHA-256 of ``1:`` and the decimal doc_id, so reruns agree. A text stays plain
if it is empty, holds a marker, or is drawn to; null is the empty text, a null doc_id has no digits.
Rows that repeat id and text get the same example; an empty table gives an empty result. Columns of
the input named as an output (n, form, prefix_chars, middle_chars, output) are replaced, others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from .common import KEYS, keyed, small_batches, unpacked

OUT, RUN, LT, MARK = range(4)
CHUNK = 1 << 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MADE = (StructField("n", LongType()), StructField("form", StringType()), StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), StructField("output", StringType()))


class Chunk:
    """The automaton over one chunk of text."""

    def __init__(self, text: str):
        self.code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.letter = ((self.code | 32) - np.uint32(97)) < 26

    def begins(self, state: int) -> np.ndarray:
        """Which code points begin a unit, if the chunk is entered in ``state``."""
        out = ~self.letter
        out[1:] |= ~self.letter[:-1]
        out[:1] |= state not in (RUN, MARK)
        return out

    def function(self) -> tuple[list[int], list[int], list[bool]]:
        """For each entry state: the end state, the units that begin, and whether a marker ends here."""
        c, n = self.code, len(self.code)
        if not n:
            return [OUT, RUN, LT, MARK], [0] * 4, [False] * 4
        less, more = c == ord("<"), c == ord(">")
        name = (c == ord("P")) | (c == ord("S")) | (c == ord("M"))
        inside = bool((less[:-2] & name[1:-1] & more[2:]).any())
        units = int(self.begins(OUT).sum())
        ends, counts, found = [], [], []
        for state in range(4):
            counts.append(units - int(self.letter[0] and state in (RUN, MARK)))
            found.append(inside or bool(state == MARK and more[0]) or bool(state == LT and n > 1 and name[0] and more[1]))
            opened = less[-2] if n > 1 else state == LT
            ends.append(LT if less[-1] else MARK if name[-1] and opened else RUN if self.letter[-1] else OUT)
        return ends, counts, found


def compose(first: tuple, then: tuple) -> tuple:
    """The function of two neighbouring chunks from the functions of both."""
    ends, counts, found = first
    return [then[0][e] for e in ends], [k + then[1][e] for k, e in zip(counts, ends, strict=True)], [f or then[2][e] for f, e in zip(found, ends, strict=True)]


def _pieces(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column("text")):
                text = text.as_py()
                ids, count = [batch.column(k)[row].as_py() for k in KEYS], -(-len(text) // size)
                for k in range(0, count, 64):
                    part = [text[i * size:(i + 1) * size] for i in range(k, min(k + 64, count))]
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(part), pa.int64()) for x in ids), pa.array(range(k, k + len(part)), pa.int64()), pa.array(part, pa.string())], [*KEYS, "chunk", "piece"])

    return run


def _functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [Chunk(p.as_py()).function() for p in batch.column("piece")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (*KEYS, "chunk")), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.int64())),
                                          pa.array([[int(f) for f in m[2]] for m in made], pa.list_(pa.int64()))], [*KEYS, "chunk", "ends", "counts", "found"])


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a document's chunk functions in order: its units, and for both cuts the chunk, its entry state and the unit's number there."""
    for batch in batches:
        out = []
        for chunks, draw in zip(batch.column("chunks").to_pylist(), batch.column("draw").to_pylist(), strict=True):
            state, units, marked, entry = OUT, 0, False, []
            for c in chunks:
                entry.append((units, state))
                units, marked, state = units + c["counts"][state], marked or bool(c["found"][state]), c["ends"][state]
            firsts = np.array([u for u, _ in entry], np.int64)
            where = []
            for unit in sorted(d % (units + 1) for d in draw[:2]):
                k = int(np.searchsorted(firsts, unit, "right")) - 1
                where += [len(entry), 0, 0] if unit == units else [k, entry[k][1], unit - entry[k][0]]
            out.append([units, int(marked), *where])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEYS), pa.array(out, pa.list_(pa.int64()))], [*KEYS, "cuts"])


def _made(batch: pa.RecordBatch, made: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*made, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(list(c), f) for c, f in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["row", *(f.name for f in _MADE)])


def _example(text: str, n: int, draw: list[int], marked: bool, cuts, plain: int, spm: int) -> tuple:
    if not text or marked or draw[2] % 100 >= plain:
        return n, "plain", None, None, text
    a, b = cuts()
    p, m, s = text[:a], text[a:b], text[b:]
    swapped = draw[3] % 100 < spm
    return n, "spm" if swapped else "psm", len(p), len(m), f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}" if swapped else f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"


def _short(plain: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, draw in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist(), strict=True):
                chunk = Chunk(text)
                begins = np.append(np.flatnonzero(chunk.begins(OUT)), len(text))
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                made.append(_example(text, len(begins) - 1, draw, marked, lambda begins=begins, draw=draw: sorted(int(begins[d % len(begins)]) for d in draw[:2]), plain, spm))
            yield _made(batch, made)

    return run


def _long(plain: int, spm: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, draw, cuts in zip(batch.column("text").to_pylist(), batch.column("draw").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                def places(text=text, cuts=cuts):
                    for chunk, state, unit in (cuts[2:5], cuts[5:8]):
                        at = chunk * size
                        yield len(text) if at >= len(text) else at + int(np.flatnonzero(Chunk(text[at:at + size]).begins(state))[unit])

                made.append(_example(text, cuts[0], draw, bool(cuts[1]), places, plain, spm))
            yield _made(batch, made)

    return run


def examples(df: DataFrame, rate: int = 90, spm: int = 20, size: int = CHUNK) -> DataFrame:
    """The columns of ``df`` without text, and n, form, prefix_chars, middle_chars, output; ``rate`` percent are cut, ``spm`` percent of those begin with the suffix; chunks have ``size`` code points."""
    small_batches(df.sparkSession)
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    draw = F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))
    docs = keyed(df).withColumns({"draw": draw, "text": F.coalesce("text", F.lit(""))})
    schema = StructType([docs.schema["row"], *_MADE])
    short = docs.filter(F.length("text") <= size).select("row", "text", "draw").mapInArrow(_short(rate, spm), schema)

    giant = docs.filter(F.length("text") > size)
    ids = ", ".join(f"{k} long" for k in KEYS)
    pieces = giant.select(*KEYS, "text").mapInArrow(_pieces(size), f"{ids}, chunk long, piece string").repartition("d", "chunk")
    functions = pieces.mapInArrow(_functions, f"{ids}, chunk long, ends array<long>, counts array<long>, found array<long>")
    # Rows that repeat id and text bring the same functions: a set holds them once. Spark's rows end at 2^31 bytes, so a text has fewer than 2^15 chunks.
    chunks = functions.groupBy(*KEYS).agg(F.sort_array(F.collect_set(F.struct("chunk", "ends", "counts", "found"))).alias("chunks"))
    draws = giant.select(*KEYS, "draw").distinct()
    cuts = chunks.join(draws, list(KEYS)).mapInArrow(_selected, f"{ids}, cuts array<long>")
    long = giant.join(cuts, list(KEYS)).select("row", "text", "draw", "cuts").mapInArrow(_long(rate, spm, size), schema)
    return short.union(long).select(*unpacked([c for c in df.columns if c != "text"], **{f.name: f.name for f in _MADE}))


def restored(output: Column, form: Column) -> Column:
    """The text, read back from an example and its form."""
    at = {m: F.instr(output, m) for m in (PREFIX, SUFFIX, MIDDLE)}

    def between(a: str, b: str | None) -> Column:
        start = at[a] + 3
        return F.substr(output, start, (at[b] if b else F.length(output) + 1) - start)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(df: DataFrame, size: int = CHUNK) -> DataFrame:
    out = examples(df.select("doc_id", "text"), size=size)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


ORACLE = """
with units as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as s from documents),
drawn as (
  select *, len(u)::bigint as n, ('0x' || s[1:8])::bigint as h1, ('0x' || s[9:16])::bigint as h2, ('0x' || s[17:24])::bigint as h3, ('0x' || s[25:32])::bigint as h4 from units),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from drawn),
parts as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as x from cut)
select doc_id, n, form, case when form <> 'plain' then length(p)::bigint end as prefix_chars, case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || x || '<M>' || m else '<S>' || x || '<P>' || p || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256
from parts"""
