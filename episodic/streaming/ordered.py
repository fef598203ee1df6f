"""Ordered folds over streams: the rows of a key wait until the watermark has passed them, then take their turn by time.

The state store must be RocksDB (``spark.sql.streaming.stateStore.providerClass``), as Spark asks for ``transformWithState``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

Step = Callable[[object, Row], tuple[object, tuple | None]]


class _Fold(StatefulProcessor):
    """State of a key: the rows that wait, and what the fold knows (as JSON, so it outlives an upgrade)."""

    def __init__(self, keys: int, step: Step, columns: list[str], schema: T.StructType, out: list[str], keep_ms: int):
        self.keys, self.step, self.columns, self.schema, self.out, self.keep_ms = keys, step, columns, schema, out, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schema)
        self.known = handle.getValueState("known", T.StructType([T.StructField("value", T.StringType()), T.StructField("last", T.LongType())]))

    def _turn(self, key: tuple, rows: list[tuple], now_ms: int) -> Iterator[Row]:
        """Folds the rows that the watermark has passed; the others wait, and a timer wakes the key for the first of them."""
        ready = sorted((r for r in rows if r[0] < now_ms * 1000), key=lambda r: r[:2])
        wait = [r for r in rows if r[0] >= now_ms * 1000]
        found = self.known.get() if self.known.exists() else None
        value, last = (json.loads(found[0]), found[1]) if found else (None, None)
        for r in ready:
            value, made = self.step(value, Row(*self.columns)(*r))
            last = r[0]
            if made is not None:
                yield Row(*self.out)(*key, r[0], *made, False)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if wait:
            self.waiting.put(wait)
            self.handle.registerTimer(min(r[0] for r in wait) // 1000 + 1)
        else:
            self.waiting.clear()
        if last is not None and not wait and last // 1000 + self.keep_ms < now_ms:
            self.known.clear()
        elif last is not None:
            self.known.update((json.dumps(value), last))
            if not wait:
                self.handle.registerTimer(last // 1000 + self.keep_ms + 1)

    def _held(self) -> list[tuple]:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now, held = timerValues.getCurrentWatermarkInMs(), self._held()
        for r in rows:
            own = tuple(r)[self.keys:]
            if own[0] < now * 1000:
                yield Row(*self.out)(*key, own[0], *[None] * (len(self.out) - self.keys - 2), True)
            else:
                held.append(own)
        yield from self._turn(key, held, now)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._turn(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def fold_stream(df: DataFrame, keys: list[str], at: str, delay: str, step: Step, out: str, keep_ms: int, rank: Column | None = None) -> DataFrame:
    """A fold over the rows of each key in order of ``at`` (a timestamp), then ``rank``: keys, t_us, ``out``, late.

    ``step`` takes what it returned last (None at first; plain values) and a row (t_us, rank and the other columns) and
    gives the next value and a tuple of ``out`` or None. Whatever the order in which rows arrive within ``delay``, the
    result is that of the rows in order. A row that the watermark has passed comes too late: it is not folded but returned
    with ``late`` true and nulls, so late rows can be counted. What is known of a key goes ``keep_ms`` after its last
    row; ``step`` must not need it for longer. Rows without a time are left out.
    """
    others = [c for c in df.columns if c not in (*keys, at)]
    # The column of the watermark itself is not passed on: Spark would drop late rows by it before they can be counted.
    rows = df.filter(F.col(at).isNotNull()).withWatermark(at, delay).select(*keys, F.unix_micros(at).alias("t_us"), (F.lit(0) if rank is None else rank).cast("int").alias("rank"), *others)
    fields = rows.schema.fields
    made = T._parse_datatype_string(out).fields if out else []
    schema = T.StructType([*fields[:len(keys)], T.StructField("t_us", T.LongType()), *made, T.StructField("late", T.BooleanType())])
    fold = _Fold(len(keys), step, rows.columns[len(keys):], T.StructType(fields[len(keys):]), schema.names, keep_ms)
    return rows.groupBy(*keys).transformWithState(fold, schema, "append", "EventTime")


def cooldown_stream(df: DataFrame, keys: list[str], at: str, seconds: float, delay: str) -> DataFrame:
    """``intervals.cooldown`` over a stream: keys, t_us, late."""
    c = int(round(seconds * 1_000_000))

    def step(last: int | None, row: Row) -> tuple[int, tuple | None]:
        return (row.t_us, ()) if last is None or row.t_us - last >= c else (last, None)

    return fold_stream(df.select(*keys, at), keys, at, delay, step, "", c // 1000 + 1)


def alerts_shown_stream(df: DataFrame, keys: list[str], at: str, delay: str, hold: float = 3.0) -> DataFrame:
    """``policy.alerts_shown`` over a stream of frames and alerts (``is_frame`` tells which; alerts have a severity):
    for each frame keys, t_us, alerts, severity, late."""
    span = int(hold * 1_000_000)

    def step(held: list | None, row: Row) -> tuple[list, tuple | None]:
        held = [x for x in held or [] if x[0] >= row.t_us - span]
        if not row.is_frame:
            return ([*held, [row.t_us, row.severity]] if row.severity is not None else held), None
        return held, (len(held), max((s for _, s in held), default=None))

    rows = df.select(*keys, at, F.coalesce("is_frame", F.lit(False)).alias("is_frame"), F.col("severity").cast("double").alias("severity"))
    return fold_stream(rows, keys, at, delay, step, "alerts long, severity double", span // 1000 + 1, F.col("is_frame").cast("int"))
