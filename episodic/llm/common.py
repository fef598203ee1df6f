"""Shared pieces of the text operators: words, row identity, checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and \t \n \v \f \r, nothing else.
SPACES = r"[ \t-\r]+"


def text_of(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order, as an array of strings."""
    return F.array_remove(F.split(text, SPACES), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other character alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: The columns that tell rows apart in ``keyed``.
KEYS = ("d", "t", "u")


def packed(df: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """The columns of ``df`` but the text as one struct ``row``, the text as ``text``, and further columns: no name of the input can clash."""
    rest = [df[f"`{c}`"] for c in df.columns if c != text]
    return df.select(F.struct(*rest or [F.lit(None).cast("string").alias("none")]).alias("row"), df[f"`{text}`"].cast("string").alias("text"), *(c.alias(name) for name, c in more.items()))


def unpacked(columns: list[str], body: str = "text", **new: Column | str) -> list[Column]:
    """Columns to select from a ``packed`` frame: the input's, and the operator's in place of any of the same name."""
    new = {name: F.col(c) if isinstance(c, str) else c for name, c in new.items()}
    old = lambda c: F.col("text") if c == body else F.col("row")[c]
    return [(new.pop(c) if c in new else old(c)).alias(c) for c in columns] + [c.alias(name) for name, c in new.items()]


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``packed`` with ``d``, ``t`` and ``u``, which tell rows apart even where doc_id is null or repeated.

    ``d`` is the doc_id (null: the largest long, so such rows come last in any order), ``t`` and
    ``u`` are 128 bits of hash of the text. Rows that repeat id and text count as one document.
    """
    return packed(df, text, d=F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1)), t=F.xxhash64(text_of(text)), u=F.xxhash64(text_of(text), F.lit(1)))


def key_columns(df: DataFrame, doc_id: str = "doc_id") -> list[str]:
    """The columns of ``keyed`` that tell the rows of ``df`` apart: ``d`` alone where no id is null or repeated."""
    ids = df.select(F.col(doc_id).cast("long").alias("d")).groupBy("d").agg(F.count("*").alias("rows"))
    return ["d"] if ids.filter("rows > 1 or d is null").isEmpty() else list(KEYS)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's Arrow batch size: texts can be long, and a batch stands in memory several times.

    It stays lowered, as frames made here run later; only frames with Python functions are slower for it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; local sessions without one get their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """What is run inside has this setting of the session."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if old is None else spark.conf.set(name, old)


def _shuffles_freed(spark: SparkSession):
    """What is run inside drops its shuffle files at its end: its result lies in the shared folder by then."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared checkpoint folder, which outlives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    with _shuffles_freed(spark):
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame, instead: DataFrame | None = None) -> DataFrame:
    """Like ``checkpoint``, but as a Parquet table, which is compressed; the session's end removes it.

    ``instead`` is an earlier result of this function that is no longer read: its table goes at once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.select("*").write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    files.deleteOnExit(at)
    if old := getattr(instead, "_stored_at", None):
        files.delete(old, True)
    out = spark.read.parquet(path)
    out._stored_at = at
    return out


def split_words(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split() splits at exactly the six ASCII white spaces."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class WordHashes(dict):
    """Memo of 64-bit word hashes, emptied when it grows past its bound."""

    bound = 120_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every window of ``width`` words: a polynomial over the word hashes mod 2**64.

    Equal windows have equal hashes wherever they stand; the result is mixed once more.
    """
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, n), dtype=np.uint64)])
    h = (sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n places lie in a window of ``width`` places from one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + width, n), -1)
    return np.cumsum(edge[:n]) > 0
