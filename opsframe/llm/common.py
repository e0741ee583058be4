"""What several operators share: reading documents, word hashes, batches of bounded size."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsframe.sources.durable import settle

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 500
_SHIPPED: set[str] = set()
#: White space, as a character class; every operator on words uses these six.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_M = np.uint64
_GOLDEN = _M(0x9E3779B97F4A7C15)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text with null as empty, and the columns named; nothing else is read."""
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), *more)


def numbered(df: DataFrame) -> DataFrame:
    """Settle the rows with a number of their own in ``_row``: the row's identity even
    where ids repeat or are null. It is fixed, as the rows are read back from storage."""
    return settle(df.withColumn("_row", F.monotonically_increasing_id()))


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches that stay small with long texts, unless the
    session sets a size itself."""
    if int(spark.conf.get(BATCH_SETTING)) == 10_000:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context: they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)  # Spark's own file server hands it out
        _SHIPPED.add(context.applicationId)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def batch(columns: dict[str, object], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], type=kind) for name, kind in types.items()], names=list(types)
    )


def with_columns(made: pa.RecordBatch, rows: pa.RecordBatch, names: tuple[str, ...]) -> pa.RecordBatch:
    """``made`` with columns of the rows it was made from, as they are."""
    return pa.RecordBatch.from_arrays(
        [*made.columns, *[rows.column(name) for name in names]], names=[*made.schema.names, *names]
    )


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one, so that any of their bits can be used."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def random_longs(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that depend on the seed only."""
    return mixed((np.arange(1, n + 1, dtype=_M) + _M(seed) * _M(1_000_003)) * _GOLDEN) | _M(1)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = random_longs(256, 11)


class WordHasher:
    """Hashes of a text's words, A-Z lowered, computed on whole byte arrays.

    A word's hash is its polynomial over the bytes modulo 2^64: the difference of two
    prefix sums, brought to a common power by the inverse of the base.
    """

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self._base = _M(base)
        self._inverse = _M(pow(base, -1, 1 << 64))
        self._up = np.ones(1, dtype=_M)
        self._down = np.ones(1, dtype=_M)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = 1 << (n - 1).bit_length()
            self._up = np.cumprod(np.concatenate(([_M(1)], np.full(size - 1, self._base))), dtype=_M)
            self._down = np.cumprod(np.concatenate(([_M(1)], np.full(size - 1, self._inverse))), dtype=_M)

    def words(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if not len(raw):
            return np.empty(0, dtype=_M)
        self._powers(len(raw) + 1)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _IS_SPACE[raw], [True])).view(np.int8)))
        start, end = edges[0::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, dtype=_M)
        np.cumsum(_BYTE[_LOWER[raw]] * self._up[: len(raw)], out=sums[1:])
        return mixed((sums[end] - sums[start]) * self._down[start] + (end - start).astype(_M))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of ``width`` words in a row; of all words where there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=_M)
    for k in range(width):
        out = mixed(out + words[k : k + n] * _M(2 * k + 3))
    return np.unique(out)

