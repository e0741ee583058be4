"""UNION ALL views over partition tables, point counts and parameter sweeps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATA_COLUMNS = ("dtanbr", "dtachr")
#: A part with more different values (of key and column) is not summed up.
MOST_VALUES = 100_000


def partition_view(
    parts: Mapping[str, DataFrame],
    columns: tuple[str, ...] = DATA_COLUMNS,
    key: str | None = None,
    bounds: Mapping[str, object] | None = None,
    label: str | None = None,
) -> DataFrame:
    """One lazy table over several partition tables.

    ``key`` adds the partition key column. ``bounds`` declares the one key value
    each part holds: the branch shows it as a literal, so Catalyst drops a branch
    that contradicts a predicate on the key. A row outside the bound of its part,
    or with a null key, is refused: reading its branch raises. ``out_of_bounds``
    lists such rows. ``label`` adds a column with the part's name, which lets
    branches be dropped likewise.
    """
    shown = [*([key] if key else []), *columns]

    def branch(name: str, df: DataFrame) -> DataFrame:
        if bounds is not None:
            value = _bound(df, key, bounds[name])
            refused = F.raise_error(f"Row of {name} outside its bound {bounds[name]!r}").cast("boolean")
            df = df.where(F.when(F.col(key).eqNullSafe(value), True).otherwise(refused)).withColumn(key, value)
        if label:
            return df.select(F.lit(name).alias(label), *shown)
        return df.select(*shown)

    return reduce(DataFrame.unionByName, [branch(n, df) for n, df in parts.items()])


def _bound(df: DataFrame, key: str, value: object) -> Column:
    return F.lit(value).cast(df.schema[key].dataType)


def out_of_bounds(parts: Mapping[str, DataFrame], key: str, bounds: Mapping[str, object]) -> DataFrame:
    """Rows that are not in the part whose bound they meet, with the part's name in ``part``."""
    outside = [
        df.where(~F.col(key).eqNullSafe(_bound(df, key, bounds[name]))).select(F.lit(name).alias("part"), "*")
        for name, df in parts.items()
    ]
    return reduce(DataFrame.unionByName, outside)


def count_where(view: DataFrame, name: str = "n", **equal) -> DataFrame:
    """Count of the rows whose columns equal the given values, as a one-row table."""
    for column, value in equal.items():
        view = view.where(F.col(column) == F.lit(value))
    return view.agg(F.count("*").alias(name))


def count_sweep(view: DataFrame, params: DataFrame, column: str, **equal) -> DataFrame:
    """``count_where`` for every parameter value in one job.

    The view is counted once per distinct value, with map-side aggregation, and
    the parameters look their count up; values that do not occur count 0.
    """
    for name, value in equal.items():
        view = view.where(F.col(name) == F.lit(value))
    counts = view.groupBy(F.col(column).alias("_value")).agg(F.count("*").alias("_n"))
    found = params.join(counts, F.col(column) == F.col("_value"), "left")
    return found.select(*params.columns, F.coalesce("_n", F.lit(0)).alias("n"))


class CountSummary:
    """Counts by value of each part of a partition view, kept beside the data.

    A single count reads no row of a part: it adds up numbers that were counted once.
    The numbers are tied to the files a part consists of; when a part's files have
    changed (rows appended, a file replaced), that part is counted again before the next
    answer. A part with more than ``most_values`` different values has no summary, and its
    counts scan, so what is kept is bounded whatever the data size.
    """

    def __init__(
        self,
        spark: SparkSession,
        parts: Mapping[str, tuple[Sequence[str], Callable[[], DataFrame]]],
        column: str,
        key: str | None = None,
        most_values: int = MOST_VALUES,
    ):
        """``parts`` gives each part's folders or files, and opens it anew, so that files added
        later are seen. An answer that needs no new count costs a listing of the files."""
        self._spark, self._parts, self._column, self._key, self._most = spark, dict(parts), column, key, most_values
        self._held: dict[str, tuple[tuple, dict | None]] = {}

    def refresh(self) -> list[str]:
        """Count the parts whose files have changed; their names."""
        changed, listed = [], {}
        for name, (paths, opened) in self._parts.items():
            files = tuple(listed.get(path) or listed.setdefault(path, _file_states(self._spark, path)) for path in paths)
            if name not in self._held or self._held[name][0] != files:
                self._held[name] = (files, self._counted(opened()))
                changed.append(name)
        return changed

    def _counted(self, df: DataFrame) -> dict | None:
        by = [*([self._key] if self._key else []), self._column]
        rows = df.groupBy(*by).agg(F.count("*").alias("_n")).limit(self._most + 1).collect()
        return None if len(rows) > self._most else {tuple(row[:-1]): row[-1] for row in rows}

    def count(self, value, label: str | None = None, key=None) -> int:
        """Rows whose column equals ``value``, of the part ``label`` only, with the key only, or
        of all. The answer is that of a scan at the moment of the call; null equals nothing."""
        self.refresh()
        total = 0
        for name, (_, counts) in self._held.items():
            if label is not None and name != label:
                continue
            if counts is None:
                equal = {self._column: value} | ({self._key: key} if key is not None else {})
                total += count_where(self._parts[name][1](), **equal).first()[0]
            elif value is not None:
                total += sum(n for own, n in counts.items() if own[-1] == value and (key is None or own[0] == key))
        return total

    def count_table(self, value, name: str = "n", **where) -> DataFrame:
        """``count`` as a one-row table."""
        return self._spark.createDataFrame([(self.count(value, **where),)], f"{name} long")


def _file_states(spark: SparkSession, path: str) -> tuple:
    """The files under a path, each with length and time of change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, states = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        file = found.next()
        states.append((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return tuple(sorted(states))


def sweep_params(first: int, last: int, spark, modulus: int = 255, column: str = "dtanbr") -> DataFrame:
    """Run numbers first … last and the value each asks for, run mod modulus."""
    return spark.range(first, last + 1).select(
        F.col("id").alias("run"), (F.col("id") % modulus).cast("smallint").alias(column)
    )
