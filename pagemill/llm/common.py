"""What the operators of this subpackage share: work tables and Arrow column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.shared import delete, release, work_folder
from pagemill.functions.shipping import ship


def map_arrow(df: DataFrame, f: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


class WorkTables:
    """Parquet tables in the shared folder: they cut lineage and survive lost executors.

    An operator drops a table once no later step reads it. Those that its lazy result still reads
    stay until ``pagemill.functions.shared.release``, or the end of the process.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = work_folder(spark, what)
        self._n = 0
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and give it back as a scan of what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(kept)] = (kept, path)
        return kept

    def frames(self) -> list[DataFrame]:
        return [df for df, _ in self._paths.values()]

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            _, path = self._paths.pop(id(df))
            delete(path, self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep_only(self, *frames: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*[df for df, _ in list(self._paths.values()) if not any(df is f for f in frames)])

    def drop_all(self) -> None:
        release(self.root)
        self._paths.clear()


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes in memory, over all its columns."""

    def of(c: Column, t: T.DataType) -> Column:
        if isinstance(t, (T.StringType, T.BinaryType)):
            return F.octet_length(c)
        if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)):
            return F.greatest(F.size(c), F.lit(0)) * 8
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(c)) if not isinstance(t, T.ArrayType) else F.octet_length(F.to_json(F.struct(c)))
        return F.lit(8)

    own = [F.coalesce(of(F.col(f"`{f.name}`"), f.dataType).cast("long"), F.lit(0)) for f in df.schema.fields]
    return sum(own, F.lit(64).cast("long"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts: a part's texts as Python objects, and what is made of them, bound a worker's memory."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def fresh_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or with a number behind it, so that no column of ``taken`` has the name."""
    have, name, k = {c.lower() for c in taken}, wanted, 0
    while name.lower() in have:
        k += 1
        name = f"{wanted}_{k}"
    return name


def append_struct(
    df: DataFrame,
    inputs: list[str],
    make: Callable[[], Callable[..., list[tuple]]],
    result: T.StructType,
    wanted: str = "result",
) -> tuple[DataFrame, str]:
    """``df`` with one more struct column, computed batch by batch from the columns ``inputs``.

    ``make`` is called once for each task and returns a function from Arrow columns to a list of
    tuples, one for each row. All columns pass through untouched; the new column's name clashes
    with none of them.
    """
    name = fresh_name(df.columns, wanted)
    arrow_type = _arrow_struct(result)
    places = [df.columns.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in slices(batches):
            rows = f(*(b.column(i) for i in places))
            fields = [pa.array([r[k] for r in rows], type=arrow_type.field(k).type) for k in range(arrow_type.num_fields)]
            made = pa.StructArray.from_arrays(fields, fields=[arrow_type.field(k) for k in range(arrow_type.num_fields)])
            yield pa.RecordBatch.from_arrays([*b.columns, made], names=[*b.schema.names, name])

    schema = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in df.schema.fields), T.StructField(name, result, True)])
    return map_arrow(df, run, schema), name


def _arrow_struct(t: T.StructType) -> pa.StructType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without making Python strings."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
