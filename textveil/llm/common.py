"""What all operators of this subpackage share: tables, the shared folder, written stages and bounded Arrow chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Stands for a null id inside an operator, so that joins on ids keep such rows. It sorts before every other id.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold inside the block only; ``__`` stands for a dot."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, **settings: str) -> DataFrame:
    """Cut the lineage: write the rows as Parquet into the shared folder and read them from there.

    Once they stand there, nothing needs the shuffle files behind them: Spark drops these at the end of the write.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with setting(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", **settings):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by written() that no later step reads."""
    spark = df.sparkSession
    bare = lambda x: x.split(":", 1)[1].lstrip("/") if ":" in x else x.lstrip("/")
    inside = bare(shared_folder(spark))
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare(path).startswith(inside):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: For stages that send whole texts to Python functions of columns: batches of 10,000 rows would hold tens of MB for each task.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2000"}


def positional(df: DataFrame, *keep: str) -> DataFrame:
    """All columns under names by position (__c0, __c1 and so on) but ``keep``, so that no name of the input can clash with one of an operator."""
    return df.toDF(*[c if c in keep else f"__c{k}" for k, c in enumerate(df.columns)])


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``gone`` (doc_id); null ids count as one id. All columns as they are."""
    ids_ = gone.select(id_key().alias("__key")).distinct()
    mine = positional(docs, "doc_id").withColumn("__key", id_key())
    return mine.join(ids_, "__key", "left_anti").drop("__key").toDF(*docs.columns)


def id_key(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_value(name: str = "doc_id") -> Column:
    return F.when(F.col(name) != NULL_ID, F.col(name))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary Arrow column as one array, with the rows' offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def ids(batch: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False).astype(np.int64)


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x := columns[f.name], pa.Array) else pa.array(x, f.type) for f in schema], schema=schema)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary Arrow column over one byte array."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data, np.uint8).tobytes())])


#: Keys with more than one in so many rows are sent to all tasks: no more than this many can be.
HOT = 10_000


def is_hot(members: Column, total: int) -> Column:
    """At most HOT keys of ``total`` rows are: those with more than 1/HOT of them, and more than 20."""
    return members * HOT > max(total, 20 * HOT)


def spread_join(many: DataFrame, few: DataFrame, key: str, members: str, total: int) -> DataFrame:
    """Inner join where ``few`` has a row for each key with its number of rows in ``many``: rows of a hot key don't meet in a task, as its row of ``few`` is broadcast."""
    hot = few.where(is_hot(F.col(members), total))
    cold = few.where(~is_hot(F.col(members), total))
    return many.join(F.broadcast(hot), key).unionByName(many.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows, written, with ``rank``: each row's place (long, from 0) in the order of the columns, nulls first. Rows that are equal in these take any order among them.

    Ranges of the order are sorted side by side, and equal rows may lie in several ranges. The driver takes one sum for each range.
    """
    n = 4 * partitions(df.sparkSession)
    salted = df.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    put = written(salted.repartitionByRange(n, *order, "__salt").sortWithinPartitions(*order).drop("__salt").withColumn("__at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(put.groupBy(part.alias("part")).agg(F.max(place) + 1).collect())
    starts, total = [], 0
    for k in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    return put.withColumn("rank", F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), part + 1) + place).drop("__at")
