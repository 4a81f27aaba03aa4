"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local session (tests) gets a folder of its own, and a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "local").startswith("local") or spark.conf.get("spark.master").startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='textveil-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows that several results need, or whose order has to stand: written once into the shared folder and read from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt_if_small(df: DataFrame, at_most: int = 128 << 20) -> DataFrame:
    """A table of files of ``at_most`` bytes in all, dealt over all cores; a larger one as it is.

    So small a table can be one row group, which one task reads whole, and then searches alone where a search costs far more than
    a shuffle of these few bytes. Larger tables are read in splits as they stand and aren't shuffled.
    """
    spark = df.sparkSession
    conf, size = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(conf).getFileStatus(path).getLen()
        if size > at_most:
            return df
    return df.repartition(2 * spark.sparkContext.defaultParallelism)


def counted(df: DataFrame, key: str, name: str, first: int = 0) -> DataFrame:
    """Adds ``name``: numbers without gaps from ``first`` on, in the order of a key without repetitions.

    Ranges of the key are sorted side by side; a range's first number is the number of rows before it. The driver takes one sum for each range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    put = written(df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()), "counted")
    part, place = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(put.groupBy(part.alias("part")).agg(F.max(place) + 1).collect())
    starts, total = [], first
    for k in range(max(sizes, default=0) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    return put.withColumn(name, F.element_at(F.array(*map(F.lit, starts)).cast("array<long>"), part + 1) + place).drop("__at")
