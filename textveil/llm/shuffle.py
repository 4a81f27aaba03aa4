"""Two-pass external shuffle into shards.

Pass one scatters whole records uniformly into buckets that fit into memory, by a seeded hash of their key. Equal records are
interchangeable: a group of them that would take up a part of a bucket is kept as one record with its number, and its copies are
scattered by key and ordinal, over all buckets. Pass two shuffles each bucket with Fisher-Yates (numpy's permutation, seeded by seed
and bucket) and writes it. Buckets follow one another, so a record's place in the whole permutation is its bucket's first place plus
its place there; shards are equal stretches of the permutation (law ``rows``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, id_key, id_value, partitions, scratch, written

BUCKET_BYTES = 16 << 20
#: A group of equal records with more than this part of a bucket is scattered by ordinals, so many at once.
PART, COPIES = 8, 8192
#: Buckets whose first places are summed up together.
STRETCH = 8192


def scatter(records: DataFrame, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int, list[DataFrame]]:
    """Pass one: doc_id, text, size, text_crc32, bucket and before, the first place of the bucket; the number of records; scratch tables that these rows need."""
    spark = records.sparkSession
    data = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = records.select(id_key(key).alias("doc_id"), F.col(text).alias("text"))
    base = base.withColumns({"size": F.length(data).cast("long") + 16, "text_crc32": F.crc32(data), "hash": F.xxhash64("text")})
    alike = ["doc_id", "size", "text_crc32", "hash"]
    groups = written(base.groupBy(*alike).agg(F.count("*").alias("copies")), "groups")
    total = groups.agg(F.sum(F.col("size") * F.col("copies")).alias("b"), F.sum("copies").alias("n"), F.max(F.col("size") * F.col("copies")).alias("most")).first()
    n, buckets = total.n or 0, max(8 * partitions(spark), -(-(total.b or 0) // bucket_bytes))  # several for each task, so that tasks are even
    hashed = lambda *more: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", *more), F.lit(buckets)).cast("int")
    many = (F.col("copies") > 1) & (F.col("size") * F.col("copies") > bucket_bytes // PART)
    few, lots = groups.where(~many), groups.where(many)

    def each(groups: DataFrame) -> DataFrame:
        """A row for each copy, with its ordinal: COPIES at a time go to one task."""
        parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
        parts = parts.repartition(partitions(spark), "doc_id", "hash", "part")
        return parts.withColumn("ordinal", F.explode(F.sequence(F.col("part") * COPIES, F.least(F.col("copies"), (F.col("part") + 1) * COPIES) - 1))).drop("part")

    placed = few.select(hashed().alias("bucket"), "copies")
    base = base.withColumn("bucket", hashed())
    used = []
    if (total.most or 0) > bucket_bytes // PART:
        used = [lots := written(lots, "lots")]
        placed = placed.union(each(lots).select(hashed("ordinal"), F.lit(1).cast("long")))
        met = base.join(lots.select(*alike, "copies"), alike).groupBy(*alike, "copies").agg(F.min("text").alias("text"))
        base = base.join(lots.select(*alike), alike, "left_anti").select("doc_id", "text", "size", "text_crc32", "bucket").union(each(met).select("doc_id", "text", "size", "text_crc32", hashed("ordinal")))
    # first places of buckets: sums within stretches of STRETCH buckets, and of whole stretches in the driver, one row for each
    sizes = written(placed.groupBy("bucket").agg(F.sum("copies").alias("n")).withColumn("stretch", F.expr(f"bucket div {STRETCH}")), "sizes")
    whole = {r.stretch: r.n for r in sizes.groupBy("stretch").agg(F.sum("n").alias("n")).collect()}
    start = np.concatenate(([0], np.cumsum([whole.get(k, 0) for k in range(-(-buckets // STRETCH))]))).tolist()
    inside = Window.partitionBy("stretch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.element_at(F.array(*map(F.lit, start)), (F.col("stretch") + 1).cast("int")) + F.coalesce(F.sum("n").over(inside), F.lit(0))
    return base.join(sizes.select("bucket", before.alias("before")), "bucket"), n, [groups, sizes, *used]


def shuffle(records: DataFrame, path: str, shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the records to ``path`` by shard and return what stands there: doc_id, text, size, text_crc32, slot, shard.

    Rows with equal key and text are told apart only by their order, which doesn't matter: they are equal. However many there are, they
    fill buckets of the same size as other rows. Null ids are ids of their own; a null text has no bytes and stays null. An empty table
    gives empty shards. A bucket is held whole, and so is a text that is longer than one. Columns but ``text`` and ``key`` are not read.
    """
    spark = records.sparkSession
    base, n, scratched = scatter(records, seed, bucket_bytes, text, key)

    def fisher_yates(bucket: pa.Table) -> pa.Table:
        b = bucket.column("bucket")[0].as_py()
        bucket = bucket.sort_by([("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")])
        place = bucket.column("before")[0].as_py() + np.arange(bucket.num_rows)
        shard = place * shards // n
        mixed = bucket.take(np.random.default_rng([seed, b]).permutation(bucket.num_rows)).select(["doc_id", "text", "size", "text_crc32"])
        return mixed.append_column("slot", pa.array(place + (-shard * n) // shards)).append_column("shard", pa.array(shard.astype(np.int32)))

    out = base.groupBy("bucket").applyInArrow(fisher_yates, "doc_id long, text string, size long, text_crc32 long, slot long, shard int")
    out = out.sortWithinPartitions("shard", "slot").withColumn("doc_id", id_value())
    out.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    for done in scratched:
        discard(done)
    return spark.read.schema(out.schema).parquet(path)


def shuffled(records: DataFrame, shards: int, **options) -> DataFrame:
    return shuffle(records, scratch(records.sparkSession, "shards"), shards, **options)
