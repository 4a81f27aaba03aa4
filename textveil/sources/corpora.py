"""Reading and writing of annotated corpora, chats in JSON, and pools of several sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        *[T.StructField(c, T.StringType()) for c in ("id", "domain", "entity_type", "name_form", "addr_form", "style", "length", "expression", "neg_category", "edge_case")],
        T.StructField("has_typo", T.BooleanType()),
        T.StructField("multi_entity", T.BooleanType()),
        T.StructField("position", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("type", T.StringType())]))),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)
CHAT = "array<struct<role:string,content:string>>"


def read_records(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of JSON lines; blank lines are no records, lines that are no JSON go to rejects with their text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fields = T.StructType([f for f in schema if f.name != "_corrupt_record"])
    parsed = lines.select("value", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in fields]), parsed.where(bad).select(F.col("value").alias("line"))


def append_records(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_offsets(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """text, ents (start, end, label) and split from Parquet with parallel label, start and end arrays, one path for each split."""
    one = lambda split, path: spark.read.parquet(path).select("text", offset_entities(F.col("entity_labels"), F.col("entity_starts"), F.col("entity_ends")).alias("ents"), F.lit(split).alias("split"))
    return pool(*[one(s, p) for s, p in paths.items()])


def offset_entities(labels: Column, starts: Column, ends: Column) -> Column:
    zipped = F.arrays_zip(starts.alias("s"), ends.alias("e"), labels.alias("l"))
    return F.transform(zipped, lambda x: F.struct(x["s"].cast("int").alias("start"), x["e"].cast("int").alias("end"), x["l"].alias("label")))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """tokens and ner_tags, zipped at once so that they can't drift apart."""
    return spark.read.parquet(path).select(F.arrays_zip(F.col("tokens").alias("token"), F.col("ner_tags").alias("tag")).alias("pairs"))


def write_annotated(df: DataFrame, path: str) -> DataFrame:
    """Write by split, read back and check the counts, which the write itself has taken: the number of rows and the sum of their splits' checksums."""
    told = (F.count("*").alias("rows"), F.coalesce(F.sum(F.crc32(F.col("split").cast("string"))), F.lit(0)).alias("splits"))
    seen = Observation()
    df.observe(seen, *told).write.mode("overwrite").partitionBy("split").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if seen.get != back.agg(*told).first().asDict():
        raise ValueError(f"{path}: counts by split differ after reading back")
    return back


def pool(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "source").agg(F.count("*").alias("n"))


def chat_turns(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, turn, role, content) of texts that are JSON chats; others have no turns."""
    return df.select(key, F.posexplode(F.from_json(text, CHAT)).alias("turn", "t")).select(key, "turn", "t.role", "t.content")


def chat_texts(turns: DataFrame, key: str = "conv_id", role: str = "role", content: str = "text") -> DataFrame:
    """(key, text): a JSON chat of each conversation's turns in order. A conversation is one row, so it has to fit into memory."""
    one = F.struct("turn", F.col(role).alias("role"), F.col(content).alias("content"))
    chat = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return turns.groupBy(key).agg(F.to_json(chat).alias("text"))
