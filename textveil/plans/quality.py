"""Checks of synthetic records: which rule each record fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import occurrences


def sentences(text: Column) -> Column:
    """Runs of text that a mark, or the end, closes."""
    return F.regexp_count(F.trim(text), F.lit(r"[^.!?…\s][^.!?…]*(?:[.!?…]+|$)"))


def rules() -> dict[str, Column]:
    """name: true where a record (the columns of the record schema, and address where there is one) fails it."""
    text, ents = F.col("text"), F.coalesce("entities", F.array().cast("array<struct<text:string,type:string>>"))
    types = F.array_sort(F.array_distinct(F.transform(ents, lambda e: e["type"])))
    kind = F.col("entity_type")
    both = F.array(F.lit("ADDRESS"), F.lit("NAME"))
    wanted = F.when(kind == "NEGATIVE", F.array().cast("array<string>")).when(kind.isin("NAME_ONLY", "NAME_CONTEXT"), F.array(F.lit("NAME"))).when(kind == "ADDRESS_ONLY", F.array(F.lit("ADDRESS"))).when(kind == "BOTH", both)
    places = F.flatten(F.transform(ents, lambda e: occurrences(text, e["text"])))
    first = F.array_min(F.transform(places, lambda s: s["start"]))
    last = F.array_max(F.transform(places, lambda s: s["end"]))
    n = F.length(text)
    size = sentences(text)
    return {
        "entity_in_text": ~F.forall(ents, lambda e: F.contains(text, e["text"])),
        "types_agree": types != wanted,
        "multi_has_two": F.col("multi_entity") & (F.size(ents) < 2),
        "position": F.when(F.col("position") == "beginning", first > n / 3).when(F.col("position") == "end", last < 2 * n / 3),
        "length": F.when(F.col("length") == "short", size != 1).when(F.col("length") == "medium", ~size.between(2, 4)).when(F.col("length") == "long", size < 4),
    }


def check_records(df: DataFrame, key: str = "id", address: str | None = None) -> DataFrame:
    """(key, rule) of each failed rule; ``address`` names a column whose text has to stand in the record."""
    all_ = rules()
    if address:
        all_["address_verbatim"] = ~F.contains(F.col("text"), F.col(address))
    failed = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in all_.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(failed).alias("rule"))


def missing_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: how many records lack each column."""
    return df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns])
