"""The hook for a user's own tagger: a function of texts to spans, run in Arrow batches with one model for each worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Spans = list[tuple[str, int, int, float]]


def tagged(docs: DataFrame, load: Callable[[], Callable[[pd.Series], list[Spans]]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity_type, start, end, score), to be given to detect() as ``external``. ``load`` makes the tagger once in each task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tag = load()
        for b in batches:
            found = tag(b["text"].fillna(""))
            yield pd.DataFrame([(k, *s) for k, spans in zip(b["key"], found, strict=True) for s in spans], columns=["key", "entity_type", "start", "end", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, entity_type string, start int, end int, score double").withColumnRenamed("key", key)
