"""Masking, numbered placeholders with a vault, restoring, and the policy of blocked types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import bound, chunked, cut, piece, running
from . import resolve
from .detectors import EXTERNAL_SCORE, SPANS, detect

ITEMS = "array<struct<operator:string,entity_type:string,start:int,end:int,text:string>>"
#: A numbered placeholder, as a whole.
PLACEHOLDER = r"<[A-Z_]+_[0-9]+>"


def _rewritten(text: Column, spans: Column, shown, limit: int | None = None) -> Column:
    """The text with each of ``spans`` (in order, disjoint) replaced by ``shown(span)``."""

    def whole(all_: Column, chunks: Column) -> Column:
        before = lambda s, k: F.concat(cut(chunks, F.coalesce(F.get(all_, k - 1)["end"], F.lit(0)), s["start"]), shown(s))
        rest = cut(chunks, F.element_at(all_, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(all_, before), ""), rest)

    out = F.when(F.size(spans) > 0, bound(spans, lambda all_: bound(chunked(text), lambda c: whole(all_, c)))).otherwise(text)
    return out if limit is None else F.left(out, F.lit(limit))


def masked_text(text: Column, spans: Column) -> Column:
    """Spans, resolved to disjoint ones (best score first), replaced by <ENTITY_TYPE>. No spans: the text as it is."""
    return _rewritten(text, resolve.best_disjoint(spans), lambda s: F.concat(F.lit("<"), s["entity_type"], F.lit(">")))


def masked_items(spans: Column) -> Column:
    """The placeholders with their places in the masked text."""
    shown = lambda s: F.concat(F.lit("<"), s["entity_type"], F.lit(">"))
    further = lambda shift, s: shift + F.length(shown(s)) - (s["end"] - s["start"])
    item = lambda shift, s: F.struct(F.lit("replace").alias("operator"), s["entity_type"].alias("entity_type"), (s["start"] + shift).alias("start"), (s["start"] + shift + F.length(shown(s))).alias("end"), shown(s).alias("text"))
    return running(resolve.best_disjoint(spans), F.lit(0), further, lambda shift, s: F.array(item(shift, s)).cast(ITEMS), ITEMS)


def mask(df: DataFrame, text: str = "text", spans: str = "spans", items: bool = False) -> DataFrame:
    out = df.withColumn("masked", masked_text(F.col(text), F.col(spans)))
    return out.withColumn("items", masked_items(F.col(spans))) if items else out


def mask_with(docs: DataFrame, spans: DataFrame, redetect_missing: bool = False, key: str = "doc_id", text: str = "text", items: bool = False) -> DataFrame:
    """Masks with a table of spans (key, entity_type, start, end[, score]); documents without any are left, or, if asked for, searched."""
    score = F.coalesce(F.col("score").cast("double"), F.lit(EXTERNAL_SCORE)) if "score" in spans.columns else F.lit(EXTERNAL_SCORE)
    one = F.struct("entity_type", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), score.alias("score"))
    lists = spans.groupBy(F.col(key).alias("__id")).agg(F.sort_array(F.collect_list(one)).cast(SPANS).alias("__given"))
    found = detect(docs, text, key=key) if redetect_missing else docs.withColumn("spans", F.array().cast(SPANS))
    joined = found.join(lists, F.col(key) == F.col("__id"), "left").drop("__id")
    return mask(joined.withColumn("spans", F.coalesce("__given", "spans")).drop("__given"), text, items=items)


def numbered(text: Column, spans: Column) -> Column:
    """Spans in order with their value and number: one number for each distinct value of a type, by first appearance in the message."""
    one = lambda s, chunks: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), cut(chunks, s["start"], s["end"]).alias("value"))
    full = bound(chunked(text), lambda c: F.transform(resolve.best_disjoint(spans), lambda s: one(s, c)))

    def shown(all_: Column, s: Column) -> Column:
        values = F.array_distinct(F.transform(F.filter(all_, lambda t: t["entity_type"] == s["entity_type"]), lambda t: t["value"]))
        return F.concat(F.lit("<"), s["entity_type"], F.lit("_"), F.array_position(values, s["value"]).cast("string"), F.lit(">"))

    def every(all_: Column) -> Column:  # the list is bound once, not made again for each of its spans
        return F.transform(all_, lambda s: F.struct(s["entity_type"].alias("entity_type"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), shown(all_, s).alias("placeholder")))

    return F.element_at(F.transform(F.array(full), every), 1)


def apply_policy(df: DataFrame, policy: dict[str, str], text: str = "text", key: str = "request_id", role: str | None = None, roles: tuple[str, ...] = ("user",), values: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(passed, rejected, vault) of messages with ``spans``.

    A message with a span of a BLOCK type is rejected whole. In others MASK types get numbered placeholders; the vault has (key,
    placeholder, value). Types without a policy stay as they are. Rows of other roles than ``roles`` pass unchanged. ``values`` names a
    column of what passes, a map of the message's placeholders to their values.
    """
    blocked = [t for t, a in policy.items() if a == "BLOCK"]
    hidden = [t for t, a in policy.items() if a == "MASK"]
    judged = F.coalesce(F.col(role).isin(*roles), F.lit(False)) if role else F.lit(True)
    bad = judged & F.exists("spans", lambda s: s["entity_type"].isin(blocked))
    rejected = df.where(bad)
    mine = F.when(judged, F.filter("spans", lambda s: s["entity_type"].isin(hidden))).otherwise(F.array().cast(SPANS))
    told = df.where(~bad).withColumn("__n", numbered(F.col(text), mine))
    passed = told.withColumn("masked", _rewritten(F.col(text), F.col("__n"), lambda s: s["placeholder"]))
    if values:  # a value that comes twice has one placeholder
        pairs = F.array_distinct(F.transform("__n", lambda s: F.struct(s["placeholder"].alias("key"), s["value"].alias("value"))))
        passed = passed.withColumn(values, F.map_from_entries(pairs))
    passed = passed.drop("__n")
    vault = told.select(key, F.explode("__n").alias("n")).select(key, "n.placeholder", "n.value").distinct()
    return passed, rejected, vault


def restored(text: Column, values: Column) -> Column:
    """Placeholders of a map put back, each as a whole; those that the map lacks stay."""
    marked = F.split(F.regexp_replace(F.translate(text, "\x01", " "), PLACEHOLDER, "\x01$0\x01"), "\x01", -1)
    return F.array_join(F.transform(marked, lambda p: F.coalesce(F.try_element_at(values, p), p)), "")


def restore(answers: DataFrame, vault: DataFrame, key: str = "request_id", text: str = "text") -> DataFrame:
    """Adds ``restored``: one row of the vault's values for each request is joined. Answers without values stay as they are."""
    kept = vault.dropDuplicates([key, "placeholder"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("placeholder", "value"))).alias("__values"))
    out = answers.join(kept, key, "left")
    values = F.coalesce("__values", F.create_map().cast("map<string,string>"))
    return out.withColumn("restored", restored(F.col(text), values)).drop("__values")


def highlight(text: Column, ents: Column, limit: int = 300) -> Column:
    """Entities (start, end, label; in order, disjoint) shown as >>LABEL:text<<, the whole cut to ``limit`` characters."""
    return _rewritten(text, ents, lambda s: F.concat(F.lit(">>"), s["label"], F.lit(":"), piece(text, s["start"], s["end"]), F.lit("<<")), limit)
