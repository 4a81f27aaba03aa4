"""Scores of predicted spans against gold spans: bags of texts, exact places, characters; comparisons and error lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import bound


def normalized(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " ")))


def _counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, g, p): how often each side has a key. Both go into one aggregation, added up before the shuffle; nothing is joined."""
    side = lambda d, g, p: d.select(*keys, F.lit(g).alias("g"), F.lit(p).alias("p"))
    return side(gold, 1, 0).union(side(pred, 0, 1)).groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))


def _summed(counts: DataFrame, by: list[str]) -> DataFrame:
    return counts.groupBy(*by).agg(F.sum(F.least("g", "p")).alias("TP"), F.sum(F.greatest(F.col("p") - F.col("g"), F.lit(0))).alias("FP"), F.sum(F.greatest(F.col("g") - F.col("p"), F.lit(0))).alias("FN"))


def bag_match(gold: DataFrame, pred: DataFrame, labels: list[str]) -> DataFrame:
    """(subset, label, TP, FP, FN) over bags of (normalised text, label) in each document of (subset, doc_id, label, text)."""
    on = lambda d: d.where(F.col("label").isin(labels)).select("subset", "doc_id", "label", normalized(F.col("text")).alias("text"))
    return _summed(_counts(on(gold), on(pred), ["subset", "doc_id", "label", "text"]), ["subset", "label"])


def exact_match(gold: DataFrame, pred: DataFrame, labels: list[str]) -> DataFrame:
    """The same over (start, end, label); a place given twice counts once."""
    keys = ["subset", "doc_id", "label", "start", "end"]
    on = lambda d: d.where(F.col("label").isin(labels))
    once = [F.least(c, F.lit(1).cast("long")).alias(c) for c in ("g", "p")]
    return _summed(_counts(on(gold), on(pred), keys).select(*keys, *once), ["subset", "label"])


def union_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): overlapping and touching intervals of each key joined."""
    by = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0)
    told = spans.where("end > start").withColumn("__new", new)
    return told.withColumn("__island", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__island")


def char_match(gold: DataFrame, pred: DataFrame, labels: list[str]) -> DataFrame:
    """(subset, label, TP, FP, FN) in characters, none of which counts twice for a side. One shuffle; no interval meets another."""
    keys = ["subset", "doc_id", "label"]
    side = lambda d, g, p: d.where(F.col("label").isin(labels) & (F.col("end") > F.col("start"))).select(*keys, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(g).alias("g"), F.lit(p).alias("p")), F.struct(F.col("end").alias("at"), F.lit(-g).alias("g"), F.lit(-p).alias("p")))).alias("x"))
    turns = side(gold, 1, 0).union(side(pred, 0, 1)).select(*keys, "x.*")
    # a sweep over the places where an interval begins or ends: between two of them each side is open or not
    by = Window.partitionBy(*keys).orderBy("at")
    open_ = turns.select(*keys, (F.lead("at").over(by) - F.col("at")).alias("size"), (F.sum("g").over(by) > 0).alias("g"), (F.sum("p").over(by) > 0).alias("p"))
    n = lambda test: F.coalesce(F.sum(F.when(test, F.col("size"))), F.lit(0)).cast("long")
    return open_.groupBy("subset", "label").agg(n(F.col("g") & F.col("p")).alias("TP"), n(~F.col("g") & F.col("p")).alias("FP"), n(F.col("g") & ~F.col("p")).alias("FN"))


def _score(label: Column, tp: Column, fp: Column, fn: Column, digits: int) -> Column:
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return F.struct(label.alias("label"), tp.alias("TP"), fp.alias("FP"), fn.alias("FN"), *[F.round(x, digits).alias(c) for x, c in ((p, "Precision"), (r, "Recall"), (f, "F1"))])


def _macro(each: Column, digits: int) -> Column:
    live = F.filter(each, lambda x: x["TP"] + x["FP"] + x["FN"] > 0)
    total = lambda c: F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x[c])
    # in units of the last digit: their sum is exact, so a mean halfway between two values is rounded up whatever the order
    mean = lambda c: F.round(F.coalesce(F.try_divide(F.aggregate(live, F.lit(0.0), lambda a, x: a + F.round(x[c] * 10**digits)), F.size(live)), F.lit(0.0))) / 10**digits
    return F.struct(F.lit("MACRO").alias("label"), *[total(c).alias(c) for c in ("TP", "FP", "FN")], *[mean(c).alias(c) for c in ("Precision", "Recall", "F1")])


def metrics(counts: DataFrame, labels: list[str], digits: int = 3, by_subset: bool = True) -> DataFrame:
    """Precision, recall and F1 for each subset (and COMBINED) and label, all ``labels`` present, and a MACRO row.

    MACRO is the mean of the rounded values over the labels that have any count, with the counts summed. ``counts`` is read once:
    grouping sets give the subsets and their whole, and a subset's labels are one small row from then on.
    """
    asked = F.array(*map(F.lit, labels)).cast("array<string>")
    sums = counts.where(F.col("label").isNotNull()).groupingSets([["subset", "label"], ["label"]] if by_subset else [["label"]], "subset", "label")
    sums = sums.agg(F.grouping("subset").alias("g"), *[F.sum(c).cast("long").alias(c) for c in ("TP", "FP", "FN")]).withColumn("subset", F.when(F.col("g") == 1, "COMBINED").otherwise(F.col("subset")))
    per = sums.groupBy("subset").agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("TP", "FP", "FN")))).alias("m"))
    n = lambda x, c: F.coalesce(F.try_element_at("m", x)[c], F.lit(0).cast("long"))
    each = F.transform(asked, lambda x: _score(x, n(x, "TP"), n(x, "FP"), n(x, "FN"), digits))
    rows = per.select("subset", F.explode(bound(each, lambda e: F.concat(e, F.array(_macro(e, digits))))).alias("r"))
    return rows.select("subset", "r.*")


def map_labels(spans: DataFrame, mapping: DataFrame) -> DataFrame:
    """Foreign labels by a table (label, to); labels that it lacks go."""
    return spans.join(mapping, "label").withColumn("label", F.col("to")).drop("to")


def recall_any_type(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(label, found, total, recall): gold spans whose place was predicted under any label."""
    places = pred.select("doc_id", "start", "end").distinct().withColumn("hit", F.lit(1))
    told = gold.join(places, ["doc_id", "start", "end"], "left").groupBy("label").agg(F.count("hit").alias("found"), F.count("*").alias("total"))
    return told.withColumn("recall", F.round(F.col("found") / F.col("total"), 4))


def compare_models(scores: DataFrame, models: list[str]) -> DataFrame:
    """F1 by label and model, with a row of macro means."""
    wide = scores.groupBy("label").pivot("model", models).agg(F.max("F1"))
    macro = wide.agg(*[(F.round(F.avg(F.round(F.col(f"`{m}`") * 10_000))) / 10_000).alias(m) for m in models]).select(F.lit("MACRO").alias("label"), *[F.col(f"`{m}`") for m in models])
    return wide.unionByName(macro)


def errors(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(kind, subset, doc_id, label, start, end, text): predictions that aren't gold (FP), gold that wasn't predicted (FN)."""
    keys = ["subset", "doc_id", "label", "start", "end"]
    fp, fn = pred.join(gold, keys, "left_anti"), gold.join(pred, keys, "left_anti")
    return fp.select(F.lit("FP").alias("kind"), *keys, "text").union(fn.select(F.lit("FN").alias("kind"), *keys, "text"))
