"""URL filter: list rules first, then association rules that FP-growth mines from labelled urls.

DataFrame functions and Spark's FP-growth alone. A url's items are its scheme, host labels, path parts and query keys; labelled
urls carry their label as one more item. Labels are a table of the user's, or else the verdicts of the list itself, which the
mined rules carry over to the urls that the list says nothing about. Rules {items} -> bad that pass the support, confidence and
lift thresholds, and that no shorter rule makes superfluous, are found again by an inverted index on each rule's rarest item.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD, GOOD = "label=bad", "label=good"
#: (verdict, host, path) of the list; a rule's name is its host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; without ``://`` empty."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def items_of(url: Column, host: Column, path: Column) -> Column:
    """A url's distinct items; digits in path parts count as one."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "0")))
    query = F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&")
    keys = F.transform(F.filter(query, lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.substring_index(x, "=", 1)))
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.lower(F.substring_index(url, "://", 1))))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, labels, parts, keys))


def list_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's: struct<rule, verdict> or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of) | F.endswith(host, F.lit(f".{of}"))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.struct(F.lit(of + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judged_items(pages: DataFrame, rules=RULES) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    got = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    return got.withColumns({"items": items_of(url, F.col("host"), F.col("path")), "listed": list_rule(F.col("host"), F.col("path"), rules)})


def mine(known: DataFrame, min_support: float = 0.002, min_count: int = 5, min_confidence: float = 0.8, min_lift: float = 1.5) -> DataFrame:
    """Rules (rule_id, items, rarest, confidence, support) from labelled urls ``known`` (items, bad), a row for each.

    A rule needs ``min_support`` of the labelled urls and ``min_count`` of them at least, so that few labels make no rules.
    A rule is dropped where one with a part of its items has at least its confidence: that one fits wherever it does. ``rarest``
    is the item that the fewest labelled urls have.
    """
    baskets = known.select(F.concat("items", F.array(F.when(F.col("bad"), BAD).otherwise(GOOD))).alias("items"))
    support = min(1.0, max(min_support, min_count / max(1, baskets.count())))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BAD) & ~F.array_contains("antecedent", GOOD) & (F.col("lift") >= min_lift))
    rules = rules.select(F.array_sort("antecedent").alias("items"), "confidence", "support").withColumn("rule_id", F.array_join("items", " "))
    index = rules.select("rule_id", "items", "confidence", F.explode("items").alias("item"))
    short = rules.select(F.col("items").alias("part"), F.col("confidence").alias("as_sure"), F.element_at("items", 1).alias("item"))
    covered = index.join(short, "item").where((F.size("part") < F.size("items")) & (F.size(F.array_except("part", "items")) == 0) & (F.col("as_sure") >= F.col("confidence")))
    often = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("item"), "freq")
    rarest = index.join(often, "item").groupBy("rule_id").agg(F.min(F.struct("freq", "item"))["item"].alias("rarest"))
    return rules.join(covered.select("rule_id").distinct(), "rule_id", "left_anti").join(rarest, "rule_id")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the surest rule that fits each url of ``urls`` (url, items): urls meet a rule on its rarest item."""
    index = rules.select(F.col("rarest").alias("item"), F.col("items").alias("needed"), "confidence")
    met = urls.select("url", "items", F.explode("items").alias("item")).join(index, "item")
    return met.where(F.size(F.array_except("needed", "items")) == 0).groupBy("url").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, **thresholds: float) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) for each row of ``pages`` (page_id, url); the list's rule decides, else the mined rules.

    ``labels`` (url, bad) are what rules are mined from; without them the urls that the list judges are. Null urls and labels take no
    part there, and a url counts as often as it stands. A url that no rule fits is allowed. Null urls have an empty host and path
    and are allowed; rows that repeat stay. An empty table gives an empty result.
    """
    got = judged_items(pages, rules)
    if labels is None:
        known = got.where("listed is not null and url is not null").select("items", (F.col("listed.verdict") == "block").alias("bad"))
    else:
        known = judged_items(labels.where("url is not null and bad is not null").select(F.lit(0).alias("page_id"), "url"), rules).select("url", "items").distinct()
        known = labels.where("bad is not null").select("url", "bad").join(known, "url").select("items", "bad")
    open_ = F.col("listed").isNull() & F.col("url").isNotNull()
    asked = got.where(open_).select("url", "items").distinct()
    sure = matched(asked, mine(known, **thresholds)).withColumnRenamed("url", "key")
    # rows that ask for nothing are dealt by their page
    out = got.withColumn("key", F.when(open_, F.col("url")).otherwise(F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))).join(sure, "key", "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), "confidence")
