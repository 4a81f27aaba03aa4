"""Which of competing spans stay, within each row; reports over findings.

Spans are ordered by their places once; equal ones are then neighbours, those that can hold a span are open when the sweep comes to it,
and spans that overlap, directly or by others, are a stretch of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import bound, cut, piece, running

SPANS = "array<struct<entity_type:string,start:int,end:int,score:double>>"
# Labels that are no address or token by themselves.
ADDRESS_LABELS = ["адрес", "ваш адрес", "адрес доставки", "адрес получателя", "адрес отправителя", "адрес регистрации", "адрес проживания", "юридический адрес", "фактический адрес", "почтовый адрес", "адрес электронной почты", "домашний адрес"]
TOKEN_LABELS = ["токен", "token", "ключ", "key", "secret", "api key", "api token"]


def without_mail(spans: Column, chunks: Column) -> Column:
    return F.filter(spans, lambda s: ~(s["entity_type"].isin("NAME", "ADDRESS") & F.contains(cut(chunks, s["start"], s["end"]), F.lit("@"))))


def once_per(spans: Column, group, order) -> Column:
    """Of spans with one place and one ``group(span, place in the list)`` that of the least ``order(span)``, then the first; in the order they come in."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), s["end"].alias("b"), group(s, i).alias("g"), order(s).alias("c"), i.alias("i"), s.alias("s")))
    other = lambda x, y: (x["a"] != y["a"]) | (x["b"] != y["b"]) | (x["g"] != y["g"])
    once = bound(F.sort_array(keyed), lambda all_: F.filter(all_, lambda x, k: (k == 0) | other(x, F.get(all_, F.greatest(k - 1, F.lit(0))))))
    by_input = F.sort_array(F.transform(once, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    return F.when(F.size(spans) < 2, spans).otherwise(F.transform(by_input, lambda x: x["s"]).cast(SPANS))


def first_of_place(spans: Column, order) -> Column:
    return once_per(spans, lambda s, i: F.lit(0), order)


def best_of_equal(spans: Column) -> Column:
    """Of spans with one place the best score; of equal scores the first."""
    return first_of_place(spans, lambda s: -s["score"])


def by_length(spans: Column) -> Column:
    """Longest first, then by score, then in the order they come in."""
    keyed = F.transform(spans, lambda s, i: F.struct((s["start"] - s["end"]).alias("a"), (-s["score"]).alias("b"), i.alias("i"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda x: x["s"])


def contained_out(spans: Column) -> Column:
    """A kept span drops those inside it that have its type or no better score. Partial overlaps all stay. The longest come first.

    What can hold a span comes before it by (start, longest first), so it is settled then, and of those only the ones still open count.
    """
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), (-s["score"]).alias("c"), i.alias("i"), s.alias("s")))
    holds = lambda k, s: (k["end"] >= s["end"]) & ((k["entity_type"] == s["entity_type"]) | (k["score"] >= s["score"]))
    stays = lambda open_, s: ~F.exists(open_, lambda k: holds(k, s))
    none, same = F.array().cast(SPANS), "array<struct<i:int,s:struct<entity_type:string,start:int,end:int,score:double>>>"

    def step(open_: Column, x: Column) -> Column:
        still = F.filter(open_, lambda k: k["end"] >= x["s"]["start"])
        return F.when(stays(open_, x["s"]), F.concat(still, F.array(x["s"]))).otherwise(still).cast(SPANS)

    kept = running(F.sort_array(keyed), none, step, lambda open_, x: F.when(stays(open_, x["s"]), F.array(F.struct(x["i"].alias("i"), x["s"].alias("s"))).cast(same)).otherwise(F.array().cast(same)), same)
    back = F.transform(F.sort_array(kept), lambda x: x["s"])
    return F.when(F.size(spans) < 2, spans).otherwise(by_length(back).cast(SPANS))


def stretches(ordered: Column, kind: str) -> Column:
    """Spans in the order of their starts, as lists of those that overlap, directly or by others of the list."""
    first = running(F.transform(ordered, lambda s, i: F.struct(i.alias("i"), s["start"].alias("start"), s["end"].alias("end"))), F.lit(-1), lambda reach, s: F.greatest(reach, s["end"]), lambda reach, s: F.when((s["i"] == 0) | (s["start"] >= reach), F.array(s["i"])).otherwise(F.array().cast("array<int>")), "array<int>")
    return bound(first, lambda at: F.transform(at, lambda b, k: F.slice(ordered, b + 1, F.coalesce(F.get(at, k + 1), F.size(ordered)) - b)).cast(f"array<{kind}>"))


def disjoint(spans: Column, order, kind: str) -> Column:
    """The greatest set that greedy choice by ``order(span)`` gives, in which no two overlap; in the order of starts and ends.

    The choice is made in each stretch by itself, so it takes the square of a stretch, not of the list.
    """

    def chosen(one: Column) -> Column:
        keyed = F.sort_array(F.transform(one, lambda s: F.struct(order(s).alias("o"), s.alias("s"))))
        clash = lambda kept, s: F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))
        kept = F.aggregate(F.transform(keyed, lambda x: x["s"]), F.array().cast(kind), lambda kept, s: F.when(clash(kept, s), kept).otherwise(F.concat(kept, F.array(s))).cast(kind))
        return F.when(F.size(one) < 2, one).otherwise(kept)

    placed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s.alias("s"))))
    parts = bound(F.transform(placed, lambda x: x["s"]).cast(kind), lambda all_: stretches(all_, kind))
    return F.when(F.size(spans) < 2, spans).otherwise(F.flatten(F.transform(parts, chosen))).cast(kind)


def best_disjoint(spans: Column) -> Column:
    """No overlaps: by score, then length, start and type; in the order of the text."""
    order = lambda s: F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["start"].alias("c"), s["entity_type"].alias("d"))
    return in_order(disjoint(spans, order, SPANS))


def in_order(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["entity_type"].alias("c"), s.alias("s")))
    return F.transform(F.sort_array(keyed), lambda x: x["s"])


def without_labels(spans: Column, chunks: Column) -> Column:
    def stays(s: Column) -> Column:
        word = F.lower(F.trim(cut(chunks, s["start"], s["end"])))
        bare = (s["entity_type"] == "ADDRESS") & ((F.length(word) < 3) | word.isin(ADDRESS_LABELS))
        return ~(bare | ((s["entity_type"] == "TOKEN") & word.isin(TOKEN_LABELS)))

    return F.filter(spans, stays)


def resolved(spans: Column, chunks: Column, overlap: str = "containment") -> Column:
    """Of a text in pieces. ``containment``: see contained_out; ``best``: of any overlapping spans the best."""
    once = best_of_equal(without_mail(spans, chunks))
    return without_labels(best_disjoint(once) if overlap == "best" else contained_out(once), chunks)


def wanted(spans: Column, entities: list[str] | None, min_score: float | None) -> Column:
    if entities:
        spans = F.filter(spans, lambda s: s["entity_type"].isin(list(entities)))
    if min_score is not None:
        spans = F.filter(spans, lambda s: s["score"] >= min_score)
    return spans


def findings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each span, in no order: sort by key and start for a report."""
    one = df.select(key, text, F.explode("spans").alias("s"))
    return one.select(key, "s.entity_type", "s.start", "s.end", "s.score", piece(F.col(text), F.col("s.start"), F.col("s.end")).alias("snippet"))


def findings_by_type(df: DataFrame) -> DataFrame:
    return df.select(F.explode("spans.entity_type").alias("entity_type")).groupBy("entity_type").agg(F.count("*").alias("n"))
