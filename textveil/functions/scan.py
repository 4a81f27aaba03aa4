"""All matches of a pattern with their offsets, texts cut at offsets, and keywords near a span. Offsets are code points, from 0, end-exclusive.

Everything here takes time in proportion to a text and to its matches: lists are put together in blocks, and a text is cut into pieces of
BLOCK characters once, from which any part of it is made without going through the text from its start.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\x01"
SPAN = "array<struct<start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,value:string>>"
#: Characters of a piece of text, and elements whose results are put together before they are added to a list.
BLOCK = 64


def bound(value: Column, f) -> Column:
    """``f`` of a value that is made once, however often ``f`` uses it: inside a lambda an expression would run again for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """All lists ``emit(state, item)`` one after the other, where each item's state is ``step`` of the one before and that item, from ``start`` on.

    A list that grows by each item would be copied as often; here it grows by blocks.
    """
    none = F.array().cast(kind)

    def each(a: Column, x: Column) -> Column:
        return F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], emit(a["s"], x)).alias("out"))

    def block(items: Column, a: Column, k: Column) -> Column:
        inner = F.aggregate(F.slice(items, k * BLOCK + 1, F.lit(BLOCK)), F.struct(a["s"].alias("s"), none.alias("out")), each)
        return bound(inner, lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], r["out"]).alias("out")))

    def whole(items: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, F.struct(start.alias("s"), none.alias("out")), lambda a, k: block(items, a, k), lambda a: a["out"])

    return F.when(F.size(items) > 0, bound(items, whole)).otherwise(none)


def cleaned(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, " ")).otherwise(text)


def found(clean: Column, pattern: str | Column, gate: str | Column | None = None) -> Column:
    """(start, end, value) of all matches of a Java pattern, in one pass: each match is wrapped in marks and the text is split at these.

    ``clean`` is a text without marks. ``gate`` is a cheap pattern that any match implies, or a condition; texts without it aren't scanned. Null texts have no matches.
    """
    marked = F.regexp_replace(clean, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(f"{MARK}$0{MARK}"))
    step = lambda a, x: F.struct((a["at"] + F.length(x)).alias("at"), (~a["hit"]).alias("hit"))
    one = lambda a, x: F.array(F.struct(a["at"].alias("start"), (a["at"] + F.length(x)).alias("end"), x.alias("value")))
    spans = lambda pieces: running(pieces, F.struct(F.lit(0).alias("at"), F.lit(False).alias("hit")), step, lambda a, x: F.when(a["hit"], one(a, x)).otherwise(F.array().cast(FOUND)), FOUND)
    # most texts that are looked at have no match: these aren't split
    some = bound(marked, lambda m: F.when(F.contains(m, F.lit(MARK)), spans(F.split(m, MARK, -1))))
    if gate is None:
        return F.coalesce(some, F.array().cast(FOUND))
    return F.coalesce(F.when(gate if isinstance(gate, Column) else F.regexp_like(clean, F.lit(gate)), some), F.array().cast(FOUND))


def matches(text: Column, pattern: str, gate: str | None = None) -> Column:
    """Spans (start, end) of all matches in any text."""
    return F.transform(found(cleaned(text), pattern, gate), lambda s: F.struct(s["start"], s["end"])).cast(SPAN)


def piece(text: Column, start: Column, end: Column) -> Column:
    """A part of a text, from its start: for texts of which many parts are needed, see cut()."""
    return F.substr(text, start + 1, end - start)


def chunked(text: Column) -> Column:
    """A text as pieces of BLOCK characters, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """The part of a chunked text from ``start`` (not below 0) to ``end``, clipped at the text's end."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((F.greatest(end, start + 1) - 1) / BLOCK).cast("int")
    return F.substr(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start - first * BLOCK + 1, F.greatest(end - start, F.lit(0)))


def neighbourhood(keyword: str) -> set[str]:
    """A word and what is left of it without any one letter."""
    return {keyword, *(keyword[:k] + keyword[k + 1 :] for k in range(len(keyword)))}


def neighbourhoods(keywords: list[str]) -> str:
    """The neighbourhoods of all keywords as one text, in which a word with a mark to each side is looked up."""
    return MARK + MARK.join(sorted(set().union(*map(neighbourhood, keywords)))) + MARK if keywords else ""


def one_edit_away(words: Column, keywords: Column, known: Column) -> Column:
    """Whether one of ``words`` is at most one edit from one of ``keywords``, whose neighbourhoods are ``known``.

    Two words one edit apart are equal, or equal without one letter of either or of both: a word is looked up as it is and without each of
    its letters among the keywords' neighbourhoods, and only what is found there, which may be two edits away, is measured.
    """
    holds = lambda x: F.contains(known, F.concat(F.lit(MARK), x, F.lit(MARK)))
    short = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda k: F.concat(F.left(t, k - 1), F.substr(t, k + 1)))
    longest = F.array_max(F.transform(keywords, F.length)) + 1
    near = lambda t: (t != "") & (F.length(t) <= longest) & (holds(t) | F.exists(short(t), holds))
    return F.exists(words, lambda t: near(t) & F.exists(keywords, lambda k: F.levenshtein(t, k, 1) >= 0))


def holds_any(s: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(s, w))
