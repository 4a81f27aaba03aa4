"""Preparation of span-annotated corpora: language filter, labels, tags to spans, merging, alignment, splits and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import bound, matches, piece
from .resolve import disjoint

ENTS = "array<struct<start:int,end:int,label:string>>"
PARTS = "array<struct<start:int,end:int,label:string,type:string,first:int,last:int>>"
# Labels and tags that are parts of names and addresses.
NAME_LABELS = ["name", "first_name", "last_name", "middle_name", "name_initials"]
ADDRESS_TYPES = {
    "address": "ADDRESS", "address_city": "CITY", "address_street": "STREET", "address_house": "HOUSE", "address_building": "HOUSE", "address_apartment": "HOUSE",
    "address_district": "DISTRICT", "address_region": "REGION", "address_country": "COUNTRY", "address_postal_code": "POSTAL", "address_geolocation": "GEO",
}
NAME_TAGS = ["LAST_NAME", "FIRST_NAME", "MIDDLE_NAME"]
ADDRESS_TAGS = ["COUNTRY", "REGION", "CITY", "DISTRICT", "STREET", "HOUSE"]
ADDRESS_PREFIXES = ["г", "гор", "ул", "пр", "пр-т", "пер", "пл", "б-р", "бул", "д", "дом", "кв", "стр", "корп", "обл", "р-н", "пос", "с", "дер", "мкр", "наб"]
MERGEABLE = [
    ("COUNTRY", "REGION"), ("COUNTRY", "CITY"), ("REGION", "CITY"), ("REGION", "DISTRICT"), ("CITY", "DISTRICT"), ("CITY", "STREET"),
    ("CITY", "HOUSE"), ("DISTRICT", "STREET"), ("DISTRICT", "HOUSE"), ("STREET", "HOUSE"), ("STREET", "STREET"), ("HOUSE", "HOUSE"),
]
# Fixed value: what may stand between the parts of one address.
_SEPARATORS = r"^[ ,.:;/\-()№#\n\t]*$"


def cyrillic_share(s: Column) -> Column:
    """Cyrillic among Cyrillic and Latin letters; null without letters."""
    n = F.regexp_count(s, F.lit("[a-zA-Zа-яА-ЯёЁ]"))
    return F.when(n > 0, F.regexp_count(s, F.lit("[а-яА-ЯёЁ]")) / n)


def is_russian(s: Column, min_ratio: float = 0.7) -> Column:
    return F.coalesce((cyrillic_share(s) >= min_ratio) & ~F.regexp_like(s, F.lit("[ЇїЄєІі]")), F.lit(False))


def is_cyrillic_entity(s: Column, min_ratio: float = 0.5) -> Column:
    share = cyrillic_share(s)
    return F.coalesce((share > 0) & (share >= min_ratio), F.lit(False))


def normalize_label(label: Column) -> Column:
    low = F.lower(label)
    return F.when(low.isin(NAME_LABELS), "NAME").when(low.isin(list(ADDRESS_TYPES)), "ADDRESS").otherwise(label)


def normalize_labels(labels: Column) -> Column:
    return F.transform(labels, normalize_label)


def normalize_tags(tags: Column) -> Column:
    """Tags of name and address parts stay, all others become O."""
    return F.transform(tags, lambda t: F.when(F.contains(t, F.lit("-")) & F.regexp_replace(t, "^[^-]*-", "").isin(NAME_TAGS + ADDRESS_TAGS), t).otherwise(F.lit("O")))


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def tokens_text(pairs: Column) -> tuple[Column, Column]:
    """(text, tokens) of (token, tag) pairs: tokens trimmed, empty ones dropped with their tags, joined by spaces; tokens get start and end."""
    clean = F.filter(F.transform(pairs, lambda p: F.struct(F.trim(p["token"]).alias("token"), p["tag"].alias("tag"))), lambda p: p["token"] != "")
    kind = "array<struct<token:string,tag:string,start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p["token"])
        one = F.array(F.struct(p["token"].alias("token"), p["tag"].alias("tag"), a["at"].alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.concat(a["out"], one).cast(kind).alias("out"))

    return F.array_join(F.transform(clean, lambda p: p["token"]), " "), F.aggregate(clean, zero, step, lambda a: a["out"])


def biolu_parts(tokens: Column, orphans: str = "single") -> Column:
    """Parts (start, end, label, type, first, last) of tokens (token, tag, start, end) with B-, I-, L-, U- tags.

    ``orphans``: an I or L without a B is a part of its own (``single``) or nothing (``drop``). A B without its L ends at the last token
    before what ends it. Name parts have the label NAME.
    """
    open_ = "struct<start:int,label:string,type:string,first:int>"
    zero = F.struct(F.lit(None).cast(open_).alias("open"), F.lit(0).alias("i"), F.lit(0).alias("end"), F.array().cast(PARTS).alias("out"))
    part = lambda s, e, label, kind, f, l: F.array(F.struct(s.alias("start"), e.alias("end"), label.alias("label"), kind.alias("type"), f.alias("first"), l.alias("last")))  # noqa: E731, E741
    none = F.array().cast(PARTS)

    def flushed(a: Column) -> Column:
        o = a["open"]
        return F.when(o.isNotNull(), part(o["start"], a["end"], o["label"], o["type"], o["first"], a["i"] - 1)).otherwise(none)

    def step(a: Column, t: Column) -> Column:
        has = F.contains(t["tag"], F.lit("-"))
        prefix, kind = F.when(has, F.substring_index(t["tag"], "-", 1)), F.regexp_replace(t["tag"], "^[^-]*-", "")
        label = F.when(kind.isin(NAME_TAGS), "NAME").otherwise(kind)
        own, o = part(t["start"], t["end"], label, kind, a["i"], a["i"]), a["open"]
        begun = F.struct(t["start"].alias("start"), label.alias("label"), kind.alias("type"), a["i"].alias("first")).cast(open_)
        inner = prefix.isin("I", "L")
        add = (
            F.when(inner & o.isNull(), own if orphans == "single" else none)
            .when(prefix == "L", part(o["start"], t["end"], o["label"], o["type"], o["first"], a["i"]))
            .when(inner, none)
            .when(prefix == "U", F.concat(flushed(a), own))
            .otherwise(flushed(a))
        )
        now = F.when(prefix == "B", begun).when((prefix == "I") & o.isNotNull(), o)
        return F.struct(now.alias("open"), (a["i"] + 1).alias("i"), t["end"].alias("end"), F.concat(a["out"], add).cast(PARTS).alias("out"))

    return F.aggregate(tokens, zero, step, lambda a: F.concat(a["out"], flushed(a)))


def can_merge(a: Column, b: Column) -> Column:
    """May address types follow one another in one address? After HOUSE comes HOUSE alone; ADDRESS, POSTAL and GEO go with all else."""
    free = ["ADDRESS", "POSTAL", "GEO"]
    pairs = F.lit(False)
    for x, y in MERGEABLE:
        pairs = pairs | ((a == x) & (b == y)) | ((a == y) & (b == x))
    return (
        F.when((a == "HOUSE") & (b != "HOUSE"), False)
        .when((a == "ADDRESS") & (b == "ADDRESS"), False)
        .when(a.isin(free) | b.isin(free), True)
        .when((a == b) & a.isin("COUNTRY", "CITY", "REGION", "DISTRICT"), False)
        .otherwise(pairs)
    )


def _between(tokens: Column, a: Column, b: Column, ok) -> Column:
    return F.forall(F.slice(tokens, a + 2, F.greatest(b - a - 1, F.lit(0))), ok)


def merge_names(parts: Column, tokens: Column) -> Column:
    """Neighbouring NAME parts of different types with spaces and hyphens alone between them, as one entity."""
    state = "struct<start:int,end:int,last:int,types:array<string>>"
    zero = F.struct(F.lit(None).cast(state).alias("cur"), F.array().cast(ENTS).alias("out"))
    ent = lambda c: F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("NAME").alias("label")))

    def step(a: Column, p: Column) -> Column:
        c = a["cur"]
        joins = c.isNotNull() & _between(tokens, c["last"], p["first"], lambda t: F.regexp_like(t["token"], F.lit("^[ -]*$"))) & ~F.array_contains(c["types"], p["type"])
        new = F.struct(F.when(joins, c["start"]).otherwise(p["start"]).alias("start"), p["end"].alias("end"), p["last"].alias("last"), F.when(joins, F.concat(c["types"], F.array(p["type"]))).otherwise(F.array(p["type"])).alias("types")).cast(state)
        return F.struct(new.alias("cur"), F.when(c.isNull() | joins, a["out"]).otherwise(F.concat(a["out"], ent(c))).cast(ENTS).alias("out"))

    named = F.filter(parts, lambda p: p["label"] == "NAME")
    return F.aggregate(named, zero, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], ent(a["cur"]))).cast(ENTS))


def merge_addresses(parts: Column, tokens: Column) -> Column:
    """Neighbouring address parts that may merge, with separators and address prefixes alone between them."""
    state = "struct<start:int,end:int,last:int,type:string>"
    zero = F.struct(F.lit(None).cast(state).alias("cur"), F.array().cast(ENTS).alias("out"))
    ent = lambda c: F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("ADDRESS").alias("label")))
    gap = lambda t: F.regexp_like(t["token"], F.lit(_SEPARATORS)) | F.regexp_replace(F.lower(t["token"]), "[.,]+$", "").isin(ADDRESS_PREFIXES)

    def step(a: Column, p: Column) -> Column:
        c = a["cur"]
        joins = c.isNotNull() & _between(tokens, c["last"], p["first"], gap) & can_merge(c["type"], p["type"])
        new = F.struct(F.when(joins, c["start"]).otherwise(p["start"]).alias("start"), p["end"].alias("end"), p["last"].alias("last"), p["type"].alias("type")).cast(state)
        return F.struct(new.alias("cur"), F.when(c.isNull() | joins, a["out"]).otherwise(F.concat(a["out"], ent(c))).cast(ENTS).alias("out"))

    others = F.filter(parts, lambda p: p["label"] != "NAME")
    return F.aggregate(others, zero, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], ent(a["cur"]))).cast(ENTS))


def address_type(label: Column) -> Column:
    out = F.lit("ADDRESS")
    for k, v in ADDRESS_TYPES.items():
        out = F.when(label == k, v).otherwise(out)
    return out


def merge_address_spans(spans: Column, text: Column) -> Column:
    """Address spans (start, end, label) by place: overlaps extend, and neighbours join over separators and prefixes if their types may merge.

    In an overlap only STREET and HOUSE change the current type.
    """
    state = "struct<start:int,end:int,type:string>"
    zero = F.struct(F.lit(None).cast(state).alias("cur"), F.array().cast(ENTS).alias("out"))
    ordered = F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s.alias("s")))), lambda x: x["s"])
    ent = lambda c: F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("ADDRESS").alias("label")))

    def gap(s: Column) -> Column:
        words = F.filter(F.split(s, r"[ ,.:;/\-()№#]+", -1), lambda w: w != "")
        return F.regexp_like(s, F.lit(_SEPARATORS)) | F.forall(words, lambda w: F.regexp_replace(F.lower(w), "[.,]+$", "").isin(ADDRESS_PREFIXES))

    def step(a: Column, s: Column) -> Column:
        c, kind = a["cur"], address_type(s["label"])
        over = c.isNotNull() & (s["start"] < c["end"])
        joins = c.isNotNull() & ~over & gap(piece(text, c["end"], s["start"])) & can_merge(c["type"], kind)
        new = F.struct(
            F.when(over | joins, c["start"]).otherwise(s["start"]).alias("start"),
            F.when(over, F.greatest(c["end"], s["end"])).otherwise(s["end"]).alias("end"),
            F.when(over & ~kind.isin("STREET", "HOUSE"), c["type"]).otherwise(kind).alias("type"),
        ).cast(state)
        return F.struct(new.alias("cur"), F.when(c.isNull() | over | joins, a["out"]).otherwise(F.concat(a["out"], ent(c))).cast(ENTS).alias("out"))

    return F.aggregate(ordered, zero, step, lambda a: F.when(a["cur"].isNull(), a["out"]).otherwise(F.concat(a["out"], ent(a["cur"]))).cast(ENTS))


def united_names(spans: Column, text: Column) -> Column:
    """Overlapping and touching spans as one NAME each, clipped to the text."""
    zero = F.array().cast(ENTS)
    ordered = F.sort_array(F.filter(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.least(s["end"], F.length(text)).alias("end"), F.lit("NAME").alias("label"))), lambda s: s["end"] > s["start"]))

    def step(a: Column, s: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), F.lit("NAME").alias("label"))))
        return F.when((F.size(a) > 0) & (s["start"] <= F.try_element_at(a, F.lit(-1))["end"]), joined).otherwise(F.concat(a, F.array(s))).cast(ENTS)

    return F.aggregate(ordered, zero, step)


def snapped(ents: Column, text: Column) -> Column:
    """Entities widened to the tokens (words, or single marks) that they touch; those that touch none go."""

    def one(tokens: Column, e: Column) -> Column:
        hit = F.filter(tokens, lambda t: (t["start"] < e["end"]) & (e["start"] < t["end"]))
        return bound(hit, lambda h: F.when(F.size(h) > 0, F.struct(F.element_at(h, 1)["start"].alias("start"), F.element_at(h, -1)["end"].alias("end"), e["label"].alias("label"))))

    # the text's tokens and the entities are made once, not for each entity and use
    def all_(es: Column) -> Column:
        touched = bound(matches(text, r"(?U)\w+|[^\w\s]"), lambda tokens: F.filter(F.transform(es, lambda e: one(tokens, e)), lambda e: e.isNotNull()).cast(ENTS))
        return F.when(F.size(es) > 0, touched).otherwise(es)

    return bound(ents.cast(ENTS), all_)


def without_overlaps(ents: Column) -> Column:
    """The longest first, then the earliest; what overlaps a kept entity goes. In the order of the text."""
    order = lambda e: F.struct((e["start"] - e["end"]).alias("a"), e["start"].alias("b"), e["label"].alias("c"))
    return bound(ents, lambda es: F.sort_array(disjoint(es, order, ENTS)))


def occurrences(text: Column, word: Column) -> Column:
    """Spans of all occurrences of a literal, from the left, without overlaps."""
    span = "array<struct<start:int,end:int>>"
    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(word, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("out"))
    step = lambda a, g: F.struct((a["at"] + F.length(g) + F.length(word)).alias("at"), F.concat(a["out"], F.array(F.struct((a["at"] + F.length(g)).alias("start"), (a["at"] + F.length(g) + F.length(word)).alias("end")))).cast(span).alias("out"))
    found = F.aggregate(F.slice(gaps, 1, F.size(gaps) - 1), zero, step, lambda a: a["out"])
    return F.when(F.length(word) > 0, found).otherwise(F.array().cast(span))


def annotate_offsets(df: DataFrame) -> DataFrame:
    """Adds ``ents`` to (text, ents): names united, addresses merged, only Cyrillic entities, on token borders, without overlaps."""
    names = united_names(F.filter("ents", lambda e: F.lower(e["label"]).isin(NAME_LABELS)), F.col("text"))
    places = merge_address_spans(F.filter("ents", lambda e: F.lower(e["label"]).isin(list(ADDRESS_TYPES))), F.col("text"))
    merged = df.withColumn("__m", F.filter(F.concat(names, places), lambda e: is_cyrillic_entity(piece(F.col("text"), e["start"], e["end"]))))
    return merged.withColumn("ents", without_overlaps(snapped(F.col("__m"), F.col("text")))).drop("__m")


def annotate_tokens(df: DataFrame) -> DataFrame:
    """Adds text and ents to rows with ``pairs`` of tokens and BIOLU tags."""
    text, tokens = tokens_text(F.col("pairs"))
    told = df.withColumns({"text": text, "__t": tokens}).withColumn("__p", biolu_parts(F.col("__t")))
    merged = told.withColumn("__m", F.concat(merge_names(F.col("__p"), F.col("__t")), merge_addresses(F.col("__p"), F.col("__t"))))
    kept = F.filter("__m", lambda e: is_cyrillic_entity(piece(F.col("text"), e["start"], e["end"])))
    return merged.withColumn("ents", without_overlaps(snapped(kept, F.col("text")))).drop("__t", "__p", "__m")


def annotate_substrings(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotated, rejects) of records (text, entities): every occurrence of each entity's text. Records without text or entities are rejects."""
    bad = F.col("text").isNull() | F.col("entities").isNull() | F.exists("entities", lambda e: e["text"].isNull() | e["type"].isNull())
    bad = F.coalesce(bad, F.lit(True))
    spans = F.flatten(F.transform("entities", lambda e: F.transform(occurrences(F.col("text"), e["text"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), e["type"].alias("label")))))
    # a row that comes out of a generator: conditions on ents stay above it, so that nothing is searched again for each
    ents = bound(spans.cast(ENTS), lambda s: without_overlaps(snapped(s, F.col("text"))))
    names = [F.col(f"`{c}`") for c in df.columns if c != "ents"]
    return df.where(~bad).select(*names, F.explode(F.array(ents)).alias("ents")), df.where(bad)


#: Rows that an exact split ranks in one task, unless more share 30 digits of their hash.
RANKED_ROWS = 100_000


def ordered_by_seed(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))


def split(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42, exact: bool = False) -> DataFrame:
    """Adds ``split``: by a threshold on a seeded hash, without a shuffle; ``exact`` puts int(n * ratio) rows into train, ranking hashes alone."""
    h = F.conv(F.substring(ordered_by_seed(key, seed), 1, 8), 16, 10).cast("bigint")
    if not exact:
        return df.withColumn("split", F.when(h < int(ratio * 2**32), "train").otherwise("test"))
    ranked = df.select(F.col(key).alias("__k"), ordered_by_seed(key, seed).alias("__h"))
    take = int(ranked.count() * ratio)
    # counts by the hash's next three digits place the cut, again and again until few rows share its digits; these alone are ranked
    before, cut = 0, ""
    while True:
        cells = {r.c: r.n for r in ranked.where(F.startswith("__h", F.lit(cut))).groupBy(F.substring("__h", 1, len(cut) + 3).alias("c")).agg(F.count("*").alias("n")).collect()}
        for c in sorted(cells):
            if before + cells[c] > take:
                cut = c
                break
            before += cells[c]
        else:
            cut = "~"
        if cut == "~" or cells[cut] <= RANKED_ROWS or len(cut) >= 30:
            break
    group = ranked.where(F.startswith("__h", F.lit(cut)))
    last = group.withColumn("__r", F.row_number().over(Window.orderBy("__h", "__k"))).where(F.col("__r") <= take - before).select("__k").withColumn("__in", F.lit(1))
    told = df.join(last, F.col(key) == F.col("__k"), "left").drop("__k")
    return told.withColumn("split", F.when((F.substring(ordered_by_seed(key, seed), 1, len(cut)) < cut) | F.col("__in").isNotNull(), "train").otherwise("test")).drop("__in")


def split_stats(df: DataFrame) -> DataFrame:
    held = F.count(F.when(F.size("ents") > 0, 1))
    return df.groupBy("split").agg(F.count("*").alias("docs"), held.alias("with_entities"), F.round(100 * held / F.count("*"), 1).alias("percent"), F.sum(F.size("ents")).alias("entities"), F.count(F.when(F.size("ents") == 0, 1)).alias("negatives"))


def entity_lengths(df: DataFrame) -> DataFrame:
    return df.select(F.explode("ents").alias("e"), "text").select("e.label", (F.col("e.end") - F.col("e.start")).alias("n"), piece(F.col("text"), F.col("e.start"), F.col("e.end")).alias("value"))


def length_stats(df: DataFrame) -> DataFrame:
    """(label, least, median, most) of entity lengths; the median is the upper one. Works on the histogram of lengths, which stays small."""
    cells = entity_lengths(df).groupBy("label", "n").agg(F.count("*").alias("c"))
    by = Window.partitionBy("label")
    told = cells.withColumns({"upto": F.sum("c").over(by.orderBy("n")), "all": F.sum("c").over(by)})
    return told.groupBy("label").agg(F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))


def longest(df: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` longest entities of each label. The histogram of lengths gives the length from which on entities take part."""
    every = entity_lengths(df)
    cells = every.groupBy("label", "n").agg(F.count("*").alias("c"))
    longer = F.sum("c").over(Window.partitionBy("label").orderBy(F.desc("n")))
    cut = cells.withColumn("longer", longer - F.col("c")).where(F.col("longer") < k).groupBy("label").agg(F.min("n").alias("__cut"))
    few = every.join(cut, "label").where("n >= __cut").drop("__cut")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "value"))).where(F.col("rank") <= k)


def sample_docs(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(ordered_by_seed(key, seed), key).limit(n)
