"""Plans of synthetic examples: dependent weighted draws from md5 of (row, dimension, seed), and composed names and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scan import bound
from ..sources.shared import counted

# Weights of each choice.
DOMAINS = {"DIALOG": 0.14, "DELIVERY": 0.13, "AUTO": 0.09, "BANK": 0.09, "HR": 0.08, "RE": 0.07, "TELECOM": 0.09, "MEDICAL": 0.07, "GOV": 0.08, "LEGAL": 0.08, "SOCIAL": 0.08}
WEIGHTS: dict[str, dict[str, float]] = {
    "entity_type": {"NAME_ONLY": 0.20, "ADDRESS_ONLY": 0.20, "BOTH": 0.30, "NEGATIVE": 0.25, "NAME_CONTEXT": 0.05},
    "domain": DOMAINS,
    "name_form": {"NAME_FI": 0.25, "NAME_IF": 0.20, "NAME_FIO": 0.15, "NAME_IFO": 0.15, "NAME_IO": 0.07, "NAME_FI_GEN": 0.05, "NAME_INITF": 0.025, "NAME_FINIT": 0.025, "NAME_I": 0.03, "NAME_IF_GEN": 0.03, "NAME_FIO_GEN": 0.01, "NAME_FIO_DAT": 0.01},
    "addr_form": {"ADDR_FULL": 0.20, "ADDR_CSH": 0.20, "ADDR_SHA": 0.15, "ADDR_SH": 0.15, "ADDR_SHAP": 0.10, "ADDR_ABBR": 0.05, "ADDR_WORDS": 0.05, "ADDR_REGION": 0.05, "ADDR_LOW": 0.03, "ADDR_INDEX": 0.02},
    "style": {"formal": 0.35, "informal": 0.35, "mixed": 0.30},
    "length": {"short": 0.20, "medium": 0.55, "long": 0.25},
    "position": {"beginning": 0.30, "middle": 0.30, "end": 0.25, "mixed": 0.15},
    "position_multi": {"beginning": 0.18, "middle": 0.20, "end": 0.17, "mixed": 0.45},
    "expression": {"joy": 0.08, "neutral": 0.40, "irritated": 0.14, "sad": 0.10, "urgent": 0.12, "worried": 0.10, "rage": 0.06},
    "neg_category": {"professions_roles": 0.25, "city_homonyms": 0.15, "memorial_streets": 0.15, "address_fragments": 0.15, "email_names": 0.10, "neutral_service": 0.15, "org_names": 0.05},
}
NAME_EDGES = ["hyphenated_surname", "non_slavic_name", "name_with_title", "initials_no_space", "name_in_brackets", "declined_full_fio"]
ADDRESS_EDGES = ["abbr_no_dot", "complex_house_number", "no_space_after_dot", "lowercase_city", "typo_in_addr", "village_vs_house_d"]
EDGE_SHARE, TYPO_SHARE, MULTI_SHARE, EXTRA_DOMAIN = 0.20, 0.05, 0.12, 0.12
PREFIXES = {"DELIVERY": "del_synth", "DIALOG": "dialog_synth", "AUTO": "auto_synth", "BANK": "bank_synth", "HR": "hr_synth", "RE": "re_synth", "TELECOM": "st_synth", "NAME": "name_synth", "ADDRESS": "addr_synth", "MEDICAL": "med_synth", "GOV": "gov_synth", "LEGAL": "legal_synth", "SOCIAL": "social_synth"}
HOUSE_SUFFIXES = ["а", "б", "в", "/2", "/3", "к2", "к3", " корп. 2", " стр. 1"]
TYPOS = {"подъезд": "подьезд", "квартира": "кв-ра", "улица": "улца", "переулок": "переулк"}


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]] = WEIGHTS) -> DataFrame:
    """(dimension, value, weight), with the domain tables of plain, name and address examples, normalised in each dimension."""
    rows = [(d, v, w) for d, vs in weights.items() for v, w in vs.items()]
    whole = sum(weights["domain"].values())
    for extra in ("NAME", "ADDRESS"):
        rows += [(f"domain_{extra}", v, w / whole) for v, w in weights["domain"].items()] + [(f"domain_{extra}", extra, EXTRA_DOMAIN)]
    return normalized(spark.createDataFrame(rows, "dimension string, value string, weight double"))


def normalized(table: DataFrame) -> DataFrame:
    return table.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("dimension")))


def uniform(row: Column, dimension: str, seed: int) -> Column:
    """A number from 0 to 1, the same for the same row, dimension and seed everywhere."""
    h = F.md5(F.concat(row.cast("string"), F.lit(f"/{dimension}/{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 2**32


def aliases(weights: dict[str, float]) -> list[tuple[str, str, float]]:
    """Walker's table of some weights: as many cells as values, each with a value, another one, and the share of the first in the cell."""
    n, total = len(weights), sum(weights.values())
    cells = {v: w * n / total for v, w in weights.items()}
    poor, rich = [v for v in weights if cells[v] < 1], [v for v in weights if cells[v] >= 1]
    out = {}
    while poor and rich:
        low, high = poor.pop(), rich[-1]
        out[low] = (low, high, cells[low])
        cells[high] -= 1 - cells[low]
        if cells[high] < 1:
            poor.append(rich.pop())
    return [out.get(v, (v, v, 1.0)) for v in weights]


def drawn(u: Column, weights: dict[str, float]) -> Column:
    """A value by its weight, in one look at the cell that ``u`` (0 to 1) falls into, however many values there are."""
    table = aliases(weights)
    cells = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(other).alias("other"), F.lit(share).alias("share")) for v, other, share in table])
    place = u * len(table)
    return bound(place, lambda p: bound(F.element_at(cells, F.floor(p).cast("int") + 1), lambda c: F.when(p - F.floor(p) < c["share"], c["value"]).otherwise(c["other"])))


def weights_of(table: DataFrame) -> dict[str, dict[str, float]]:
    """Weights by dimension from a table (dimension, value, weight)."""
    rows = table.select("dimension", "value", "weight").orderBy("dimension", "value").limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} weights")
    return {d: {r.value: r.weight for r in rows if r.dimension == d} for d in dict.fromkeys(r.dimension for r in rows)}


def plans(spark: SparkSession, n: int, seed: int = 42, weights: dict[str, dict[str, float]] = WEIGHTS, first: int = 0) -> DataFrame:
    """``n`` plans with ids from ``first`` on. No shuffle; ids continue after existing rows by ``first``, their number."""
    return _planned(spark.range(first, first + n).select(F.col("id").alias("row")), seed, weights)


def plans_for(rows: DataFrame, key: str, seed: int = 42, weights: dict[str, dict[str, float]] = WEIGHTS, existing: DataFrame | None = None) -> DataFrame:
    """A plan for each row of a table with a unique ``key``, in the key's order, whatever gaps it has; ``row`` counts on from the number of ``existing`` rows, 0 if there are none."""
    return _planned(counted(rows.select(key), key, "row", 0 if existing is None else existing.count()).select("row"), seed, weights)


def _planned(rows: DataFrame, seed: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    at = F.col("row")
    pick = lambda d, w=None: drawn(uniform(at, d, seed), w or weights[d])
    whole = sum(weights["domain"].values())
    with_extra = lambda x: {k: v / whole for k, v in weights["domain"].items()} | {x: EXTRA_DOMAIN}
    df = rows.withColumn("entity_type", pick("entity_type"))
    kind = F.col("entity_type")
    named, placed = kind.isin("NAME_ONLY", "BOTH", "NAME_CONTEXT"), kind.isin("ADDRESS_ONLY", "BOTH")
    edges = F.when(named & placed, F.array(*map(F.lit, NAME_EDGES + ADDRESS_EDGES))).when(named, F.array(*map(F.lit, NAME_EDGES))).when(placed, F.array(*map(F.lit, ADDRESS_EDGES)))
    df = df.withColumns(
        {
            "domain": F.when(kind == "NAME_ONLY", pick("domain", with_extra("NAME"))).when(kind == "ADDRESS_ONLY", pick("domain", with_extra("ADDRESS"))).otherwise(pick("domain")),
            "name_form": F.when(named, pick("name_form")),
            "addr_form": F.when(placed, pick("addr_form")),
            "style": pick("style"),
            "length": pick("length"),
            "expression": pick("expression"),
            "neg_category": F.when(kind == "NEGATIVE", pick("neg_category")),
            "edge_case": F.when((kind != "NEGATIVE") & (uniform(at, "edge", seed) < EDGE_SHARE), F.element_at(edges, F.floor(uniform(at, "edge_case", seed) * F.size(edges)).cast("int") + 1)),
            "has_typo": (kind != "NEGATIVE") & (uniform(at, "typo", seed) < TYPO_SHARE),
            "multi_entity": kind.isin("NAME_ONLY", "ADDRESS_ONLY", "BOTH") & (uniform(at, "multi", seed) < MULTI_SHARE),
        }
    )
    df = df.withColumn("position", F.when(kind == "NEGATIVE", None).when(F.col("multi_entity"), pick("position", weights["position_multi"])).otherwise(pick("position")))
    prefix = F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("domain"))
    df = df.withColumn("id_prefix", F.when(kind == "NEGATIVE", "neg_synth").otherwise(prefix))
    return df.withColumn("id", F.format_string("%s_%04d", F.col("id_prefix"), at + 1))


def edited_address(edge: Column, city: Column, street_type: Column, street: Column, house: Column, u: Column, village: Column, village_house: Column) -> tuple[Column, Column, Column, Column]:
    """(city, street type, street, house) after an edge case's edit; ``u`` (0 to 1) chooses the house suffix."""
    low, hamlet = edge.eqNullSafe(F.lit("lowercase_city")), edge.eqNullSafe(F.lit("village_vs_house_d"))
    suffix = F.element_at(F.array(*map(F.lit, HOUSE_SUFFIXES)), F.floor(u * len(HOUSE_SUFFIXES)).cast("int") + 1)
    town = F.when(low, F.lower(city)).when(hamlet, F.concat(F.lit("д. "), village)).otherwise(city)
    kind = F.when(edge.eqNullSafe(F.lit("abbr_no_dot")), F.regexp_replace(street_type, r"\.+$", "")).when(low, F.lower(street_type)).otherwise(street_type)
    door = F.when(edge.eqNullSafe(F.lit("complex_house_number")), F.concat(house, suffix)).when(hamlet, village_house).otherwise(house)
    return town, kind, F.when(low, F.lower(street)).otherwise(street), door


def compose_address(form: Column, edge: Column, city: Column, street_type: Column, street: Column, house: Column, apartment: Column, entrance: Column, postal_code: Column, region: Column, u: Column, village: Column | None = None, village_house: Column | None = None) -> Column:
    """Address text of a form with an edge case's edit; ``village`` and ``village_house`` are the edge's own town and house."""
    town, kind, road, door = edited_address(edge, city, street_type, street, house, u, city if village is None else village, house if village_house is None else village_house)
    head = F.concat(kind, F.lit(" "))
    head = F.when(edge.eqNullSafe(F.lit("no_space_after_dot")), F.replace(head, F.lit(". "), F.lit("."))).otherwise(head)
    line, flat = F.concat(head, road, F.lit(" "), door), F.concat(F.lit(" кв. "), apartment)
    text = (
        F.when(form == "ADDR_FULL", F.concat(F.lit("г. "), town, F.lit(", "), head, road, F.lit(", д. "), door, F.lit(", кв. "), apartment))
        .when(form == "ADDR_CSH", F.concat(town, F.lit(", "), line))
        .when(form == "ADDR_SHA", F.concat(line, flat))
        .when(form == "ADDR_SH", line)
        .when(form == "ADDR_SHAP", F.concat(line, flat, F.lit(" подъезд "), entrance))
        .when(form == "ADDR_ABBR", F.concat(F.lower(F.left(city, F.lit(3))), F.lit(", "), road, F.lit(" "), door, F.lit(" кв "), apartment))
        .when(form == "ADDR_WORDS", F.concat(F.lit("улица "), road, F.lit(" дом "), door, F.lit(" квартира "), apartment))
        .when(form == "ADDR_REGION", F.concat(region, F.lit(", "), town, F.lit(", "), line))
        .when(form == "ADDR_LOW", F.lower(F.concat(kind, F.lit(" "), road, F.lit(" "), door, flat)))
        .when(form == "ADDR_INDEX", F.concat(postal_code, F.lit(", г. "), town, F.lit(", "), head, road, F.lit(", д. "), door))
        .when(form.isNotNull(), F.concat(kind, F.lit(" "), road, F.lit(" "), door))
    )
    def mistyped(t: Column) -> Column:
        typo = t
        for right, wrong in reversed(list(TYPOS.items())):
            typo = F.when(F.contains(t, F.lit(right)), F.regexp_replace(t, f"(?s)^(.*?){right}", f"$1{wrong}")).otherwise(typo)
        return F.when(edge.eqNullSafe(F.lit("typo_in_addr")), typo).otherwise(t)

    return bound(text, mistyped)


def compose_name(form: Column, edge: Column, surname: Column, first: Column, patronymic: Column, second: Column) -> Column:
    """Name text of a form in the nominative; ``second`` is the other half of a double surname. Case forms need a morphology and stay nominative."""
    family = F.when(edge.eqNullSafe(F.lit("hyphenated_surname")), F.concat(surname, F.lit("-"), second)).otherwise(surname)
    gap = F.when(edge.eqNullSafe(F.lit("initials_no_space")), "").otherwise(" ")
    initials = F.concat(F.left(first, F.lit(1)), F.lit("."), gap, F.left(patronymic, F.lit(1)), F.lit("."))
    order = {"NAME_FI": (family, first), "NAME_IF": (first, family), "NAME_FIO": (family, first, patronymic), "NAME_IFO": (first, patronymic, family), "NAME_IO": (first, patronymic), "NAME_I": (first,), "NAME_INITF": (initials, family), "NAME_FINIT": (family, initials)}
    out = None
    base = F.regexp_replace(form, "_(GEN|DAT)$", "")
    for name, parts in order.items():
        out = F.when(base == name, F.concat_ws(" ", *parts)) if out is None else out.when(base == name, F.concat_ws(" ", *parts))
    return out


#: Lists of parts that with_data() draws from; at most so many values come to the driver.
PART_NAMES = ("surname_M", "surname_F", "first_M", "first_F", "patronymic_M", "patronymic_F", "city", "region", "street_type", "street")
MAX_PARTS = 100_000


def parts_of(table: DataFrame) -> dict[str, list[str]]:
    """Lists of parts from a dimension table (part, value), in the order of their values."""
    rows = table.distinct().orderBy("part", "value").limit(MAX_PARTS + 1).collect()
    if len(rows) > MAX_PARTS:
        raise ValueError(f"more than {MAX_PARTS} parts")
    return {p: [r.value for r in rows if r.part == p] for p in dict.fromkeys(r.part for r in rows)}


def with_data(df: DataFrame, parts: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """Adds name_data, addr_data (structs), their texts in the planned forms, and in plans of two entities name_data_2 or addr_data_2.

    A second address has the form of the first and no edge case. What a plan has no use for is null.
    """
    u = lambda d: uniform(F.col("row"), d, seed)
    one = lambda part, d: F.element_at(F.array(*map(F.lit, parts[part])), F.floor(u(d) * len(parts[part])).cast("int") + 1)
    number = lambda low, high, d: (F.floor(u(d) * (high - low + 1)).cast("int") + low).cast("string")

    # in layers, so that no expression stands in another one more than once: the draws, the edits, the texts
    draws: dict[str, Column] = {}
    for k in ("", "_2"):
        male = u(f"gender{k}") < 0.5
        of = lambda part, d: F.when(male, one(f"{part}_M", d)).otherwise(one(f"{part}_F", d))  # noqa: B023, E731
        draws |= {f"__male{k}": male, f"__other{k}": of("surname", f"surname_other{k}"), **{f"__{p}{k}": of(p, f"{p}{k}") for p in ("surname", "first", "patronymic")}}
        draws |= {f"__{p}{k}": one(p, f"{p}{k}") for p in ("city", "street_type", "street", "region")} | {f"__village{k}": one("city", f"village{k}"), f"__suffix{k}": u(f"suffix{k}")}
        draws |= {f"__{d}{k}": number(low, high, f"{d}{k}") for d, low, high in (("house", 1, 200), ("apartment", 1, 400), ("entrance", 1, 8), ("postal_code", 100_000, 999_999), ("village_house", 1, 50))}
    edits: dict[str, Column] = {}
    for k, edge in (("", F.col("edge_case")), ("_2", F.lit(None).cast("string"))):
        c = lambda d: F.col(f"__{d}{k}")  # noqa: B023, E731
        own = (c("suffix"), c("village"), c("village_house"))
        for d, x in zip(("town", "road_kind", "road", "number"), edited_address(edge, c("city"), c("street_type"), c("street"), c("house"), *own), strict=True):
            edits[f"__{d}{k}"] = x
        edits[f"__family{k}"] = F.when(edge.eqNullSafe(F.lit("hyphenated_surname")), F.concat(c("surname"), F.lit("-"), c("other"))).otherwise(c("surname"))
        edits[f"__said{k}"] = compose_name(F.col("name_form"), edge, c("surname"), c("first"), c("patronymic"), c("other"))
        edits[f"__where{k}"] = compose_address(F.col("addr_form"), edge, c("city"), c("street_type"), c("street"), c("house"), c("apartment"), c("entrance"), c("postal_code"), c("region"), *own)

    def name(k: str) -> Column:
        c = lambda d: F.col(f"__{d}{k}")
        return F.struct(F.when(c("male"), "M").otherwise("F").alias("gender"), c("family").alias("surname"), c("first").alias("firstname"), c("patronymic").alias("patronymic"), F.concat_ws(" ", c("family"), c("first"), c("patronymic")).alias("full_fio"))

    def address(k: str) -> Column:
        c = lambda d: F.col(f"__{d}{k}")
        return F.struct(c("town").alias("city"), F.lower(F.left(c("city"), F.lit(3))).alias("city_abbr"), c("region").alias("region"), c("road_kind").alias("street_type"), c("road").alias("street_name"), c("number").alias("house"), c("apartment").alias("apartment"), c("entrance").alias("entrance"), c("postal_code").alias("postal_code"), c("where").alias("address_string"))

    named, placed = F.col("name_form").isNotNull(), F.col("addr_form").isNotNull()
    again = F.col("multi_entity") & named & (~placed | (u("second") < 0.5))
    there = F.col("multi_entity") & placed & ~again
    out = df.withColumns(draws).withColumns(edits)
    out = out.withColumns({"name_data": F.when(named, name("")), "name_text": F.when(named, F.col("__said")), "addr_data": F.when(placed, address("")), "name_data_2": F.when(again, name("_2")), "addr_data_2": F.when(there, address("_2"))})
    return out.drop(*draws, *edits)


def mix_audit(df: DataFrame, weights: DataFrame, dimensions: list[str]) -> DataFrame:
    """(dimension, value, n, share, target, difference) of the rows' values against target weights; rows without a value take no part."""
    one = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])).alias("x")
    seen = df.select(one).select("x.*").where("value is not null").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dimension"))
    told = seen.withColumn("share", share).join(weights.where(F.col("dimension").isin(dimensions)).withColumnRenamed("weight", "target"), ["dimension", "value"], "full")
    return told.select("dimension", "value", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"), F.round(F.coalesce("target", F.lit(0.0)), 6).alias("target"), F.round(F.coalesce("share", F.lit(0.0)) - F.coalesce("target", F.lit(0.0)), 6).alias("difference"))
