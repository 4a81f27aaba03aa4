"""Chat formatting over typed content parts, with DataFrame functions alone.

A turn is ``<|im_start|>role\\n`` body ``<|im_end|>\\n``. Inside roles and texts ``&`` is written ``&amp;``, ``<|`` is written
``&lt;|`` and a role's line feed ``&#10;``, so control strings come from the template only and the way back is exact. Parts that
are no text stand as placeholders (``<|image|>``, ``<|audio|>``, ``<|document|>``) in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part takes in place of its placeholder, unless the part says how many.
PART_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#10;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def kind(part: Column) -> Column:
    """A part's type; one that is neither text nor known counts as a document."""
    named = F.lower(F.coalesce(part["type"], F.lit("text")))
    return F.when(named.isin("text", *PART_TOKENS), named).otherwise(F.lit("document"))


def visit(part: Column) -> Column:
    """What stands for one part in the body."""
    return F.when(kind(part) == "text", escaped(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(part), F.lit("|>")))


def attachments(parts: Column) -> Column:
    """References of the parts that are no text, in order, with the tokens that each expands to."""
    tokens = lambda p: F.coalesce(p["tokens"], F.element_at(F.create_map(*[F.lit(x) for k, v in PART_TOKENS.items() for x in (k, v)]), kind(p)).cast("long"))
    placed = F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens")))
    return F.filter(placed, lambda p: p["type"] != "text")


def format_chats(turns: DataFrame, content: str | None = None) -> DataFrame:
    """One row for each conversation of ``turns`` (conv_id, turn, role, text).

    Returns conv_id, formatted, loss_spans (start and length, in bytes of ``formatted``, of each assistant body), attachments
    (turn, part, type, ref, tokens) and attachment_tokens. ``content`` names a column of parts, array<struct<type, text, ref,
    tokens>>; where it is null, or not named, the text is the one part. Turns go by turn, then role, then body; nulls come
    first and are empty as role or text; a null conv_id is a conversation of its own. A conversation is one string, so it has
    to fit into memory; the turns of all others are never held together.
    """
    part = "array<struct<type:string,text:string,ref:string,tokens:bigint>>"
    one = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens"))).cast(part)
    parts = F.coalesce(F.col(content).cast(part), one) if content else one
    role = F.coalesce(F.col("role"), F.lit(""))
    rows = turns.select("conv_id", "turn", (role == "assistant").alias("learn"), F.concat(F.lit(START), F.replace(escaped(role), F.lit("\n"), F.lit("&#10;")), F.lit("\n")).alias("head"), F.array_join(F.transform(parts, visit), "").alias("body"), attachments(parts).alias("refs"))
    piece = F.concat("head", "body", F.lit(END + "\n"))
    by = Window.partitionBy("conv_id").orderBy("turn", "head", "body")
    rows = rows.withColumns({"at": F.row_number().over(by), "before": F.coalesce(F.sum(F.octet_length(piece)).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    one_turn = F.struct("at", piece.alias("piece"), "learn", (F.col("before") + F.octet_length("head")).alias("start"), F.octet_length("body").cast("long").alias("length"), "turn", "refs")
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one_turn)).alias("t"))
    refs = F.flatten(F.transform("t", lambda x: F.transform(x["refs"], lambda r: F.struct(x["turn"].alias("turn"), r["part"].alias("part"), r["type"].alias("type"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    return got.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda x: x["learn"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
        refs.alias("attachments"),
        F.aggregate(refs, F.lit(0).cast("long"), lambda a, r: a + r["tokens"]).alias("attachment_tokens"),
    )


def parsed(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text>>, unescaped; placeholders stay as they are."""
    split = F.split(formatted, r"<\|im_start\|>", -1)
    role = lambda x: F.substring_index(x, "\n", 1)
    text = lambda x: F.replace(F.substr(x, F.length(role(x)) + 2), F.lit(END + "\n"), F.lit(""))
    return F.transform(F.slice(split, 2, F.greatest(F.size(split) - 1, F.lit(0))), lambda x: F.struct(unescaped(role(x)).alias("role"), unescaped(text(x)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    in_bytes = F.transform(F.array(formatted.cast("binary")), lambda b: F.array_join(F.transform(spans, lambda s: unescaped(F.substring(b, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string"))), ""))
    return F.element_at(in_bytes, 1)


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from format_chats' output."""
    got = chats.select("conv_id", "formatted", parsed(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
