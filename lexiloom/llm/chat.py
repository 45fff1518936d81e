"""Conversations of typed content parts flattened into one training text with its loss mask."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, CONTENT, END = "<|turn|>", "<|content|>", "<|end|>"
# Strings that mean something to some template or tokenizer. Fixed values.
CONTROL = ("<|", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# A part is (kind, text, ref, units): units are pixels, seconds or pages.
PART = "struct<kind:string,text:string,ref:string,units:double>"
# Tokens that a placeholder stands for: per patch of 28 x 28 pixels, per second, per page.
RATES = {"image": 1 / 784, "audio": 25.0, "document": 600.0}


def text_part(text: Column) -> Column:
    """A list of one text part."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("double").alias("units"))).cast(f"array<{PART}>")


def escaped(text: Column) -> Column:
    """Text without control strings: backslashes doubled, a backslash after a control string's first character."""
    firsts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), firsts, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _run(parts: Column, marks: Column, i: Column) -> Column:
    """The texts between the i-th placeholder and the next one as one text, escaped."""
    first = F.when(i == 0, F.lit(0)).otherwise(F.get(marks, i - 1))
    last = F.coalesce(F.get(marks, i), F.size(parts) + 1)
    texts = F.slice(parts, first + 1, last - first - 1)
    return escaped(F.array_join(F.transform(texts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))


def _laid_out(pieces: Column) -> Column:
    """Where in a turn's content each piece (text, spoken) begins."""
    step = lambda s, p: F.struct(
        (s["at"] + F.length(p["text"])).alias("at"),
        F.when(p["spoken"] & (p["text"] != ""), F.concat(s["spans"], F.array(F.struct(s["at"].alias("at"), F.length(p["text"]).alias("length"))))).otherwise(s["spans"]).alias("spans"))
    none = F.array().cast("array<struct<at:int,length:int>>")
    return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda s: s["spans"])


def _tokens(part: Column) -> Column:
    rate = F.lit(0.0)
    for kind, per_unit in RATES.items():
        rate = F.when(part["kind"] == kind, F.lit(per_unit)).otherwise(rate)
    return F.ceil(F.coalesce(part["units"], F.lit(0.0)) * rate).cast("bigint")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss, attachments) from rows (conv_id, turn, role, parts).

    ``parts`` are visited in order: an image, audio or document part becomes a placeholder; the texts
    between two placeholders are one text, which is escaped as a whole, so that no control string is left, not even
    one that lay across parts, and the text can be read back. ``attachments`` holds (kind, ref, tokens) of
    the placeholders in order, tokens being what each is expanded to. ``loss`` holds (start, length) in code points
    of the assistants' texts; placeholders are no part of it.

    Cases. Turns are ordered by number (null first), then role and content, so ties have a
    fixed order and repeated rows all stay. Null roles and texts are empty, null parts and
    parts of other kinds vanish, null or negative units expand to nothing. A null conv_id is
    a conversation of its own. An empty table gives an empty one. Other columns are not read.
    """
    known = lambda p: p.isNotNull() & p["kind"].isin("text", *RATES)
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(known(p), F.lit(False)))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), parts.alias("parts"))
    marks = F.filter(F.transform("parts", lambda p, i: F.when(p["kind"] != "text", i + 1)), lambda i: i.isNotNull())
    rows = rows.select("*", marks.alias("marks"), F.filter("parts", lambda p: p["kind"] != "text").alias("objects"))
    texts = F.transform(F.sequence(F.lit(0), F.size("marks")), lambda i: F.struct(_run(F.col("parts"), F.col("marks"), i).alias("text"), F.lit(True).alias("spoken")))
    shown = F.transform("objects", lambda p: F.struct(F.concat(F.lit("<|"), p["kind"], F.lit("|>")).alias("text"), F.lit(False).alias("spoken")))
    # texts and placeholders in turn; the last text has no placeholder after it
    pieces = F.flatten(F.zip_with(texts, shown, lambda t, o: F.array_compact(F.array(t, o))))
    rows = rows.select("conv_id", "turn", "role", "objects", pieces.alias("pieces")).select(
        "conv_id", "turn", "role",
        F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(CONTENT)).alias("head"), F.array_join(F.col("pieces.text"), "").alias("body"), _laid_out(F.col("pieces")).alias("spans"),
        F.transform("objects", lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), F.greatest(_tokens(p), F.lit(0)).alias("tokens"))).alias("attachments"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.xxhash64("attachments"))
    length = F.length("head") + F.length("body") + len(END)
    rows = rows.select("*", F.row_number().over(order).alias("nth"), F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("until"))
    start = F.col("until") - F.length("body") - len(END)
    loss = F.transform("spans", lambda x: F.struct((start + x["at"]).alias("start"), x["length"].alias("length")))
    rows = rows.select(
        "conv_id", F.struct(
            "nth", F.concat("head", "body", F.lit(END)).alias("piece"), "attachments",
            F.when(F.col("role") == "assistant", loss).otherwise(F.slice(loss, 1, 0)).alias("loss")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return whole.select(
        "conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"),
        F.flatten(F.col("t.loss")).alias("loss"), F.flatten(F.col("t.attachments")).alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) of each turn, read back from a formatted conversation without attachments."""
    quoted = lambda mark: re.escape(mark).replace("<", r"\<")
    pieces = F.filter(F.split(formatted, quoted(TURN)), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(p, CONTENT, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(p, CONTENT, -1), END, 1)).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda m: unescaped(F.substring(formatted, (m["start"] + 1).cast("int"), m["length"]))), "")


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, all read back from the output."""
    rows = formatted.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("masked"), "attachments")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return rows.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), digest(said).alias("turns_sha256"),
        F.length("masked").cast("bigint").alias("loss_chars"), digest(F.col("masked")).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"]).alias("attachment_tokens"))
