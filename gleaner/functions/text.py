"""Text helpers as Columns: snippets, positions, headings, page estimates and symbol lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def snippet(text: Column, n: int) -> Column:
    """One line of at most ``n`` code points, cut to ``n - 3`` and ``...`` if longer."""
    flat = F.translate(text, "\n", " ")
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n - 3), F.lit("..."))).otherwise(flat)


def preview(text: Column, n: int) -> Column:
    """The first ``n`` code points, with ``...`` if there is more."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def byte_of(text: Column, offset: Column) -> Column:
    """Byte offset of a 0-based code point offset."""
    return F.octet_length(F.substring(text, F.lit(1), offset.cast("int"))).cast("long")


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of a 0-based code point offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return (F.char_length(before) - F.char_length(F.translate(before, "\n", ""))).cast("int")


def heading_level(line: Column) -> Column:
    """Level 1 to 6 of a ``#`` heading line, else null."""
    hashes = F.regexp_extract(line, r"^\s*(#{1,6})\s", 1)
    return F.when(hashes != "", F.char_length(hashes))


def is_title_line(text: Column) -> Column:
    """Whether a paragraph looks like a heading: one short line of few words, half of them capitalised, no final stop."""
    t = F.trim(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return (
        (F.octet_length(t) <= 100) & (t != "") & ~t.endswith(".") & ~t.contains("\n") & (F.size(words) <= 8)
        & (capital >= F.floor(F.size(words) / 2))
    )


def page_estimate(text: Column) -> Column:
    """Pages by form feeds if there are any, else one for each 3,000 bytes, at least 1."""
    feeds = F.char_length(text) - F.char_length(F.translate(text, "\f", ""))
    return F.when(feeds > 0, feeds + 1).otherwise(F.greatest(F.lit(1), F.floor(F.octet_length(text) / 3000))).cast("int")


def paragraphs(text: Column) -> Column:
    """``array<struct<text, byte_offset>>`` of the blocks between blank lines, with running offsets; blank ones left out."""
    parts = F.split(text, "\n\n", -1)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<text:string,byte_offset:bigint>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        item = F.array(F.struct(p.alias("text"), acc["at"].alias("byte_offset")))
        return F.struct((acc["at"] + F.octet_length(p) + 2).cast("long").alias("at"), F.when(F.trim(p) != "", F.concat(acc["out"], item)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, state, step, lambda acc: acc["out"])
