"""Column functions over text; all stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Unicode text knows them. Java's \R lacks three of them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: White space at either end that strip() takes off.
BLANK = "[\\s\x1c-\x1f\x85\xa0  -     　]"
HEADING = r"^(#{1,6})\s+(.*)$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lines(text: str | Column) -> Column:
    """Lines without their ends; a line end at the very end opens no further line, and empty text has none."""
    parts = F.split(_col(text), LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def strip(text: str | Column) -> Column:
    return F.regexp_replace(_col(text), f"^{BLANK}+|{BLANK}+$", "")


def clean(text: str | Column) -> Column:
    """One kind of line end, no NUL, no blanks before a line end, at most one empty line in a row, nothing at either end."""
    one = F.regexp_replace(F.regexp_replace(_col(text), "\r\n?", "\n"), "\x00", "")
    return strip(F.regexp_replace(F.regexp_replace(one, "[ \t]+(?=\n|$)", ""), "\n{3,}", "\n\n"))


def extension(path: str | Column) -> Column:
    """Lower-case suffix of the base name with its dot; empty where there is none. A leading dot makes no suffix."""
    return F.lower(F.regexp_extract(_col(path), r"[^/\\.][^/\\]*?(\.[^./\\]+)$", 1))


def numbered(text: str | Column) -> Column:
    """array<struct<line_no, text>>, from 1."""
    return F.transform(lines(text), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("text")))


def hits(text: str | Column, pattern: str, *, literal: bool = False, ignore_case: bool = False, most: int = 20, width: int = 400) -> Column:
    """array<struct<line_no, text>> of the first `most` lines in which the pattern is found, stripped, then cut.

    Everything happens in the row, so a search shuffles nothing. A literal is looked up without a regular expression.
    """
    if literal:
        found = (lambda x: F.lower(x.text).contains(pattern.lower())) if ignore_case else (lambda x: x.text.contains(pattern))
    else:
        found = lambda x: x.text.rlike(("(?i)" if ignore_case else "") + pattern)
    first = F.slice(F.filter(numbered(text), found), 1, most)
    return F.transform(first, lambda x: F.struct(x.line_no.alias("line_no"), F.substring(strip(x.text), 1, width).alias("text")))


def outline(text: str | Column, most: int = 200) -> Column:
    """array<struct<line_no, level, title>> of the first headings."""
    heads = F.slice(F.filter(numbered(text), lambda x: x.text.rlike(HEADING)), 1, most)
    return F.transform(heads, lambda x: F.struct(x.line_no.alias("line_no"), F.length(F.regexp_extract(x.text, HEADING, 1)).alias("level"), F.regexp_extract(x.text, HEADING, 2).alias("title")))


def page(text: str | Column, offset: int, size: int) -> Column:
    """struct<page, remaining, next_offset>: a piece of the text; next_offset is null on the last page."""
    text = _col(text)
    left = F.greatest(F.length(text) - offset - size, F.lit(0))
    return F.struct(F.substring(text, offset + 1, size).alias("page"), left.alias("remaining"), F.when(left > 0, F.lit(offset + size)).alias("next_offset"))


def truncated(text: str | Column, most: int) -> Column:
    """At most so many characters, then a note that says how many are missing; 0 means no limit."""
    text = _col(text)
    if not most:
        return text
    note = F.concat(F.substring(text, 1, most), F.lit("\n[... "), (F.length(text) - most).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(text) > most, note).otherwise(text)


def rendered(title: Column, meta: dict[str, Column], warnings: Column, body: Column, most: int = 0) -> Column:
    """A Markdown page: heading, the metadata that isn't empty, warnings, the text."""
    facts = [F.when((v.cast("string") != "") & v.isNotNull(), F.concat(F.lit(f"- {k}: "), v.cast("string"))) for k, v in meta.items()]
    warned = F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("> "), w)), "\n")
    parts = [F.concat(F.lit("# "), title), F.concat_ws("\n", *facts), warned, truncated(body, most)]
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "\n\n")


def markdown_table(rows: Column) -> Column:
    """array<array<string>>, the first row the header, as a Markdown table; short rows are padded, empty ones left out."""
    escaped = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    kept = F.filter(rows, lambda r: F.exists(r, lambda c: F.coalesce(c, F.lit("")) != ""))
    width = F.aggregate(kept, F.lit(0), lambda w, r: F.greatest(w, F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, escaped), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    text = F.transform(kept, line)
    return F.when(F.size(kept) > 0, F.array_join(F.concat(F.slice(text, 1, 1), F.array(rule), F.slice(text, F.lit(2), F.greatest(F.size(text) - 1, F.lit(0)))), "\n")).otherwise(F.lit(""))


def distinct_in_order(values: Column) -> Column:
    """Each value once, where it first stands."""
    return F.array_distinct(values)


def day_from_serial(serial: Column) -> Column:
    """A spreadsheet's day number as a date."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int"))
