"""Fill in the middle: a text cut at line ends into prefix, middle and suffix, and put together around markers.

Escaped marker injection, all in DataFrame functions: a delimiter that the text may hold itself is escaped, regexp_replace
appends the delimiter after every unit, its count is the number of units, substring_index extracts the parts between two ranks, and these are
unescaped and assembled. restored() goes the other way, from the output and its form alone.

The cuts are drawn from the digest of a seed and the doc_id, so reruns agree and rows that repeat an id and a text get the same output.
A null text is empty; an empty text, one that holds a marker, and one that the rate leaves out are plain: the output is the text. A null doc_id is drawn as an
empty one. Units are never dropped, whatever a text's length: each function passes once over it. A text of one unit has empty parts. An empty table gives no
rows. Columns of the documents stay as they are; where one has the name of a new column, the new one takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a line with its end, or what follows the last one.
UNIT = r"[^\n]*\n|[^\n]+"
#: Before the prefix, the suffix and the middle of an output.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Hundredths of the texts that are transformed, and of these the hundredths with the suffix first.
RATE, SPM = 100, 50

# The delimiter, and what makes a delimiter or itself harmless by a letter that follows.
_END, _ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """Without the delimiter; unescaped() gives the text back."""
    return F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + "e")), F.lit(_END), F.lit(_ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESCAPE + "d"), F.lit(_END)), F.lit(_ESCAPE + "e"), F.lit(_ESCAPE))


def _part(marked: Column, start: Column, stop: Column) -> Column:
    """The units from rank start up to stop, without delimiters. The units before stop first, then the last of these."""
    head = F.call_function("substring_index", marked, F.lit(_END), stop)
    tail = F.when(start == 0, head).otherwise(F.call_function("substring_index", head, F.lit(_END), start - stop))
    return F.when(start < stop, unescaped(F.replace(tail, F.lit(_END), F.lit("")))).otherwise(F.lit(""))


def _drawn(seed: int, doc_id: str, group: int) -> Column:
    """The group-th eight digits of the digest as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("bigint")


def fill_in_middle(documents: DataFrame, unit: str = UNIT, seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """documents with n (units), form (plain, psm, spm), prefix, middle, suffix (null where plain) and output."""
    p, s, m = (F.lit(x) for x in markers)
    keep = [c for c in documents.columns if c.lower() not in {"n", "form", "prefix", "middle", "suffix", "output"}]
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.regexp_replace(escaped(text), unit, f"$0{_END}")
    held = documents.select(F.struct(*keep).alias("row"), text.alias("text"), marked.alias("marked"), *[_drawn(seed, "doc_id", k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    held = held.withColumn("n", F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(_END), F.lit(""))))
    free = (F.col("n") > 0) & (F.col("h3") % 100 < rate)
    for x in markers:
        free &= ~F.col("text").contains(x)
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    held = held.withColumns({
        "form": F.when(~free, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm"),
        "start": F.least(first, second).cast("int"), "stop": F.greatest(first, second).cast("int"),
    })
    part = lambda a, b: F.when(F.col("form") != "plain", _part(F.col("marked"), a, b))
    zero, start, stop, n = F.lit(0), F.col("start"), F.col("stop"), F.col("n").cast("int")
    held = held.select("row", "text", "form", F.col("n").cast("bigint").alias("n"), part(zero, start).alias("prefix"), part(start, stop).alias("middle"), part(stop, n).alias("suffix"))
    psm, spm_ = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("text"))
    return held.select("row.*", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text from an output and its form. A marker occurs once in an output that isn't plain, so each cut is certain."""
    p, s, m = markers
    # The part that stands first, between the first marker and the second, and so on.
    after = lambda x: F.substring_index(output, x, -1)
    upto = lambda c, x: F.substring_index(c, x, 1)
    psm = F.concat(upto(after(p), s), after(m), upto(after(s), m))
    spm = F.concat(upto(after(p), m), after(m), upto(after(s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(made: DataFrame) -> DataFrame:
    """doc_id, n, form, the lengths of prefix and middle, and the digests of the output and of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
