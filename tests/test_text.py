"""Quirks of text functions on tiny inputs."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions import bits
from tidewright.functions import text as tx
from tidewright.operators import integrity


def one(spark, col, **given):
    return spark.createDataFrame([tuple(given.values())], list(given)).select(col.alias("x")).first().x


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029", "\n"])
def test_lines_as_python(spark, text):
    assert one(spark, tx.lines("t"), t=text) == text.splitlines()


@pytest.mark.parametrize("text", ["", " \t a b \u00a0\u2003", "\x1c\x85x\u3000", "\n\n"])
def test_strip_as_python(spark, text):
    assert one(spark, tx.strip("t"), t=text) == text.strip()


def test_clean(spark):
    assert one(spark, tx.clean("t"), t="\r\n a \t\r\nb\x00\r\r\r\rc  \n") == "a\nb\n\nc"


@pytest.mark.parametrize(("path", "ext"), [("a/b.TXT", ".txt"), ("a/b.tar.gz", ".gz"), ("a.b/c", ""), (".hidden", ""), ("x/.hidden", ""), ("a.", "")])
def test_extension(spark, path, ext):
    assert one(spark, tx.extension("p"), p=path) == ext


def test_hits_are_capped_then_cut(spark):
    got = one(spark, tx.hits("t", "a.c", most=2, width=3), t="  abcd\nx\nazc\naoc")
    assert [(h.line_no, h.text) for h in got] == [(1, "abc"), (3, "azc")]
    assert len(one(spark, tx.hits("t", "a.c", literal=True), t="abc\na.c")) == 1


def test_table_and_page(spark):
    assert one(spark, tx.markdown_table(F.array(F.array(F.lit("a|b"), F.lit("c")), F.array(F.lit("")), F.array(F.lit("d\ne")))), x=1) == "| a\\|b | c |\n| --- | --- |\n| d<br>e |  |"
    assert one(spark, tx.page("t", 2, 3), t="abcdefg").asDict() == {"page": "cde", "remaining": 2, "next_offset": 5}
    assert one(spark, tx.truncated("t", 3), t="abcdef") == "abc\n[... 3 more characters]"
    assert one(spark, tx.truncated("t", 0), t="abcdef") == "abcdef"


def test_serial_day(spark):
    assert str(one(spark, tx.day_from_serial(F.lit(45000.5)), x=1)) == "2023-03-15"


def test_bits(spark):
    assert one(spark, bits.floor_div(F.col("v"), 2), v=-7) == -4
    assert one(spark, bits.hex_to_int(F.col("v")), v="0x7fffffffffffffff") == 2**63 - 1
    assert one(spark, bits.hex_to_int(F.col("v")), v="ffffffffffffffff") is None
    assert one(spark, bits.field(F.col("v"), 8, 2), v=0x3FF) == 3


@pytest.mark.parametrize(("value", "text"), [(0xABC, "0x000000000abc"), (2**48 - 1, "0x" + "f" * 12), (2**48, "0x1" + "0" * 12), (600_000 * 2654435761, "0x5a884645e3bc0")])
def test_hex_keeps_all_digits(spark, value, text):
    shown = bits.int_to_hex(F.col("v").cast("bigint"), 12)
    assert one(spark, shown, v=value) == text
    assert one(spark, bits.hex_to_int(shown), v=value) == value


@pytest.mark.parametrize(("path", "safe"), [("a/b", True), ("", False), ("../a", False), ("a/../..", False), ("a/..", False), ("/a", False), ("c:\\a", False), ("./a", True)])
def test_safe_path(spark, path, safe):
    assert one(spark, integrity.safe_path(F.col("p")), p=path) is safe
