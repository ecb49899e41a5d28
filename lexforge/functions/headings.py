"""Headings of law texts as Markdown headings: six ordered rewrites, one for bare Roman numerals, and blank-line collapse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.functions.text import SPACE

#: Heading word with its number, in the order of the rewrites, and the Markdown level. Word and pattern are apart because two
#: engines use them (Spark and, in the tests, DuckDB) and blanks are those of Unicode in both.
HEADINGS = (
    (rf"Phần{SPACE}+[IVXLCDM0-9]+", "#"),
    (rf"Chương{SPACE}+[IVXLCDM0-9]+", "##"),
    (rf"Mục{SPACE}+[0-9]+", "###"),
    (rf"Tiểu{SPACE}+mục{SPACE}+[0-9]+", "####"),
    (rf"Điều{SPACE}+[0-9]+[a-zA-Z]*", "#####"),
    (rf"Phụ{SPACE}+lục{SPACE}*[IVXLCDM0-9]*", "#"),
)


def heading_pattern(word: str) -> str:
    return rf"^[#*]*{SPACE}*({word}){SPACE}*[.:*]*{SPACE}*(.*)$"


ROMAN = rf"^[#*]*{SPACE}*([IVXLCDM]+){SPACE}*[.:*]+{SPACE}*(.*)$"


def promote_headings(c: Column) -> Column:
    """Each heading on a line of its own with its '#' level, its title on the next line."""
    return reduce(lambda x, h: F.regexp_replace(x, "(?imud)" + heading_pattern(h[0]), f"{h[1]} $1\n$2"), HEADINGS, c)


def roman_headings(c: Column) -> Column:
    return F.regexp_replace(c, "(?md)" + ROMAN, "## $1. $2")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")


def normalize_headings(c: Column) -> Column:
    return collapse_blank_lines(roman_headings(promote_headings(c)))
