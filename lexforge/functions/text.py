"""Column functions on text, ids and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexforge.schemas import NO_DATE

#: White space as Unicode has it, for Java patterns and for RE2.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


#: The same as characters.
SPACE_CHARS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def clean_id(c: Column) -> Column:
    """'Unknown_ID' for null and empty ids, trimmed otherwise."""
    return F.when(c.isNull() | (c == ""), "Unknown_ID").otherwise(strip(c.cast("string")))


def prettify_date(c: Column) -> Column:
    """'yyyy-MM-ddT...' as 'dd/MM/yyyy'; a default for missing dates; anything else as it is. Works on strings only."""
    parts = F.split(F.get(F.split(c, "T"), 0), "-")
    return (
        F.when(c.isNull() | c.isin("", "N/A", "None"), NO_DATE)
        .when(F.size(parts) == 3, F.concat_ws("/", F.get(parts, 2), F.get(parts, 1), F.get(parts, 0)))
        .otherwise(c)
    )


def tail(c: Column, n: int = 500) -> Column:
    """The last n characters, stripped."""
    return strip(F.expr("NULL") if n <= 0 else F.right(c, F.lit(n)))


def doc_info(name: Column, number: Column) -> Column:
    return F.concat(name, F.lit(" (Số hiệu: "), number, F.lit(")"))


def contextual_text(context: Column, text: Column) -> Column:
    """The text under its context line, if it has one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat(context, F.lit("\n\nNội dung chi tiết:\n"), text)).otherwise(text)


def template_context(text: Column, title: Column) -> Column:
    """A context line without a language model: the pluggable default."""
    return F.concat(F.lit("Đây là quy định về "), F.lower(F.substring_index(F.substring_index(text, "\n", 1), ".", 1)), F.lit(" nằm trong "), title, F.lit("."))


def json_text(c: Column, path: str) -> Column:
    """A member of a JSON text; null where the text as a whole is invalid."""
    return F.try_variant_get(F.try_parse_json(c), path, "string")


def page_count(total: Column, size: int) -> Column:
    """Pages of ``size`` rows; one page for a size below one."""
    return F.lit(1).cast("bigint") if size <= 0 else F.ceil(total / size)
