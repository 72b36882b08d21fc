"""Text and JSON expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CONTROLS = "".join(map(chr, range(0x21)))


def computed_once(df: DataFrame) -> DataFrame:
    """The same rows behind a generator, through which the optimizer does not copy the columns' expressions into their uses."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def trimmed(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.btrim(c, F.lit(CONTROLS))


def is_blank(c: Column) -> Column:
    """Null, empty, or nothing but characters up to U+0020."""
    return F.coalesce(trimmed(c) == "", F.lit(True))


def json_text(value: Column, path: str) -> Column:
    """A field as text; missing and null are null."""
    return F.get_json_object(value, path)


def json_long(value: Column, path: str) -> Column:
    """A field as a whole number; missing and malformed are 0."""
    return F.coalesce(F.get_json_object(value, path).try_cast("bigint"), F.lit(0).cast("bigint"))


def joined(*parts: Column) -> Column:
    """Parts as text with _ between."""
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def words(c: Column) -> Column:
    """Pieces between single spaces, without empty pieces at the end.

    A line of spaces alone has none, an empty line has one empty piece, and a null line is null.
    """
    held = F.regexp_replace(c, " +$", "")
    return F.when(F.length(held) > 0, F.split(held, " ")).when(F.length(c) > 0, F.array().cast("array<string>")).when(c.isNotNull(), F.array(F.lit("")))


#: Whitespace of any script but for the no-break spaces.
BLANKS = r"^[\p{Z}\x09-\x0D\x1C-\x1F&&[^\u00A0\u2007\u202F]]*$"


def is_white(c: Column) -> Column:
    """Null, empty, or nothing but whitespace of any script."""
    return F.coalesce(c.rlike(BLANKS), F.lit(True))
