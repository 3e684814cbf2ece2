"""Tolerant coercions of loosely typed values, as Column expressions that give NULL-free typed values.

``to_`` functions take text, ``json_`` functions a VARIANT, whose type counts: the text "true" is no number and the
text "2" no truth value, though true and 2 are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that count as true and as false.
TRUE_WORDS = ("true", "1", "yes", "keep", "kept")
FALSE_WORDS = ("false", "0", "no", "drop", "dropped")
#: What counts as a number: underscores between digits, no type suffix.
_NUMBER = r"(?i)^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+)?$|^[+-]?(inf|infinity)$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _or(c: Column, fallback: Column | float | bool | str) -> Column:
    return F.coalesce(c, fallback if isinstance(fallback, Column) else F.lit(fallback))


def _number(text: Column) -> Column:
    s = strip(text)
    return F.when(s.rlike(_NUMBER), F.regexp_replace(s, "_", "").try_cast("double"))


def _truth(text: Column) -> Column:
    s = F.lower(strip(text))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_number(c: Column, fallback: Column | float = 0.0) -> Column:
    """A double from text; what is no number, NaN included, gives the fallback."""
    return _or(_number(c), fallback if isinstance(fallback, Column) else float(fallback))


def _truncated(x: Column, fallback: int) -> Column:
    return F.coalesce(F.when(F.abs(x) < F.lit(9.2e18), x).cast("long"), F.lit(fallback).cast("long"))


def to_integer(c: Column, fallback: int = 0) -> Column:
    """A long, truncated towards zero; infinities give the fallback."""
    return _truncated(_number(c), fallback)


def to_boolean(c: Column, fallback: bool = False) -> Column:
    """By word; other text gives the fallback."""
    return _or(_truth(c), fallback)


def _kind(v: Column) -> Column:
    """STRING, BOOLEAN, the name of a numeric type, NONE for null and missing, or MANY for arrays and objects."""
    k = F.schema_of_variant(v)
    return F.when(k.isNull() | (k == "VOID"), "NONE").when(k.startswith("ARRAY") | k.startswith("OBJECT"), "MANY").otherwise(k)


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _json_number(v: Column) -> Column:
    k = _kind(v)
    return F.when(k == "STRING", _number(_as(v, "string"))).when(~k.isin("NONE", "MANY"), _as(v, "double"))


def json_number(v: Column, fallback: Column | float = 0.0) -> Column:
    """A double; true and false count as 1 and 0, text as it reads."""
    return _or(_json_number(v), fallback if isinstance(fallback, Column) else float(fallback))


def json_integer(v: Column, fallback: int = 0) -> Column:
    return _truncated(_json_number(v), fallback)


def json_boolean(v: Column, fallback: bool = False) -> Column:
    """Truth values as they are, text by word, numbers true unless zero; anything else gives the fallback."""
    k = _kind(v)
    known = F.when(k == "BOOLEAN", _as(v, "boolean")).when(k == "STRING", _truth(_as(v, "string"))).when(~k.isin("NONE", "MANY"), _as(v, "double") != 0)
    return _or(known, fallback)


def json_text(v: Column, default: Column | str | None) -> Column:
    """The value as text; ``default`` where it is missing, null, "", 0, false or an empty container. The texts "0" and
    "false" stay; true reads True."""
    k, text = _kind(v), _as(v, "string")
    empty = (k == "NONE") | ((k == "STRING") & (text == "")) | ((k == "BOOLEAN") & ~_as(v, "boolean")) | ((k == "MANY") & F.to_json(v).isin("[]", "{}"))
    empty = empty | (~k.isin("NONE", "STRING", "BOOLEAN", "MANY") & (_as(v, "double") == 0))
    stated = F.when(k == "MANY", F.to_json(v)).when(k == "BOOLEAN", "True").otherwise(text)
    return F.when(empty, default if isinstance(default, Column) else F.lit(default)).otherwise(stated)


def is_missing(c: Column, number: bool = False) -> Column:
    """Null, blank text or, of a floating-point ``number``, NaN. The text "nan" is a value."""
    return c.isNull() | F.isnan(c) if number else c.isNull() | (strip(c) == "")


def text_or_empty(c: Column) -> Column:
    return F.when(is_missing(c), F.lit("")).otherwise(c.cast("string"))


def clamp(x: Column, lo: float, hi: float | None = None) -> Column:
    """Bounds on a value without NaN."""
    low = F.greatest(F.lit(float(lo)), x)
    return low if hi is None else F.least(F.lit(float(hi)), low)


def title_case(c: Column) -> Column:
    """Each run of ASCII letters with its first letter upper and the others lower."""
    parts = F.split(c, r"(?<=[^A-Za-z])")
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 30)))), "")
