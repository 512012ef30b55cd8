"""Types of text values, and their conversion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .timestamps import ANY

_TRUE, _FALSE = ("true", "yes", "y", "1"), ("false", "no", "n", "0")
_INTEGER = r"^\s*[+-]?\d+(?:_\d+)*\s*$"
_FLOAT = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:nan|inf|infinity))\s*$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def infer_type(text: Column) -> Column:
    """boolean, integer, float, timestamp or string, in that order of preference; the empty text is a string."""
    t = strip(text)
    return F.when(F.lower(t).isin(*_TRUE, *_FALSE), "boolean").when(t.rlike(_INTEGER), "integer").when(t.rlike(_FLOAT), "float").when(t.rlike(ANY), "timestamp").otherwise("string")


def convert(text: Column, kind: str) -> Column:
    """A typed value, null where the text isn't one."""
    t = F.replace(strip(text), F.lit("_"), F.lit(""))
    if kind == "integer":
        return F.when(text.rlike(_INTEGER), t.try_cast("bigint"))
    if kind == "float":
        return F.when(text.rlike(_FLOAT), t.try_cast("double"))
    if kind == "boolean":
        return F.when(text.isNotNull(), F.lower(text).isin("true", "1", "yes", "on"))
    return text
