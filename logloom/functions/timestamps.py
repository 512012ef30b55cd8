"""Timestamp detection in text as Column expressions over a registry of shapes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DETECTED = "array<struct<ts:timestamp_ntz,offset_min:int,format:string,confidence:double>>"


@dataclass(frozen=True)
class Shape:
    """A timestamp shape: where it stands in text, how Spark reads it, and how far it is trusted."""

    name: str
    regex: str
    pattern: str  # Spark datetime pattern, or "unix:<digits after seconds>"
    base: float
    specificity: str
    zoned: bool = False
    micros: bool = False


_D, _T, _F = r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}", r"\.\d{1,6}"
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY = r"(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
# fixed values: names, base confidences and specificities in detection order
SHAPES = (
    Shape("iso8601_utc_ms", rf"\b{_D}T{_T}{_F}Z", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", 0.98, "high", True, True),
    Shape("iso8601_utc", rf"\b{_D}T{_T}Z", "yyyy-MM-dd'T'HH:mm:ss", 0.95, "high", True),
    Shape("iso8601_tz", rf"\b{_D}T{_T}(?:{_F})?[+-]\d{{2}}:?\d{{2}}\b", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", 0.92, "high", True, True),
    Shape("iso8601_naive", rf"\b{_D}T{_T}(?:{_F})?\b", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", 0.85, "high", False, True),
    Shape("rfc2822", rf"\b{_DAY}, \d{{1,2}} {_MON} \d{{4}} {_T} [+-]\d{{4}}\b", "d MMM yyyy HH:mm:ss", 0.90, "high", True),
    Shape("apache_modjk_bracketed", rf"\b{_DAY} {_MON} +\d{{1,2}} {_T} \d{{4}}\b", "MMM d HH:mm:ss yyyy", 0.88, "high"),
    Shape("apache_common", rf"\b\d{{2}}/{_MON}/\d{{4}}:{_T} [+-]\d{{4}}\b", "dd/MMM/yyyy:HH:mm:ss", 0.87, "medium", True),
    Shape("apache_common_no_tz", rf"\b\d{{2}}/{_MON}/\d{{4}}:{_T}\b", "dd/MMM/yyyy:HH:mm:ss", 0.82, "medium"),
    Shape("python_logging", rf"\b{_D} {_T},\d{{3}}\b", "yyyy-MM-dd HH:mm:ss,SSS", 0.90, "high", False, True),
    Shape("standard_datetime", rf"\b{_D} {_T}(?:{_F})?\b", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", 0.80, "medium", False, True),
    Shape("nginx_error", rf"\b\d{{4}}/\d{{2}}/\d{{2}} {_T}\b", "yyyy/MM/dd HH:mm:ss", 0.78, "medium"),
    Shape("us_datetime", rf"\b\d{{2}}-\d{{2}}-\d{{4}} {_T}\b", "MM-dd-yyyy HH:mm:ss", 0.65, "low"),
    Shape("us_slash_datetime", rf"\b\d{{2}}/\d{{2}}/\d{{4}} {_T}\b", "MM/dd/yyyy HH:mm:ss", 0.65, "low"),
    Shape("syslog_long", rf"\b{_MON} +\d{{1,2}} \d{{4}} {_T}\b", "MMM d yyyy HH:mm:ss", 0.82, "medium"),
    Shape("syslog_short", rf"\b{_MON} +\d{{1,2}} {_T}\b", "year:MMM d HH:mm:ss", 0.70, "low"),
    Shape("unix_microseconds", r"\b\d{16}\b", "unix:6", 0.75, "medium", True),
    Shape("unix_milliseconds", r"\b\d{13}\b", "unix:3", 0.80, "medium", True),
    Shape("unix_seconds", r"\b\d{10}\b", "unix:0", 0.85, "medium", True),
    Shape("iso_date", rf"\b{_D}\b", "yyyy-MM-dd", 0.60, "low"),
    Shape("slash_date", r"\b\d{4}/\d{2}/\d{2}\b", "yyyy/MM/dd", 0.55, "low"),
    Shape("us_date", r"\b\d{2}/\d{2}/\d{4}\b", "MM/dd/yyyy", 0.45, "low"),
    Shape("time_only", rf"\b{_T}(?:{_F})?\b", "time:HH:mm:ss[.SSSSSS]", 0.35, "low", False, True),
)
BY_NAME = {s.name: s for s in SHAPES}
#: All shapes at once: at every place the first shape in order that stands there.
ANY = r"\b(?=\d\d|[A-Z][a-z]{2})(?:" + "|".join(s.regex for s in SHAPES) + ")"


def parse_shape(text: Column, shape: Shape, now: datetime) -> Column:
    """The wall clock as written, null if it isn't a date."""
    kind, _, pattern = shape.pattern.partition(":") if shape.pattern.startswith(("unix:", "year:", "time:")) else ("", "", shape.pattern)
    if kind == "unix":
        micros = text.try_cast("bigint") * 10 ** (6 - int(pattern))
        instant = F.timestamp_micros(micros).cast("timestamp_ntz")
        return F.when(micros.between(0, 4_000_000_000 * 10**6), F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant))
    clean = text
    if shape.regex.startswith(rf"\b{_DAY}"):
        clean = F.regexp_replace(clean, rf"^{_DAY},? ", "")
    if "MMM d" in pattern:
        clean = F.regexp_replace(clean, " +", " ")
    if shape.zoned and shape.regex.endswith("Z"):
        clean = F.substring(clean, F.lit(1), F.char_length(clean) - 1)
    elif shape.zoned:  # an offset is under a day, its minutes under an hour
        clean = F.when(~text.rlike(r"[+-](2[4-9]|[3-9]\d):?\d{2}$|[+-]\d{2}:?[6-9]\d$"), F.regexp_replace(clean, r" ?[+-]\d{2}:?\d{2}$", ""))
    if kind == "year":
        clean, pattern = F.concat(F.lit(f"{now.year} "), clean), "yyyy " + pattern
    if kind == "time":
        clean, pattern = F.concat(F.lit(f"{now:%Y-%m-%d} "), clean), "yyyy-MM-dd " + pattern
    return F.try_to_timestamp(clean, F.lit(pattern)).cast("timestamp_ntz")


def _offset(text: Column, name: Column, shapes: tuple[Shape, ...]) -> Column:
    """Minutes east of UTC as written; null without a zone."""
    utc = [s.name for s in shapes if s.zoned and (s.pattern.startswith("unix:") or s.regex.endswith("Z"))]
    zoned = [s.name for s in shapes if s.zoned and s.name not in utc]
    out = F.lit(None).cast("int")
    if zoned:
        hours, minutes = (F.regexp_extract(text, r"[+-](\d{2}):?(\d{2})$", i).try_cast("int") for i in (1, 2))
        value = hours * 60 + minutes
        given = F.when(text.rlike(r"-\d{2}:?\d{2}$"), -value).when(text.rlike(r"\+\d{2}:?\d{2}$"), value).otherwise(0)  # a failing cast is slow
        out = F.when(name.isin(zoned), given)
    return F.when(name.isin(utc), 0).otherwise(out) if utc else out


def _by_name(shapes: tuple[Shape, ...], value) -> Column:
    """A map from the shapes' names to numbers, as one literal."""
    return F.expr("map(" + ", ".join(f"'{s.name}', {value(s)!r}D" for s in shapes) + ")")


def confidence(text: Column, ts: Column, name: Column, now: datetime, shapes: tuple[Shape, ...] = SHAPES) -> Column:
    """The base, raised for precise shapes, zones and fractions, lowered for US order and for far dates, Unix times once more; 0 to 1."""
    days = F.abs(F.date_diff(ts.cast("date"), F.lit(now.date())))
    base = _by_name(shapes, lambda s: float(s.base * (0.95 if s.name == "python_logging" else 1.0)))[name]
    if any(s.pattern.startswith("unix:") for s in shapes):
        base = F.when(name.startswith("unix_"), base * F.when(days > 50 * 365.25, 0.7).when(days > 10 * 365.25, 0.9).otherwise(1.0)).otherwise(base)
    bonus = _by_name(shapes, lambda s: float({"high": 0.05, "medium": 0.02, "low": 0.0}[s.specificity] + 0.03 * s.zoned - 0.05 * s.name.startswith("us_")))[name]
    micros = [s.name for s in shapes if s.micros]
    out = base + bonus + (F.when(name.isin(micros) & F.contains(text, F.lit(".")), 0.02).otherwise(0.0) if micros else F.lit(0.0))
    out = out * F.when(days > 3652, 0.8).otherwise(1.0)
    n = F.char_length(text)
    out = out + F.when((n >= 19) & (n <= 35), 0.02).when(n < 10, -0.05).otherwise(0.0) + F.when(text.rlike(r"\d{4}"), 0.01).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 6)


def _read_any(x: Column, now: datetime, shapes: tuple[Shape, ...] = SHAPES) -> Column:
    """The reading of the first shape that the whole text has, null if it has none.

    The shape and the time are worked out once, under the names of elements; what depends on
    the shape alone is looked up, so the expression stays small.
    """

    def of_shape(name: Column) -> Column:
        ts = F.lit(None).cast("timestamp_ntz")
        for shape in reversed(shapes):
            ts = F.when(name == shape.name, parse_shape(x, shape, now)).otherwise(ts)
        fields = lambda t: F.struct(t.alias("ts"), _offset(x, name, shapes).alias("offset_min"), name.alias("format"), confidence(x, t, name, now, shapes).alias("confidence"))
        return F.when(name.isNotNull(), F.get(F.transform(F.array(ts), fields), F.lit(0)))

    return F.get(F.transform(F.array(whole_shape(x, shapes)), of_shape), F.lit(0))


#: Shapes that stand inside of others and are looked for where those fail: without an offset, then dates and times alone.
_WITHIN = (("iso8601_naive", "apache_common_no_tz"), ("iso_date", "slash_date", "us_date", "time_only"))


def _reading(now: datetime, shapes: tuple[Shape, ...]):
    return lambda x: _read_any(x, now, shapes)


def _valid(readings: Column) -> Column:
    return F.filter(readings, lambda x: x["ts"].isNotNull())


def _within(x: Column, now: datetime) -> Column:
    """Readings of lesser shapes inside a text that has the shape of a timestamp but isn't one."""
    found = []
    for names in _WITHIN:
        shapes = tuple(BY_NAME[n] for n in names)
        hits = F.regexp_extract_all(x, F.lit("|".join(s.regex for s in shapes)), F.lit(0))
        found.append(_valid(F.transform(hits, _reading(now, shapes))))
    return F.when(F.size(found[0]) > 0, found[0]).otherwise(found[1])


def detect_timestamps(text: Column, now: datetime) -> Column:
    """All timestamps in a text, the surest first; equal ones by time.

    Spans don't overlap: the text is gone through once. Where the first shape that stands at a
    place has no valid reading (an hour 25, the 30th of February), its span is free for the
    lesser shapes inside.
    """
    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0))

    def readings(x: Column) -> Column:  # the reading is worked out once, under the name of an element
        return F.get(F.transform(F.array(_read_any(x, now)), lambda r: F.when(r["ts"].isNotNull(), F.array(r)).otherwise(_within(x, now))), F.lit(0))

    found = F.flatten(F.transform(hits, readings))
    keyed = F.transform(found, lambda x: F.struct((-x["confidence"]).alias("k"), x["ts"].alias("t"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda x: x["x"])


def best_timestamp(text: Column, now: datetime) -> Column:
    return F.get(detect_timestamps(text, now), F.lit(0))


def extract_timestamps(text: Column, now: datetime, least: float = 0.5) -> Column:
    return F.filter(detect_timestamps(text, now), lambda x: x["confidence"] >= least)


def first_timestamp(values: Column, now: datetime) -> Column:
    """The best timestamp of the first text in an array that has any; texts behind it aren't searched."""
    best = lambda v: F.when(F.coalesce(v, F.lit("")) != "", best_timestamp(v, now))
    none = F.get(F.lit([]).cast(DETECTED), F.lit(0))
    return F.aggregate(values, none, lambda found, v: F.coalesce(found, best(v)))


def read_timestamp(text: Column, now: datetime, shapes: tuple[str, ...]) -> Column:
    """The timestamp of a column whose usual shapes are known; a text of another shape is searched like any."""
    known = F.get(_valid(F.array(_read_any(text, now, tuple(BY_NAME[name] for name in shapes)))), F.lit(0))
    return F.when(text.isNotNull(), F.coalesce(known, best_timestamp(text, now)))


def whole_shape(text: Column, shapes: tuple[Shape, ...] = SHAPES) -> Column:
    """The name of the first shape that the whole text has, null if it has none."""
    out = F.lit(None).cast("string")
    for s in reversed(shapes):
        out = F.when(text.rlike(f"^(?:{s.regex})$"), F.lit(s.name)).otherwise(out)
    return out


def explain_confidence(text: Column, value: Column, name: Column) -> Column:
    """The band of a confidence and what speaks for the shape, joined by dashes."""
    band = F.when(value >= 0.9, "very high confidence").when(value >= 0.8, "high confidence").when(value >= 0.7, "good confidence").when(value >= 0.6, "moderate confidence").otherwise("low confidence")
    kind = F.when(name.startswith("iso"), "ISO 8601 format").when(name.startswith("unix"), "Unix timestamp").when(name.startswith("us_"), "US date order, ambiguous")
    zone = F.when(reduce(lambda a, z: a | F.contains(text, F.lit(z)), ("+", "-", "UTC", "GMT"), F.contains(text, F.lit("Z"))), "includes timezone")
    fine = F.when(F.char_length(F.substring_index(text, ".", -1)) > 2, F.when(F.contains(text, F.lit(".")), "sub-second precision"))
    return F.concat_ws(" - ", band, kind, zone, fine)
