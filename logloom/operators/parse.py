"""Parsers: a detection compiles to one projection from lines to entries."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import LEVELS, PATTERNS, first_match, last_of_keys, pairs
from ..functions.timestamps import best_timestamp, first_timestamp, read_timestamp
from ..functions.values import convert, strip
from ..model import Detection, Field, distinct_names

_WEB = ("apache_common", "apache_combined", "apache_extended", "nginx_access", "nginx_error", "generic_web")
_DELIMITED, _FREE = ("csv", "custom_delimited"), ("python_log", "basic_log")
_MAP = "map<string,string>"
#: Parsers of formats that callers have added: from a line and its detection to a map of texts, null if the line isn't of the format.
_OWN_PARSERS: dict[str, Callable[[Column, Detection], Column]] = {}


def _json(line: Column) -> Column:
    """An object's members by trimmed keys; of equal ones the last counts."""
    entries = F.transform(F.map_entries(F.from_json(line, _MAP)), lambda e: F.struct(strip(e["key"]).alias("k"), e["value"].alias("v")))
    return F.when(line.rlike(r"^\s*\{"), last_of_keys(entries))


def delimiter_of(detection: Detection) -> str:
    """The known delimiter; else the one that cuts the first sample line best into as many values as there are fields."""
    if "delimiter" in detection.metadata:
        return detection.metadata["delimiter"]
    # fixed values: the delimiters to try, and their score
    usual = (",", ";", "\t", "|") if detection.format == "csv" else ("|", ";", "\t", ",", ":", " ")
    if not detection.samples:
        return usual[0]
    hits = {d: detection.samples[0].count(d) for d in usual}
    return max(usual, key=lambda d: hits[d] / (1 + abs(hits[d] + 1 - len(detection.fields))))


def _parts(line: Column, detection: Detection) -> tuple[Column, Column]:
    """The values between delimiters, as many as there are fields at most, and how many there are."""
    delimiter = delimiter_of(detection)
    if detection.format != "csv":
        parts = F.split(line, "\\Q" + delimiter + "\\E", -1)
        return parts, F.size(parts)
    d = re.escape(delimiter)
    width = len(detection.fields)
    row = F.from_csv(line, ", ".join(f"c{i} string" for i in range(width)), {"sep": delimiter, "mode": "PERMISSIVE", "escape": '"'})
    n = F.regexp_count(F.concat(F.lit(delimiter), line), F.lit(f'{d}(?:"(?:[^"]|"")*"[^{d}]*|[^{d}]*)'))
    return F.array(*[F.coalesce(row[f"c{i}"], F.lit("")) for i in range(width)]), n


def _split(line: Column, detection: Detection) -> Column:
    parts, n = _parts(line, detection)
    names = F.array(*[F.lit(n) for n in distinct_names(list(detection.names))])
    k = F.least(n, F.size(names))
    return F.map_from_arrays(F.slice(names, 1, k), F.transform(F.slice(parts, 1, k), strip))


def extract(line: Column, detection: Detection) -> Column:
    """The line's fields as a map of texts, null if the line isn't of the format."""
    kind = detection.metadata.get("patterns", detection.format)
    if kind in _OWN_PARSERS:
        return _OWN_PARSERS[kind](line, detection).cast(_MAP)
    if kind == "json":
        return _json(line)
    if kind in ("csv", "custom_delimited"):
        return _split(line, detection)
    if kind in ("key_value", "ltsv"):
        return F.get(F.filter(F.array(pairs(line, kind)), lambda m: F.size(m) > 0), F.lit(0))
    if kind in PATTERNS:
        return first_match(line, PATTERNS[kind])
    raise ValueError(f"no parser for format {detection.format!r}")


def derived(fields: Column, kind: str) -> Column:
    """Method, path and protocol of a request; facility and severity of a priority."""
    if kind in _WEB:
        parts = F.split(F.coalesce(fields["request"], F.lit("")), r"\s+")
        more = F.map_from_arrays(F.array(*[F.lit(x) for x in ("method", "path", "protocol")]), F.array(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")) for i in range(3)]))
        return F.when(fields["request"].isNotNull(), F.map_concat(fields, more)).otherwise(fields)
    if kind == "syslog":
        p = fields["priority"].try_cast("int")
        more = F.map_from_arrays(F.array(F.lit("facility"), F.lit("severity")), F.array(F.shiftright(p, 3).cast("string"), p.bitwiseAND(7).cast("string")))
        return F.when(p.isNotNull(), F.map_concat(fields, more)).otherwise(fields)
    return fields


class _Plan:
    """The columns of one detection's parser, each built on those before: ``_all``, ``fields``, ``_ts``, ``parse_errors``."""

    def __init__(self, detection: Detection, now: datetime, derive: bool):
        self.detection, self.now, self.derive = detection, now, derive
        self.kind = detection.metadata.get("patterns", detection.format)
        self.names = distinct_names(list(detection.names)) if self.kind in _DELIMITED else detection.names
        self.stamp = next((f.name for f in detection.fields if f.is_timestamp), None)
        self.line = F.col("raw_line")

    @property
    def is_header(self) -> Column:
        """The first line of a CSV source is no data if it is the header; a later line like it is."""
        header = self.detection.metadata.get("header", delimiter_of(self.detection).join(self.detection.names))
        return F.coalesce((F.col("line_number") == 1) & (self.line == header), F.lit(False)) if self.kind == "csv" else F.lit(False)

    @property
    def found(self) -> Column:
        out = extract(self.line, self.detection)
        return derived(out, self.kind) if self.derive and self.detection.format not in _OWN_PARSERS else out

    @property
    def best(self) -> Column:
        """The time of a whole line that matches no pattern: the line is the message, and the timestamp's text if it has one."""
        return best_timestamp(self.line, self.now)

    @property
    def fields(self) -> Column:
        out = _wanted(F.col("_all"), self.names, self.kind, self.derive)
        if self.kind not in _FREE:
            return out
        told = [n for n in ("timestamp", "message") if n in self.detection.names or not self.detection.fields]
        if not told:
            return out
        texts = F.map_from_entries(F.array_compact(F.array(*[F.when(self.best.isNotNull() if n == "timestamp" else F.lit(True), F.struct(F.lit(n).alias("key"), self.line.alias("value"))) for n in told])))
        return F.when(F.col("_all").isNull(), texts).otherwise(out)

    @property
    def time(self) -> Column:
        """Of the declared field; else of the first value, in order of the schema, that holds one; of line patterns the line's."""
        if self.stamp:
            source = F.col("fields")[self.stamp]
            if self.kind in _FREE:
                source = F.when(F.col("_all").isNull(), self.line).otherwise(source)
            shapes = self.detection.metadata.get("stamps")  # usual shapes of the field
            return read_timestamp(source, self.now, tuple(shapes.split(","))) if shapes else best_timestamp(source, self.now)
        if self.kind in PATTERNS:
            return best_timestamp(self.line, self.now)
        # numbers and booleans are no texts to look at, but between delimiters all parts are
        texts = [f.name for f in self.detection.fields if self.kind in _DELIMITED or f.data_type not in ("integer", "float", "boolean")]
        values = F.array(*[F.col("fields")[n] for n in texts]) if texts else F.array().cast("array<string>")
        return first_timestamp(values if self.detection.fields else F.map_values("fields"), self.now)

    @property
    def errors(self) -> Column:
        failed = F.when(F.col("_all").isNull(), F.lit("line does not match the format"))
        # patterns of one format differ in their fields: only the other formats know what each line must have
        missing = [F.when(F.col("_all").isNotNull() & ~F.map_contains_key("fields", F.lit(n)), F.lit(f"missing field {n}")) for n in (self.names if self.kind not in PATTERNS else ())]
        unread = F.when(F.col("fields")[self.stamp].isNotNull() & F.col("_ts").isNull(), F.lit(f"unreadable timestamp in {self.stamp}")) if self.stamp else F.lit(None).cast("string")
        extra = F.lit(None).cast("string")
        if self.kind in _DELIMITED and self.detection.fields:
            more = _parts(self.line, self.detection)[1] - len(self.names)
            extra = F.when(more > 0, F.concat(more.cast("string"), F.lit(" values too many")))
        return F.array_compact(F.array(failed, *missing, extra, unread))


def parse(lines: DataFrame, detection: Detection, now: datetime, derive: bool = False) -> DataFrame:
    """Entries: the line with ``fields``, ``ts`` (as written) and its offset, format and confidence, ``parse_errors``, ``is_malformed``, ``confidence``.

    Blank lines are no entries. Every missing or unreadable field is an error, and so are
    values beyond the fields of a delimited line; an error makes the entry malformed and
    takes 0.2 off its confidence, down to 0.1. No line ends the job: one that isn't of the
    format is an entry with an error. Keys are found whatever their case, exact ones first.
    A line of an application log that matches no pattern is the message.
    """
    return parse_sources(lines, [(detection, None)], now, derive)


def parse_sources(lines: DataFrame, plans: list[tuple[Detection, list[str] | None]], now: datetime, derive: bool = False) -> DataFrame:
    """Entries of sources of several formats in one pass over the lines: each line takes its own source's parser.

    ``plans`` has the detections with the names of their sources (null: all). Lines of other
    sources are left out. Only journals, whose entries are blocks of lines, are gone through
    apart.
    """
    journals = [(d, s) for d, s in plans if d.metadata.get("patterns", d.format) == "systemd_journal"]
    rest = [(_Plan(d, now, derive), s) for d, s in plans if (d, s) not in journals]
    parts = [parse_journal(lines if s is None else lines.filter(F.col("source_file").isin(s)), d, now) for d, s in journals]
    if rest:
        line = F.col("raw_line")
        rows = lines.filter(strip(line) != "").withColumn("raw_line", strip(line))
        which = F.lit(None).cast("int")
        for i, (_, sources) in enumerate(rest):
            which = F.when(F.col("source_file").isin(sources) if sources is not None else F.lit(True), F.coalesce(which, F.lit(i))).otherwise(which)
        if len(rest) == 1 and rest[0][1] is None:
            choose = lambda name: getattr(rest[0][0], name)
        else:
            rows = rows.withColumn("_plan", which).filter("_plan is not null")

            def choose(name: str) -> Column:
                out = F.when(F.col("_plan") == 0, getattr(rest[0][0], name))
                for i, (plan, _) in enumerate(rest[1:], 1):
                    out = out.when(F.col("_plan") == i, getattr(plan, name))
                return out

        if any(p.kind == "csv" for p, _ in rest):
            rows = rows.filter(~choose("is_header"))
        for column, name in (("_all", "found"), ("fields", "fields"), ("_ts", "time"), ("parse_errors", "errors")):
            rows = rows.withColumn(column, choose(name))
        parts.append(_entries(rows))
    if not parts:
        return parse_sources(lines.filter("false"), [(Detection("json"), None)], now)
    return reduce(DataFrame.unionByName, parts)


def _wanted(found: Column, names: tuple[str, ...], kind: str, derive: bool) -> Column:
    """The fields of the schema, all if there is none; a null map is an empty one."""
    if names and not derive and kind in ("key_value", "ltsv"):
        other = lambda n: F.get(F.map_values(F.map_filter(found, lambda k, v: F.lower(k) == n.lower())), F.lit(0))
        found = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.coalesce(found[n], other(n)) for n in names]))
    wanted = F.array(*[F.lit(n) for n in names])
    keep = F.map_filter(found, lambda k, v: (F.array_contains(wanted, k) if names and not derive else F.lit(True)) & v.isNotNull())
    return F.coalesce(keep, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def parse_line(spark, text: str, detection: Detection, now: datetime) -> DataFrame:
    """The entry of a single line, without a number."""
    return parse(spark.createDataFrame([(None, None, text)], "source_file string, line_number bigint, raw_line string"), detection, now)


def _entries(rows: DataFrame) -> DataFrame:
    n = F.size("parse_errors")
    return rows.select(
        "source_file", "line_number", "raw_line", "fields", F.col("_ts.ts").alias("ts"), F.col("_ts.offset_min").alias("ts_offset_min"), F.col("_ts.format").alias("ts_format"), F.col("_ts.confidence").alias("ts_confidence"),
        "parse_errors", (n > 0).alias("is_malformed"), F.when(n > 0, F.greatest(F.lit(0.1), 1 - 0.2 * n)).otherwise(1.0).alias("confidence"),
    )


#: Lines that share one running count of blank lines.
_CHUNK_LINES = 50_000


def parse_journal(lines: DataFrame, detection: Detection, now: datetime) -> DataFrame:
    """Blocks of ``KEY=value`` lines between blank ones; an entry stands at its block's first line.

    A block of one line without ``=`` is read in the short form, time, host and service
    before the message. Blocks are numbered by chunks of lines, so one large file is many
    tasks' work.
    """
    blank = (strip(F.col("raw_line")) == "").cast("long")
    inner = F.sum("_blank").over(Window.partitionBy("source_file", "_chunk").orderBy("line_number"))
    if "_blanks_before" in lines.columns:  # the reader has counted them
        placed = lines.select("source_file", "line_number", "raw_line", blank.alias("_blank"), "_chunk", F.col("_blanks_before").alias("_before")).withColumn("_inner", inner).filter("_blank = 0")
    else:
        numbered = lines.select("source_file", "line_number", "raw_line", blank.alias("_blank"), F.floor(F.col("line_number") / _CHUNK_LINES).alias("_chunk"))
        chunks = numbered.groupBy("source_file", "_chunk").agg(F.sum("_blank").alias("_n"))
        before = chunks.select("source_file", "_chunk", F.coalesce(F.sum("_n").over(Window.partitionBy("source_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
        placed = numbered.withColumn("_inner", inner).join(before, ["source_file", "_chunk"]).filter("_blank = 0")
    blocks = placed.groupBy("source_file", (F.col("_inner") + F.col("_before")).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("line_number", "raw_line"))).alias("rows"))
    text = lambda r: strip(r["raw_line"])
    keyed = r"^[A-Z_][A-Z0-9_]*="
    good = F.filter("rows", lambda r: text(r).rlike(keyed))
    entries = F.transform(good, lambda r: F.struct(F.substring_index(text(r), "=", 1).alias("k"), F.regexp_replace(text(r), "(?s)^[^=]*=", "").alias("v")))
    whole = F.array_join(F.transform("rows", text), "\n")
    out = blocks.select("source_file", F.get("rows", F.lit(0))["line_number"].alias("line_number"), whole.alias("raw_line"), "rows", last_of_keys(entries).alias("_keys"), ((F.size("rows") == 1) & ~F.contains(whole, F.lit("="))).alias("_short"))
    short = first_match(F.col("raw_line"), PATTERNS["journal_short"])
    out = out.withColumn("_all", F.when(F.col("_short"), short).otherwise(F.col("_keys")))
    known = [n for n in detection.names]
    message = F.create_map(F.lit("message"), F.col("raw_line")) if "message" in known or not known else F.col("_keys")
    keep = F.map_filter("_all", lambda k, v: F.array_contains(F.array(*[F.lit(n) for n in known]), k) if known else F.lit(True))
    out = out.withColumn("fields", F.when(F.col("_all").isNull(), message).otherwise(keep))
    micros = F.col("_all")["__REALTIME_TIMESTAMP"].try_cast("bigint")
    ts = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_micros(micros).cast("timestamp_ntz"))
    stamped = F.when(micros.isNotNull(), F.struct(ts.alias("ts"), F.lit(0).alias("offset_min"), F.lit("unix_microseconds").alias("format"), F.lit(0.81).alias("confidence")))
    out = out.withColumn("_ts", F.when(F.col("_short"), best_timestamp(F.col("_all")["timestamp"], now)).otherwise(stamped))
    errors = F.transform(F.filter("rows", lambda r: ~text(r).rlike(keyed)), lambda r: F.concat(F.lit("not a journal field: "), text(r)))
    errors = F.when(~F.col("_short"), errors).when(F.col("_all").isNull(), F.array(F.lit("line does not match the short form"))).otherwise(F.array().cast("array<string>"))
    return _entries(out.withColumn("parse_errors", errors))


def typed(entries: DataFrame, fields: tuple[Field, ...]) -> DataFrame:
    """The entries with a typed column for each field, null where the text can't be converted."""
    return entries.select("*", *[convert(F.col("fields")[f.name], f.data_type).alias(f.name) for f in fields])


def error_class(message: Column) -> Column:
    """timestamp_parsing, field_extraction, format_mismatch, type_conversion or other, by the first word that occurs."""
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("timestamp")), "timestamp_parsing").when(F.contains(m, F.lit("field")), "field_extraction").when(F.contains(m, F.lit("format")), "format_mismatch").when(F.contains(m, F.lit("type")), "type_conversion").otherwise("other")


def log_level(line: Column) -> Column:
    """The first level word of a line in upper case, null if there is none."""
    found = F.upper(F.regexp_extract(line, rf"(?i)\b({LEVELS})\b", 1))
    return F.when(found != "", found)


def parse_statistics(entries: DataFrame) -> DataFrame:
    """One row for each source: totals, success rate, mean confidence and counts of error classes."""
    classes = ("timestamp_parsing", "field_extraction", "format_mismatch", "type_conversion", "other")
    of = F.transform("parse_errors", error_class)
    equals = lambda c: lambda x: x == c
    counts = [F.sum(F.size(F.filter(of, equals(c)))).cast("long").alias(c) for c in classes]
    return entries.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("total_lines"), F.count_if(~F.col("is_malformed")).alias("parsed_lines"), F.count_if("is_malformed").alias("malformed_lines"), F.avg((~F.col("is_malformed")).cast("double")).alias("success_rate"), F.avg("confidence").alias("mean_confidence"), *counts
    )


def extraction_rates(entries: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """For each source and field, in how many entries it is present and the rate."""
    present = [F.struct(F.lit(n).alias("field"), F.map_contains_key("fields", F.lit(n)).cast("long").alias("hit")) for n in names]
    each = entries.select("source_file", F.explode(F.array(*present)).alias("f"))
    return each.groupBy("source_file", F.col("f.field").alias("field")).agg(F.sum("f.hit").alias("extracted"), F.avg("f.hit").alias("rate"))
