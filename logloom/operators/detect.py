"""Format detection: all detectors score a sample of lines in one aggregate; fields follow from the winner."""

from __future__ import annotations

import csv
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import PATTERNS, TYPES, Pattern, pairs
from ..functions.timestamps import ANY, BY_NAME, whole_shape
from ..functions.values import infer_type, strip
from ..model import Detection, Field, distinct_names
from .parse import _OWN_PARSERS, extract


def _line() -> Column:
    return F.col("raw_line")


WEB = ("apache_combined", "apache_common", "apache_extended", "nginx_error", "nginx_access", "generic_web")
DELIMITERS = ("|", ";", ":", "\t", "~")
#: Detectors in order of preference, with the least confidence that they accept (fixed values).
THRESHOLDS = {
    "json": 0.8, "syslog": 0.7, "python_log": 0.8, "systemd_journal": 0.6, "apache_combined": 0.7, "apache_common": 0.7, "apache_extended": 0.7, "nginx_error": 0.7, "nginx_access": 0.7,
    "ltsv": 0.7, "csv": 0.6, "generic_web": 0.6, "basic_log": 0.7, "custom_delimited": 0.5, "key_value": 0.6,
}
#: Formats that callers have added, with their own test of a line where they have one.
_ADDED: dict[str, Callable[[Column], Column] | None] = {}


def register_format(
    name: str, patterns: tuple[Pattern, ...] = (), threshold: float = 0.7, *, detector: Callable[[Column], Column] | None = None, parser: Callable[[Column, Detection], Column] | None = None
) -> None:
    """Add a format.

    ``patterns``: regular expressions in Java's dialect (found anywhere in a line unless
    anchored) with the names of their groups. ``detector``: whether a line is of the format,
    in place of the patterns. ``parser``: a map of texts from a line and its detection, null
    for lines that aren't of the format, in place of the patterns as well.
    """
    if name in THRESHOLDS and name not in _ADDED:
        raise ValueError(f"{name} is a format already")
    if not patterns and (detector is None or parser is None):
        raise ValueError("without patterns a format needs a detector and a parser")
    THRESHOLDS[name], _ADDED[name] = threshold, detector
    for table, value in ((PATTERNS, tuple(patterns) or None), (_OWN_PARSERS, parser)):
        table.pop(name, None)
        if value is not None:
            table[name] = value


def unregister_format(name: str) -> None:
    """Take an added format away again."""
    del _ADDED[name], THRESHOLDS[name]
    PATTERNS.pop(name, None)
    _OWN_PARSERS.pop(name, None)


def _any(kind: str, patterns: slice = slice(None)) -> Column:
    out = F.lit(False)
    for regex, _ in PATTERNS[kind][patterns]:
        out = out | _line().rlike(regex)
    return out


def line_tests() -> dict[str, Column]:
    """Whether a line is of a format."""
    ltsv = F.filter(F.split(_line(), "\t"), lambda x: x.rlike(r"^[^:=]+:[^=]*"))
    return {
        "json": F.expr("""try_parse_json(concat('{"line":', raw_line, '}')) is not null"""),  # alone, a number before other text would pass
        "syslog": _any("syslog", slice(0, 2)),
        "python_log": _any("python_log"),
        "apache_combined": _line().rlike(PATTERNS["apache_combined"][0][0]),
        "apache_common": _any("apache_common"),
        "apache_extended": _any("apache_extended"),
        "nginx_error": _any("nginx_error"),
        "nginx_access": _any("nginx_access"),
        "ltsv": F.contains(_line(), F.lit("\t")) & (F.size(ltsv) >= 2),
        "generic_web": _any("generic_web"),
        "basic_log": _any("basic_log"),
        "key_value": F.size(pairs(_line(), "key_value")) >= 2,
    } | {name: test(_line()) if test else _any(name) for name, test in _ADDED.items()}


def scores(lines: DataFrame, sample: int = 100) -> DataFrame:
    """``source_file``, ``format``, ``confidence`` of each detector over the first lines that aren't blank.

    JSON looks at 50 lines, the journal at 200; web formats gain 0.1 beyond a coverage of 0.8.
    """
    rows = lines.filter(F.col("line_number") <= 200)
    full = strip(_line()) != ""
    near = full & (F.col("line_number") <= sample)
    tests = line_tests()
    share = lambda test, within: F.coalesce(F.try_divide(F.count_if(test & within), F.count_if(within)), F.lit(0.0))
    columns = {k: share(t, full & (F.col("line_number") <= 50) if k == "json" else near) for k, t in tests.items()}
    columns = {k: F.least(F.lit(1.0), c + F.when(c > 0.8, 0.1).otherwise(0.0)) if k in WEB else c for k, c in columns.items()}
    # journal lines that are fields, and blocks for every ten lines
    keyed = _line().rlike(r"^[_A-Z][A-Z0-9_]*=")
    blocks = F.count_if(keyed & F.coalesce(~F.col("_before"), F.lit(True)))
    columns["systemd_journal"] = F.least(F.lit(1.0), F.try_divide(blocks, F.greatest(F.count(F.lit(1)) / 10, F.lit(1.0)))) * share(keyed, full)
    for d in DELIMITERS:
        n = F.when(near & F.contains(_line(), F.lit(d)), F.size(F.split(_line(), "\\Q" + d + "\\E", -1)))
        n = F.when(n >= 2, n)
        even = F.greatest(F.lit(0.0), 1 - F.try_divide(F.var_pop(n), F.greatest(F.avg(n), F.lit(1.0))) / 0.3)
        score = 0.5 * F.try_divide(F.count(n), F.count_if(near)) + 0.3 * even + 0.2 * F.least(F.lit(1.0), F.avg(n) / 4)
        columns[f"delimited {d}"] = F.coalesce(score, F.lit(0.0))
    rows = rows.withColumn("_before", F.lag(keyed).over(Window.partitionBy("source_file").orderBy("line_number")))  # a sample of 200 lines
    wide = rows.groupBy("source_file").agg(*[c.alias(k) for k, c in columns.items()])
    best = F.greatest(*[F.col(f"`delimited {d}`") for d in DELIMITERS])
    listed = [F.struct(F.lit(k).alias("format"), F.col(k).alias("confidence")) for k in THRESHOLDS if k in columns]
    listed.append(F.struct(F.lit("custom_delimited").alias("format"), best.alias("confidence")))
    which = F.get(F.filter(F.array(*[F.when(F.col(f"`delimited {d}`") == best, F.lit(d)) for d in DELIMITERS]), lambda x: x.isNotNull()), F.lit(0))
    return wide.withColumn("delimiter", which).select("source_file", "delimiter", F.explode(F.array(*listed)).alias("s")).select("source_file", "s.format", F.col("s.confidence").cast("double").alias("confidence"), F.when(F.col("s.format") == "custom_delimited", F.col("delimiter")).alias("delimiter"))


def best_formats(scored: DataFrame) -> DataFrame:
    """The surest format of each source above its threshold; of equal ones the earlier detector, a caller's before all; else ``unknown``."""
    ranked = [*_ADDED, *[k for k in THRESHOLDS if k not in _ADDED]]
    order = F.create_map(*[x for i, k in enumerate(ranked) for x in (F.lit(k), F.lit(i))])
    least = F.create_map(*[x for k, v in THRESHOLDS.items() for x in (F.lit(k), F.lit(v))])
    ok = F.when(F.col("confidence") >= least[F.col("format")], F.struct(F.col("confidence"), (-order[F.col("format")]).alias("o"), "format", "delimiter"))
    best = scored.groupBy("source_file").agg(F.max(ok).alias("b"))
    return best.select("source_file", F.coalesce("b.format", F.lit("unknown")).alias("format"), F.coalesce("b.confidence", F.lit(0.0)).alias("confidence"), "b.delimiter")


def sniff_csv(sample: list[str]) -> tuple[str, float] | None:
    """Delimiter and confidence of at most 50 sampled lines by the standard library's sniffer."""
    rows = [x for x in sample[:50] if x.strip()]
    if len(rows) < 4:
        return None
    try:
        delimiter = csv.Sniffer().sniff("\n".join(rows), ",;\t|").delimiter
    except csv.Error:
        # the delimiter that the first lines have most of, if they have much the same
        counts = {d: {x.count(d) for x in rows[:5]} for d in ",;\t|"}
        even = [d for d, n in counts.items() if len(n) <= 2 and max(n) > 0]
        if not even:
            return None
        delimiter = max(even, key=lambda d: max(counts[d]))
    having = sum(delimiter in x for x in rows)
    return (delimiter, min((len(rows) - 1) / len(rows) + 0.2, 1.0)) if having >= max(3, len(rows) / 2) else None


def field_schema(lines: DataFrame, detection: Detection) -> DataFrame:
    """``source_file``, ``field``, ``data_type``, ``frequency``, ``is_timestamp``, ``samples`` (the first 10 distinct), ``confidence``, ``stamps``, in first-seen order.

    A type is that of the first value that is neither empty nor ``-``; web and syslog numbers
    are fixed. ``stamps`` are the shapes of timestamps that whole values have.
    """
    full = lines.withColumn("raw_line", strip(_line())).filter("raw_line <> ''")
    each = full.withColumn("_all", extract(_line(), detection)).select("source_file", "line_number", F.posexplode("_all").alias("at", "field", "value"))
    each = each.filter(F.col("value").isNotNull() & ~F.trim("value").isin("", "-"))
    values = each.groupBy("source_file", "field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("line_number", "at")).alias("place"))
    first = Window.partitionBy("source_file", "field").orderBy("place")
    samples = values.withColumn("k", F.row_number().over(first)).filter("k <= 10").groupBy("source_file", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]).alias("samples"))
    out = values.groupBy("source_file", "field").agg(
        F.min_by("value", "place").alias("first"), F.sum("n").alias("frequency"), F.max(F.col("value").rlike(ANY)).alias("stamped"), F.min("place").alias("place"), F.collect_set(whole_shape(F.col("value"))).alias("stamps")
    )
    n = full.groupBy("source_file").agg(F.count(F.lit(1)).alias("lines"))
    fixed = F.create_map(*[x for k, v in TYPES.items() for x in (F.lit(k), F.lit(v))])
    kind = F.coalesce(fixed[F.col("field")] if detection.format in PATTERNS else F.lit(None).cast("string"), infer_type(F.col("first")))
    stamp = F.col("stamped") & ~kind.isin("integer", "float", "boolean") & ~F.col("field").isin("message", "request")
    if detection.metadata.get("patterns", detection.format) in WEB:  # fields of web logs are times by their names
        stamp = F.lower("field").rlike("time|date")
    out = out.withColumn("data_type", kind).withColumn("is_timestamp", stamp).join(n, "source_file").join(samples, ["source_file", "field"])
    sure = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("frequency") / F.col("lines")) + F.when(F.col("is_timestamp"), 0.2).otherwise(0.0) + F.when(F.col("data_type") != "unknown", 0.1).otherwise(0.0))
    return out.withColumn("confidence", sure).orderBy("source_file", "place").select("source_file", "field", "data_type", "frequency", "is_timestamp", "samples", "confidence", "stamps")


def detect(lines: DataFrame, now: datetime | None = None) -> dict[str, Detection]:
    """A detection for each source from its first 1000 lines.

    Sources of one format are looked at together, so the number of jobs doesn't grow with
    them; the driver gets 50 lines and the fields of each source.
    """
    head = lines.filter(F.col("line_number") <= 1000)
    found = {r["source_file"]: r for r in best_formats(scores(head)).collect()}
    near = F.slice(F.sort_array(F.collect_list(F.struct("line_number", "raw_line"))), 1, 50)
    samples = {r["source_file"]: list(r["x"]) for r in head.groupBy("source_file").agg(F.transform(near, lambda x: x["raw_line"]).alias("x")).collect()}
    rfc = [F.count_if(_line().rlike(PATTERNS["syslog"][k][0])).alias(f"c{k}") for k in (0, 1)]
    syslog = [s for s, r in found.items() if r["format"] == "syslog"]
    counts = {r["source_file"]: r for r in head.filter(F.col("source_file").isin(syslog) & (F.col("line_number") <= 100)).groupBy("source_file").agg(*rfc).collect()} if syslog else {}
    out, alike = {}, {}
    for source, r in found.items():
        sample = samples[source]
        best = Detection(r["format"], r["confidence"], metadata={"delimiter": r["delimiter"]} if r["delimiter"] else {})
        if source in counts:
            a, b = counts[source]["c0"], counts[source]["c1"]
            best = replace(best, metadata={"rfc3164_count": str(a), "rfc5424_count": str(b), "detected_rfc": "3164" if a >= b else "5424"})
        sniffed = sniff_csv(sample)
        if sniffed and sniffed[1] > best.confidence or sniffed and best.format in ("unknown", "custom_delimited"):
            names = distinct_names([x.strip() for x in next(csv.reader([sample[0]], delimiter=sniffed[0]))])
            best = Detection("csv", sniffed[1], tuple(Field(x) for x in names), metadata={"delimiter": sniffed[0], "header": sample[0].strip()})
        if best.format == "custom_delimited":
            width = max(len(x.split(best.metadata["delimiter"])) for x in sample if x.strip())
            best = replace(best, fields=tuple(Field(f"field_{i + 1}") for i in range(width)))
        if best.format == "generic_web":
            best = replace(best, format="basic_log", metadata={"patterns": "generic_web"})
        out[source] = replace(best, samples=tuple(x.strip() for x in sample if x.strip())[:5])
        if best.format not in ("unknown", "systemd_journal"):
            alike.setdefault((best.format, best.names, best.metadata.get("delimiter"), best.metadata.get("patterns")), []).append(source)
    for sources in alike.values():
        rows: dict[str, list] = {s: [] for s in sources}
        for x in field_schema(head.filter(F.col("source_file").isin(sources)), out[sources[0]]).collect():
            rows[x["source_file"]].append(x)
        for source, own in rows.items():
            d = out[source]
            known = {x["field"]: Field(x["field"], x["data_type"], x["is_timestamp"], x["frequency"], x["confidence"], tuple(x["samples"])) for x in own}
            d = replace(d, fields=tuple(known.get(f.name, f) for f in d.fields) if d.fields else tuple(known.values()))
            stamp = next((f.name for f in d.fields if f.is_timestamp), None)
            shapes = next((set(x["stamps"]) for x in own if x["field"] == stamp), set())
            if shapes:  # the parser tries these before it searches the text
                d = replace(d, metadata={**d.metadata, "stamps": ",".join(n for n in BY_NAME if n in shapes)})
            out[source] = d
    return out


def validate(detection: Detection) -> dict:
    """Whether a detection can be parsed, how well, and warnings."""
    stamps = sum(f.is_timestamp for f in detection.fields)
    quality = min(1.0, detection.confidence + min(0.1 * stamps, 0.2) + min(0.05 * len(detection.fields), 0.3) - 0.1 * (len(detection.samples) < 3))
    warnings = ["unknown format"] if detection.format == "unknown" else []
    warnings += ["few sample lines"] if len(detection.samples) < 3 else []
    warnings += ["low quality"] if quality < 0.7 else []
    return {"can_parse": detection.format != "unknown", "quality": quality, "warnings": warnings}
