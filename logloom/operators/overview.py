"""Everything that an analysis says, from one pass over the entries.

Entries become counts of (source, kind, name, value) in a single aggregate, partial before
it is shuffled; those counts are summed again for all sources together, and folded into one
row for each source. Profiles, file statistics, hints, times, bars and the report are
projections of these few rows, so each of them reads and parses the lines once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import Detection
from .parse import error_class
from .stats import quality_score, recommendations

#: Parts into which a field's values are split while the most frequent ones are found.
_PARTS = 32


def _items() -> Column:
    """What an entry counts for: its line, its fields, its errors, its hour and its day."""
    item = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    none = F.lit("")
    line = F.array(item("line", F.when(F.col("is_malformed"), "bad").otherwise("good"), none))
    fields = F.transform(F.map_entries("fields"), lambda e: item("field", e["key"], e["value"]))
    errors = F.transform("parse_errors", lambda m: item("error", error_class(m), none))
    times = F.when(F.col("ts").isNotNull(), F.array(item("hour", F.date_format("ts", "HH"), none), item("day", F.date_format("ts", "yyyy-MM-dd"), none))).otherwise(F.slice(line, 1, 0))
    return F.concat(line, fields, errors, times)


def overview(entries: DataFrame, most: int = 5) -> DataFrame:
    """A row for each source, and one of null ``source_file`` for all.

    ``total_lines``, ``bad_lines``, ``mean_confidence``; ``errors`` (class to count);
    ``fields`` by name: ``field``, ``present``, ``nulls`` (empty texts), ``distinct_values``
    and the ``most`` most frequent ``top_values`` (of equal ones the one that occurs first);
    ``hours`` and ``days``: ``name``, ``n``, first and last time ``lo`` and ``hi``. No entries
    give no rows. What a source has of fields, days and errors must fit a row, its values needn't.
    """
    each = entries.select("source_file", "line_number", "ts", "confidence", F.explode(_items()).alias("i")).select("source_file", "line_number", "ts", "confidence", "i.kind", "i.name", "i.value")
    facts = each.groupBy("source_file", "kind", "name", "value").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("first"), F.sum("confidence").alias("c"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    scopes = F.array(F.struct(F.col("source_file").alias("source"), F.lit(False).alias("all")), F.struct(F.lit(None).cast("string").alias("source"), F.lit(True).alias("all")))
    facts = facts.withColumn("scope", F.explode(scopes)).withColumn("part", F.pmod(F.xxhash64("value"), F.lit(_PARTS)))
    key = ["scope", "kind", "name"]
    facts = facts.groupBy(*key, "part", "value").agg(F.sum("n").alias("n"), F.min(F.struct("source_file", "first")).alias("first"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    rank = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.desc("n"), "first"))
    top = F.collect_list(F.when((F.col("kind") == "field") & (F.col("rank") <= most), F.struct((-F.col("n")).alias("k"), "first", "value", "n")))
    sums = [F.sum("n").alias("n"), F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    parts = facts.withColumn("rank", rank).groupBy(*key, "part").agg(*sums, F.sum(F.when(F.col("value") == "", F.col("n")).otherwise(0)).alias("empty"), F.count(F.lit(1)).alias("distinct"), top.alias("top"))
    names = parts.groupBy(*key).agg(*sums, F.sum("empty").alias("empty"), F.sum("distinct").alias("distinct"), F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, most).alias("top"))
    of = lambda kind, name: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name") == name), F.col("n"))), F.lit(0))
    listed = lambda kind, *columns: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns))))
    tops = F.transform("top", lambda x: F.struct(x["value"], x["n"])).alias("top_values")
    rows = names.groupBy("scope").agg(
        (of("line", "good") + of("line", "bad")).alias("total_lines"), of("line", "bad").alias("bad_lines"), F.sum(F.when(F.col("kind") == "line", F.col("c"))).alias("c"), listed("error", "name", "n").alias("errors"),
        listed("field", F.col("name").alias("field"), F.col("n").alias("present"), F.col("empty").alias("nulls"), F.col("distinct").alias("distinct_values"), tops).alias("fields"), listed("hour", "name", "n", "lo", "hi").alias("hours"), listed("day", "name", "n", "lo", "hi").alias("days"),
    )
    # a source without a name isn't the row for all
    return rows.select(F.col("scope.source").alias("source_file"), F.col("scope.all").alias("is_all"), "total_lines", "bad_lines", (F.col("c") / F.col("total_lines")).alias("mean_confidence"), F.map_from_entries("errors").alias("errors"), "fields", "hours", "days")


def _rate(count: Column) -> Column:
    return F.coalesce(F.try_divide(count, F.col("total_lines")), F.lit(0.0))


def profile(seen: DataFrame, detection: Detection | None = None) -> DataFrame:
    """Fields of all sources together: presence, nulls, distinct values, top values.

    With a detection also types, confidences and whether a field is a time, and fields of the
    schema that never occur.
    """
    out = seen.filter("is_all").select("total_lines", F.inline("fields")).withColumns({"extraction_rate": _rate(F.col("present")), "null_rate": _rate(F.col("nulls"))}).drop("total_lines")
    columns = ["field", "present", "extraction_rate", "null_rate", "distinct_values", "top_values"]
    if detection is None:
        return out.select(*columns)
    known = seen.sparkSession.createDataFrame([(f.name, f.data_type, float(f.confidence), f.is_timestamp) for f in detection.fields], "field string, data_type string, confidence double, is_timestamp boolean")
    out = out.join(known, "field", "full").fillna(0, ["present", "distinct_values", "extraction_rate", "null_rate"]).withColumns({"data_type": F.coalesce("data_type", F.lit("string")), "confidence": F.coalesce("confidence", F.lit(0.0)), "is_timestamp": F.coalesce("is_timestamp", F.lit(False))})
    return out.select(*columns, "data_type", "confidence", "is_timestamp")


def _rated(seen: DataFrame, detection: Detection, sure: float) -> DataFrame:
    """The overview's rows with the figures of files beside them."""
    names = list(detection.names)
    found = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], F.struct(f["present"], f["nulls"]))))
    every = F.array_union(F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"), F.transform("fields", lambda f: f["field"]))
    of = lambda n, what: _rate(F.coalesce(F.col("_found")[n][what], F.lit(0)))
    rates = F.transform(every, lambda n: F.struct((-of(n, "present")).alias("r"), n.alias("field"), of(n, "nulls").alias("e")))
    out = seen.withColumn("_found", found).withColumn("_rates", F.array_sort(rates))
    listed = lambda test: F.transform(F.filter("_rates", test), lambda x: x["field"])
    sampled = [f.confidence for f in detection.fields if f.frequency]
    out = out.withColumns({
        "success_rate": 1 - _rate(F.col("bad_lines")), "mean_extraction": sum((of(n, "present") for n in names), F.lit(0.0)) / max(1, len(names)), "detection_confidence": F.lit(float(sure)),
        "top_error_share": _rate(F.coalesce(F.array_max(F.map_values("errors")), F.lit(0))), "poor_fields": listed(lambda x: -x["r"] < 0.5), "null_fields": listed(lambda x: x["e"] > 0.3),
        "format": F.lit(detection.format), "n_fields": F.lit(len(detection.fields)), "n_timestamp_fields": F.lit(sum(f.is_timestamp for f in detection.fields)),
        "n_high_fields": F.lit(sum(c >= 0.8 for c in sampled)), "n_low_fields": F.lit(sum(c < 0.5 for c in sampled)), "n_samples": F.lit(len(detection.samples)),
    })
    return out.withColumn("quality", quality_score(F.col("detection_confidence"), F.col("success_rate"), F.col("mean_extraction"), F.col("mean_confidence"))).drop("_found", "_rates")


def files(seen: DataFrame, detection: Detection, detection_confidence: float | None = None) -> DataFrame:
    """For each source what ``stats.file_statistics`` and ``stats.file_details`` say of it, and ``errors``."""
    sure = detection.confidence if detection_confidence is None else detection_confidence
    return _rated(seen.filter("not is_all"), detection, sure).drop("is_all", "bad_lines", "fields", "hours", "days")


def problem_files(rated: DataFrame, below: float = 0.5) -> DataFrame:
    """Files of poor quality, the worst first, with their first two hints as ``issues``."""
    hinted = recommendations(rated.filter(F.col("quality") < below))
    return hinted.select("source_file", "quality", F.slice("recommendations", 1, 2).alias("issues")).orderBy("quality", "source_file")


def times(seen: DataFrame) -> DataFrame:
    """Of all sources: number of times, first and last, seconds between, entries a second, peak hour and day (of equal ones the one that begins first), how many hours and days occur."""
    peak = lambda c: F.array_max(F.transform(c, lambda x: F.struct(x["n"], (-F.unix_micros(x["lo"].cast("timestamp"))).alias("t"), x["name"])))["name"]
    out = seen.filter("is_all").select(
        F.coalesce(F.aggregate("hours", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]), F.lit(0)).alias("n"), F.array_min(F.transform("hours", lambda x: x["lo"])).alias("first_ts"), F.array_max(F.transform("hours", lambda x: x["hi"])).alias("last_ts"),
        peak("hours").cast("bigint").alias("peak_hour"), peak("days").alias("peak_day"), F.size("hours").cast("bigint").alias("n_hours"), F.size("days").cast("bigint").alias("n_days"),
    )
    out = out.withColumn("seconds", F.timestamp_diff("MICROSECOND", "first_ts", "last_ts") / 1e6)
    return out.withColumn("per_second", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("seconds")), F.lit(0.0)))


def buckets(seen: DataFrame, kind: str) -> DataFrame:
    """Entries of all sources by ``hours`` (0 to 23) or ``days``: ``name`` and ``n``."""
    return seen.filter("is_all").select(F.inline(kind)).select(F.col("name").cast("bigint").alias("name") if kind == "hours" else "name", "n")


def _bar(share: Column, width: int) -> Column:
    full = F.floor(F.round(share * width, 9)).cast("int")  # 0.4 may be a sum of tenths
    return F.concat(F.repeat(F.lit("#"), full), F.repeat(F.lit("."), F.lit(width) - full))


def rate_bars(seen: DataFrame, detection: Detection, most: int = 8, width: int = 30) -> DataFrame:
    """The rates of the first ``most`` fields of the schema (all that occur, by name, without one) as bars scaled to the highest."""
    own = seen.filter("is_all").withColumn("_found", F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["present"]))))
    names = F.array(*[F.lit(n) for n in detection.names]) if detection.fields else F.transform("fields", lambda f: f["field"])
    rates = F.transform(F.slice(names, 1, most), lambda n, i: F.struct(i.alias("place"), n.alias("field"), _rate(F.coalesce(F.col("_found")[n], F.lit(0))).alias("rate")))
    rows = own.withColumn("_rates", rates).withColumn("_top", F.array_max(F.transform("_rates", lambda x: x["rate"]))).select("_top", F.inline("_rates"))
    return rows.select("place", "field", "rate", _bar(F.coalesce(F.try_divide(F.col("rate"), F.col("_top")), F.lit(0.0)), width).alias("bar"))


def gauges(rated: DataFrame, width: int = 30) -> DataFrame:
    """Quality, success, detection and confidence of each source as bars of 0 to 1."""
    shown = [F.struct(F.lit(n).alias("gauge"), F.col(c).alias("value")) for n, c in (("quality", "quality"), ("success", "success_rate"), ("detection", "detection_confidence"), ("confidence", "mean_confidence"))]
    rows = rated.select("source_file", F.inline(F.array(*shown)))
    return rows.select("source_file", "gauge", "value", _bar(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("value"))), width).alias("bar"))


def report(seen: DataFrame, detection: Detection) -> DataFrame:
    """(section, label, value) rows: format, each file, parsing, errors, rates, fields, time and hints.

    A projection of the overview's rows: fields are those of all sources together.
    """
    row = lambda section, label, value: F.struct(F.lit(section).alias("section"), label.alias("label"), value.alias("value"))
    text, count, percent, mean = F.lit, lambda c: F.format_string("%d", c), lambda c: F.format_string("%.1f %%", c * 100), lambda c: F.format_string("%.3f", c)
    names = [("format", detection.format), ("detection confidence", f"{detection.confidence:.3f}"), ("fields", len(detection.fields)), ("timestamp fields", sum(f.is_timestamp for f in detection.fields)), ("sure fields", sum(f.confidence >= 0.8 for f in detection.fields)), ("unsure fields", sum(f.confidence < 0.5 for f in detection.fields)), ("sample lines", len(detection.samples))]
    good = F.col("total_lines") - F.col("bad_lines")
    fields = F.transform("fields", lambda f: row("field", f["field"], F.format_string("%d values, %d distinct", f["present"], f["distinct_values"])))
    rates = F.transform("fields", lambda f: row("rate", f["field"], F.concat(percent(_rate(f["present"])), F.lit(", empty "), percent(_rate(f["nulls"])))))
    tops = F.transform("fields", lambda f: row("top values", f["field"], F.array_join(F.transform(f["top_values"], lambda v: F.format_string("%s(%d)", v["value"], v["n"])), ", ")))
    errors = F.transform(F.map_entries("errors"), lambda e: row("error", e["key"], count(e["value"])))
    n = F.aggregate("hours", F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    peak = lambda c: F.array_max(F.transform(c, lambda x: F.struct(x["n"], (-F.unix_micros(x["lo"].cast("timestamp"))).alias("t"), x["name"])))["name"]
    lo, hi = F.array_min(F.transform("hours", lambda x: x["lo"])), F.array_max(F.transform("hours", lambda x: x["hi"]))
    shown = {"entries with a time": count(n), "first": lo.cast("string"), "last": hi.cast("string"), "peak hour": peak("hours"), "peak day": peak("days"), "hours": count(F.size("hours")), "days": count(F.size("days")), "entries a second": mean(F.coalesce(F.try_divide(n.cast("double"), F.timestamp_diff("MICROSECOND", lo, hi) / 1e6), F.lit(0.0)))}
    time = F.filter(F.array(*[row("time", text(k), v) for k, v in shown.items()]), lambda x: x["value"].isNotNull())
    parsing = F.array(row("parsing", text("lines"), count(F.col("total_lines"))), row("parsing", text("parsed"), count(good)), row("parsing", text("malformed"), count(F.col("bad_lines"))), row("parsing", text("success"), percent(_rate(good))), row("parsing", text("mean confidence"), mean(F.col("mean_confidence"))))
    whole = F.concat(F.array(*[row("format", text(k), text(str(v))) for k, v in names]), parsing, errors, rates, fields, tops, time)
    own = F.array(row("file", F.coalesce("source_file", F.lit("")), F.format_string("%d lines, quality %.2f", "total_lines", "quality")))
    hints = F.transform("recommendations", lambda h: row("hint", F.coalesce(F.col("source_file"), F.lit("")), h))
    rated = recommendations(_rated(seen, detection, detection.confidence))
    return rated.select(F.inline(F.when(F.col("is_all"), whole).otherwise(F.concat(own, hints))))

