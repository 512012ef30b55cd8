"""Statistics of entries: fields, time, quality, recommendations, and comparison of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import Detection
from .parse import extraction_rates, parse_statistics


def hourly(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count("ts").alias("n")).filter("n > 0")


def daily(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("ts").alias("n")).filter("n > 0")


def time_series(entries: DataFrame) -> DataFrame:
    """Number, range in seconds, entries a second (0 without a range), peak hour and day (the earliest of equal ones).

    Entries are counted once, by day and hour; all figures follow from those counts.
    """
    counts = entries.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count("ts").alias("c"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    # both kinds of buckets from the counts: days, hours, and everything
    each = counts.select("c", "lo", "hi", F.explode(F.array(F.struct(F.lit("day").alias("kind"), F.col("day").alias("key")), F.struct(F.lit("hour").alias("kind"), F.col("hour").cast("string").alias("key")), F.struct(F.lit("all").alias("kind"), F.lit("").alias("key")))).alias("b")).filter("c > 0")
    sums = each.groupBy("b").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = lambda kind: F.max(F.when(F.col("b.kind") == kind, F.struct("c", (-F.unix_micros(F.col("lo").cast("timestamp"))).alias("t"), F.col("b.key").alias("key"))))["key"]
    whole = lambda c: F.max(F.when(F.col("b.kind") == "all", F.col(c)))
    out = sums.agg(F.coalesce(whole("c"), F.lit(0)).alias("n"), whole("lo").alias("first_ts"), whole("hi").alias("last_ts"), best("hour").cast("long").alias("peak_hour"), best("day").alias("peak_day"))
    out = out.withColumn("seconds", F.timestamp_diff("MICROSECOND", "first_ts", "last_ts") / 1e6)
    return out.withColumn("per_second", F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("seconds")), F.lit(0.0)))


def quality_score(detection: F.Column, success: F.Column, extraction: F.Column, confidence: F.Column):
    """0 to 1: 30 parts detection, 40 parsing, 20 mean extraction, 10 confidence."""
    return F.least(F.lit(1.0), (30 * detection + 40 * success + 20 * F.coalesce(extraction, F.lit(0.0)) + 10 * confidence) / 100)


def file_statistics(entries: DataFrame, names: tuple[str, ...], detection: float) -> DataFrame:
    """For each source: totals, success rate, mean extraction rate, confidence and quality score."""
    rate = F.aggregate(F.array(*[F.map_contains_key("fields", F.lit(n)).cast("double") for n in names]), F.lit(0.0), lambda a, x: a + x) / max(1, len(names))
    out = entries.groupBy("source_file").agg(F.count(F.lit(1)).alias("total_lines"), F.avg((~F.col("is_malformed")).cast("double")).alias("success_rate"), F.avg(rate).alias("mean_extraction"), F.avg("confidence").alias("mean_confidence"))
    return out.withColumn("detection_confidence", F.lit(detection)).withColumn("quality", quality_score(F.col("detection_confidence"), F.col("success_rate"), F.col("mean_extraction"), F.col("mean_confidence")))


def file_details(entries: DataFrame, detection: Detection) -> DataFrame:
    """For each source: the format, its counts of fields, fields of rates under 0.5 and of null rates over 0.3, and the share of the most frequent error in the lines.

    Fields are those of the schema and all that occur, by falling rate, then by name. Declared
    fields (never sampled) have no confidence to count.
    """
    names = F.array(*[F.lit(n) for n in detection.names]) if detection.fields else F.array().cast("array<string>")
    each = entries.select("source_file", "fields", F.explode(F.array_union(names, F.map_keys("fields"))).alias("field"))
    value = F.col("fields")[F.col("field")]
    counted = each.groupBy("source_file", "field").agg(F.count_if(F.map_contains_key("fields", F.col("field"))).alias("hits"), F.count_if(value == "").alias("empty"))
    errors = parse_statistics(entries)
    classes = [F.col(c) for c in ("timestamp_parsing", "field_extraction", "format_mismatch", "type_conversion", "other")]
    lines = errors.select("source_file", "total_lines", (F.greatest(*classes) / F.col("total_lines")).alias("top_error_share"))
    rated = counted.join(lines, "source_file").withColumn("rate", F.col("hits") / F.col("total_lines"))
    listed = lambda test: F.transform(F.array_sort(F.array_compact(F.collect_list(F.when(test, F.struct((-F.col("rate")).alias("r"), F.col("field").alias("field")))))), lambda x: x["field"])
    fields = rated.groupBy("source_file").agg(listed(F.col("rate") < 0.5).alias("poor_fields"), listed(F.col("empty") / F.col("total_lines") > 0.3).alias("null_fields"))
    sampled = [f.confidence for f in detection.fields if f.frequency]
    return lines.drop("total_lines").join(fields, "source_file", "left").withColumns({
        "format": F.lit(detection.format), "n_fields": F.lit(len(detection.fields)), "n_timestamp_fields": F.lit(sum(f.is_timestamp for f in detection.fields)),
        "n_high_fields": F.lit(sum(c >= 0.8 for c in sampled)), "n_low_fields": F.lit(sum(c < 0.5 for c in sampled)), "n_samples": F.lit(len(detection.samples)),
    })


def recommendations(files: DataFrame) -> DataFrame:
    """Up to five hints for each row of file statistics with its details, in a fixed order of rules.

    A row without a detection or without entries has one: there isn't enough to say.
    """
    c = {f: (F.col(f) if f in files.columns else F.lit(None)) for f in ("poor_fields", "null_fields", "n_timestamp_fields", "n_low_fields", "n_high_fields", "top_error_share")}
    rules = F.array(
        F.when(F.col("detection_confidence") < 0.7, F.lit("check the detected format")),
        F.when(F.col("success_rate") < 0.8, F.lit("many lines fail to parse")),
        F.when(F.coalesce(F.size(c["poor_fields"]) > 0, F.lit(False)), F.concat(F.lit("rarely extracted: "), F.array_join(F.slice(c["poor_fields"], 1, 3), ", "))) if "poor_fields" in files.columns else F.lit(None).cast("string"),
        F.when(F.coalesce(F.size(c["null_fields"]) > 0, F.lit(False)), F.concat(F.lit("often empty: "), F.array_join(F.slice(c["null_fields"], 1, 3), ", "))) if "null_fields" in files.columns else F.lit(None).cast("string"),
        F.when(c["n_timestamp_fields"] == 0, F.lit("no timestamp field")),
        F.when(c["n_low_fields"] > c["n_high_fields"], F.lit("most fields are uncertain")),
        F.when(c["top_error_share"] > 0.1, F.lit("one kind of error is frequent")),
    )
    nothing = F.col("detection_confidence").isNull() | F.col("success_rate").isNull()
    return files.withColumn("recommendations", F.when(nothing, F.array(F.lit("not enough data"))).otherwise(F.slice(F.array_compact(rules), 1, 5)))


def aggregate_results(entries: DataFrame, names: tuple[str, ...]) -> dict[str, DataFrame]:
    """Parse results of all sources together.

    ``totals``: one row of summed counts and errors, the success rate over all lines and the
    mean of the sources' mean confidences; ``rates``: for each field the mean of the sources'
    rates, and how many lines that would be.
    """
    files, rates = parse_statistics(entries), extraction_rates(entries, names)
    classes = ("timestamp_parsing", "field_extraction", "format_mismatch", "type_conversion", "other")
    sums = ("total_lines", "parsed_lines", "malformed_lines", *classes)
    totals = files.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.avg("mean_confidence").alias("mean_confidence"))
    totals = totals.withColumn("success_rate", F.coalesce(F.try_divide(F.col("parsed_lines"), F.col("total_lines")), F.lit(0.0)))
    lines = totals.select(F.col("total_lines").alias("_lines"))
    means = rates.groupBy("field").agg(F.avg("rate").alias("rate")).join(F.broadcast(lines))  # one row
    return {"totals": totals, "rates": means.select("field", "rate", F.floor(F.col("rate") * F.col("_lines")).alias("extracted"))}


def best_detection(detections: dict[str, Detection]) -> Detection | None:
    """The surest detection of several sources, the first of equal ones."""
    return max(detections.values(), key=lambda d: d.confidence, default=None)


def format_statistics(detection: Detection) -> dict:
    """Format, confidence, and how many fields there are, are times, are sure (0.8) and unsure (under 0.5); and sample lines."""
    sure = [f.confidence for f in detection.fields]
    return {"format": detection.format, "confidence": detection.confidence, "n_fields": len(sure), "n_timestamp_fields": sum(f.is_timestamp for f in detection.fields), "n_high_fields": sum(c >= 0.8 for c in sure), "n_low_fields": sum(c < 0.5 for c in sure), "n_samples": len(detection.samples)}


def global_insights(files: DataFrame) -> DataFrame:
    """Over all files: their number, mean quality and success, and how many fall in each band of quality; with ``format``, how many have each format."""
    q = F.col("quality")
    out = files.agg(
        F.count(F.lit(1)).alias("n_files"), F.avg("quality").alias("mean_quality"), F.avg("success_rate").alias("mean_success"), F.avg("detection_confidence").alias("mean_detection"),
        F.count_if(q >= 0.9).alias("excellent"), F.count_if((q >= 0.7) & (q < 0.9)).alias("good"), F.count_if((q >= 0.5) & (q < 0.7)).alias("fair"), F.count_if(q < 0.5).alias("poor"),
    )
    if "format" not in files.columns:
        return out
    each = files.groupBy("format").agg(F.count(F.lit(1)).alias("n"))
    return out.join(F.broadcast(each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("format", "n")))).alias("formats"))))  # one row each


def problem_files(files: DataFrame, below: float = 0.5) -> DataFrame:
    return files.filter(F.col("quality") < below).orderBy("quality", "source_file")


def compare_files(rates: DataFrame) -> DataFrame:
    """For fields of two files or more: sample variance of their rates, best and worst file (the first of equal ones)."""
    both = rates.groupBy("field").agg(F.count(F.lit(1)).alias("n_files"), F.var_samp("rate").alias("variance"), F.min(F.struct(-F.col("rate"), "source_file"))["source_file"].alias("best_file"), F.min(F.struct("rate", "source_file"))["source_file"].alias("worst_file"))
    return both.filter("n_files >= 2")


def consistency(compared: DataFrame) -> DataFrame:
    return compared.agg((1 - F.coalesce(F.avg("variance"), F.lit(0.0))).alias("consistency"))


def bars(counts: DataFrame, label: str, value: str, width: int = 30) -> DataFrame:
    """Text bars scaled to the largest value."""
    most = counts.agg(F.max(value).alias("_most"))
    return counts.join(F.broadcast(most)).select(label, value, F.expr(f"repeat('#', cast(floor({value} * {width} / greatest(_most, 1)) as int))").alias("bar"))  # one row
