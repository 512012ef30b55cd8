"""The log engine's registered queries over the given tables, and their SQL.

Most render ``events`` as log lines of a format, so that the engine parses real text, and
compare what it reads with the original columns.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import shared_folder
from .functions import timestamps
from .functions.values import infer_type
from .model import Detection, Field, distinct_names, fields_of
from .operators import detect, overview, parse, search, stats
from .operators.search import QueryBuilder, SearchFilter, SearchQuery, TimeFilter
from .plans.index import LogIndex
from .sources.lines import lines_of

NOW = datetime(2024, 1, 31)
_FIELDS = fields_of(event_id="integer", ts="timestamp", user_id="integer", event_type="string", value="float")
JSON = Detection("json", 1.0, _FIELDS, metadata={"stamps": "iso8601_utc_ms"})
_ISO = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _lines(spark: SparkSession, sf_dir: str, expression: str, source: str = "'events'") -> DataFrame:
    e = _events(spark, sf_dir).withColumn("raw_line", F.expr(expression)).withColumn("source_file", F.expr(source))
    return e.select("source_file", F.col("event_id").alias("line_number"), "raw_line")


_JSON_LINE = f"""concat('{{"event_id": "', event_id, '", "ts": "', {_ISO}, '", "user_id": "', user_id, '", "event_type": "', event_type, '", "value": "', value, '"}}')"""
_LEVEL = "case when event_type = 'error' then 'ERROR' else 'INFO' end"
_CLF = "concat('10.0.', user_id, '.1 - - [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, '/', event_id, ' HTTP/1.1\" ', case when event_type = 'error' then 500 else 200 end, ' ', cast(floor(value) as bigint))"


def _entries(spark, sf_dir, source="'events'"):
    return parse.parse(_lines(spark, sf_dir, _JSON_LINE, source), JSON, NOW)


def _typed(entries, fields, *names):
    """Typed fields under the given names; a ts column reads the entry's time."""
    out = parse.typed(entries.select("fields", F.col("ts").alias("_at")), fields)
    return out.select(*[F.col("_at").alias("ts") if n == "ts" else F.col(n) for n in names])


_ROW = ("event_id", "ts", "user_id", "event_type", "value")
_SELECT = "select event_id, ts, user_id, event_type, value from events"


def json_parse(spark, sf_dir):
    return _typed(_entries(spark, sf_dir), [f for f in _FIELDS if f.name != "ts"], *_ROW)


def _plain(expression: str, detection: Detection):
    def run(spark, sf_dir):
        return _typed(parse.parse(_lines(spark, sf_dir, expression), detection, NOW), [f for f in detection.fields if f.name != "ts"], *_ROW)

    return run


csv_parse = _plain(f"concat_ws(',', event_id, {_ISO}, user_id, event_type, value)", Detection("csv", 0.95, _FIELDS, metadata={"delimiter": ","}))
custom_delimited_parse = _plain(f"concat_ws('|', event_id, {_ISO}, user_id, event_type, value)", Detection("custom_delimited", 0.95, _FIELDS, metadata={"delimiter": "|"}))
ltsv_parse = _plain(f"concat('event_id:', event_id, '\\t', 'ts:', {_ISO}, '\\t', 'user_id:', user_id, '\\t', 'event_type:', event_type, '\\t', 'value:', value)", Detection("ltsv", 1.0, _FIELDS))
kv_parse = _plain(f"concat('event_id=', event_id, ' ts=\"', {_ISO}, '\" user_id=', user_id, ' event_type=\"', event_type, '\" value=\"', value, '\"')", Detection("key_value", 1.0, _FIELDS))


def _web(kind: str, expression: str, stamp: str):
    kinds = {"remote_host": "string", "remote_addr": "string", "status": "integer", "bytes_sent": "integer", "referer": "string", "user_agent": "string", "http_referer": "string", "http_user_agent": "string", "path": "string", "method": "string", "protocol": "string"}
    names = {"apache_common": ("remote_host", "status", "bytes_sent", "method", "path", "protocol"), "apache_combined": ("remote_host", "status", "bytes_sent", "path", "referer", "user_agent"), "nginx_access": ("remote_addr", "status", "bytes_sent", "path", "http_referer", "http_user_agent")}[kind]

    def run(spark, sf_dir):
        d = Detection(kind, 1.0, (Field(stamp, "string", True), *(Field(n, kinds[n]) for n in names)))
        return _typed(parse.parse(_lines(spark, sf_dir, expression), d, NOW, derive=True), [Field(n, kinds[n]) for n in names], "ts", *names)

    return run


_AGENT = "concat(' \"https://ref.example/', user_id, '\" \"agent ', event_id, '\"')"
apache_common_parse = _web("apache_common", _CLF, "timestamp")
apache_combined_parse = _web("apache_combined", f"concat({_CLF}, {_AGENT})", "timestamp")
nginx_access_parse = _web("nginx_access", f"concat({_CLF}, {_AGENT})", "time_local")
_CLF_SQL = "date_trunc('second', ts) as ts, '10.0.' || user_id || '.1' as {host}, case when event_type = 'error' then 500 else 200 end::bigint as status, floor(value)::bigint as bytes_sent, '/' || event_type || '/' || event_id as path"


def _pattern(kind: str, expression: str, **fields: str):
    own = fields_of(**fields)

    def run(spark, sf_dir):
        d = Detection(kind, 1.0, own)
        return _typed(parse.parse(_lines(spark, sf_dir, expression), d, NOW, derive=kind == "syslog"), [f for f in own if not f.is_timestamp], "ts", *[f.name for f in own if not f.is_timestamp])

    return run


nginx_error_parse = _pattern("nginx_error", "concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [error] ', user_id, '#', event_id, ': *7 ', event_type)", timestamp="timestamp", level="string", pid="integer", tid="integer", connection="integer", message="string")
python_log_parse = _pattern("python_log", f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' - ', event_type, ' - ', {_LEVEL}, ' - user ', user_id)", timestamp="timestamp", logger="string", level="string", message="string")
basic_log_parse = _pattern("basic_log", f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', {_LEVEL}, ' ', event_type, ': user ', user_id)", timestamp="timestamp", level="string", module="string", message="string")
syslog3164_parse = _pattern("syslog", "concat('<', event_id % 192, '>', date_format(ts, 'MMM d HH:mm:ss'), ' host', user_id, ' ', event_type, ': n ', event_id)", timestamp="timestamp", hostname="string", tag="string", message="string", facility="integer", severity="integer")
syslog5424_parse = _pattern("syslog", f"concat('<', event_id % 192, '>1 ', {_ISO}, ' host', user_id, ' ', event_type, ' 42 ID7 [a b=\"1\"][c d=\"2\"] n ', event_id)", timestamp="timestamp", hostname="string", app_name="string", structured_data="string", message="string", facility="integer", severity="integer")


def journal_parse(spark, sf_dir):
    block = "array(concat('PRIORITY=', event_id % 8), concat('__REALTIME_TIMESTAMP=', unix_micros(cast(ts as timestamp))), concat('MESSAGE=', event_type, ' of ', user_id), '')"
    e = _events(spark, sf_dir).select((F.col("event_id") % 64).cast("string").alias("source_file"), "event_id", F.posexplode(F.expr(block)).alias("k", "raw_line"))
    lines = e.select("source_file", (F.col("event_id") * 4 + F.col("k")).alias("line_number"), "raw_line")
    fields = fields_of(PRIORITY="integer", MESSAGE="string")
    return _typed(parse.parse(lines, Detection("systemd_journal", 1.0, fields), NOW), fields, "ts", "PRIORITY", "MESSAGE").withColumnsRenamed({"PRIORITY": "priority", "MESSAGE": "message"})


def _search(query: SearchQuery):
    def run(spark, sf_dir):
        return _typed(search.search(_entries(spark, sf_dir), query, NOW).page, fields_of(event_id="integer"), "event_id")

    return run


def _where(test: str) -> str:
    return f"select event_id from events where {test}"


_SEARCHES = {
    "search_text": (QueryBuilder.simple_text("PURCHASE"), "event_type = 'purchase'"),
    "search_contains": (QueryBuilder.field_contains("event_type", "IG"), "contains(event_type, 'ig')"),
    "search_equals": (QueryBuilder.field_equals("event_type", "Click"), "event_type = 'click'"),
    "search_regex": (QueryBuilder.regex_search("event_type", "^(S|E).*[pr]$"), "regexp_matches(event_type, '^(s|e).*[pr]$')"),
    "search_bad_regex": (QueryBuilder.regex_search("event_type", "("), "false"),
    "search_case_sensitive": (SearchQuery(filters=(SearchFilter("event_type", "contains", "Click", True),)), "false"),
    "search_gt": (SearchQuery(filters=(SearchFilter("value", "gt", "50"),)), "value > 50"),
    "search_lt": (SearchQuery(filters=(SearchFilter("value", "lt", "10.5"),)), "value < 10.5"),
    "search_gte": (SearchQuery(filters=(SearchFilter("user_id", "gte", "90"),)), "user_id >= 90"),
    "search_lte": (SearchQuery(filters=(SearchFilter("user_id", "lte", "7"),)), "user_id <= 7"),
    "search_time_range": (QueryBuilder.time_range(datetime(2024, 1, 10), datetime(2024, 1, 12, 6)), "ts between timestamp '2024-01-10' and timestamp '2024-01-12 06:00:00'"),
    "search_last_hours": (QueryBuilder.last_hours(72), "ts between timestamp '2024-01-28' and timestamp '2024-01-31'"),
    "search_last_minutes": (SearchQuery(time=TimeFilter(last_minutes=2000)), "ts between timestamp '2024-01-31' - interval 2000 minute and timestamp '2024-01-31'"),
    "search_combined": (QueryBuilder.combined("error", (SearchFilter("value", "gt", "20"), SearchFilter("user_id", "lt", "500")), TimeFilter(datetime(2024, 1, 5), None)), "event_type = 'error' and value > 20 and user_id < 500 and ts >= timestamp '2024-01-05'"),
}


def search_page(spark, sf_dir):
    return _search(SearchQuery(filters=(SearchFilter("event_type", "equals", "view"),), limit=25, offset=40))(spark, sf_dir)


def facet_top10(spark, sf_dir):
    return search.facets(_entries(spark, sf_dir)).filter("field in ('event_type', 'user_id')").select("field", "value", "n", F.col("rank").cast("long").alias("rank"))


def facet_display(spark, sf_dir):
    return search.facets(_entries(spark, sf_dir), 3).filter("field = 'event_type'").select("value", "n")


def field_names(spark, sf_dir):
    return search.field_names(_entries(spark, sf_dir)).select("field")


def time_range_meta(spark, sf_dir):
    return search.time_range(_entries(spark, sf_dir))


def search_errors(spark, sf_dir):
    line = f"""concat('{{"id": "', event_id, '", "level": "', lower({_LEVEL}), '", "status": "', 200 + user_id % 60, '"}}')"""
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("json", 1.0, fields_of(id="integer", level="string", status="integer")), NOW)
    return search.search_errors(entries, NOW, 300).select(F.col("fields")["id"].cast("bigint").alias("event_id"), F.col("priority").cast("long").alias("priority"))


def search_by_ip(spark, sf_dir):
    line = """concat('{"id": "', event_id, '", "remote_addr": "10.0.0.', user_id % 50, '", "note": "via 10.0.0.', event_id % 50, '"}')"""
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("json", 1.0, fields_of(id="integer", remote_addr="string", note="string")), NOW)
    return search.search_by_ip(entries, "10.0.0.7", 100).select(F.col("fields")["id"].cast("bigint").alias("event_id"))


def hourly_counts(spark, sf_dir):
    return stats.hourly(_entries(spark, sf_dir))


def daily_counts(spark, sf_dir):
    return stats.daily(_entries(spark, sf_dir))


def time_series(spark, sf_dir):
    return stats.time_series(_entries(spark, sf_dir)).select("n", "first_ts", "last_ts", F.round("seconds", 3).alias("seconds"), F.round("per_second", 9).alias("per_second"), "peak_hour", "peak_day")


def field_profile(spark, sf_dir):
    return overview.profile(overview.overview(_entries(spark, sf_dir))).select("field", "present", "extraction_rate", "null_rate", "distinct_values").filter("field in ('event_id', 'user_id', 'event_type')")


def top5_values(spark, sf_dir):
    return overview.profile(overview.overview(_entries(spark, sf_dir))).filter("field = 'event_type'").select(F.explode("top_values").alias("x")).select("x.value", "x.n")


_BROKEN = f"case when event_id % 10 = 3 then 'broken line' when event_id % 10 = 7 then concat('{{\"event_id\": \"', event_id, '\", \"ts\": \"never\", \"event_type\": \"', event_type, '\"}}') else {_JSON_LINE} end"


def _broken(spark, sf_dir, source="'events'"):
    return parse.parse(_lines(spark, sf_dir, _BROKEN, source), JSON, NOW)


def parse_quality(spark, sf_dir):
    return parse.parse_statistics(_broken(spark, sf_dir)).select("total_lines", "parsed_lines", "malformed_lines", F.round("success_rate", 9).alias("success_rate"), F.round("mean_confidence", 9).alias("mean_confidence"), "timestamp_parsing", "field_extraction", "format_mismatch", "type_conversion", "other")


def extraction_rates(spark, sf_dir):
    return parse.extraction_rates(_broken(spark, sf_dir), JSON.names).select("field", "extracted", F.round("rate", 9).alias("rate"))


def quality_score(spark, sf_dir):
    return stats.file_statistics(_broken(spark, sf_dir, "event_type"), JSON.names, 1.0).select("source_file", "total_lines", F.round("quality", 9).alias("quality"))


def recommendations(spark, sf_dir):
    entries = _broken(spark, sf_dir, "cast(event_id % 10 as string)")
    files = overview.files(overview.overview(entries), JSON, 0.6)
    return stats.recommendations(files).select("source_file", F.explode("recommendations").alias("hint"))


def multi_file_global(spark, sf_dir):
    files = stats.file_statistics(_broken(spark, sf_dir, "cast(event_id % 10 as string)"), JSON.names, 1.0)
    return stats.global_insights(files).select("n_files", F.round("mean_quality", 9).alias("mean_quality"), F.round("mean_success", 9).alias("mean_success"), "excellent", "good", "fair", "poor")


def multi_file_compare(spark, sf_dir):
    rates = parse.extraction_rates(_broken(spark, sf_dir, "cast(event_id % 10 as string)"), JSON.names)
    return stats.compare_files(rates).select("field", "n_files", F.round("variance", 9).alias("variance"), "best_file", "worst_file")


_MIXED = {
    "json": _JSON_LINE, "ltsv": f"concat('id:', event_id, '\\t', 'type:', event_type)", "apache_common": _CLF, "apache_combined": f"concat({_CLF}, {_AGENT})", "syslog": "concat('<', event_id % 192, '>', date_format(ts, 'MMM d HH:mm:ss'), ' host', user_id, ' ', event_type, ': n')",
    "python_log": f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' - ', event_type, ' - ', {_LEVEL}, ' - m')", "nginx_error": "concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ' [error] 1#2: ', event_type)", "custom_delimited": "concat_ws('|', event_id, event_type, user_id, 'x')",
}


def detect_best(spark, sf_dir):
    """Every event stands in a source of one of the formats; the sources' formats are found again."""
    names = list(_MIXED)
    k = f"event_id % {len(names)}"
    line = "case " + " ".join(f"when {k} = {i} then {x}" for i, x in enumerate(_MIXED.values())) + " end"
    e = _events(spark, sf_dir).select(F.expr(f"array({', '.join(repr(n) for n in names)})[cast({k} as int)]").alias("source_file"), (F.floor(F.col("event_id") / len(names)) + 1).cast("long").alias("line_number"), F.expr(line).alias("raw_line"))
    return detect.best_formats(detect.scores(e)).select(F.col("source_file").alias("rendered"), "format", F.round("confidence", 6).alias("confidence"))


def detect_format_scores(spark, sf_dir):
    return detect.scores(_lines(spark, sf_dir, f"case when event_id % 10 = 3 then 'no web line' else {_CLF} end")).filter("format in ('json', 'apache_common', 'apache_combined', 'syslog')").select("format", F.round("confidence", 9).alias("confidence"))


def type_inference(spark, sf_dir):
    v = _events(spark, sf_dir).select("event_id", F.explode(F.expr("array(cast(event_id as string), cast(value as string), event_type, cast(date_format(ts, 'yyyy-MM-dd HH:mm:ss') as string), 'yes', '')")).alias("text"))
    return v.groupBy(infer_type(F.col("text")).alias("data_type")).agg(F.count(F.lit(1)).alias("n"))


_STAMPS = {"iso8601_utc_ms": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")", "apache_common": "concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000')", "python_logging": "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')", "standard_datetime": "date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "nginx_error": "date_format(ts, 'yyyy/MM/dd HH:mm:ss')", "us_slash_datetime": "date_format(ts, 'MM/dd/yyyy HH:mm:ss')", "unix_seconds": "cast(unix_seconds(cast(ts as timestamp)) as string)", "unix_milliseconds": "cast(unix_millis(cast(ts as timestamp)) as string)", "iso_date": "date_format(ts, 'yyyy-MM-dd')", "syslog_short": "date_format(ts, 'MMM d HH:mm:ss')"}


def timestamp_formats(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.explode(F.expr("map(" + ", ".join(f"'{k}', concat('at ', {x}, ' ok')" for k, x in _STAMPS.items()) + ")")).alias("rendered", "text"))
    best = timestamps.best_timestamp(F.col("text"), NOW)
    return e.withColumn("b", best).select("event_id", "rendered", F.col("b.format").alias("format"), F.col("b.ts").alias("ts"), F.round("b.confidence", 6).alias("confidence"))


def timestamp_extract_all(spark, sf_dir):
    text = F.expr(f"concat('a ', {_STAMPS['iso8601_utc_ms']}, ' b ', {_STAMPS['us_slash_datetime']}, ' c ', {_STAMPS['nginx_error']})")
    found = timestamps.extract_timestamps(text, NOW, 0.7)
    return _events(spark, sf_dir).select("event_id", F.posexplode(found).alias("k", "x")).select("event_id", F.col("k").cast("long").alias("k"), F.col("x.format").alias("format"))


def doc_text_search(spark, sf_dir):
    d = lines_of(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "documents", "doc_id").withColumn("fields", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return d.filter(search.text_condition("idiot")).select(F.col("line_number").alias("doc_id"))


def conversation_search(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("fields", F.create_map(F.lit("role"), F.col("role"))).withColumnRenamed("text", "raw_line")
    return c.filter(search.text_condition("USER")).select("conv_id", "turn")


def flagship(spark, sf_dir):
    found = search.search(_entries(spark, sf_dir), SearchQuery(filters=(SearchFilter("event_type", "equals", "error"), SearchFilter("value", "gt", "50"))), NOW)
    return found.facets("all").filter("field = 'user_id'").select("value", "n", F.col("rank").cast("long").alias("rank"))


_SEARCHES["search_named_group"] = (QueryBuilder.regex_search("event_type", "^(?P<first_part>err)(?P<rest>or)$"), "event_type = 'error'")


def dirty_json_parse(spark, sf_dir):
    """Lines with a key twice, keys equal but for blanks, control characters, and lines cut short."""
    line = """case event_id % 5
      when 1 then concat('{"event_id": "first", "event_id": "', event_id, '", "user_id": ', user_id, ', "event_type": "', event_type, '"}')
      when 2 then concat('{"event_id": ', event_id, ', " user_id": "first", "user_id ": "', user_id, '", "event_type": "', event_type, '"}')
      when 3 then concat('{"event_id": ', event_id, ', "user_id": ', user_id, ', "event_type": "', event_type, '\\\\u0001\\\\u0001"}')
      when 4 then concat('{"event_id": ', event_id, ', "user')
      else concat('{"event_id": ', event_id, ', "user_id": ', user_id, ', "event_type": "', event_type, '"}') end"""
    own = fields_of(event_id="integer", user_id="integer", event_type="string")
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("json", 1.0, own), NOW)
    return parse.typed(entries, own).select("line_number", "event_id", "user_id", "event_type", "is_malformed")


def dirty_csv_parse(spark, sf_dir):
    """A header with a name twice; lines with a value too many, one too few, and quoted delimiters."""
    line = """case event_id % 4 when 1 then concat_ws(',', event_id, event_type, user_id, 'more', 'most') when 2 then concat_ws(',', event_id, event_type)
      when 3 then concat(event_id, ',"a, ""b"" and ', event_type, '",', user_id) else concat_ws(',', event_id, event_type, user_id) end"""
    found = Detection("csv", 1.0, tuple(Field(n) for n in distinct_names(["id", "kind", "id"])), metadata={"delimiter": ","})
    entries = parse.parse(_lines(spark, sf_dir, line), found, NOW)
    return entries.select("line_number", F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"), F.col("fields")["id_2"].alias("id_2"), F.array_join("parse_errors", "; ").alias("errors"))


def dirty_text_parse(spark, sf_dir):
    """Log lines with the control character that the parser itself uses, and lines that match no pattern."""
    line = f"case event_id % 3 when 1 then concat('no pattern in this line ', event_id) else concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' - ', event_type, ' - ', {_LEVEL}, ' - user', chr(1), user_id, chr(1)) end"
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("python_log", 1.0, fields_of(timestamp="timestamp", logger="string", level="string", message="string")), NOW)
    return entries.select("line_number", "ts", F.col("fields")["logger"].alias("logger"), F.replace(F.col("fields")["message"], F.lit("\x01"), F.lit("^")).alias("message"), "is_malformed")


def kv_case_parse(spark, sf_dir):
    line = "concat('EVENT_ID=', event_id, ' User=', user_id, ' user=\"', event_type, '\"')"
    own = fields_of(event_id="integer", user="string", kind="string")
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("key_value", 1.0, own), NOW)
    return parse.typed(entries, own[:2]).select("event_id", "user", F.array_join("parse_errors", "; ").alias("errors"))


def journal_short_parse(spark, sf_dir):
    block = "array(concat(date_format(ts, 'MMM d HH:mm:ss'), ' host', user_id, ' svc[', event_id, ']: ', event_type, ': x'), '', concat('odd line ', event_id), ' ')"
    e = _events(spark, sf_dir).select((F.col("event_id") % 8).cast("string").alias("source_file"), "event_id", F.posexplode(F.expr(block)).alias("k", "raw_line"))
    lines = e.select("source_file", (F.col("event_id") * 4 + F.col("k")).alias("line_number"), "raw_line")
    own = fields_of(timestamp="timestamp", hostname="string", service="string", message="string")
    entries = parse.parse(lines, Detection("systemd_journal", 1.0, own), NOW)
    return entries.select(F.floor(F.col("line_number") / 4).alias("event_id"), "ts", F.col("fields")["hostname"].alias("hostname"), F.col("fields")["service"].alias("service"), F.col("fields")["message"].alias("message"), "is_malformed")


def apache_extended_parse(spark, sf_dir):
    """Virtual hosts with and without referer, and response times with and without it."""
    clf = f"{_CLF}"
    virtual = "concat('10.0.', user_id, '.1 - - site', user_id, ' [', date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +0000] \"GET /', event_type, ' HTTP/1.1\" 200 ', event_id)"
    line = f"case event_id % 4 when 0 then {virtual} when 1 then concat({virtual}, {_AGENT}) when 2 then concat({clf}, ' ', event_id % 100) else concat({clf}, {_AGENT}, ' 0.', event_id % 9 + 1) end"
    own = [Field(n, k) for n, k in (("virtual_host", "string"), ("path", "string"), ("referer", "string"), ("response_time", "float"))]
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("apache_extended", 1.0, (Field("timestamp", "string", True), *own)), NOW, derive=True)
    return parse.typed(entries.select("line_number", "fields", "ts"), tuple(own)).select("line_number", "ts", *[f.name for f in own])


def nginx_timed_parse(spark, sf_dir):
    own = (Field("remote_addr"), Field("request_time", "float"))
    entries = parse.parse(_lines(spark, sf_dir, f"concat({_CLF}, {_AGENT}, ' ', event_id % 7, '.25')"), Detection("nginx_access", 1.0, (Field("time_local", "string", True), *own)), NOW)
    return parse.typed(entries.select("line_number", "fields", "ts"), own).select("line_number", "ts", "remote_addr", "request_time")


def field_schema(spark, sf_dir):
    found = detect.field_schema(_lines(spark, sf_dir, _JSON_LINE), Detection("json", 1.0))
    return found.select("field", "data_type", F.col("frequency").cast("long").alias("frequency"), "is_timestamp", "confidence", F.array_join("samples", ",").alias("samples"), F.array_join("stamps", ",").alias("stamps")).filter("field <> 'value' and field <> 'ts'")


def confidence_words(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.explode(F.expr("map(" + ", ".join(f"'{k}', {x}" for k, x in _STAMPS.items()) + ")")).alias("rendered", "text"))
    b = timestamps.best_timestamp(F.col("text"), NOW)
    said = e.withColumn("b", b).select("rendered", timestamps.explain_confidence(F.col("text"), F.col("b.confidence"), F.col("b.format")).alias("said"))
    return said.groupBy("rendered", "said").agg(F.count(F.lit(1)).alias("n"))


def _files(spark, sf_dir):
    return stats.file_statistics(_broken(spark, sf_dir, "cast(event_id % 10 as string)"), JSON.names, 1.0)


def problem_files(spark, sf_dir):
    return stats.problem_files(_files(spark, sf_dir), 0.8).select("source_file", F.round("quality", 9).alias("quality"))


def multi_file_consistency(spark, sf_dir):
    rates = parse.extraction_rates(_broken(spark, sf_dir, "cast(event_id % 10 as string)"), JSON.names)
    return stats.consistency(stats.compare_files(rates)).select(F.round("consistency", 9).alias("consistency"))


def multi_file_totals(spark, sf_dir):
    totals = stats.aggregate_results(_broken(spark, sf_dir, "cast(event_id % 10 as string)"), JSON.names)["totals"]
    return totals.withColumns({"mean_confidence": F.round("mean_confidence", 9), "success_rate": F.round("success_rate", 9)})


def multi_file_rates(spark, sf_dir):
    rates = stats.aggregate_results(_broken(spark, sf_dir, "case when event_id % 10 = 3 then 'a' else 'b' end"), JSON.names)["rates"]
    return rates.select("field", F.round("rate", 9).alias("rate"), "extracted")


def insufficient_data(spark, sf_dir):
    """Sources of unknown format beside parsed ones: there isn't enough to say of them."""
    entries = _broken(spark, sf_dir, "cast(event_id % 10 as string)")
    files = stats.file_statistics(entries, JSON.names, 1.0).join(stats.file_details(entries, JSON), "source_file")
    every = _events(spark, sf_dir).select((F.col("event_id") % 12).cast("string").alias("source_file")).distinct()
    return stats.recommendations(every.join(files, "source_file", "left")).select("source_file", F.size("recommendations").cast("long").alias("n"), F.coalesce(F.get("recommendations", F.lit(0)), F.lit("none")).alias("first"))


def hour_bars(spark, sf_dir):
    return stats.bars(stats.hourly(_entries(spark, sf_dir)), "hour", "n", 25)


def results_table(spark, sf_dir):
    return search.results_table(_entries(spark, sf_dir), ["event_type", "user_id", "missing"], limit=50, offset=20)


def raw_view(spark, sf_dir):
    return search.raw_view(_lines(spark, sf_dir, "concat('line ', event_id, ' of ', user_id)").withColumn("fields", F.lit(None)), limit=40, offset=7)


def level_counts(spark, sf_dir):
    line = f"concat('at ', event_id, ' ', lower({_LEVEL}), ' then WARN')"
    return _lines(spark, sf_dir, line).groupBy(parse.log_level(F.col("raw_line")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


def report(spark, sf_dir):
    from .plans.session import LogSession

    return LogSession(spark, NOW).report(_broken(spark, sf_dir), JSON).filter("section = 'file' or section = 'field' and label = 'event_type'")


def analysis_report(spark, sf_dir):
    """The report's figures of parsing and of time."""
    return overview.report(overview.overview(_broken(spark, sf_dir)), JSON).filter("section in ('parsing', 'error', 'time') and label not in ('first', 'last')")


def problem_issues(spark, sf_dir):
    files = overview.files(overview.overview(_broken(spark, sf_dir, "cast(event_id % 10 as string)")), JSON, 0.6)
    return overview.problem_files(files, 0.9).select("source_file", F.round("quality", 9).alias("quality"), F.array_join("issues", "; ").alias("issues"))


def rate_bars(spark, sf_dir):
    return overview.rate_bars(overview.overview(_broken(spark, sf_dir)), JSON).select("field", F.round("rate", 9).alias("rate"), "bar")


def gauges(spark, sf_dir):
    files = overview.files(overview.overview(_broken(spark, sf_dir, "cast(event_id % 10 as string)")), JSON, 0.6)
    return overview.gauges(files).filter("gauge <> 'quality'").select("source_file", "gauge", F.round("value", 9).alias("value"), "bar")


def timestamp_fallback(spark, sf_dir):
    """Texts whose first shape isn't a valid time: a date or a time inside of them remains."""
    text = """case event_id % 5 when 0 then concat('at ', date_format(ts, 'yyyy-MM-dd'), ' 25:', date_format(ts, 'mm:ss')) when 1 then concat(date_format(ts, 'yyyy-MM-dd HH:mm'), ':60 it began')
      when 2 then concat('2024-13-45 ', date_format(ts, 'HH:mm:ss')) when 3 then concat('Feb 30 ', date_format(ts, 'HH:mm:ss'), ' host') else concat(date_format(ts, 'dd/MMM/yyyy:HH:mm:ss'), ' +9999') end"""
    best = timestamps.best_timestamp(F.expr(text), NOW)
    return _events(spark, sf_dir).select("event_id", best.alias("b")).select("event_id", "b.ts", "b.format")


def first_field_time(spark, sf_dir):
    """Without a declared time the first field that holds one gives it, also where a later one is surer."""
    line = f"""concat('{{"id": ', event_id, ', "day": "', case when event_id % 3 = 0 then 'none' else date_format(ts, 'yyyy-MM-dd') end, '", "at": "', {_ISO}, '"}}')"""
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("json", 1.0, fields_of(id="integer", day="string", at="string")), NOW)
    return entries.select("line_number", "ts", F.col("ts_format").alias("format"))


def csv_header_once(spark, sf_dir):
    """The header is left out where it is the first line; elsewhere a line like it is data."""
    line = "case when event_id % 7 = 1 then 'id,kind' else concat_ws(',', event_id, event_type) end"
    entries = parse.parse(_lines(spark, sf_dir, line), Detection("csv", 1.0, fields_of(id="string", kind="string"), metadata={"delimiter": ",", "header": "id,kind"}), NOW)
    return entries.select("line_number", F.col("fields")["id"].alias("id"), F.col("fields")["kind"].alias("kind"))


def mixed_formats(spark, sf_dir):
    """Sources of four formats in one scan, each line by its own source's parser."""
    kv = "concat('event_id=', event_id, ' event_type=', event_type, ' ts=', {})".format(_ISO)
    csv = f"concat_ws(',', event_id, event_type, {_ISO})"
    log = f"concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS'), ' - ', event_id, ' - ', {_LEVEL}, ' - ', event_type)"
    lines = _lines(spark, sf_dir, f"case event_id % 4 when 0 then {_JSON_LINE} when 1 then {kv} when 2 then {csv} else {log} end", "concat('s', event_id % 4)")
    own = fields_of(event_id="integer", event_type="string", ts="timestamp")
    plans = [(Detection("json", 1.0, own), ["s0"]), (Detection("key_value", 1.0, own), ["s1"]), (Detection("csv", 1.0, own, metadata={"delimiter": ","}), ["s2"])]
    plans.append((Detection("python_log", 1.0, fields_of(timestamp="timestamp", logger="string", level="string", message="string")), ["s3"]))
    f = F.col("fields")
    return parse.parse_sources(lines, plans, NOW).select("source_file", F.coalesce(f["event_id"], f["logger"]).cast("bigint").alias("event_id"), F.coalesce(f["event_type"], f["message"]).alias("event_type"), "ts", "is_malformed")


def index_search(spark, sf_dir):
    """A search in time for a value over an index written and opened again."""
    path = shared_folder(spark, "index")
    LogIndex.build(_entries(spark, sf_dir), path, ("event_type",), NOW)
    query = QueryBuilder.combined(filters=(SearchFilter("event_type", "equals", "Error"), SearchFilter("value", "gt", "10")), time=TimeFilter(datetime(2024, 1, 3), datetime(2024, 1, 20)))
    return _typed(LogIndex(spark, path, NOW).search(query).matches, fields_of(event_id="integer"), "event_id")


def added_formats(spark, sf_dir):
    """Formats of callers: a pattern found anywhere in a line, with a group inside of a group, and an own test and parser."""
    detect.register_format("level_note", ((r"lvl=((\w)\w*) msg=(.*)", ("level", "initial", "msg")),))
    parts = lambda line: F.split(line, " -> ")
    detect.register_format("arrows", detector=lambda line: F.contains(line, F.lit(" -> ")), parser=lambda line, d: F.when(F.size(parts(line)) == 2, F.create_map(F.lit("from"), F.get(parts(line), F.lit(0)), F.lit("to"), F.get(parts(line), F.lit(1)))))
    try:
        line = f"case when event_id % 2 = 0 then concat(event_id, ' lvl=', {_LEVEL}, ' msg=of ', user_id) else concat(event_id, ' -> ', event_type) end"
        lines = _lines(spark, sf_dir, line, "concat('s', event_id % 2)")
        plans = [(Detection("level_note", 1.0, fields_of(level="string", initial="string", msg="string")), ["s0"]), (Detection("arrows", 1.0, fields_of(**{"from": "integer", "to": "string"})), ["s1"])]
        found = detect.best_formats(detect.scores(lines)).select(F.col("source_file").alias("_s"), "format")
        entries = parse.parse_sources(lines, plans, NOW)
        f = F.col("fields")
        return entries.join(found, F.col("source_file") == F.col("_s")).select("line_number", "format", *[f[n].alias(n) for n in ("level", "initial", "msg", "from", "to")], "is_malformed")
    finally:
        detect.unregister_format("level_note")
        detect.unregister_format("arrows")


def web_field_schema(spark, sf_dir):
    """Fields of web logs are times by their names."""
    lines = _lines(spark, sf_dir, f"concat({_CLF}, {_AGENT}, ' ', event_id % 7, '.25')")
    return detect.field_schema(lines, Detection("nginx_access", 1.0)).select("field", "is_timestamp", F.col("frequency").cast("long").alias("frequency"))


_SEARCHES["search_python_regex"] = (QueryBuilder.regex_search("event_type", r"^(?P<first>[^[\W])(?:rr|[i-i&&]e)(?P<last>or|w)\Z(?!\\Z)"), "event_type in ('error', 'view')")
_SEARCHES["search_conditional_regex"] = (QueryBuilder.regex_search("event_type", r"^(?P<e>e)?(?(e)rror|[^[e]+w)\Z"), "event_type = 'error'")


QUERIES = {k: _search(q) for k, (q, _) in _SEARCHES.items()} | {
    f.__name__: f
    for f in (json_parse, journal_parse, search_page, facet_top10, facet_display, field_names, time_range_meta, search_errors, search_by_ip, hourly_counts, daily_counts, time_series, field_profile, top5_values, parse_quality, extraction_rates, quality_score, recommendations, multi_file_global, multi_file_compare, detect_best, detect_format_scores, type_inference, timestamp_formats, timestamp_extract_all, doc_text_search, conversation_search, flagship,
        dirty_json_parse, dirty_csv_parse, dirty_text_parse, kv_case_parse, journal_short_parse, apache_extended_parse, nginx_timed_parse, field_schema, confidence_words, problem_files, multi_file_consistency, multi_file_totals, multi_file_rates, insufficient_data, hour_bars, results_table, raw_view, level_counts, report,
        analysis_report, problem_issues, rate_bars, gauges, timestamp_fallback, first_field_time, csv_header_once, mixed_formats, index_search, added_formats, web_field_schema)
} | {
    "csv_parse": csv_parse, "custom_delimited_parse": custom_delimited_parse, "ltsv_parse": ltsv_parse, "kv_parse": kv_parse, "apache_common_parse": apache_common_parse, "apache_combined_parse": apache_combined_parse, "nginx_access_parse": nginx_access_parse,
    "nginx_error_parse": nginx_error_parse, "python_log_parse": python_log_parse, "basic_log_parse": basic_log_parse, "syslog3164_parse": syslog3164_parse, "syslog5424_parse": syslog5424_parse,
}

_BAND = "case when c >= 0.9 then 'very high' when c >= 0.8 then 'high' when c >= 0.7 then 'good' when c >= 0.6 then 'moderate' else 'low' end || ' confidence'"
_LEVEL_SQL = "case when event_type = 'error' then 'ERROR' else 'INFO' end"
_SEC = "date_trunc('second', ts) as ts"
_RATES = "select (event_id % 10)::varchar as source_file, f.field, case when event_id % 10 = 3 then 0 when event_id % 10 = 7 and f.field in ('user_id', 'value') then 0 else 1 end as hit from events, (values ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value')) f(field)"
_FILES = "select {source} as source_file, count(*) as total_lines, avg(case when event_id % 10 in (3, 7) then 0.0 else 1.0 end) as success, avg(case event_id % 10 when 3 then 0.0 when 7 then 0.6 else 1.0 end) as extraction, avg(case event_id % 10 when 3 then 0.8 when 7 then 0.4 else 1.0 end) as confidence from events group by 1"
_QUALITY = "least(1.0, (30 * {d} + 40 * success + 20 * extraction + 10 * confidence) / 100)"
ORACLES = {k: _where(w) for k, (_, w) in _SEARCHES.items()} | dict.fromkeys(("json_parse", "csv_parse", "custom_delimited_parse", "ltsv_parse", "kv_parse"), _SELECT) | {
    "apache_common_parse": f"select {_CLF_SQL.format(host='remote_host')}, 'GET' as method, 'HTTP/1.1' as protocol from events",
    "apache_combined_parse": f"select {_CLF_SQL.format(host='remote_host')}, 'https://ref.example/' || user_id as referer, 'agent ' || event_id as user_agent from events",
    "nginx_access_parse": f"select {_CLF_SQL.format(host='remote_addr')}, 'https://ref.example/' || user_id as http_referer, 'agent ' || event_id as http_user_agent from events",
    "nginx_error_parse": f"select {_SEC}, 'error' as level, user_id as pid, event_id as tid, 7::bigint as connection, event_type as message from events",
    "python_log_parse": f"select date_trunc('millisecond', ts) as ts, event_type as logger, {_LEVEL_SQL} as level, 'user ' || user_id as message from events",
    "basic_log_parse": f"select {_SEC}, {_LEVEL_SQL} as level, event_type as module, 'user ' || user_id as message from events",
    "syslog3164_parse": f"select {_SEC}, 'host' || user_id as hostname, event_type as tag, 'n ' || event_id as message, (event_id % 192) // 8 as facility, event_id % 8 as severity from events",
    "syslog5424_parse": "select ts, 'host' || user_id as hostname, event_type as app_name, '[a b=\"1\"][c d=\"2\"]' as structured_data, 'n ' || event_id as message, (event_id % 192) // 8 as facility, event_id % 8 as severity from events",
    "journal_parse": "select ts, event_id % 8 as priority, event_type || ' of ' || user_id as message from events",
    "search_page": "select event_id from events where event_type = 'view' order by event_id limit 25 offset 40",
    "facet_top10": "with v as (select 'event_type' as field, event_type as value, event_id from events union all select 'user_id', user_id::varchar, event_id from events), c as (select field, value, count(*) as n, min(event_id) as f from v group by 1, 2), r as (select *, row_number() over (partition by field order by n desc, f) as rank from c) select field, value, n, rank from r where rank <= 10",
    "facet_display": "select event_type as value, count(*) as n from events group by 1 order by n desc, min(event_id) limit 3",
    "field_names": "select unnest(['event_id', 'ts', 'user_id', 'event_type', 'value']) as field",
    "time_range_meta": "select min(ts) as first_ts, max(ts) as last_ts from events",
    "search_errors": "select event_id, p::bigint as priority from (select event_id, case when event_type = 'error' then 0 when contains((200 + user_id % 60)::varchar, '5') then 2 end as p from events) where p is not null order by p, event_id limit 300",
    "search_by_ip": "select event_id from events where user_id % 50 = 7 order by event_id limit 100",
    "hourly_counts": "select hour(ts)::bigint as hour, count(*) as n from events group by 1",
    "daily_counts": "select strftime(ts, '%Y-%m-%d') as day, count(*) as n from events group by 1",
    "time_series": "with s as (select count(*) as n, min(ts) as first_ts, max(ts) as last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as s from events), h as (select hour(ts)::bigint as k, count(*) as c, min(ts) as t from events group by 1 order by c desc, t limit 1), d as (select strftime(ts, '%Y-%m-%d') as k, count(*) as c, min(ts) as t from events group by 1 order by c desc, t limit 1) select n, first_ts, last_ts, round(s, 3) as seconds, round(n / s, 9) as per_second, h.k as peak_hour, d.k as peak_day from s, h, d",
    "field_profile": "select f as field, n as present, 1.0::double as extraction_rate, 0.0::double as null_rate, d as distinct_values from (select count(*) as n, unnest(['event_id', 'user_id', 'event_type']) as f, unnest([count(distinct event_id), count(distinct user_id), count(distinct event_type)]) as d from events)",
    "top5_values": "select event_type as value, count(*) as n from events group by 1 order by n desc, min(event_id) limit 5",
    "parse_quality": "with e as (select event_id % 10 as k from events) select count(*) as total_lines, count(*) filter (k not in (3, 7)) as parsed_lines, count(*) filter (k in (3, 7)) as malformed_lines, round(avg(case when k in (3, 7) then 0.0 else 1.0 end), 9) as success_rate, round(avg(case k when 3 then 0.8 when 7 then 0.4 else 1.0 end), 9) as mean_confidence, count(*) filter (k = 7) as timestamp_parsing, (2 * count(*) filter (k = 7))::bigint as field_extraction, count(*) filter (k = 3) as format_mismatch, 0::bigint as type_conversion, 0::bigint as other from e",
    "extraction_rates": f"select field, sum(hit)::bigint as extracted, round(avg(hit), 9) as rate from ({_RATES}) group by 1",
    "quality_score": f"select source_file, total_lines, round({_QUALITY.format(d='1.0')}, 9) as quality from ({_FILES.format(source='event_type')})",
    "recommendations": f"with f as ({_FILES.format(source='(event_id % 10)::varchar')}), r as (select source_file, field, avg(hit) as rate from ({_RATES}) group by 1, 2), p as (select *, row_number() over (partition by source_file order by rate desc, field) as k from r where rate < 0.5), e as (select (event_id % 10)::varchar as source_file, count(*) as n, greatest(count(*) filter (event_id % 10 = 7), 2 * count(*) filter (event_id % 10 = 7), count(*) filter (event_id % 10 = 3)) as most from events group by 1) select source_file, 'check the detected format' as hint from f union all select source_file, 'many lines fail to parse' from f where success < 0.8 union all select source_file, 'rarely extracted: ' || string_agg(field, ', ' order by k) from p where k <= 3 group by 1 union all select source_file, 'one kind of error is frequent' from e where most > 0.1 * n",
    "multi_file_global": f"with f as (select *, {_QUALITY.format(d='1.0')} as q from ({_FILES.format(source='(event_id % 10)::varchar')})) select count(*) as n_files, round(avg(q), 9) as mean_quality, round(avg(success), 9) as mean_success, count(*) filter (q >= 0.9) as excellent, count(*) filter (q >= 0.7 and q < 0.9) as good, count(*) filter (q >= 0.5 and q < 0.7) as fair, count(*) filter (q < 0.5) as poor from f",
    "multi_file_compare": f"with r as (select source_file, field, avg(hit) as rate from ({_RATES}) group by 1, 2) select field, count(*) as n_files, round(var_samp(rate), 9) as variance, (list(source_file order by -rate, source_file))[1] as best_file, (list(source_file order by rate, source_file))[1] as worst_file from r group by 1",
    "detect_best": "select f as rendered, f as format, 1.0::double as confidence from (select distinct ['" + "', '".join(_MIXED) + f"'][event_id % {len(_MIXED)} + 1] as f from events)",
    "detect_format_scores": "with e as (select event_id % 10 as k from events where event_id between 1 and 100), c as (select avg(case when k = 3 then 0.0 else 1.0 end) as c from e) select 'apache_common' as format, round(least(1.0, c + case when c > 0.8 then 0.1 else 0 end), 9)::double as confidence from c union all select unnest(['json', 'apache_combined', 'syslog']), 0.0",
    "type_inference": "select t as data_type, sum(n)::bigint as n from (select 'string' as t, 2 * count(*) as n from events union all select 'timestamp', count(*) from events union all select 'float', count(*) from events union all select 'integer', count(*) filter (event_id not in (0, 1)) from events union all select 'boolean', count(*) + count(*) filter (event_id in (0, 1)) from events) group by 1",
    "timestamp_formats": "with s as (select event_id, unnest(['iso8601_utc_ms', 'apache_common', 'python_logging', 'standard_datetime', 'nginx_error', 'us_slash_datetime', 'unix_seconds', 'unix_milliseconds', 'iso_date', 'syslog_short']) as format, unnest([ts, date_trunc('second', ts), date_trunc('millisecond', ts), date_trunc('second', ts), date_trunc('second', ts), date_trunc('second', ts), date_trunc('second', ts), date_trunc('millisecond', ts), date_trunc('day', ts), date_trunc('second', ts)]) as ts, unnest([1.0, 0.95, 0.935, 0.85, 0.83, 0.63, 0.91, 0.86, 0.61, 0.70]) as c, unnest([0, 0, 0, 0, 0, 0, 0, 0, 0, 1]) as short from events) select event_id, format as rendered, format, ts, round(c, 6)::double as confidence from s",
    "timestamp_extract_all": "select event_id, unnest([0, 1])::bigint as k, unnest(['iso8601_utc_ms', 'nginx_error']) as format from events",
    "doc_text_search": "select doc_id from documents where contains(lower(text), 'idiot')",
    "conversation_search": "select conv_id, turn from conversations where contains(lower(text), 'user') or role = 'user'",
    "flagship": "select user_id::varchar as value, n, rank from (select user_id, count(*) as n, row_number() over (order by count(*) desc, min(event_id)) as rank from events where event_type = 'error' and value > 50 group by 1) where rank <= 10",
    "dirty_json_parse": "select event_id as line_number, case when event_id % 5 < 4 then event_id end as event_id, case when event_id % 5 < 4 then user_id end as user_id, case event_id % 5 when 3 then event_type || chr(1) || chr(1) when 4 then null else event_type end as event_type, event_id % 5 = 4 as is_malformed from events",
    "dirty_csv_parse": "select event_id as line_number, event_id::varchar as id, case when event_id % 4 = 3 then 'a, \"b\" and ' || event_type else event_type end as kind, case when event_id % 4 <> 2 then user_id::varchar end as id_2, case event_id % 4 when 1 then '2 values too many' when 2 then 'missing field id_2' else '' end as errors from events",
    "dirty_text_parse": "select event_id as line_number, case when event_id % 3 <> 1 then date_trunc('millisecond', ts) end as ts, case when event_id % 3 <> 1 then event_type end as logger, case when event_id % 3 = 1 then 'no pattern in this line ' || event_id else 'user^' || user_id || '^' end as message, event_id % 3 = 1 as is_malformed from events",
    "kv_case_parse": "select event_id, event_type as user, 'missing field kind' as errors from events",
    "journal_short_parse": "select event_id, date_trunc('second', ts) as ts, 'host' || user_id as hostname, 'svc[' || event_id || ']' as service, event_type || ': x' as message, false as is_malformed from events union all select event_id, null, null, null, 'odd line ' || event_id, true from events",
    "apache_extended_parse": "select event_id as line_number, date_trunc('second', ts) as ts, case when event_id % 4 < 2 then 'site' || user_id end as virtual_host, '/' || event_type || case when event_id % 4 < 2 then '' else '/' || event_id end as path, case when event_id % 4 in (1, 3) then 'https://ref.example/' || user_id end as referer, case event_id % 4 when 2 then (event_id % 100)::double when 3 then (event_id % 9 + 1) / 10.0::double end as response_time from events",
    "nginx_timed_parse": "select event_id as line_number, date_trunc('second', ts) as ts, '10.0.' || user_id || '.1' as remote_addr, (event_id % 7 + 0.25)::double as request_time from events",
    "field_schema": "with v as (select 'event_id' as field, event_id::varchar as value, event_id from events union all select 'user_id', user_id::varchar, event_id from events union all select 'event_type', event_type, event_id from events), d as (select field, value, min(event_id) as f from v group by 1, 2), k as (select *, row_number() over (partition by field order by f) as k from d), t as (select field, string_agg(value, ',' order by k) as samples from k where k <= 10 group by 1), o as (select field, arg_min(value, event_id) as first, count(*) as frequency from v group by 1) select field, case when lower(first) in ('0', '1', 'yes', 'no', 'true', 'false', 'y', 'n') then 'boolean' when field = 'event_type' then 'string' else 'integer' end as data_type, frequency, false as is_timestamp, 1.0::double as confidence, samples, '' as stamps from o join t using (field)",
    "confidence_words": f"with s as (select unnest(['iso8601_utc_ms', 'apache_common', 'python_logging', 'standard_datetime', 'nginx_error', 'us_slash_datetime', 'unix_seconds', 'unix_milliseconds', 'iso_date', 'syslog_short']) as rendered, unnest([1.0, 0.95, 0.935, 0.85, 0.83, 0.63, 0.91, 0.86, 0.61, 0.70]) as c, unnest([' - ISO 8601 format - includes timezone - sub-second precision', ' - includes timezone', ' - includes timezone', ' - includes timezone', '', ' - US date order, ambiguous', ' - Unix timestamp', ' - Unix timestamp', ' - ISO 8601 format - includes timezone', '']) as more from events) select rendered, {_BAND} || more as said, count(*) as n from s group by 1, 2",
    "problem_files": f"with f as (select *, {_QUALITY.format(d='1.0')} as q from ({_FILES.format(source='(event_id % 10)::varchar')})) select source_file, round(q, 9) as quality from f where q < 0.8",
    "multi_file_consistency": f"with r as (select source_file, field, avg(hit) as rate from ({_RATES}) group by 1, 2) select round(1 - avg(v), 9) as consistency from (select field, var_samp(rate) as v from r group by 1)",
    "multi_file_totals": "with e as (select event_id % 10 as k from events), c as (select k, avg(case k when 3 then 0.8 when 7 then 0.4 else 1.0 end) as c from e group by 1) select count(*) as total_lines, count(*) filter (k not in (3, 7)) as parsed_lines, count(*) filter (k in (3, 7)) as malformed_lines, count(*) filter (k = 7) as timestamp_parsing, (2 * count(*) filter (k = 7))::bigint as field_extraction, count(*) filter (k = 3) as format_mismatch, 0::bigint as type_conversion, 0::bigint as other, round((select avg(c) from c), 9)::double as mean_confidence, round(avg(case when k in (3, 7) then 0.0 else 1.0 end), 9) as success_rate from e",
    "multi_file_rates": "with h as (select case when event_id % 10 = 3 then 'a' else 'b' end as s, f.field, case when event_id % 10 = 3 then 0 when event_id % 10 = 7 and f.field in ('user_id', 'value') then 0 else 1 end as hit from events, (values ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value')) f(field)), r as (select s, field, avg(hit) as rate from h group by 1, 2) select field, round(avg(rate), 9) as rate, floor(avg(rate) * (select count(*) from events))::bigint as extracted from r group by 1",
    "insufficient_data": "with s as (select distinct event_id % 12 as k from events) select k::varchar as source_file, case when k > 9 then 1 when k in (3, 7) then 3 else 0 end::bigint as n, case when k > 9 then 'not enough data' when k in (3, 7) then 'many lines fail to parse' else 'none' end as first from s",
    "hour_bars": "with h as (select hour(ts)::bigint as hour, count(*) as n from events group by 1) select hour, n, repeat('#', (n * 25 // (select max(n) from h))::int) as bar from h",
    "results_table": "select row_number() over (order by event_id) + 20 as number, strftime(ts, '%m-%d %H:%M') as time, event_type, '' as missing, user_id::varchar as user_id from (select * from events order by event_id limit 50 offset 20)",
    "raw_view": "select row_number() over (order by event_id) + 7 as number, 'line ' || event_id || ' of ' || user_id as raw_line from (select * from events order by event_id limit 40 offset 7)",
    "level_counts": f"select {_LEVEL_SQL} as level, count(*) as n from events group by 1",
    "report": f"with f as (select 'events' as source_file, count(*) as n, avg(case when event_id % 10 in (3, 7) then 0.0 else 1.0 end) as success, avg(case event_id % 10 when 3 then 0.0 when 7 then 0.6 else 1.0 end) as extraction, avg(case event_id % 10 when 3 then 0.8 when 7 then 0.4 else 1.0 end) as confidence from events) select 'file' as section, 'events' as label, printf('%d lines, quality %.2f', n, {_QUALITY.format(d='1.0')}) as value from f union all select 'field', 'event_type', printf('%d values, %d distinct', count(*), count(distinct event_type)) from events where event_id % 10 <> 3",
}

_BAR = "repeat('#', floor(round({share} * 30, 9))::int) || repeat('.', 30 - floor(round({share} * 30, 9))::int)"
_TIMES = "select event_id, ts from events where event_id % 10 not in (3, 7)"
ORACLES |= {
    "analysis_report": f"""with t as ({_TIMES}), h as (select strftime(ts, '%H') as name, count(*) as n, min(ts) as lo from t group by 1), d as (select strftime(ts, '%Y-%m-%d') as name, count(*) as n, min(ts) as lo from t group by 1),
      e as (select count(*) as n, count(*) filter (event_id % 10 in (3, 7)) as bad, avg(case event_id % 10 when 3 then 0.8 when 7 then 0.4 else 1.0 end) as c, count(*) filter (event_id % 10 = 3) as failed, count(*) filter (event_id % 10 = 7) as few from events)
      select 'parsing' as section, 'lines' as label, n::varchar as value from e union all select 'parsing', 'parsed', (n - bad)::varchar from e union all select 'parsing', 'malformed', bad::varchar from e union all select 'parsing', 'success', printf('%.1f %%', (n - bad) * 100.0 / n) from e
      union all select 'parsing', 'mean confidence', printf('%.3f', c) from e union all select 'error', 'format_mismatch', failed::varchar from e union all select 'error', 'field_extraction', (2 * few)::varchar from e union all select 'error', 'timestamp_parsing', few::varchar from e
      union all select 'time', 'entries with a time', count(*)::varchar from t union all select 'time', 'peak hour', (select name from h order by n desc, lo limit 1) union all select 'time', 'peak day', (select name from d order by n desc, lo limit 1)
      union all select 'time', 'hours', count(*)::varchar from h union all select 'time', 'days', count(*)::varchar from d union all select 'time', 'entries a second', printf('%.3f', count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6) from t""",
    "problem_issues": f"with f as (select *, {_QUALITY.format(d='0.6')} as q from ({_FILES.format(source='(event_id % 10)::varchar')})) select source_file, round(q, 9) as quality, 'check the detected format' || case when success < 0.8 then '; many lines fail to parse' else '' end as issues from f where q < 0.9",
    "rate_bars": f"with r as (select f.field, avg(case when event_id % 10 = 3 or event_id % 10 = 7 and f.field in ('user_id', 'value') then 0.0 else 1.0 end) as rate from events, (values ('event_id'), ('ts'), ('user_id'), ('event_type'), ('value')) f(field) group by 1), m as (select *, rate / (select max(rate) from r) as share from r) select field, round(rate, 9) as rate, {_BAR.format(share='share')} as bar from m",
    "gauges": f"with f as ({_FILES.format(source='(event_id % 10)::varchar')}), g as (select source_file, unnest(['success', 'detection', 'confidence']) as gauge, unnest([success, 0.6, confidence]) as value from f) select source_file, gauge, round(value, 9) as value, {_BAR.format(share='value')} as bar from g",
    "timestamp_fallback": "select event_id, case when event_id % 5 < 2 then date_trunc('day', ts)::timestamp when event_id % 5 < 4 then timestamp '2024-01-31' + (date_trunc('second', ts) - date_trunc('day', ts)) else date_trunc('second', ts) end as ts, case when event_id % 5 < 2 then 'iso_date' when event_id % 5 < 4 then 'time_only' else 'apache_common_no_tz' end as format from events",
    "first_field_time": "select event_id as line_number, case when event_id % 3 = 0 then ts else date_trunc('day', ts)::timestamp end as ts, case when event_id % 3 = 0 then 'iso8601_utc_ms' else 'iso_date' end as format from events",
    "csv_header_once": "select event_id as line_number, case when event_id % 7 = 1 then 'id' else event_id::varchar end as id, case when event_id % 7 = 1 then 'kind' else event_type end as kind from events where event_id <> 1",
    "mixed_formats": "select 's' || event_id % 4 as source_file, event_id, event_type, case when event_id % 4 = 3 then date_trunc('millisecond', ts) else ts end as ts, false as is_malformed from events",
    "index_search": "select event_id from events where event_type = 'error' and value > 10 and ts between timestamp '2024-01-03' and timestamp '2024-01-20'",
    "added_formats": f"select event_id as line_number, case when event_id % 2 = 0 then 'level_note' else 'arrows' end as format, case when event_id % 2 = 0 then {_LEVEL_SQL} end as level, case when event_id % 2 = 0 then {_LEVEL_SQL}[1] end as initial, case when event_id % 2 = 0 then 'of ' || user_id end as msg, case when event_id % 2 = 1 then event_id::varchar end as from, case when event_id % 2 = 1 then event_type end as to, false as is_malformed from events".replace(" as from,", ' as "from",').replace(" as to,", ' as "to",'),
    "web_field_schema": "select f as field, f in ('time_local', 'request_time') as is_timestamp, count(*) as frequency from events, (values ('remote_addr'), ('time_local'), ('request'), ('status'), ('bytes_sent'), ('http_referer'), ('http_user_agent'), ('request_time')) v(f) group by 1",
}
