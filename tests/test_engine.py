"""The log engine on small inputs, with values worked out by hand."""

import bz2
import gzip
import lzma
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions import timestamps
from logloom.functions.values import convert, infer_type
from logloom.model import Detection, Field, fields_of
from logloom.operators import detect, overview, parse, search, stats
from logloom.operators.search import QueryBuilder, SearchFilter, SearchQuery, TimeFilter
from logloom.plans.session import LogSession
from logloom.sources.lines import list_sources, read_heads, read_lines

NOW = datetime(2026, 6, 1)


def lines(spark, rows, source="s"):
    return spark.createDataFrame([(source, i + 1, x) for i, x in enumerate(rows)], "source_file string, line_number bigint, raw_line string")


@pytest.mark.parametrize(
    "text, name, sure",
    [
        ("1999-12-31", "iso_date", 0.49), ("2019-03-05T04:06:07", "iso8601_naive", 0.93), ("on 2025-11-30T23:59:58.5Z!", "iso8601_utc_ms", 1.0), ("2021-02-03T01:02:03Z", "iso8601_utc", 1.0), ("2022-08-09T10:11:12-0330", "iso8601_tz", 1.0),
        ("Mon, 3 Feb 2025 08:09:10 -0700", "rfc2822", 1.0), ("[Tue Feb 04 05:06:07 2025]", "apache_modjk_bracketed", 0.96), ("04/Feb/2025:05:06:07 -0800", "apache_common", 0.95), ("2024-02-29 00:00:01,999", "python_logging", 0.935),
        ("2024/02/29 06:07:08", "nginx_error", 0.83), ("02/28/2024 06:07:08", "us_slash_datetime", 0.63), ("1719000000", "unix_seconds", 0.91), ("1719000000123", "unix_milliseconds", 0.86), ("1719000000123456", "unix_microseconds", 0.81),
        ("1000000000", "unix_seconds", 0.662), ("4000000000", "unix_seconds", 0.526), ("2023-02-30", None, None), ("nothing of the kind", None, None), ("", None, None), (None, None, None),
    ],
)
def test_timestamps(spark, text, name, sure):
    r = spark.createDataFrame([(text,)], "t string").select(timestamps.best_timestamp(F.col("t"), NOW).alias("b")).first()["b"]
    assert (r and (r["format"], round(r["confidence"], 3))) == ((name, sure) if name else None)


def test_offsets_and_explanation(spark):
    df = spark.createDataFrame([("2024-05-06T07:08:09-09:30",)], "t string")
    r = df.select(timestamps.best_timestamp(F.col("t"), NOW).alias("b"), timestamps.explain_confidence(F.col("t"), F.lit(0.95), F.lit("iso8601_tz")).alias("e")).first()
    assert r["b"]["offset_min"] == -570 and r["b"]["ts"] == datetime(2024, 5, 6, 7, 8, 9)
    assert r["e"] == "very high confidence - ISO 8601 format - includes timezone"


def test_several_timestamps_in_a_text(spark):
    text = "from 2024-05-06T07:08:09Z to 05/07/2024 01:02:03, not 2024-13-01 00:00:00, day 2024/05/08"
    df = spark.createDataFrame([(text,)], "t string").select(timestamps.detect_timestamps(F.col("t"), NOW).alias("x"), timestamps.extract_timestamps(F.col("t"), NOW, 0.7).alias("y"))
    r = df.first()
    assert [x["format"] for x in r["x"]] == ["iso8601_utc", "us_slash_datetime", "slash_date", "time_only"] and [x["format"] for x in r["y"]] == ["iso8601_utc"]


def test_types(spark):
    texts = ["yes", "1", "12", " -7 ", "1_000", "2.5", "nan", "1e3", "2023-07-27 10:00:00", "abc", "", "1d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(infer_type(F.col("t"))).collect()]
    assert got == ["boolean", "boolean", "integer", "integer", "integer", "float", "float", "float", "timestamp", "string", "string", "string"]
    assert df.select(convert(F.col("t"), "integer")).collect()[4][0] == 1000 and df.select(convert(F.col("t"), "float")).collect()[11][0] is None


def test_search(spark):
    rows = [("fatal", "disk full on sdb", "507"), ("notice", "backup begun", "202"), ("notice", "backup done", "201"), ("error", "disk gone", "403"), ("debug", "tick", "200")]
    schema = "source_file string, line_number bigint, raw_line string, fields map<string,string>, ts timestamp_ntz, ts_offset_min int"
    e = spark.createDataFrame([("s", i, f"{a} {b}", {"level": a, "message": b, "status": c}, datetime(2026, 5, 31, 19 + i), None) for i, (a, b, c) in enumerate(rows)], schema)
    n = lambda q: search.search(e, q, NOW).total
    assert n(QueryBuilder.simple_text("DISK")) == 2
    assert n(QueryBuilder.regex_search("status", "^20[12]$")) == 2
    assert n(SearchQuery(filters=(SearchFilter("status", "gte", "403"),))) == 2 and n(SearchQuery(filters=(SearchFilter("status", "lt", "x"),))) == 0
    assert n(SearchQuery(filters=(SearchFilter("level", "sounds", "x"),))) == 0 and n(QueryBuilder.field_equals("nothing", "x")) == 0
    assert n(QueryBuilder.last_hours(3)) == 3 and n(SearchQuery(time=TimeFilter())) == 5
    page = search.search(e, SearchQuery(limit=2, offset=1), NOW)
    assert page.total == 5 and [r["line_number"] for r in page.page.collect()] == [1, 2]
    assert {(r["value"], r["n"]) for r in search.facets(e).filter("field = 'level'").collect()} == {("notice", 2), ("fatal", 1), ("error", 1), ("debug", 1)}
    assert [r["line_number"] for r in search.search_errors(e, NOW).collect()] == [3, 0]
    assert search.search_by_ip(e, "10.0.0.1").count() == 0
    with pytest.raises(ValueError):
        search.search(e, SearchQuery(offset=-1), NOW)
    assert SearchQuery.from_form({"text": " x ", "last_hours": "2"}) == SearchQuery("x", (), TimeFilter(last_hours=2), 100, 0)
    table = search.results_table(e, limit=2, offset=3).collect()
    assert [tuple(r) for r in table] == [(4, "05-31 22:00", "error", "disk gone", "403"), (5, "05-31 23:00", "debug", "tick", "200")]
    assert [tuple(r) for r in search.raw_view(e, limit=1, offset=4).collect()] == [(5, "debug tick")]


@pytest.mark.parametrize("pattern, hits", [(r"(?P<a_b>di)sk (?P=a_b)?", 2), (r"(?P<x>tick)\Z", 1), ("(", 0), (r"(?P<x>", 0), (r"\u0064isk", 2), (r"(?(1)a|b)", 0), ("[[:x", 0)])
def test_regexes_of_any_dialect_end_no_job(spark, pattern, hits):
    e = spark.createDataFrame([("s", i, m, {"m": m}, None, None) for i, m in enumerate(("disk full", "disk di", "tick"))], "source_file string, line_number bigint, raw_line string, fields map<string,string>, ts timestamp_ntz, ts_offset_min int")
    assert search.search(e, QueryBuilder.regex_search("m", pattern), NOW).total == hits


def test_searches_parse_each_line_once(spark):
    e = parse.parse(lines(spark, ['{"a": "1", "b": "x"}'] * 3), Detection("json", 1.0, fields_of(a="integer", b="string", at="timestamp")), NOW)
    found = search.search(e, SearchQuery("x", (SearchFilter("a", "gt", "0"), SearchFilter("b", "equals", "x")), TimeFilter(end=NOW)), NOW).matches
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json(") <= 1 and found.count() == 0


@pytest.mark.parametrize(
    "rows, name",
    [
        (['{"level": "a", "msg": "b"}'] * 3, "json"), (["<77>Mar  3 05:06:07 barn pump: dry"] * 2, "syslog"), (["<77>1 2021-03-03T05:06:07Z barn pump 8 LVL [tank cm=\"4\"] dry"] * 2, "syslog"),
        (['10.8.0.9 - - [03/Mar/2021:05:06:07 +0000] "PUT /tank HTTP/1.1" 204 17'], "apache_common"), (["tank:north\tpump:two\tlevel:low"] * 3, "ltsv"), (["a|b|c", "d|e|f", "g|h|i"], "custom_delimited"),
        (['tank="north" pump="two" level="low"'] * 3, "key_value"), (["_PID=1", "MESSAGE=x", "", "_PID=2", "MESSAGE=y"], "systemd_journal"), (["just words", "of prose"], "unknown"),
    ],
)
def test_detection(spark, rows, name):
    d = detect.detect(lines(spark, rows))
    assert d["s"].format == name


def test_csv_detection_and_parse(spark):
    text = lines(spark, ["plant;height;bed", 'fern;31;"North; shady"', "moss;;East", "oak;900;Lawn", "ivy;7"])
    d = detect.detect(text)["s"]
    assert (d.format, d.names, d.metadata["delimiter"]) == ("csv", ("plant", "height", "bed"), ";")
    e = parse.parse(text, d, NOW).orderBy("line_number").collect()
    assert [r["fields"].get("bed") for r in e] == ["North; shady", "East", "Lawn", None] and e[3]["parse_errors"] == ["missing field bed"]


def test_lines_that_used_to_end_jobs(spark):
    """Keys twice, keys equal but for blanks, the parser's own mark in a text, header names twice."""
    d = Detection("json", 1.0, fields_of(a="string"))
    rows = ['{"a": 1, "a": 2}', '{"a": 1, " a": 3}', '{" a ": null, "a": 4}', '{"a": {"b": 1}}', '{"a": [1, 2]}', '{"a": "\\u0001"}', "{", '{"a"', '"a"', "null", "{}"]
    got = [(r["fields"].get("a"), r["is_malformed"]) for r in parse.parse(lines(spark, rows), d, NOW).orderBy("line_number").collect()]
    assert got == [("2", False), ("3", False), ("4", False), ('{"b":1}', False), ("[1,2]", False), ("\x01", False), (None, True), (None, True), (None, True), (None, True), (None, True)]
    assert detect.detect(lines(spark, rows))["s"].format != "unknown"
    text = lines(spark, ["n,m,n", "1,2,3", "4,5,6", "7,8,9", "1,2,3,4"])
    d = detect.detect(text)["s"]
    assert d.names == ("n", "m", "n_2")
    e = parse.parse(text, d, NOW).orderBy("line_number").collect()
    assert e[0]["fields"] == {"n": "1", "m": "2", "n_2": "3"} and e[3]["parse_errors"] == ["1 values too many"]
    twice = Detection("csv", 1.0, (Field("x"), Field("x")), metadata={"delimiter": ","})
    assert parse.parse(lines(spark, ["1,2"]), twice, NOW).first()["fields"] == {"x": "1", "x_2": "2"}
    line = "2024-05-06 07:08:09,010 - web\x01 - INFO - mess\x01age"
    r = parse.parse(lines(spark, [line]), Detection("python_log", 1.0), NOW).first()
    assert r["fields"]["logger"] == "web\x01" and r["fields"]["message"] == "mess\x01age"
    kv = parse.parse(lines(spark, ["a=1 b=2 a=3 A=4"]), Detection("key_value", 1.0, fields_of(a="string", B="string")), NOW).first()
    assert kv["fields"] == {"a": "3", "B": "2"}


def test_journal_blocks(spark, monkeypatch):
    monkeypatch.setattr(parse, "_CHUNK_LINES", 3)  # blocks over the borders of chunks
    rows = ["", "_PID=7", "MESSAGE=a", "MESSAGE=b", "odd", "", "", "Feb  3 04:05:06 box cron[9]: ran: well", "", "no journal line", "MESSAGE=x", "", "__REALTIME_TIMESTAMP=1714979289000000", "MESSAGE=c=d"]
    e = parse.parse(lines(spark, rows), Detection("systemd_journal", 1.0), NOW).orderBy("line_number").collect()
    assert [(r["line_number"], r["fields"], len(r["parse_errors"])) for r in e] == [
        (2, {"_PID": "7", "MESSAGE": "b"}, 1), (8, {"timestamp": "Feb  3 04:05:06", "hostname": "box", "service": "cron[9]", "message": "ran: well"}, 0), (10, {"MESSAGE": "x"}, 1), (13, {"__REALTIME_TIMESTAMP": "1714979289000000", "MESSAGE": "c=d"}, 0),
    ]
    assert e[1]["ts"] == datetime(2026, 2, 3, 4, 5, 6) and e[3]["ts"] == datetime(2024, 5, 6, 7, 8, 9)


def test_fallbacks(spark):
    d = Detection("basic_log", 1.0, fields_of(timestamp="timestamp", level="string", message="string"))
    r = parse.parse(lines(spark, ["~~ odd but stamped 2024/05/06 07:08:09", "~~ odd"]), d, NOW).orderBy("line_number").collect()
    assert r[0]["ts"] == datetime(2024, 5, 6, 7, 8, 9) and r[0]["is_malformed"] and r[1]["fields"] == {"message": "~~ odd"} and r[1]["ts"] is None
    assert parse.parse_line(spark, "WARN: low", d, NOW).first()["fields"] == {"level": "WARN", "message": "low"}
    guessed = Detection("custom_delimited", 1.0, tuple(Field(x) for x in "abc"), samples=("1:2;3;4",))
    assert parse.delimiter_of(guessed) == ";" and parse.delimiter_of(Detection("csv")) == ","


def test_formats_can_be_added(spark):
    detect.register_format("ship_log", ((r"^=(\w+)= (.*)$", ("ship", "message")),), 0.6)
    try:
        text = lines(spark, ["=ana= left port", "=bo= at sea", "?"])
        d = detect.detect(text)["s"]
        assert d.format == "ship_log" and d.names == ("ship", "message")
        assert [r["fields"].get("ship") for r in parse.parse(text, d, NOW).orderBy("line_number").collect()] == ["ana", "bo", None]
        with pytest.raises(ValueError):
            detect.register_format("json", ())
    finally:
        detect._ADDED.clear()
        detect.PATTERNS.pop("ship_log")
        detect.THRESHOLDS.pop("ship_log")


def test_detections_carry_shapes_and_kinds(spark):
    text = lines(spark, [f'{{"at": "2024-05-0{i}T07:08:09Z", "n": "{i}0", "w": "w{i % 3}"}}' for i in range(1, 9)], "j").unionByName(lines(spark, [f"<3{i}>Feb  {i} 04:05:06 box app: m{i}" for i in range(1, 9)], "y"))
    d = detect.detect(text)
    assert d["j"].metadata["stamps"] == "iso8601_utc" and d["y"].metadata["detected_rfc"] == "3164"
    kinds = {f.name: (f.data_type, f.is_timestamp, f.samples[:2]) for f in d["j"].fields}
    assert kinds["n"] == ("integer", False, ("10", "20")) and kinds["w"] == ("string", False, ("w1", "w2")) and kinds["at"][1]
    assert detect.validate(d["j"])["can_parse"] and detect.validate(Detection("unknown"))["warnings"] == ["unknown format", "few sample lines", "low quality"]
    e = LogSession(spark, NOW).parse(text, d)
    assert e.filter("ts is null").isEmpty() and e.count() == 16
    assert stats.best_detection(d).confidence == 1.0 and stats.format_statistics(d["j"])["n_timestamp_fields"] == 1
    profile = {r["field"]: r for r in overview.profile(overview.overview(e.filter("source_file = 'j'")), Detection("json", 1.0, fields_of(n="integer", gone="float"))).collect()}
    assert (profile["n"]["distinct_values"], profile["n"]["data_type"], profile["gone"]["present"], profile["gone"]["extraction_rate"]) == (8, "integer", 0, 0.0)


def test_error_model(spark):
    d = Detection("json", 1.0, fields_of(a="integer", at="timestamp"))
    e = parse.parse(lines(spark, ['{"a": "1", "at": "2021-03-03T05:06:07Z"}', "", "nonsense", '{"a": "x"}', '{"a": "1", "at": "never"}', "[1]"]), d, NOW)
    got = {r["line_number"]: (r["is_malformed"], round(r["confidence"], 2)) for r in e.collect()}
    assert got == {1: (False, 1.0), 3: (True, 0.8), 4: (True, 0.8), 5: (True, 0.8), 6: (True, 0.8)}
    assert parse.parse_statistics(e).first()["malformed_lines"] == 4
    assert parse.parse(e.select("source_file", "line_number", "raw_line").filter("false"), d, NOW).count() == 0


def test_quality_and_comparison(spark):
    files = spark.createDataFrame([("a", 0.9, 0.5, 0.5, 0.8), ("b", 1.0, 1.0, 1.0, 1.0)], "source_file string, d double, s double, x double, c double")
    assert [round(r[0], 2) for r in files.select(stats.quality_score(*[F.col(k) for k in "dsxc"])).collect()] == [0.65, 1.0]
    rates = spark.createDataFrame([("a", "f", 1.0), ("b", "f", 0.5), ("a", "g", 1.0)], "source_file string, field string, rate double")
    r = stats.compare_files(rates).collect()
    assert [(x["field"], x["best_file"], x["worst_file"], x["variance"]) for x in r] == [("f", "a", "b", 0.125)]


def test_all_hints(spark):
    rows = ['{"a": "1", "at": "2021-03-03T05:06:07Z", "b": ""}'] * 6 + ["nonsense"] * 2
    other = lines(spark, ['{"a": "1", "at": "2021-03-03T05:06:07Z", "b": "x"}'] * 3, "fine")
    declared = Detection("json", 1.0, fields_of(a="integer", b="string", at="timestamp", c="string"))
    e = parse.parse(lines(spark, rows).unionByName(other), Detection("json", 1.0, fields_of(a="integer", b="string", at="timestamp")), NOW)
    files = stats.file_statistics(e, declared.names, 0.6).join(stats.file_details(e, declared), "source_file")
    got = {r["source_file"]: r["recommendations"] for r in stats.recommendations(files).collect()}
    first = "check the detected format"
    assert got == {"s": [first, "many lines fail to parse", "rarely extracted: c", "often empty: b", "one kind of error is frequent"], "fine": [first, "rarely extracted: c"]}
    assert stats.global_insights(files).first()["formats"] == {"json": 2}
    unsure = Detection("json", 1.0, tuple(Field(n, frequency=3, confidence=0.4) for n in ("a", "b")))
    files = stats.file_statistics(e, unsure.names, 1.0).join(stats.file_details(e, unsure), "source_file")
    assert {r["source_file"]: r["recommendations"] for r in stats.recommendations(files).collect()}["fine"] == ["no timestamp field", "most fields are uncertain"]


def test_broken_events_hints(spark, tmp_path):
    from logloom.registry import QUERIES

    rows = [(i, datetime(2024, 1, 1, 0, i % 60), i, "view", 1.5) for i in range(100)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["source_file"], r["hint"]) for r in QUERIES["recommendations"](spark, str(tmp_path)).collect()}
    more = {(s, h) for s in "37" for h in ("many lines fail to parse", "one kind of error is frequent")} | {("3", "rarely extracted: event_id, event_type, ts"), ("7", "rarely extracted: user_id, value")}
    assert got == {(str(k), "check the detected format") for k in range(10)} | more


def test_files_round_trip(spark, tmp_path):
    body = "\n".join(f'{{"n": "{i}", "at": "2024-05-06T07:08:0{i}Z"}}' for i in range(5)).encode() + b"\n\xff\n"
    for name, data in (("a.log", body), ("b.log.gz", gzip.compress(body)), ("c.log.bz2", bz2.compress(body)), ("d.log.xz", lzma.compress(body)), ("empty.log", b"")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "folder").mkdir()
    (tmp_path / "image.png").write_bytes(b"")
    s, paths = LogSession(spark, NOW), [str(tmp_path / n) for n in ("a.log", "b.log.gz", "c.log.bz2", "d.log.xz", "empty.log")]
    text = s.read(*paths)
    found = s.detect_files(*paths)
    assert sorted(d.format for d in found.values()) == ["json"] * 4 + ["unknown"] and set(s.detect(text)) == {f for f, d in found.items() if d.format == "json"}
    sizes = {r["source_file"].rsplit("/", 1)[1]: (r["file_size_bytes"], r["format"]) for r in s.sources(found, *paths).collect()}
    assert sizes["a.log"] == (len(body), "json") and sizes["empty.log"] == (0, "unknown")
    assert s.parse(text, found).groupBy("source_file").count().collect()[0]["count"] == 5
    assert s.report(s.parse(text, found), next(d for d in found.values() if d.fields)).count() >= 4
    listed = list_sources(spark, str(tmp_path)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["is_folder"]) for r in listed] == [("folder", True)] + [(p.rsplit("/", 1)[1], False) for p in paths]


def test_lines_of_any_packing_have_the_same_numbers(spark, tmp_path, monkeypatch):
    body = "a\n\nb\x0bc\x1cd\u2028e\r\nf\rg".encode()
    (tmp_path / "t.log").write_bytes(body)
    (tmp_path / "t.log.xz").write_bytes(lzma.compress(body))
    rows = lambda n: sorted((r["line_number"], r["raw_line"]) for r in read_lines(spark, str(tmp_path / n)).collect())
    assert rows("t.log") == rows("t.log.xz") == [(1, "a"), (2, ""), (3, "b\x0bc\x1cd\u2028e"), (4, "f"), (5, "g")]
    # a file of many splits, beside a small one
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(1, 20_001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        text = read_lines(spark, str(tmp_path / "big.log"), str(tmp_path / "t.log"))
        assert text.rdd.getNumPartitions() > 10
        assert text.filter("raw_line = concat('line ', line_number)").count() == 20_000 and text.count() == 20_005
        heads = read_heads(spark, str(tmp_path / "big.log"), str(tmp_path / "t.log"), most=50)
        assert heads.filter("raw_line = concat('line ', line_number)").count() == 50 and heads.count() == 55
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_index(spark, tmp_path):
    d = Detection("json", 1.0, fields_of(a="integer", at="timestamp"))
    e = parse.parse(lines(spark, [f'{{"a": "{i}", "at": "2024-05-0{9 - i}T00:00:00Z"}}' for i in range(1, 9)]), d, NOW)
    kept = LogSession(spark, NOW).index(e, str(tmp_path / "index"))
    assert kept.entries.dtypes == e.dtypes and kept.search(SearchQuery(filters=(SearchFilter("a", "gt", "3"),), time=TimeFilter(end=datetime(2024, 5, 4)))).total == 4
    plan = kept.search(SearchQuery(time=TimeFilter(end=datetime(2024, 5, 4)))).matches._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan


def test_stream(spark, tmp_path):
    from logloom.streaming.tail import tail

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"a": "1"}\n{"a": "2"}\n')
    stream = tail(spark, str(tmp_path / "in"), Detection("json", 1.0, fields_of(a="integer")), NOW)
    q = stream.writeStream.format("memory").queryName("tail_test").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tail_test").count() == 2
