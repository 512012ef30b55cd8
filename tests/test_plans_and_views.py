"""Sources, regular expressions, times, indexes and analyses: results by hand and what their plans read."""

import io
import lzma
import random
import re
import warnings
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.functions import regexes, timestamps
from logloom.model import Detection, Field, fields_of
from logloom.operators import detect, overview, parse, search, stats
from logloom.operators.search import QueryBuilder, SearchFilter, SearchQuery, TimeFilter
from logloom.plans.index import LogIndex
from logloom.plans.session import LogSession
from logloom.sources import lines as lines_module
from logloom.sources import xz
from logloom.sources.lines import path_of, read_lines

NOW = datetime(2026, 6, 1)


def lines(spark, rows, source="s"):
    return spark.createDataFrame([(source, i + 1, x) for i, x in enumerate(rows)], "source_file string, line_number bigint, raw_line string")


def leaves(df):
    """The scans of a plan with the files that each reads."""
    plan = df._jdf.queryExecution().sparkPlan()
    found = plan.collectLeaves()
    out = []
    for i in range(found.size()):
        leaf = found.apply(i)
        if "FileSourceScan" in leaf.getClass().getSimpleName():
            out.append(sorted(f.rsplit("/", 1)[1] for f in leaf.relation().location().inputFiles()))
    return out


# ---------------------------------------------------------------- regular expressions

_ATOMS = ["a", "b", "A", "é", "É", "1", "_", " ", r"\n", ".", r"\d", r"\w", r"\s", r"\D", r"\W", r"\S", "[ab]", "[^a]", r"[\w.]", r"[^\W1]", r"[\Wa]", r"[^\s\d]", "[[]", "[^[]", "[[a]", "[&&]", "[a&&b]", "[a-b&&a]", r"[\]\-]", "^", "$", r"\b", r"\B", r"\A", r"\Z", r"\\Z", r"\.", r"\x41", "ß", "#"]


def _pattern(depth, groups):
    r = random.random()
    if depth == 0 or r < 0.35:
        return random.choice(_ATOMS)
    more = lambda: _pattern(depth - 1, groups)
    if r < 0.5:
        return "".join(more() for _ in range(random.randint(1, 3)))
    if r < 0.6:
        return f"(?:{more()}|{more()})"
    if r < 0.7:
        inner = more()
        groups[0] += 1
        return random.choice([f"({inner})", f"(?P<n{groups[0]}>{inner})"])
    if r < 0.82:
        return f"(?:{more()})" + random.choice(["*", "+", "?", "{1,2}", "*?", "+?", "{2}", "?+", "*+"])
    if r < 0.88 and groups[0]:
        k = random.randint(1, groups[0])
        return random.choice([f"\\{k}", f"(?({k}){more()}|{more()})"])
    if r < 0.93:
        return random.choice(["(?={})", "(?!{})", "(?<=a){}", "(?<![b1]){}", "(?>{})"]).format(more())
    return random.choice(["(?i:{})", "(?s:{})", "(?m:{})", "(?-i:{})", "(?im-s:{})"]).format(more())


def test_java_finds_what_python_finds(spark):
    random.seed(11)
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    texts = ["", "a", "b", "ab", "aB\n", "é1 _", "\n", "a\nb", "ABÉ é", "1a_ [&]", "a.b#ß", "٠a ", "A\\Z", "-]", "a\r\nb", "x a"]
    tried = 0
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for _ in range(700):
            groups = [0]
            pattern = random.choice(["", "", "(?i)", "(?m)", "(?s)", "(?a)", "(?x)"]) + "".join(_pattern(3, groups) for _ in range(random.randint(1, 2)))
            fold = random.random() < 0.3
            try:
                want = re.compile(pattern, re.I if fold else 0)
            except re.error:
                continue
            regex = regexes.java_regex(pattern, fold)
            if regex is None:  # Python decides, over Arrow
                continue
            tried += 1
            got = java.compile(regex)
            for t in random.sample(texts, 6):
                assert got.matcher(t).find() == (want.search(t) is not None), (pattern, fold, t, regex)
    assert tried > 400


@pytest.mark.parametrize("pattern", ["[[]", "[^[]", "[[a]", "[&&]", "(a)(?(1)b|c)", "(?P<a>x)?(?(a)y|z)", "(?a)x", r"\\Z", "[a&&b]", r"(?:a|)*b", r"(a)+\1", r"(?P<q>['\"]).*(?P=q)", "a{1,2}+b"])
def test_patterns_that_one_dialect_reads_otherwise(spark, pattern):
    texts = ["[", "&", "a", "b", "ab", "xy", "z", "x", "\\Z", "Z", "aab", "say 'it'", ""]
    e = spark.createDataFrame([("s", i, t, {"m": t}, None, None) for i, t in enumerate(texts)], "source_file string, line_number bigint, raw_line string, fields map<string,string>, ts timestamp_ntz, ts_offset_min int")
    for exact in (True, False):
        found = search.search(e, SearchQuery(filters=(SearchFilter("m", "regex", pattern, exact),)), NOW).page
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            want = [i for i, t in enumerate(texts) if re.search(pattern, t, 0 if exact else re.I)]
        assert [r["line_number"] for r in found.collect()] == want


# ---------------------------------------------------------------- times


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-05 25:00:00", [("iso_date", datetime(2024, 1, 5))]), ("2024-01-05 23:59:60", [("iso_date", datetime(2024, 1, 5))]), ("2024-13-45 10:11:12", [("time_only", datetime(2026, 6, 1, 10, 11, 12))]),
        ("Feb 30 10:00:00", [("time_only", datetime(2026, 6, 1, 10))]), ("[05/Jan/2024:10:00:00 +9999]", [("apache_common_no_tz", datetime(2024, 1, 5, 10))]), ("2024-01-05T10:00:00+0170", [("iso8601_naive", datetime(2024, 1, 5, 10))]),
        ("2024-13-45 25:00:00", []), ("32/Jan/2024:10:00:00 +0000 2024-05-06T07:08:09Z", [("iso8601_utc", datetime(2024, 5, 6, 7, 8, 9)), ("time_only", datetime(2026, 6, 1, 10))]),
    ],
)
def test_a_failed_reading_leaves_its_span_free(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(timestamps.detect_timestamps(F.col("t"), NOW).alias("x"), timestamps.read_timestamp(F.col("t"), NOW, ("standard_datetime",)).alias("k")).first()
    assert [(x["format"], x["ts"]) for x in r["x"]] == want
    assert (r["k"] and (r["k"]["format"], r["k"]["ts"])) == (want[0] if want else None)


def test_time_of_the_first_field_that_has_one(spark):
    rows = ['{"n": 1700000000, "later": "2024-05-06T07:08:09Z", "day": "2024-01-02"}', '{"n": 1, "day": "none", "later": "2024-05-06T07:08:09Z"}', '{"n": 1700000000}', '{"day": ""}']
    declared = Detection("json", 1.0, fields_of(n="integer", day="string", later="string"))
    got = [r["ts"] for r in parse.parse(lines(spark, rows), declared, NOW).orderBy("line_number").collect()]
    assert got == [datetime(2024, 1, 2), datetime(2024, 5, 6, 7, 8, 9), None, None]
    pipes = Detection("custom_delimited", 1.0, fields_of(a="string", b="integer"), metadata={"delimiter": "|"})
    assert parse.parse(lines(spark, ["x|1700000000"]), pipes, NOW).first()["ts"] == datetime(2023, 11, 14, 22, 13, 20)
    free = Detection("json", 1.0)
    assert parse.parse(lines(spark, ['{"b": "2024-01-02", "a": "2024-05-06T07:08:09Z"}']), free, NOW).first()["ts"] == datetime(2024, 1, 2)


def test_header_only_on_the_first_line(spark):
    d = Detection("csv", 1.0, fields_of(a="string", b="string"), metadata={"delimiter": ",", "header": "a,b"})
    got = [(r["line_number"], r["fields"]["a"]) for r in parse.parse(lines(spark, ["a,b", "1,2", "a,b"]), d, NOW).orderBy("line_number").collect()]
    assert got == [(2, "1"), (3, "a")] and parse.parse_line(spark, "a,b", d, NOW).count() == 1


# ---------------------------------------------------------------- files of several formats


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a [1] b.log").write_text("".join(f'{{"n": "{i}", "at": "2024-05-06T07:08:0{i}Z"}}\n' for i in range(5)))
    (tmp_path / "k.log").write_text("".join(f'user="u{i}" code="{i}"\n' for i in range(4)))
    (tmp_path / "c.csv").write_text("plant;height;bed\n" + "".join(f"p{i};{i};North\n" for i in range(6)))
    (tmp_path / "w.log").write_text('10.0.0.1 - - [27/Jul/2023:14:30:00 +0000] "GET / HTTP/1.1" 200 5\n' * 3)
    (tmp_path / "j.log").write_text("_PID=1\nMESSAGE=x\n\n_PID=2\nMESSAGE=y\n")
    (tmp_path / "u.log").write_text("just words\nof prose\n")
    return tmp_path


def test_one_scan_for_all_formats(spark, folder):
    s = LogSession(spark, NOW)
    paths = [str(folder / n).replace("[", "\\[").replace("]", "\\]") for n in ("a [1] b.log", "k.log", "c.csv", "w.log", "j.log", "u.log")]
    found = s.detect_files(*paths)
    formats = {k.rsplit("/", 1)[1].replace("%20", " ").replace("%5B", "[").replace("%5D", "]"): d.format for k, d in found.items()}
    assert {k: v for k, v in formats.items() if v != "unknown"} == {"a [1] b.log": "json", "k.log": "key_value", "c.csv": "csv", "w.log": "apache_common", "j.log": "systemd_journal"}
    entries = s.parse_files(found)
    counts = {path_of(r["source_file"]).rsplit("/", 1)[1].replace("\\", ""): r["count"] for r in entries.groupBy("source_file").count().collect()}
    assert counts == {"a [1] b.log": 5, "k.log": 4, "c.csv": 6, "w.log": 3, "j.log": 2}
    scans = leaves(entries)
    read = [f for scan in scans for f in scan]
    assert len(scans) == 4 and not any("u.log" in f for f in read)  # two of all line formats, two of journals
    for name in ("k.log", "c.csv", "w.log", "j.log"):
        assert read.count(name) == 2
    # the same from lines that are read already
    assert s.parse(s.read(*paths), found).groupBy("source_file").count().count() == 5


def test_sources_take_their_own_parser(spark):
    text = lines(spark, ['{"a": "1"}', "a=2 b=3"], "j").unionByName(lines(spark, ["a=4 b=5", '{"a": "6"}'], "k")).unionByName(lines(spark, ["a=7"], "none"))
    plans = [(Detection("json", 1.0, fields_of(a="string")), ["j"]), (Detection("key_value", 1.0, fields_of(a="string", b="string")), ["k"])]
    got = {(r["source_file"], r["line_number"]): (r["fields"].get("a"), r["is_malformed"]) for r in parse.parse_sources(text, plans, NOW).collect()}
    assert got == {("j", 1): ("1", False), ("j", 2): (None, True), ("k", 1): ("4", False), ("k", 2): (None, True)}
    assert parse.parse_sources(text, [], NOW).count() == 0


# ---------------------------------------------------------------- indexes


def test_index_skips_row_groups(spark, tmp_path):
    d = Detection("json", 1.0, fields_of(level="string", n="integer", at="timestamp"))
    rows = [f'{{"level": "{"Error" if i == 1234 else f"l{i}"}", "n": "{i}", "at": "2024-05-{1 + i // 100:02d}T{i % 24:02d}:00:00Z"}}' for i in range(2000)] + ['{"level": "none", "n": "1"}']
    e = parse.parse(lines(spark, rows), d, NOW)
    path = str(tmp_path / "index")
    LogSession(spark, NOW).index(e, path, exact=("level",), partitions=8)
    index = LogIndex(spark.newSession(), path, NOW)  # opened by its path in another session
    assert index.entries.count() == 2001 and index.entries.dtypes == e.dtypes and list(index.exact) == ["level"]

    def read(query):
        found = index.search(query).matches
        rows = found.collect()
        plan = found._jdf.queryExecution().executedPlan()
        leaf = (plan.executedPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan).collectLeaves().apply(0)
        return len(rows), leaf.metrics().apply("numOutputRows").value(), plan.toString()

    n, scanned, plan = read(SearchQuery(time=TimeFilter(datetime(2024, 5, 7), datetime(2024, 5, 7, 23))))
    assert n == 100 and scanned < 1000 and re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(_utc", plan)
    n, scanned, plan = read(SearchQuery(filters=(SearchFilter("level", "equals", "ERROR"),)))
    assert n == 1 and scanned <= 500 and "EqualTo(_exact_0,error)" in plan
    n, scanned, _ = read(SearchQuery(filters=(SearchFilter("level", "equals", "nowhere"),)))
    assert (n, scanned) == (0, 0)
    for q in (SearchQuery("l77"), SearchQuery(filters=(SearchFilter("level", "equals", "Error", True),)), SearchQuery(filters=(SearchFilter("n", "gt", "1990"),), time=TimeFilter(end=datetime(2025, 1, 1))), SearchQuery(time=TimeFilter(last_hours=1))):
        assert index.search(q).total == search.search(e, q, NOW).total


def test_index_takes_offsets_off(spark, tmp_path):
    d = Detection("json", 1.0, fields_of(at="timestamp"))
    e = parse.parse(lines(spark, ['{"at": "2024-05-06T01:00:00+0200"}', '{"at": "2024-05-06T01:00:00-0200"}', '{"at": "x"}']), d, NOW)
    index = LogIndex.build(e, str(tmp_path / "i"), now=NOW)
    query = QueryBuilder.time_range(datetime(2024, 5, 6), datetime(2024, 5, 7))
    assert [r["line_number"] for r in index.search(query).page.collect()] == [2] and index.search(SearchQuery()).total == 3


# ---------------------------------------------------------------- formats of callers


def test_own_formats_round_trip(spark):
    detect.register_format("notes", ((r"lvl=((\w)\w*) msg=(.*)", ("level", None, "msg")),))
    parts = lambda line: F.split(line, " -> ")
    detect.register_format("arrows", threshold=0.9, detector=lambda line: F.contains(line, F.lit(" -> ")), parser=lambda line, d: F.when(F.size(parts(line)) == 2, F.create_map(F.lit("from"), F.get(parts(line), F.lit(0)), F.lit("to"), F.get(parts(line), F.lit(1)))))
    try:
        text = lines(spark, ["x 1 lvl=a msg=b c", "2024 lvl=low msg=d", "lvl=e msg=f"], "n").unionByName(lines(spark, ["1 -> b", "2 -> d", "3 -> e"], "w"))
        found = detect.detect(text, NOW)
        assert {s: (d.format, d.names) for s, d in found.items()} == {"n": ("notes", ("level", "msg")), "w": ("arrows", ("from", "to"))}
        got = {(r["source_file"], r["line_number"]): dict(r["fields"]) for r in LogSession(spark, NOW).parse(text, found).collect()}
        assert got[("n", 1)] == {"level": "a", "msg": "b c"} and got[("n", 2)] == {"level": "low", "msg": "d"} and got[("w", 3)] == {"from": "3", "to": "e"}
        assert parse.parse_line(spark, "no arrow", found["w"], NOW).first()["is_malformed"]
        with pytest.raises(ValueError):
            detect.register_format("nothing")
        with pytest.raises(ValueError):
            detect.register_format("json", (("x", ("a",)),))
    finally:
        detect.unregister_format("notes")
        detect.unregister_format("arrows")


@pytest.mark.parametrize(
    "rows, name, own",
    [
        (['10.0.0.1 [2024-05-06 07:08:09] "GET /a" 200', '10.0.0.2 [2024-05-06 07:08:10] "GET /b" 404'] * 3, "basic_log", {"remote_addr": "10.0.0.1", "request": "GET /a", "status": "200"}),
        (["2024-05-06 07:08:09 INFO begun well", "2024-05-06 07:08:10 WARN slow disk"] * 3, "basic_log", {"level": "INFO", "message": "begun well"}),
    ],
)
def test_general_formats(spark, rows, name, own):
    found = detect.detect(lines(spark, rows), NOW)["s"]
    first = parse.parse(lines(spark, rows), found, NOW).orderBy("line_number").first()
    assert found.format == name and {k: first["fields"].get(k) for k in own} == own and first["ts"] == datetime(2024, 5, 6, 7, 8, 9)


def test_catalog_and_json_lines(spark):
    rows = {r["detector"]: (r["format"], r["threshold"]) for r in LogSession(spark, NOW).formats().collect()}
    assert rows["generic_web"] == ("basic_log", 0.6) and rows["json"] == ("json", 0.8) and len(rows) == 15
    assert detect.detect(lines(spark, ["12 -> b", "13 words", "14, 15"]))["s"].format != "json"


# ---------------------------------------------------------------- analyses


def test_analysis_of_one_pass(spark, tmp_path):
    rows = ['{"a": "1", "b": "x", "at": "2024-05-06T07:08:09Z"}', '{"a": "1", "b": "", "at": "2024-05-06T07:30:00Z"}', '{"a": "2", "at": "2024-05-07T01:00:00Z"}', "nonsense"]
    d = Detection("json", 0.9, (Field("a", "integer", confidence=0.9, frequency=3), Field("b", confidence=0.4, frequency=2), Field("at", is_timestamp=True)))
    (tmp_path / "one.log").write_text("\n".join(rows))
    (tmp_path / "two.log").write_text(rows[0] + "\n")
    s = LogSession(spark, NOW)
    text = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_name").alias("source_file"), (F.monotonically_increasing_id() + 1).alias("line_number"), F.col("value").alias("raw_line"))
    entries = parse.parse(text, d, NOW)
    for one in (s.report(entries, d), stats.recommendations(overview.files(overview.overview(entries), d)), overview.profile(overview.overview(entries)), overview.rate_bars(overview.overview(entries), d)):
        assert len(leaves(one)) == 1
    a = s.analyze(entries, d)
    fields = {r["field"]: r for r in a["fields"].collect()}
    assert (fields["a"]["present"], fields["a"]["extraction_rate"], [tuple(x) for x in fields["a"]["top_values"]]) == (4, 0.8, [("1", 3), ("2", 1)])
    assert (fields["b"]["present"], fields["b"]["null_rate"], fields["b"]["distinct_values"], fields["b"]["data_type"]) == (3, 0.2, 2, "string")
    files = {r["source_file"]: r for r in a["files"].collect()}
    assert (files["one.log"]["total_lines"], files["one.log"]["success_rate"], files["one.log"]["errors"]) == (4, 0.5, {"format_mismatch": 1, "field_extraction": 1})
    old = {r["source_file"]: r for r in stats.file_statistics(entries, d.names, d.confidence).join(stats.file_details(entries, d), "source_file").collect()}
    for name, r in files.items():
        for c in ("total_lines", "success_rate", "mean_extraction", "mean_confidence", "quality", "top_error_share", "poor_fields", "null_fields", "n_fields", "n_high_fields", "n_low_fields"):
            assert r[c] == (pytest.approx(old[name][c]) if isinstance(r[c], float) else old[name][c]), (name, c)
    t = a["time"].first()
    assert (t["n"], t["first_ts"], t["peak_hour"], t["peak_day"], t["n_hours"], t["n_days"]) == (4, datetime(2024, 5, 6, 7, 8, 9), 7, "2024-05-06", 2, 2)
    assert {(r["name"], r["n"]) for r in a["hours"].collect()} == {(7, 3), (1, 1)} and {(r["name"], r["n"]) for r in a["days"].collect()} == {("2024-05-06", 3), ("2024-05-07", 1)}
    assert [(r["field"], r["bar"].count("#")) for r in a["rate_bars"].orderBy("place").collect()] == [("a", 30), ("b", 22), ("at", 30)]
    assert {(r["source_file"], r["gauge"]): r["bar"].count("#") for r in a["gauges"].collect()}[("one.log", "success")] == 15
    assert [tuple(r) for r in overview.problem_files(a["files"], 0.9).collect()][0][2] == ["many lines fail to parse", "one kind of error is frequent"]
    report = {(r["section"], r["label"]): r["value"] for r in a["report"].collect()}
    assert report[("format", "format")] == "json" and report[("parsing", "success")] == "60.0 %" and report[("rate", "b")] == "60.0 %, empty 20.0 %" and report[("top values", "a")] == "1(3), 2(1)" and report[("time", "peak hour")] == "07" and report[("file", "two.log")].startswith("1 lines")
    a["overview"].unpersist()
    none = s.analyze(entries.filter("false"), d)
    assert all(df.count() == 0 for k, df in none.items() if k not in ("fields",)) and none["fields"].count() == 3


# ---------------------------------------------------------------- xz by blocks


def blocked_xz(data, cuts, check=lzma.CHECK_CRC64):
    """A single xz stream with a block for each part of the data, put together from streams of one block."""

    def number(x):
        out = b""
        while x >= 0x80:
            out, x = out + bytes([x & 0x7F | 0x80]), x >> 7
        return out + bytes([x])

    body, index, n = b"", b"", 0
    for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True):
        one = lzma.compress(data[a:b], check=check)
        size = 4 * (int.from_bytes(one[-8:-4], "little") + 1)
        header, block = one[:12], one[12 : len(one) - 12 - size]
        found = xz.blocks(io.BytesIO(one))
        assert len(found) == (b > a)
        if b > a:
            record = one[len(one) - 12 - size :][2:]
            packed, at = xz._number(record, 0)
            body, index, n = body + block, index + number(packed) + number(b - a), n + 1
    index = b"\0" + number(n) + index
    index += b"\0" * (-len(index) % 4)
    index += zlib.crc32(index).to_bytes(4, "little")
    foot = (len(index) // 4 - 1).to_bytes(4, "little") + header[6:8]
    return header + body + index + zlib.crc32(foot).to_bytes(4, "little") + foot + b"YZ"


@pytest.mark.parametrize("seed", range(4))
def test_lines_of_blocks(seed, tmp_path):
    random.seed(seed)
    data = b"".join(random.choice([b"a", b"long line", b"", b"\xc3\xa9", b"x\x0by\x1cz"]) + random.choice([b"\n", b"\r\n", b"\r", b"\n\n"]) for _ in range(200)) + random.choice([b"", b"tail"])
    cuts = sorted(random.sample(range(1, len(data)), 12))
    packed = blocked_xz(data, cuts)
    assert lzma.decompress(packed) == data
    two = packed + b"\0" * 8 + lzma.compress(data) + lzma.compress(b"")  # streams behind one another, with padding
    for name, content, whole in (("one.xz", packed, data), ("two.xz", two, data + data)):
        path = tmp_path / name
        path.write_bytes(content)
        with open(path, "rb") as f:
            found = xz.blocks(f)
        for least in (1, 50, 10**9):
            got = [x for a, b in xz.ranges(found, least) for x in xz.lines(str(path), a, b)]
            want = io.TextIOWrapper(io.BytesIO(whole), encoding="latin-1", newline=None).read().split("\n")
            assert [x.decode("latin-1") for x in got] == (want[:-1] if want[-1] == "" else want)
    with pytest.raises(lzma.LZMAError):
        xz.blocks(io.BytesIO(b"no such file at all, by far"))


def test_a_file_of_blocks_is_many_tasks_work(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(xz, "RANGE_BYTES", 1)
    monkeypatch.setattr(xz.ranges, "__defaults__", (1,))
    data = "".join(f"line {i}\n" for i in range(1, 3001)).encode()
    (tmp_path / "b.log.xz").write_bytes(blocked_xz(data, list(range(2000, len(data), 2000))))
    (tmp_path / "e.log.xz").write_bytes(lzma.compress(b""))
    (tmp_path / "p.log").write_text("line 1\nline 2\n")
    text = read_lines(spark, *[str(tmp_path / n) for n in ("b.log.xz", "e.log.xz", "p.log")])
    assert text.filter("raw_line = concat('line ', line_number)").count() == 3002 == text.count()
    of_file = lines_module._packed_text(spark, [str(tmp_path / "b.log.xz")])
    assert len(lines_module._blocked(spark, [str(tmp_path / "b.log.xz")])[0]) > 10 and of_file.select(F.spark_partition_id()).distinct().count() > 5
