"""Line grammars: regular expressions in Java's dialect with the names of their groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = "DEBUG|INFO|WARNING|WARN|ERROR|CRITICAL|FATAL|TRACE|NOTICE"
_STAMP = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}"
_HOST, _REST = r"(\S+)", r"(.*)"
_QUOTED, _NUMBER, _COUNT = r'"([^"]*)"', r"(\d+)", r"(\d+|-)"
_COMMON = rf"{_HOST} {_HOST} {_HOST} \[([^\]]+)\] {_QUOTED} (\d{{3}}|-) {_COUNT}"
# fixed values: the names of fields
_COMMON_NAMES = ("remote_host", "remote_logname", "remote_user", "timestamp", "request", "status", "bytes_sent")
_VIRTUAL_NAMES = (*_COMMON_NAMES[:3], "virtual_host", *_COMMON_NAMES[3:])
_NGINX_NAMES = ("remote_addr", "remote_logname", "remote_user", "time_local", "request", "status", "bytes_sent", "http_referer", "http_user_agent")
_ERROR = r"(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[(\w+)\] "

#: Stands between groups while they are one text.
_MARK = "\x01"

Pattern = tuple[str, tuple[str | None, ...]]
#: The most specific pattern comes first, so that no field is lost to a shorter one.
PATTERNS: dict[str, tuple[Pattern, ...]] = {
    "python_log": (
        (rf"^({_STAMP},\d{{3}}) \[(\w+)\] (\S+) - {_REST}$", ("timestamp", "level", "logger", "message")),
        (rf"^({_STAMP}[,.]\d{{3}}) - (\S+) - (\w+) - {_REST}$", ("timestamp", "logger", "level", "message")),
        (rf"^({_STAMP},\d{{3}}) ({LEVELS}) (\S+) {_REST}$", ("timestamp", "level", "logger", "message")),
        (rf"^\[([^\]]+)\] ({LEVELS}) in ([^:]+): {_REST}$", ("timestamp", "level", "logger", "message")),
        (rf"^([^:]*\d{{2}}:\d{{2}}:\d{{2}}[^:]*?) ({LEVELS}) (\S+?): {_REST}$", ("timestamp", "level", "logger", "message")),
        (rf"^({LEVELS}):([^:]+):{_REST}$", ("level", "logger", "message")),
    ),
    "basic_log": (
        (rf"^({_STAMP}(?:\.\d+)?) \[(\w+)\] (\S+) - {_REST}$", ("timestamp", "level", "module", "message")),
        (rf"^({_STAMP}(?:\.\d+)?) ({LEVELS}) (\S+?): {_REST}$", ("timestamp", "level", "module", "message")),
        (rf"^(\D*[\d/-]*[ T]?\d{{2}}:\d{{2}}:\d{{2}}\S*) ({LEVELS}) {_REST}$", ("timestamp", "level", "message")),
        (rf"^(\D*[\d/-]*[ T]?\d{{2}}:\d{{2}}:\d{{2}}\S*) {_REST}$", ("timestamp", "message")),
        (rf"^({LEVELS}): {_REST}$", ("level", "message")),
    ),
    "syslog": (
        (rf"^<(\d{{1,3}})>(\w{{3}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}) (\S+) ([^:\s]+): ?{_REST}$", ("priority", "timestamp", "hostname", "tag", "message")),
        (rf"^<(\d{{1,3}})>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\]]*\])+) ?{_REST}$", ("priority", "version", "timestamp", "hostname", "app_name", "procid", "msgid", "structured_data", "message")),
        (rf"^(\w{{3}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}) (\S+) {_REST}$", ("timestamp", "hostname", "message")),
    ),
    "apache_common": ((rf"^{_COMMON}", _COMMON_NAMES),),
    "apache_combined": ((rf"^{_COMMON} {_QUOTED} {_QUOTED}", (*_COMMON_NAMES, "referer", "user_agent")), (rf"^{_COMMON}", _COMMON_NAMES)),
    "apache_extended": (
        (rf"^{_HOST} {_HOST} {_HOST} {_HOST} \[([^\]]+)\] {_QUOTED} (\d{{3}}|-) {_COUNT} {_QUOTED} {_QUOTED}", (*_VIRTUAL_NAMES, "referer", "user_agent")),
        (rf"^{_HOST} {_HOST} {_HOST} {_HOST} \[([^\]]+)\] {_QUOTED} (\d{{3}}|-) {_COUNT}", _VIRTUAL_NAMES),
        (rf"^{_COMMON} {_QUOTED} {_QUOTED} (\d+(?:\.\d+)?)", (*_COMMON_NAMES, "referer", "user_agent", "response_time")),
        (rf"^{_COMMON} (\d+(?:\.\d+)?|-)", (*_COMMON_NAMES, "response_time")),
        (rf"^\[(\w{{3}} \w{{3}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}} \d{{4}})\] \[(\w+)\] {_REST}$", ("timestamp", "level", "message")),
    ),
    "nginx_access": (
        (rf"^{_COMMON} {_QUOTED} {_QUOTED} (\d+(?:\.\d+)?)", (*_NGINX_NAMES, "request_time")),
        (rf"^{_COMMON} {_QUOTED} {_QUOTED}", _NGINX_NAMES),
        (rf"^{_HOST} - - \[([^\]]+)\] {_QUOTED} (\d{{3}}|-) {_COUNT}", ("remote_addr", "time_local", "request", "status", "bytes_sent")),
    ),
    "nginx_error": (
        (rf"^{_ERROR}(\d+)#(\d+): \*(\d+) {_REST}$", ("timestamp", "level", "pid", "tid", "connection", "message")),
        (rf"^{_ERROR}(\d+)#(\d+): {_REST}$", ("timestamp", "level", "pid", "tid", "message")),
        (rf"^{_ERROR}{_REST}$", ("timestamp", "level", "message")),
    ),
    "generic_web": (
        (rf"^{_HOST} - - \[([^\]]+)\] {_QUOTED} (\d{{3}}) {_COUNT}", ("remote_addr", "timestamp", "request", "status", "bytes_sent")),
        (rf"^{_HOST} \[([^\]]+)\] {_QUOTED}(?: (\d{{3}}))?", ("remote_addr", "timestamp", "request", "status")),
        (rf"^\[([^\]]+)\] {_HOST} {_QUOTED}(?: (\d{{3}}))?", ("timestamp", "remote_addr", "request", "status")),
    ),
    "journal_short": ((rf"^(\w{{3}} +\d{{1,2}} \d{{2}}:\d{{2}}:\d{{2}}) +(\S+) +([^:]+): *{_REST}$", ("timestamp", "hostname", "service", "message")),),
}
# fixed values: the types of fields by name
TYPES = {"status": "integer", "bytes_sent": "integer", "pid": "integer", "tid": "integer", "response_size": "integer", "request_time": "float", "response_time": "float", "priority": "integer", "version": "integer"}


def anchored(regex: str) -> str:
    """The pattern over a whole line, so that what stands before and behind its match is in no group."""
    front = "" if regex.startswith(("^", "\\A")) else "^.*?"
    return f"(?s){front}(?:{regex})" + ("" if regex.endswith(("$", "\\z")) else ".*$")


def groups(line: Column, pattern: Pattern) -> Column:
    """A map of the pattern's named groups, in order of their opening brackets; a null name leaves its group out.

    The expression runs once for all of them, but for lines that hold the mark between groups.
    """
    regex, names = pattern
    named = [(i + 1, n) for i, n in enumerate(names) if n is not None]
    joined = F.regexp_replace(line, anchored(regex), _MARK.join(f"${i}" for i, _ in named))
    each = F.array(*[F.regexp_extract(line, f"(?s){regex}", i) for i, _ in named])
    parts = F.when(F.contains(line, F.lit(_MARK)), each).otherwise(F.split(joined, _MARK, -1))
    return F.map_from_arrays(F.array(*[F.lit(n) for _, n in named]), parts)


def first_match(line: Column, patterns: tuple[Pattern, ...]) -> Column:
    """The groups of the first pattern that the line has, null if it has none."""
    out = F.lit(None)
    for p in reversed(patterns):
        out = F.when(line.rlike(p[0]), groups(line, p)).otherwise(out)
    return out


def pairs(line: Column, kind: str) -> Column:
    """``key=value`` pairs (values may be quoted or follow a colon), or LTSV's ``key:value`` by tabs, as a map; of equal keys the last counts."""
    if kind == "ltsv":
        parts = F.filter(F.split(line, "\t"), lambda x: F.instr(x, ":") > 1)
        keyed = F.transform(parts, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, "(?s)^[^:]*:", "").alias("v")))
    else:
        regex = r"""([A-Za-z_][\w.-]*) ?(?:=|:) ?("[^"]*"|'[^']*'|[^\s,;]+)"""
        keys, values = (F.regexp_extract_all(line, F.lit(regex), F.lit(i)) for i in (1, 2))
        keyed = F.transform(keys, lambda k, i: F.struct(k.alias("k"), F.regexp_replace(F.get(values, i), r"""^["']|["']$""", "").alias("v")))
    return last_of_keys(keyed)


def last_of_keys(keyed: Column) -> Column:
    """A map from an array of structs (``k``, ``v``); of equal keys the last counts."""

    def once(xs: Column) -> Column:  # the array is worked out once, under the name of an element
        keys = F.transform(xs, lambda x: x["k"])
        last = F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, i + 2, F.size(xs)), lambda y: y["k"] == x["k"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(xs), xs).otherwise(last))

    return F.get(F.transform(F.array(keyed), once), F.lit(0))
