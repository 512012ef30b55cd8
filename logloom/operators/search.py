"""Searches: a query compiles to one predicate over entries; paging and facets follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.regexes import matches

ORDER = ("source_file", "line_number")


@dataclass(frozen=True)
class SearchFilter:
    """``operator``: contains, equals, regex, gt, lt, gte or lte; any other one matches nothing."""

    field: str
    operator: str
    value: str
    case_sensitive: bool = False


@dataclass(frozen=True)
class TimeFilter:
    """Bounds are inclusive; hours beat minutes, and either beats the absolute bounds."""

    start: datetime | None = None
    end: datetime | None = None
    last_hours: float | None = None
    last_minutes: float | None = None


@dataclass(frozen=True)
class SearchQuery:
    text: str | None = None
    filters: tuple[SearchFilter, ...] = ()
    time: TimeFilter | None = None
    limit: int | None = None
    offset: int = 0

    @staticmethod
    def from_form(form: dict[str, str]) -> SearchQuery:
        """From text inputs; blank ones are ignored, an absolute time beats hours, hours beat minutes."""
        get = lambda k: (form.get(k) or "").strip()
        at = lambda k: datetime.strptime(get(k), "%Y-%m-%d %H:%M:%S") if get(k) else None
        filters = (SearchFilter(get("field"), get("operator") or "contains", get("value")),) if get("field") and get("value") else ()
        if get("start") or get("end"):
            time = TimeFilter(at("start"), at("end"))
        elif get("last_hours"):
            time = TimeFilter(last_hours=int(get("last_hours")))
        else:
            time = TimeFilter(last_minutes=int(get("last_minutes"))) if get("last_minutes") else None
        return SearchQuery(get("text") or None, filters, time, int(get("limit") or 100), int(get("offset") or 0))


class QueryBuilder:
    @staticmethod
    def simple_text(text: str, **page) -> SearchQuery:
        return SearchQuery(text=text, **page)

    @staticmethod
    def field_equals(name: str, value: str, **page) -> SearchQuery:
        return SearchQuery(filters=(SearchFilter(name, "equals", value),), **page)

    @staticmethod
    def field_contains(name: str, value: str, **page) -> SearchQuery:
        return SearchQuery(filters=(SearchFilter(name, "contains", value),), **page)

    @staticmethod
    def regex_search(name: str, pattern: str, **page) -> SearchQuery:
        return SearchQuery(filters=(SearchFilter(name, "regex", pattern),), **page)

    @staticmethod
    def time_range(start: datetime | None, end: datetime | None, **page) -> SearchQuery:
        return SearchQuery(time=TimeFilter(start, end), **page)

    @staticmethod
    def last_hours(hours: float, **page) -> SearchQuery:
        return SearchQuery(time=TimeFilter(last_hours=hours), **page)

    @staticmethod
    def combined(text: str | None = None, filters: tuple[SearchFilter, ...] = (), time: TimeFilter | None = None, **page) -> SearchQuery:
        return SearchQuery(text, filters, time, **page)


def text_condition(text: str) -> Column:
    """The text occurs in the line or in a field, whatever its case."""
    t = F.lit(text.lower())
    return F.contains(F.lower("raw_line"), t) | F.exists(F.map_values("fields"), lambda v: F.contains(F.lower(v), t))


def filter_condition(f: SearchFilter) -> Column:
    value = F.col("fields")[f.field]
    fold = (lambda c: c) if f.case_sensitive else F.lower
    wanted = F.lit(f.value if f.case_sensitive else f.value.lower())
    if f.operator == "contains":
        test = F.contains(fold(value), wanted)
    elif f.operator == "equals":
        test = fold(value) == wanted
    elif f.operator == "regex":
        test = matches(value, f.value, not f.case_sensitive)
    elif f.operator in ("gt", "lt", "gte", "lte"):
        try:
            bound = float(f.value)
        except ValueError:
            return F.lit(False)
        x = F.when(value.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(value).try_cast("double"))
        test = {"gt": x > bound, "lt": x < bound, "gte": x >= bound, "lte": x <= bound}[f.operator]
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def bounds(t: TimeFilter, now: datetime) -> tuple[datetime | None, datetime | None]:
    if t.last_hours:
        return now - timedelta(hours=t.last_hours), now
    if t.last_minutes:
        return now - timedelta(minutes=t.last_minutes), now
    return t.start, t.end


def time_condition(t: TimeFilter, now: datetime) -> Column:
    """Offsets are taken off before comparing; entries without a time only pass if there are no bounds."""
    start, end = bounds(t, now)
    at = F.col("ts") - F.make_dt_interval(mins=F.coalesce("ts_offset_min", F.lit(0)))
    out = F.lit(True)
    if start is not None:
        out = out & (at >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out & (at <= F.lit(end).cast("timestamp_ntz"))
    return out if start is None and end is None else F.coalesce(out, F.lit(False))


def condition(query: SearchQuery, now: datetime) -> Column:
    out = F.lit(True)
    if query.text:
        out = out & text_condition(query.text)
    for f in query.filters:
        out = out & filter_condition(f)
    if query.time:
        out = out & time_condition(query.time, now)
    return out


@dataclass
class SearchResult:
    """``matches``: all of them; ``page``: in order of place; both lazy."""

    matches: DataFrame
    page: DataFrame
    query: SearchQuery = field(default_factory=SearchQuery)

    @property
    def total(self) -> int:
        return self.matches.count()

    def facets(self, scope: str = "page", most: int = 10) -> DataFrame:
        return facets(self.page if scope == "page" else self.matches, most)


def held(entries: DataFrame, *names: str) -> DataFrame:
    """The entries with some columns worked out once, so that a filter on them doesn't parse lines again.

    Without this step filters move below the parser and take a copy of it for each mention.
    """
    rest = [c for c in entries.columns if c not in names]
    return entries.select(*rest, F.inline(F.array(F.struct(*names)))).select(*entries.columns)


def _read_by(query: SearchQuery) -> list[str]:
    return (["fields"] if query.text or query.filters else []) + (["ts", "ts_offset_min"] if query.time else [])


def search(entries: DataFrame, query: SearchQuery, now: datetime, stored: bool = False) -> SearchResult:
    """``stored``: the entries are columns on disk, so filters may move down to the reader."""
    if query.offset < 0 or (query.limit or 0) < 0:
        raise ValueError("offset and limit can't be negative")
    names = [] if stored else _read_by(query)
    found = (held(entries, *names) if names else entries).filter(condition(query, now))
    page = found.orderBy(*ORDER)
    page = page.offset(query.offset) if query.offset else page
    return SearchResult(found, page.limit(query.limit) if query.limit else page, query)


def facets(entries: DataFrame, most: int = 10) -> DataFrame:
    """The most frequent values of each field; equal counts in the order in which values first occur."""
    each = entries.select(*ORDER, F.explode("fields").alias("field", "value"))
    counts = each.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "first"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= most).select("field", "value", "n", "rank")


def field_names(entries: DataFrame) -> DataFrame:
    """Field names with the place where each first occurs."""
    return entries.select(*ORDER, F.explode(F.map_keys("fields")).alias("field")).groupBy("field").agg(F.min(F.struct(*ORDER)).alias("first")).orderBy("first", "field")


def time_range(entries: DataFrame) -> DataFrame:
    return entries.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def search_errors(entries: DataFrame, now: datetime, limit: int = 100, http_5xx: bool = False) -> DataFrame:
    """Entries of level error, then of severity error, then with a 5 in their status (or a status from 500), each once, up to ``limit``."""
    five = SearchFilter("status", "regex", "^5") if http_5xx else SearchFilter("status", "contains", "5")
    tests = [SearchFilter("level", "equals", "error"), SearchFilter("severity", "equals", "error"), five]
    turn = F.when(filter_condition(tests[0]), 0).when(filter_condition(tests[1]), 1).when(filter_condition(tests[2]), 2)
    return held(entries, "fields").withColumn("priority", turn).filter("priority is not null").orderBy("priority", *ORDER).limit(limit)


def search_by_ip(entries: DataFrame, ip: str, limit: int = 100) -> DataFrame:
    """Entries whose client_ip, else remote_addr, else ip is the address, else that mention it: the first kind that has any."""
    kinds = [filter_condition(SearchFilter(f, "equals", ip)) for f in ("client_ip", "remote_addr", "ip")]
    kinds.append(text_condition(ip))
    hits = held(entries, "fields").select("*", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in enumerate(kinds)]))).alias("kind"))
    best = hits.agg(F.min("kind").alias("best"))
    return hits.join(F.broadcast(best), F.col("kind") == F.col("best")).drop("best").orderBy(*ORDER).limit(limit)  # one row


def results_table(entries: DataFrame, names: list[str] | None = None, most: int = 8, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page as rows of text: ``number``, ``time`` (``MM-dd HH:mm`` or ``No Time``) and the first ``most`` fields by name, blank where missing.

    Without ``names`` the fields are those that occur on the page.
    """
    page = _page(entries, limit, offset)
    if names is None:
        names = [r["field"] for r in page.select(F.explode(F.map_keys("fields")).alias("field")).distinct().orderBy("field").limit(most).collect()]
    return page.select("number", F.coalesce(F.date_format("ts", "MM-dd HH:mm"), F.lit("No Time")).alias("time"), *[F.coalesce(F.col("fields")[n], F.lit("")).alias(n) for n in sorted(names)[:most]])


def raw_view(entries: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page's lines with their numbers."""
    return _page(entries, limit, offset).select("number", "raw_line")


def _page(entries: DataFrame, limit: int, offset: int) -> DataFrame:
    page = entries.orderBy(*ORDER).offset(offset).limit(limit)
    return page.withColumn("number", F.row_number().over(Window.orderBy(*ORDER)).cast("long") + offset)  # ``limit`` rows
