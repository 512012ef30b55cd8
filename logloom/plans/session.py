"""From paths to answers: detect each source, parse it with its own plan, search and summarise."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Detection
from ..operators import detect, overview, parse, search, stats
from ..sources.lines import file_sizes, path_of, read_heads, read_lines
from .index import LogIndex

#: Kinds of sources that one scan tells apart.
PLANS_AT_ONCE = 32


class LogSession:
    """``now`` stands for the present in ages of timestamps and relative times."""

    def __init__(self, spark: SparkSession, now: datetime | None = None):
        self.spark, self.now = spark, now or datetime.now()

    def read(self, *paths: str) -> DataFrame:
        return read_lines(self.spark, *paths)

    def detect(self, lines: DataFrame) -> dict[str, Detection]:
        return detect.detect(lines, self.now)

    def detect_files(self, *paths: str) -> dict[str, Detection]:
        """Detections from the files' first lines alone; a file without lines is of unknown format."""
        found = detect.detect(read_heads(self.spark, *paths), self.now)
        files = [r["source_file"] for r in file_sizes(self.spark, *paths).select("source_file").collect()]
        return {f: found.get(f, Detection("unknown")) for f in files}

    def sources(self, detections: dict[str, Detection], *paths: str) -> DataFrame:
        """``source_file``, ``file_size_bytes``, ``format`` and ``detection_confidence`` of files."""
        rows = self.spark.createDataFrame([(s, d.format, float(d.confidence)) for s, d in detections.items()], "source_file string, format string, detection_confidence double")
        return file_sizes(self.spark, *paths).join(rows, "source_file", "left")

    @staticmethod
    def _plans(detections: dict[str, Detection]) -> list[tuple[Detection, list[str]]]:
        """Detections that parse alike, with their sources."""
        plans: dict[tuple, list[str]] = {}
        for source, d in detections.items():
            if d.format != "unknown":
                plans.setdefault((d.format, tuple((f.name, f.data_type, f.is_timestamp) for f in d.fields), *(d.metadata.get(k) for k in ("delimiter", "header", "patterns", "stamps"))), []).append(source)
        return [(detections[sources[0]], sources) for sources in plans.values()]

    def parse(self, lines: DataFrame, detections: dict[str, Detection], derive: bool = False) -> DataFrame:
        """Every line goes to its own source's parser, in one pass over ``lines`` for all formats but journals."""
        return parse.parse_sources(lines, self._plans(detections), self.now, derive)

    def parse_files(self, detections: dict[str, Detection], derive: bool = False) -> DataFrame:
        """Entries of files by the names that their detections have.

        Files of all line formats are one scan, whose splits take their file's parser; journals
        are another. Each scan has its own files alone, so a file is read twice in all: for the
        numbers of its lines and for itself. Beyond ``PLANS_AT_ONCE`` kinds there are more
        scans, still with files of their own.
        """
        plans = self._plans(detections)
        journals = [p for p in plans if p[0].format == "systemd_journal"]
        rest = [p for p in plans if p not in journals]
        groups = [journals] * bool(journals) + [rest[i : i + PLANS_AT_ONCE] for i in range(0, len(rest), PLANS_AT_ONCE)]
        parts = [parse.parse_sources(read_lines(self.spark, *[path_of(s) for _, sources in g for s in sources], blanks=g is journals), g, self.now, derive) for g in groups]
        return reduce(DataFrame.unionByName, parts) if parts else parse.parse_sources(self.spark.createDataFrame([], "source_file string, line_number bigint, raw_line string"), [], self.now)

    def parse_line(self, text: str, detection: Detection) -> DataFrame:
        return parse.parse_line(self.spark, text, detection, self.now)

    def index(self, entries: DataFrame, path: str, exact: tuple[str, ...] = (), **options) -> LogIndex:
        """The entries written by time, with bloom filters on the fields ``exact``: searches parse no line again and skip row groups."""
        return LogIndex.build(entries, path, exact, self.now, **options)

    def open_index(self, path: str) -> LogIndex:
        return LogIndex(self.spark, path, self.now)

    def search(self, entries: DataFrame, query: search.SearchQuery) -> search.SearchResult:
        return search.search(entries, query, self.now)

    def analyze(self, entries: DataFrame, detection: Detection) -> dict[str, DataFrame]:
        """The profile, the times, the file statistics with hints, the bars and the report of entries of one detection.

        All come from one pass, whose few rows are kept; ``overview`` holds them: unpersist it
        when done. No entries give empty tables.
        """
        seen = overview.overview(entries).persist()
        files = overview.files(seen, detection)
        return {
            "overview": seen, "fields": overview.profile(seen, detection), "hours": overview.buckets(seen, "hours"), "days": overview.buckets(seen, "days"), "time": overview.times(seen), "files": files, "recommendations": stats.recommendations(files),
            "problems": overview.problem_files(files), "rate_bars": overview.rate_bars(seen, detection), "gauges": overview.gauges(files), "report": overview.report(seen, detection),
        }

    def report(self, entries: DataFrame, detection: Detection) -> DataFrame:
        """(section, label, value) rows of the analysis, in one pass over the entries."""
        return overview.report(overview.overview(entries), detection)

    def formats(self) -> DataFrame:
        """Every detector with the format that it reports and the least confidence that it accepts."""
        rows = [(k, "basic_log" if k == "generic_web" else k, v) for k, v in detect.THRESHOLDS.items()]
        return self.spark.createDataFrame(rows, "detector string, format string, threshold double")
