"""Entries on disk, laid out so that searches skip what can't match.

An index is a folder of Parquet. Its rows are range-partitioned and sorted by the UTC
instant of their time, so a search in time touches few row groups; chosen fields have a
lower-cased column of their own with a bloom filter, so a search for a value skips row
groups without it. Searches put both in front of the full condition, in a form that reaches
the reader. Which column stands for which field is kept in the files' own schema, so any
session can open an index by its path.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

_UTC, _EXACT = "_utc", "_exact_"
_EPOCH = datetime(1970, 1, 1)


def instant() -> Column:
    """An entry's time less its offset, as microseconds since 1970: a number, since Parquet keeps no statistics of Spark's timestamps by default."""
    at = F.col("ts") - F.make_dt_interval(mins=F.coalesce("ts_offset_min", F.lit(0)))
    return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH).cast("timestamp_ntz"), at)


class LogIndex:
    """``entries``: the stored entries; ``exact``: fields that have a column of their own."""

    def __init__(self, spark: SparkSession, path: str, now: datetime):
        self.spark, self.path, self.now = spark, path, now
        self._table = spark.read.parquet(path)
        self.exact = {f.metadata["field"]: f.name for f in self._table.schema if f.name.startswith(_EXACT)}

    @staticmethod
    def build(entries: DataFrame, path: str, exact: tuple[str, ...] = (), now: datetime | None = None, row_group_bytes: int = 64 << 20, partitions: int | None = None) -> LogIndex:
        """Write the index. Entries without a time come first. An existing folder is an error."""
        columns = [instant().alias(_UTC)]
        columns += [F.lower(F.col("fields")[n]).alias(f"{_EXACT}{i}", metadata={"field": n}) for i, n in enumerate(dict.fromkeys(exact))]
        rows = entries.select("*", *columns)
        by = (F.col(_UTC), F.col("source_file"), F.col("line_number"))
        rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
        writer = rows.sortWithinPartitions(*by).write.option("parquet.block.size", row_group_bytes)
        for i in range(len(columns) - 1):
            writer = writer.option(f"parquet.bloom.filter.enabled#{_EXACT}{i}", "true")
        writer.parquet(path)
        return LogIndex(entries.sparkSession, path, now or datetime.now())

    @property
    def entries(self) -> DataFrame:
        return self._table.drop(_UTC, *self.exact.values())

    def _skip(self, query: search.SearchQuery) -> Column:
        """What the reader can decide by statistics and bloom filters: never more than the condition asks."""
        out = F.lit(True)
        if query.time:
            start, end = search.bounds(query.time, self.now)
            for bound, test in ((start, Column.__ge__), (end, Column.__le__)):
                if bound is not None:
                    out = out & test(F.col(_UTC), F.lit((bound - _EPOCH) // timedelta(microseconds=1)))
        for f in query.filters:
            if f.operator == "equals" and f.field in self.exact:
                out = out & (F.col(self.exact[f.field]) == F.lit(f.value.lower()))
        return out

    def search(self, query: search.SearchQuery) -> search.SearchResult:
        """As ``search.search`` over the entries."""
        found = self._table.filter(self._skip(query)).drop(_UTC, *self.exact.values())
        return search.search(found, query, self.now, stored=True)
