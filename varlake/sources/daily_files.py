"""A data source over Parquet files by day: a range of days, given or pushed down from filters, picks the files to be opened; as a stream, days arrive in order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..shipping import ship_package

FORMAT, DAY = "daily_files", "day"


class Day(InputPartition):
    """The files of one day."""

    def __init__(self, day: str, files: list[str]):
        super().__init__(day)
        self.day, self.files = day, files


def _opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def days_of(path: str, first: str = "", last: str = "9999-99-99") -> list[Day]:
    """The days in the folder from first to last, by the names of its folders day=...; only those of the range are listed further."""
    from pyarrow import fs

    system, root = _opened(path)
    found = []
    for entry in system.get_file_info(fs.FileSelector(root)):
        day = entry.base_name.removeprefix(f"{DAY}=")
        if entry.type == fs.FileType.Directory and day != entry.base_name and first <= day <= last:
            files = [f.path for f in system.get_file_info(fs.FileSelector(entry.path)) if f.base_name.endswith(".parquet")]
            found.append(Day(day, sorted(files)))
    return sorted(found, key=lambda d: d.day)


def rows_of(path: str, names: list[str], day: Day):
    """A day's rows as Arrow batches of these columns, the day itself among them."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    system, _ = _opened(path)
    own = [n for n in names if n != DAY]
    for file in day.files:
        for batch in pq.ParquetFile(system.open_input_file(file), coerce_int96_timestamp_unit="us").iter_batches(columns=own):
            at = dict(zip(batch.schema.names, batch.columns))
            # Spark's files hold instants without their zone, which is UTC.
            at = {n: c.cast(pa.timestamp("us", "UTC")) if pa.types.is_timestamp(c.type) else c for n, c in at.items()}
            at[DAY] = pa.array([dt.date.fromisoformat(day.day)] * batch.num_rows, pa.date32())
            yield pa.RecordBatch.from_arrays([at[n] for n in names], names)


class DailyReader(DataSourceReader):
    def __init__(self, path: str, names: list[str], first: str, last: str):
        self.path, self.names, self.first, self.last = path, names, first, last

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on the day narrow the range; Spark keeps the others."""
        for f in filters:
            value = f.value.isoformat() if isinstance(getattr(f, "value", None), dt.date) else None
            if getattr(f, "attribute", None) != (DAY,) or value is None:
                yield f
            elif isinstance(f, GreaterThanOrEqual):
                self.first = max(self.first, value)
            elif isinstance(f, LessThanOrEqual):
                self.last = min(self.last, value)
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, value), min(self.last, value)
            else:
                if isinstance(f, GreaterThan):
                    self.first = max(self.first, value)
                elif isinstance(f, LessThan):
                    self.last = min(self.last, value)
                yield f

    def partitions(self) -> list[Day]:
        return days_of(self.path, self.first, self.last)

    def read(self, partition: Day):
        return rows_of(self.path, self.names, partition)


class DailyStream(DataSourceStreamReader):
    """Offsets are days: a batch has the days after the last one's."""

    def __init__(self, path: str, names: list[str], first: str, last: str):
        self.path, self.names, self.first, self.last = path, names, first, last

    def initialOffset(self) -> dict:
        return {DAY: ""}

    def latestOffset(self) -> dict:
        days = days_of(self.path, self.first, self.last)
        return {DAY: days[-1].day if days else ""}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        return [d for d in days_of(self.path, self.first, self.last) if start[DAY] < d.day <= end[DAY]]

    def read(self, partition: Day):
        return rows_of(self.path, self.names, partition)

    def commit(self, end: dict) -> None:
        pass


class DailyFiles(DataSource):
    """Options: path, a folder of folders day=YYYY-MM-DD with Parquet files; first and last, the days between which to read, both included."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        raise ValueError("a schema with the column day must be given")

    def _made(self, kind, schema):
        return kind(self.options["path"], [f.name for f in schema.fields], self.options.get("first", ""), self.options.get("last", "9999-99-99"))

    def reader(self, schema) -> DailyReader:
        return self._made(DailyReader, schema)

    def streamReader(self, schema) -> DailyStream:
        return self._made(DailyStream, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and filters pushed down to it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(DailyFiles)


def write_days(frame: DataFrame, path: str) -> None:
    """The frame, which has a column day, as files by day."""
    frame.write.partitionBy(DAY).parquet(path)
