"""The source of files by day: which files are opened, what is pushed down, and days that arrive as a stream."""

import datetime as dt
import os

from varlake.sources import daily_files

SCHEMA = "day date, k long, v double"


def written(spark, path, days):
    rows = [(dt.date(2024, 1, d), 10 * d + i, float(i)) for d in days for i in range(3)]
    daily_files.write_days(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(path))
    return rows


def broken(path, day):
    """A file that can't be read."""
    os.makedirs(f"{path}/day=2024-01-{day:02}", exist_ok=True)
    open(f"{path}/day=2024-01-{day:02}/part.parquet", "w").close()


def test_files_outside_the_range_are_not_opened(spark, tmp_path):
    daily_files.register(spark)
    rows = written(spark, tmp_path / "t", range(1, 9))
    broken(tmp_path / "t", 9)
    load = lambda **o: spark.read.format("daily_files").schema(SCHEMA).options(**o).load(str(tmp_path / "t"))
    want = lambda low, high: sorted(r for r in rows if low <= r[0].day <= high)
    assert sorted(map(tuple, load().where("day >= DATE '2024-01-03' AND day < DATE '2024-01-06'").collect())) == want(3, 5)
    assert sorted(map(tuple, load(first="2024-01-02", last="2024-01-04").collect())) == want(2, 4)
    assert sorted(map(tuple, load(last="2024-01-08").where("day > DATE '2024-01-07' AND k % 2 = 0").collect())) == [r for r in want(8, 8) if r[1] % 2 == 0]
    assert [tuple(r) for r in load().where("day = DATE '2024-01-02'").select("v").orderBy("v").collect()] == [(0.0,), (1.0,), (2.0,)]
    reader = daily_files.DailyReader(str(tmp_path / "t"), ["day", "k", "v"], "", "9999")
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    left = list(reader.pushFilters([GreaterThanOrEqual(("day",), dt.date(2024, 1, 7)), LessThan(("k",), 5)]))
    assert [d.day for d in reader.partitions()] == ["2024-01-07", "2024-01-08", "2024-01-09"] and left == [LessThan(("k",), 5)]


def test_days_arrive_as_a_stream(spark, tmp_path):
    daily_files.register(spark)

    def run():
        stream = spark.readStream.format("daily_files").schema(SCHEMA).load(str(tmp_path / "t"))
        made = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        made.trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("day", "k", "v").collect())

    rows = written(spark, tmp_path / "t", range(1, 4))
    assert run() == sorted(rows)
    more = written(spark, tmp_path / "more", range(4, 6))
    for day in (4, 5):
        os.rename(tmp_path / "more" / f"day=2024-01-{day:02}", tmp_path / "t" / f"day=2024-01-{day:02}")
    assert run() == sorted(rows + more)
