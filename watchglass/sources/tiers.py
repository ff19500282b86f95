"""Hot and cold event tables: scans, the view over both, rollover and retention.

A rollover moves files, not days. What it moves is the list of a hot day's files at its
start; their rows are staged under a name of their own, counted, and committed by a marker
that names the hot files and the staged ones. Only then are the staged files published
into the cold day, beside what is there, and the named hot files deleted. Files that reach
the hot day meanwhile, or later, wait for the next move. A run that stops before the
marker leaves nothing that readers see; one that stops behind it is finished by the next
run, and until then readers take the rows of its hot files from the staged ones.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Retention in days, and the age ladder of storage classes.
HOT_RETENTION_DAYS = 14
EXPORT_AGE_DAYS = 13
ALERT_RETENTION_DAYS = 30
STORAGE_LADDER = ((365, "ARCHIVE"), (90, "COLDLINE"), (30, "NEARLINE"))

HOT_SCHEMA = T.StructType([
    T.StructField("data", T.VariantType()), T.StructField("dt", T.DateType()),
])
COLD_SCHEMA = T.StructType([
    T.StructField("data", T.StringType()), T.StructField("dt", T.DateType()),
])

Day = "dt.date | str"


# Spark's readers pass over folders of these names.
_MOVES = "_moves"
_STAGING = "_staging"
_HOT_DATA = T.StructType([HOT_SCHEMA["data"]])
_COLD_DATA = T.StructType([COLD_SCHEMA["data"]])


@dataclass(frozen=True)
class Move:
    """A committed export: `hot` files, by their paths below the hot table, became `cold` files."""

    id: str
    day: dt.date
    rows: int
    hot: tuple[str, ...]
    cold: tuple[str, ...]


def _scan(spark: SparkSession, path: str, schema: T.StructType, start: Day | None, end: Day | None) -> DataFrame:
    if start is None or end is None:
        raise ValueError("a scan needs a first and a last day: the tables are read by partition")
    days = F.col("dt").between(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date"))
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(days)


def scan_hot(
    spark: SparkSession, path: str, start: Day | None = None, end: Day | None = None,
    *, cold_path: str | None = None,
) -> DataFrame:
    """Hot events (VARIANT data) of the given days; the days are mandatory.

    With `cold_path`, files that a committed move to it has yet to delete are left out.
    """
    rows = _scan(spark, path, HOT_SCHEMA, start, end)
    moved = [f for m in pending_moves(spark, cold_path) for f in m.hot] if cold_path else []
    if moved:
        below = F.regexp_extract("_metadata.file_path", "^.*/(dt=[^/]*/.*)$", 1)
        rows = rows.where(~below.isin(moved))
    return rows


def scan_cold(spark: SparkSession, path: str, start: Day | None = None, end: Day | None = None) -> DataFrame:
    """Cold events (JSON text) of the given days; the days are mandatory.

    Files that are committed but not yet published belong to them.
    """
    rows = _scan(spark, path, COLD_SCHEMA, start, end)
    for move in pending_moves(spark, path):
        staged = _existing(spark, [f"{path}/{_STAGING}/{move.id}/{name}" for name in move.cold])
        if staged and str(start) <= move.day.isoformat() <= str(end):
            extra = spark.read.schema(_COLD_DATA).parquet(*staged)
            rows = rows.unionByName(extra.withColumn("dt", F.lit(move.day)))
    return rows


def events_all(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """Both tiers as (data, partition_date)."""
    return hot.select("data", F.col("dt").alias("partition_date")).unionByName(
        cold.select(F.try_parse_json("data").alias("data"), F.col("dt").alias("partition_date"))
    )


def create_events_view(
    spark: SparkSession, hot_path: str, cold_path: str, start: Day, end: Day, name: str = "events_all"
) -> DataFrame:
    hot = scan_hot(spark, hot_path, start, end, cold_path=cold_path)
    view = events_all(hot, scan_cold(spark, cold_path, start, end))
    view.createOrReplaceTempView(name)
    return view


def export_rows(hot: DataFrame) -> DataFrame:
    """Hot rows in the form the cold tier stores."""
    return hot.select(F.to_json("data").alias("data"), "dt")


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _partitions(spark: SparkSession, path: str, column: str) -> tuple[list[dt.date], list[str]]:
    """Days that have a partition folder, and folders of the column that name no day."""
    fs, root = _filesystem(spark, path)
    days, odd = [], []
    for status in fs.listStatus(root) if fs.exists(root) else ():
        name = status.getPath().getName()
        if status.isDirectory() and name.startswith(f"{column}="):
            try:
                days.append(dt.date.fromisoformat(name.split("=", 1)[1]))
            except ValueError:
                odd.append(name)
    return sorted(days), sorted(odd)


def partition_days(spark: SparkSession, path: str, column: str = "dt") -> list[dt.date]:
    """Days that have a partition folder; `odd_partitions` has the folders that name no day."""
    return _partitions(spark, path, column)[0]


def odd_partitions(spark: SparkSession, path: str, column: str = "dt") -> list[str]:
    """Partition folders that name no day, which no scan by days reads and no retention reaches."""
    return _partitions(spark, path, column)[1]


def _data_files(spark: SparkSession, path: str, below: str) -> list[str]:
    """Data files of the folder `below` of `path`, by their paths below `path`."""
    fs, folder = _filesystem(spark, f"{path}/{below}")
    if not fs.exists(folder):
        return []
    root = fs.getFileStatus(folder).getPath().toString()
    found, files = [], fs.listFiles(folder, True)
    while files.hasNext():
        rest = files.next().getPath().toString().removeprefix(root).strip("/")
        if not any(part.startswith(("_", ".")) for part in rest.split("/")):
            found.append(f"{below}/{rest}")
    return sorted(found)


def _existing(spark: SparkSession, paths: list[str]) -> list[str]:
    return [p for p in paths if (at := _filesystem(spark, p))[0].exists(at[1])]


def _delete(spark: SparkSession, path: str) -> bool:
    fs, at = _filesystem(spark, path)
    return fs.delete(at, True) if fs.exists(at) else False


def drop_partition(spark: SparkSession, path: str, day: dt.date, column: str = "dt") -> bool:
    return _delete(spark, f"{path}/{column}={day.isoformat()}")


def expire(
    spark: SparkSession, path: str, today: dt.date, keep_days: int, column: str = "dt",
    *, exported_to: str | None = None,
) -> list[dt.date]:
    """Drop partitions older than `keep_days`; returns the dropped days.

    With `exported_to`, the path of the cold tier, days that hold a file which no committed
    move names stay. Folders that name no day stay too, with a warning.
    """
    limit = today - dt.timedelta(days=keep_days)
    days, odd = _partitions(spark, path, column)
    if odd:
        warnings.warn(f"not expired, as they name no day: {', '.join(odd)} below {path}", stacklevel=2)
    old = [d for d in days if d < limit]
    if exported_to is not None:
        moved = {f for m in pending_moves(spark, exported_to) for f in m.hot}
        old = [d for d in old if moved.issuperset(_data_files(spark, path, f"{column}={d.isoformat()}"))]
    for d in old:
        drop_partition(spark, path, d, column)
    return old


def rollover(
    spark: SparkSession,
    hot_path: str,
    cold_path: str,
    today: dt.date,
    *,
    age_days: int = EXPORT_AGE_DAYS,
    files: int | None = None,
) -> int:
    """Move hot days of the given age or more to cold ZSTD Parquet; returns the rows moved.

    A day that an earlier run missed is moved too, and so are rows that a day received
    after an earlier move; moves that an earlier run left unfinished are finished first.
    One rollover of a table runs at a time.
    """
    if age_days >= HOT_RETENTION_DAYS:
        raise ValueError("export must come before the hot partition expires")
    for move in pending_moves(spark, cold_path):
        finish_move(spark, hot_path, cold_path, move)
    last = today - dt.timedelta(days=age_days)
    moved = 0
    for day in (d for d in partition_days(spark, hot_path) if d <= last):
        move = stage_move(spark, hot_path, cold_path, day, files)
        if move is None:
            _drop_if_empty(spark, hot_path, day)
            continue
        commit_move(spark, cold_path, move)
        finish_move(spark, hot_path, cold_path, move)
        moved += move.rows
    return moved


def stage_move(
    spark: SparkSession, hot_path: str, cold_path: str, day: dt.date, files: int | None = None
) -> Move | None:
    """Write the rows of a hot day's present files where no reader looks; None if it has none."""
    hot = _data_files(spark, hot_path, f"dt={day.isoformat()}")
    if not hot:
        return None
    name = f"{day.isoformat()}-{uuid.uuid4().hex}"
    source = spark.read.schema(_HOT_DATA).parquet(*(f"{hot_path}/{f}" for f in hot))
    rows = export_rows(source.withColumn("dt", F.lit(day))).drop("dt")
    if files:
        rows = rows.repartition(files)
    target = f"{cold_path}/{_STAGING}/{name}"
    rows.write.option("compression", "zstd").parquet(target)
    cold = [f.rsplit("/", 1)[1] for f in _data_files(spark, f"{cold_path}/{_STAGING}", name)]
    staged, had = spark.read.schema(_COLD_DATA).parquet(target).count(), source.count()
    if staged != had:
        raise RuntimeError(f"rollover of {day}: {staged} rows are staged, hot has {had}")
    return Move(name, day, staged, tuple(hot), tuple(cold))


def commit_move(spark: SparkSession, cold_path: str, move: Move) -> None:
    """Write the marker: from here on the move's rows are cold ones."""
    text = json.dumps({
        "day": move.day.isoformat(), "rows": move.rows, "hot": move.hot, "cold": move.cold,
    })
    fs, marker = _filesystem(spark, f"{cold_path}/{_MOVES}/{move.id}.json")
    _, draft = _filesystem(spark, f"{cold_path}/{_MOVES}/{move.id}.draft")
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, marker):
        raise RuntimeError(f"the move {move.id} could not be committed")


def pending_moves(spark: SparkSession, cold_path: str) -> list[Move]:
    """Committed moves that are not finished."""
    fs, folder = _filesystem(spark, f"{cold_path}/{_MOVES}")
    found = []
    for status in fs.listStatus(folder) if fs.exists(folder) else ():
        name = status.getPath().getName()
        if not name.endswith(".json"):
            continue
        stream = fs.open(status.getPath())
        try:
            held = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        found.append(Move(
            name.removesuffix(".json"), dt.date.fromisoformat(held["day"]), held["rows"],
            tuple(held["hot"]), tuple(held["cold"]),
        ))
    return sorted(found, key=lambda m: m.id)


def finish_move(spark: SparkSession, hot_path: str, cold_path: str, move: Move) -> None:
    """Publish the staged files and delete the hot ones; may be repeated after any stop."""
    fs, day = _filesystem(spark, f"{cold_path}/dt={move.day.isoformat()}")
    fs.mkdirs(day)
    for name in move.cold:
        _, staged = _filesystem(spark, f"{cold_path}/{_STAGING}/{move.id}/{name}")
        _, target = _filesystem(spark, f"{cold_path}/dt={move.day.isoformat()}/{name}")
        if fs.exists(staged):
            if not fs.rename(staged, target):
                raise RuntimeError(f"{staged} could not be published")
        elif not fs.exists(target):
            raise RuntimeError(f"the move {move.id} has lost {name}")
    for name in move.hot:
        _delete(spark, f"{hot_path}/{name}")
    _drop_if_empty(spark, hot_path, move.day)
    _delete(spark, f"{cold_path}/{_STAGING}/{move.id}")
    _delete(spark, f"{cold_path}/{_MOVES}/{move.id}.json")


def _drop_if_empty(spark: SparkSession, hot_path: str, day: dt.date) -> None:
    if not _data_files(spark, hot_path, f"dt={day.isoformat()}"):
        drop_partition(spark, hot_path, day)


def storage_class(age: Column) -> Column:
    """Storage class of a cold partition by its age in days."""
    out = F.lit("STANDARD")
    for days, name in reversed(STORAGE_LADDER):
        out = F.when(age >= days, name).otherwise(out)
    return out


def retention_plan(days: DataFrame, today: Column) -> DataFrame:
    """(dt, age_days, action, storage_class) of partitions."""
    age = F.date_diff(today, "dt")
    action = (
        F.when(age > HOT_RETENTION_DAYS, "expired")
        .when(age >= EXPORT_AGE_DAYS, "export")
        .otherwise("keep")
    )
    return days.select(
        "dt", age.alias("age_days"), action.alias("action"), storage_class(age).alias("storage_class")
    )


def late_arrivals(df: DataFrame, ingest_date: str, event_date: str, age_days: int = EXPORT_AGE_DAYS) -> DataFrame:
    """Rows whose event day had already been exported when they arrived, per day."""
    return (
        df.where(F.date_diff(ingest_date, event_date) > age_days)
        .groupBy(F.col(event_date).alias("event_date"))
        .agg(F.count(F.lit(1)).alias("late_rows"))
    )
