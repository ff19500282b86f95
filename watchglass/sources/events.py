"""Event sources: message streams, files, and typed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.shaping import parse_events


def kafka_events(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Unbounded messages with their attributes: raw, data, attributes, ingest_time."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("includeHeaders", "true")
    )
    for k, v in options.items():
        reader = reader.option(k, v)
    return parse_events(messages(reader.load()))


def messages(records: DataFrame, *keep: str) -> DataFrame:
    """Kafka-shaped records -> value, attributes map, ingest time and the columns to keep."""
    pairs = F.transform(
        F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")),
        lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")),
    )
    # A repeated header keeps its last value.
    merged = F.aggregate(
        pairs,
        F.create_map().cast("map<string,string>"),
        lambda acc, h: F.map_concat(
            F.map_filter(acc, lambda k, _: k != h["key"]), F.create_map(h["key"], h["value"])
        ),
    )
    return records.select(
        "value", merged.alias("attributes"), F.col("timestamp").alias("ingest_time"), *keep
    )


#: Records of a message topic as files hold them: the columns of Spark's Kafka reader.
MESSAGE_SCHEMA = (
    "key binary, value binary, topic string, partition int, offset long, timestamp timestamp,"
    " headers array<struct<key:string,value:binary>>"
)


def message_files(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Messages that a topic's archive lands as Parquet files, as a stream: what `kafka_events` gives, and offsets.

    A batch reads at most `files_per_trigger` files; a restarted query goes on behind the
    files that its checkpoint has. Files may hold some of the columns of MESSAGE_SCHEMA only.
    """
    records = (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", str(files_per_trigger))
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)
    )
    return parse_events(messages(records, "partition", "offset"))


def file_events(spark: SparkSession, *paths: str, whole_files: bool = False) -> DataFrame:
    """JSON documents from files or directories: path, raw, data.

    One document per line, or one per file with `whole_files`.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    if whole_files:
        reader = reader.option("wholetext", "true")
    lines = reader.text(list(paths)).select("value", F.col("_metadata.file_path").alias("path"))
    if whole_files:
        lines = lines.withColumn("value", F.regexp_replace("value", r"\s+$", ""))
    return parse_events(lines)


def stream_files(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """New files of JSON lines as a stream: path, raw, data."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", str(files_per_trigger))
        .text(path).select("value", F.col("_metadata.file_path").alias("path"))
    )
    return parse_events(lines)


def table_events(df: DataFrame, time: str = "ts") -> DataFrame:
    """A typed table as events: its columns plus event_time (UTC)."""
    return df.withColumn("event_time", F.col(time).cast("timestamp"))
