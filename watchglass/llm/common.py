"""What several operators share: tables, the shared folder, running sums."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from watchglass.plans.durable import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the checkpoint folder that all executors share."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: one computation, short lineage.

    Nothing needs the shuffle files behind it then. Spark deletes them once the JVM
    has collected their plans, which a driver with little to do may put off for half
    an hour; so this asks for it, behind a job of one row, since Spark holds on to its
    last job until the next one.
    """
    spark, schema = df.sparkSession, df.schema
    path = shared_path(spark, name)
    df.write.parquet(path)
    del df
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `written` made, once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """`docs` with a number of the row in ROW, written so that every reader sees the same numbers."""
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like `wanted` that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def tasks(spark: SparkSession) -> int:
    """Partitions for work whose cost does not show in its bytes, which Spark must not coalesce."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ranged(df: DataFrame, *order: Column | str) -> DataFrame:
    """Range partitions in `order`, each sorted, with the number of the partition in `part`."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    out = df.repartitionByRange(tasks(df.sparkSession), *columns).sortWithinPartitions(*columns)
    return out.withColumn("part", F.spark_partition_id())


def sums_before(parts: DataFrame, value: str, order: str, *, by: str | None = None) -> DataFrame:
    """`before`: the sum of `value` over the earlier rows of `parts`, which has a row per partition.

    `parts` holds one small row per partition of a larger table (and key), never the
    rows of that table, so its window stays small whatever the table's size.
    """
    window = Window.partitionBy(by if by else F.lit(0)).orderBy(order)
    frame = window.rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum(value).over(frame), F.lit(0)).cast("long"))
