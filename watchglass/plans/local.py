"""Small driver-side tables as local relations."""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def literal_frame(spark: SparkSession, columns: dict[str, tuple[pa.DataType, Sequence]]) -> DataFrame:
    """A DataFrame over values that are part of the configuration.

    It becomes a local relation whose size Catalyst knows, so joins with it are
    broadcast only while it is below spark.sql.autoBroadcastJoinThreshold.
    """
    arrays = [pa.array(list(values), type=dtype) for dtype, values in columns.values()]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=list(columns)))
