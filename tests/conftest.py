from __future__ import annotations

import json
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from watchglass.plans.session import local_session  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        4, "tests", spark__driver__memory="4g",
        spark__sql__streaming__stateStore__providerClass=(
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
    )
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session


@pytest.fixture(scope="session")
def make_events(spark):
    """Events from dicts (or raw text), parsed, with path = position and event_time."""
    from watchglass.operators.shaping import attach_event_time, parse_events
    from pyspark.sql import functions as F

    def make(items):
        rows = [
            (str(i), x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(items)
        ]
        parsed = parse_events(spark.createDataFrame(rows, "path string, value string"))
        return attach_event_time(parsed, F.expr("try_variant_get(data, '$.timestamp', 'string')"))

    return make
