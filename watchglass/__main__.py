"""Try rules on event files.

usage: python -m watchglass matches  RULES EVENTS   rules that fire, per event
       python -m watchglass coverage RULES EVENTS   matches per rule, silent rules included

RULES is a rule file or a folder of them; EVENTS a JSON-lines file, a folder, or -.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .functions.fields import FieldMap
from .operators import matching
from .operators.rules import load_rules
from .operators.shaping import parse_events
from .sources.events import file_events

DOCUMENT = FieldMap(document="data", raw="raw")


def read(spark: SparkSession, where: str) -> DataFrame:
    if where != "-":
        return file_events(spark, where)
    lines = [(line.rstrip("\n"),) for line in sys.stdin if line.strip()]
    return parse_events(spark.createDataFrame(lines, "value string"))


def main(argv: list[str]) -> int:
    if len(argv) != 3 or argv[0] not in ("matches", "coverage"):
        print(__doc__, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("watchglass").getOrCreate()
    rules = load_rules(argv[1]).rules
    matched = matching.matches(read(spark, argv[2]), rules, DOCUMENT, keep=["raw"])
    if argv[0] == "coverage":
        out = matching.rule_coverage(matched, rules).orderBy("matches", "rule_id")
    else:
        out = matched.select("rule_id", "rule_title", "severity", "raw")
    for line in out.toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
