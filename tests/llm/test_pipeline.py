"""The pipeline stage by stage on a small corpus, and the registered queries' names."""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from watchglass.llm import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_dedup", "pii", "packing"]
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = corpus_pipeline.written(out, f"test-{name}")
            counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] == counts[4] > 0.7 * counts[0]
    packed = out.groupBy("doc_id").sum("length").count()
    assert packed == counts[4]


def test_registered():
    known = entry.queries()
    assert set(catalogue.QUERIES) | {"pipeline"} <= set(known)
    assert sorted(int(n[2:].split("_")[0]) for n in catalogue.QUERIES) == list(range(1, 14))
