"""Packing documents into sequences under a mixture of sources.

Each source is a queue of tokens. The output is a stream of windows of WINDOW sequences.
A window takes from each queue its share of the window; a share is seldom whole, so a
queue's deficit, what it was owed and did not get, is carried to the next window. That is
deficit round-robin with a quantum of share * window: after w windows a queue has given
floor(w * window * hi) - floor(w * window * lo), if the queues' shares lie side by side
from lo to hi in the unit interval. So the deficits stay under one token, no window needs
the one before it, and every task can place its own documents: a token's place follows
from its place in its queue alone. Documents are cut where a window or a sequence ends.

By default the targets are the sources' shares of all tokens, and all queues end together.
With `targets`, weights by source, queues drain at different times; a phase ends with each
queue that runs dry, and the others share on. Sources without a target form one queue.

A queue's order is that of partitions and rows of the input as it was tokenized; the
places are running sums over partitions, a row for each queue and partition.

Defined results: a null text is empty, its document is the end id alone; a null source
is the source ''; rows of equal doc_id are packed each for itself. Only the last sequence
is shorter than LENGTH, and padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import sums_before, text_or_empty, written
from .token_ids import encoder

LENGTH = 1024  # tokens of a sequence
WINDOW = 64  # sequences of a window, in which the mixture holds
PIECES = (
    "doc_id long, queue string, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_NAMES = ["doc_id", "queue", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def tokenized(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """doc_id, queue, n, chunk, within, ids: `within` counts the tokens of the queue before, in the chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, chunk = encoder(tokenizer), TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in batches:
            sizes, within, ids = [], [], []
            for queue, t in zip(batch.column(1).to_pylist(), batch.column(2)):
                found = ids_of.document(t.as_py())
                ids.append(np.frombuffer(found, "<u4").astype(ids_of.width).tobytes())
                sizes.append(len(found) // 4)
                within.append(seen.get(queue, 0))
                seen[queue] = within[-1] + sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                 pa.array([chunk] * len(sizes), pa.int32()), pa.array(within, pa.int64()),
                 pa.array(ids, pa.binary())],
                names=["doc_id", "queue", "n", "chunk", "within", "ids"],
            )

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"),
        text_or_empty(text).alias("text"),
    )
    schema = "doc_id long, queue string, n long, chunk int, within long, ids binary"
    return written(source.mapInArrow(run, schema), "tokenized")


def phases(totals: dict[str, int], targets: dict[str, float]) -> list[tuple]:
    """queue, from, to, out, tokens, lo, hi: what a queue gives in a phase, places in the queue.

    `out` is where the phase starts in the output, `tokens` what all queues give in it,
    lo to hi the queue's part of those.
    """
    weights = {q: Fraction(targets[q]) for q in totals}
    if any(w <= 0 for w in weights.values()):
        raise ValueError("targets must be above zero")
    ends = sorted({Fraction(totals[q]) / weights[q] for q in totals if totals[q]})
    rows, out, given = [], 0, dict.fromkeys(totals, 0)
    for end in ends:
        upto = {q: min(totals[q], int(weights[q] * end)) for q in totals}
        tokens = sum(upto.values()) - sum(given.values())
        lo = 0
        for q in sorted(totals):
            if upto[q] > given[q]:
                hi = lo + upto[q] - given[q]
                rows.append((q, given[q], upto[q], out, tokens, lo, hi))
                lo = hi
        out, given = out + tokens, upto
    return rows


def _schedule(tokens: DataFrame, targets: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """A row per queue and chunk with the queue's tokens before, and a row per queue and phase."""
    parts = tokens.groupBy("queue", "chunk").agg(F.sum("n").alias("n"))
    chunks = sums_before(parts, "n", "chunk", by="queue").select("queue", "chunk", "before")
    totals = parts.groupBy("queue").agg(F.sum("n").alias("to"))
    if targets is not None:  # at most a row per target and one more
        rows = phases({r.queue: r.to for r in totals.collect()}, targets)
        schema = "queue string, `from` long, `to` long, out long, tokens long, lo long, hi long"
        return chunks, tokens.sparkSession.createDataFrame(rows, schema)
    side = sums_before(totals, "to", "queue")
    every = totals.agg(F.sum("to").alias("tokens"))
    rows = side.join(F.broadcast(every)).select(  # a single row beside each
        "queue", F.lit(0).cast("long").alias("from"), "to", F.lit(0).cast("long").alias("out"),
        "tokens", F.col("before").alias("lo"), (F.col("before") + F.col("to")).alias("hi"),
    )
    return chunks, rows


def runs(first: int, n: int, phase: tuple[int, int, int, int, int, int], window: int, length: int):
    """Cut n tokens from place `first` of a queue: (skipped, size, place in the output) of each piece."""
    start, _, out, tokens, lo, hi = phase
    k, end = first - start, first - start + n

    def mark(w: int, bound: int) -> int:  # tokens of the windows before w that lie below a bound
        return min(w * window, tokens) * bound // tokens

    w = k * tokens // ((hi - lo) * window)
    while mark(w, hi) - mark(w, lo) > k:
        w -= 1
    while k < end:
        while mark(w + 1, hi) - mark(w + 1, lo) <= k:
            w += 1
        ends = min(end, mark(w + 1, hi) - mark(w + 1, lo))
        place = out + min(w * window, tokens) + mark(w + 1, lo) - mark(w, lo) + k - (mark(w, hi) - mark(w, lo))
        while k < ends:
            size = min(ends - k, length - place % length)
            yield k + start - first, size, place
            k, place = k + size, place + size


def _cut(window: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, queue, n, first, ids, plan in zip(*batch.columns):
                doc_id, queue, n, first, ids = (x.as_py() for x in (doc_id, queue, n, first, ids))
                kind = np.dtype(f"<u{len(ids) // n}")
                held = np.frombuffer(ids, kind).astype("<u4")
                for p in plan.as_py():
                    phase = (p["from"], p["to"], p["out"], p["tokens"], p["lo"], p["hi"])
                    a, b = max(first, phase[0]), min(first + n, phase[1])
                    if a >= b:
                        continue
                    for skipped, size, place in runs(a, b - a, phase, window, length):
                        start = a - first + skipped
                        crc = zlib.crc32(held[start : start + size].tobytes())
                        rows.append((doc_id, queue, start, size, crc, n, place // length, place % length))
            columns = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    return run


def pack(
    docs: DataFrame, tokenizer: str, *, targets: dict[str, float] | None = None,
    length: int = LENGTH, window: int = WINDOW,
) -> DataFrame:
    """A row per piece: its document, start and length there, checksum of its ids, sequence and offset."""
    if targets is not None:
        targets = {"": 1.0} | targets
        named = F.col("source").isin([q for q in targets if q])
        docs = docs.withColumn("source", F.when(named, F.col("source")).otherwise(""))
    tokens = tokenized(docs, tokenizer)
    chunks, rows = _schedule(tokens, targets)
    plan = rows.groupBy("queue").agg(
        F.sort_array(F.collect_list(F.struct("from", "to", "out", "tokens", "lo", "hi"))).alias("plan")
    )
    # Written, so that their size is known: Spark broadcasts them if they are small enough.
    places = written(chunks.join(plan, "queue"), "packing-plan")
    placed = tokens.join(places, ["queue", "chunk"]).select(
        "doc_id", "queue", "n", (F.col("before") + F.col("within")).alias("first"), "ids", "plan"
    )
    return placed.mapInArrow(_cut(window * length, length), PIECES)
