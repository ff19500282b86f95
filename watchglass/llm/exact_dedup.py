"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

Texts are equal if they are identical after each run of white space became one space.
The fingerprint of n bytes x is the polynomial sum of x[i] * B**i, modulo two primes
below 2**31, and n. Polynomials compose: that of two parts one behind the other is the
first's plus B**(length of the first) times the second's. So a long text is cut into
chunks of CHUNK bytes, tasks hash the chunks of one text side by side, each shifted by
its place, and the text's fingerprint is a plain sum.

Rows of equal fingerprints form a group. A group's first row is its candidate to stay;
every other row is compared with it byte by byte, a chunk of each at a time, wherever
both chunks meet. Rows that differ in spite of their fingerprints form groups of their
own in another round, until none is left over. Groups of more than MEMBERS rows meet
several copies of their first row's chunks, one for each MEMBERS rows, so a group of any
size is spread over tasks.

Defined results: a null text counts as empty, empty texts are equal; the row of the
smallest doc_id stays, a null doc_id comes behind all others; of rows that share that
doc_id the first of the input stays, and all others go. An empty table gives no row.
Columns other than the doc_id and the text are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name, tasks, text_or_empty, written

CHUNK = 1 << 16  # bytes hashed and compared at once
MEMBERS = 256  # rows that meet one copy of a chunk
PRIMES = (2147483647, 2147483629)
BASES = (1000003019, 1500450271)
_SENT = 64  # chunks of a long text in an Arrow batch


def normalised(text: str = "text"):
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


@lru_cache(maxsize=4)
def _powers(base: int, prime: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo prime, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out[:n]


def fingerprint(data: np.ndarray, at: int, primes: tuple[int, ...]) -> list[int]:
    """What the bytes that stand at place `at` of a text add to its fingerprint."""
    wide, out = data.astype(np.uint64), []
    for base, prime in zip(BASES, primes):
        # At most 2**16 products below 2**39.
        own = int(np.dot(wide, _powers(base, prime, CHUNK)[: len(wide)]))
        out.append(own * pow(base, at, prime) % prime)
    return out


def _hashed(primes: tuple[int, ...]):
    """Replaces the last column, of bytes, and the one before, their place, by two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, places, data = batch.columns[:-2], batch.columns[-2].to_pylist(), batch.columns[-1]
            found = [
                fingerprint(np.frombuffer(x.as_buffer(), np.uint8), at, primes)
                for x, at in zip(data, places)
            ]
            f1, f2 = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*kept, f1, f2], names=[*batch.schema.names[:-2], "f1", "f2"])

    return run


def _chunks(chunk: int):
    """A row per chunk: the last column's bytes become their place and a slice of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [*batch.schema.names[:-1], "at", "data"]
            data = batch.columns[-1]
            rows, places, parts = [], [], []

            def sent():
                taken = batch.select(list(range(batch.num_columns - 1))).take(pa.array(rows, pa.int64()))
                held = [pa.array(places, pa.int64()), pa.array(parts, pa.binary())]
                return pa.RecordBatch.from_arrays([*taken.columns, *held], names=names)

            size = 0
            for i, x in enumerate(data):
                whole = memoryview(x.as_buffer())
                for at in range(0, max(len(whole), 1), chunk):
                    rows.append(i)
                    places.append(at)
                    parts.append(bytes(whole[at : at + chunk]))
                    size += len(parts[-1])
                    if size >= _SENT * CHUNK:
                        yield sent()
                        rows, places, parts, size = [], [], [], 0
            if rows:
                yield sent()

    return run


def fingerprints(texts: DataFrame, primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """row, id, n, f1, f2 of `texts` (row, id, n, text), where n is the bytes of the text."""
    keys = "row long, id long, n long"
    data = F.col("text").cast("binary")
    short = texts.where(F.col("n") <= CHUNK).select("row", "id", "n", F.lit(0).cast("long").alias("at"), data)
    whole = short.mapInArrow(_hashed(primes), f"{keys}, f1 long, f2 long")
    cut = texts.where(F.col("n") > CHUNK).select("row", "id", "n", data.alias("data")).mapInArrow(
        _chunks(CHUNK), f"{keys}, at long, data binary"
    )
    dealt = cut.repartition(tasks(texts.sparkSession), "row", "at")
    hashed = dealt.mapInArrow(_hashed(primes), f"{keys}, f1 long, f2 long")
    summed = hashed.groupBy("row", "id", "n").agg(
        *(F.pmod(F.sum(f), F.lit(p)).cast("long").alias(f) for f, p in zip(("f1", "f2"), primes))
    )
    return whole.unionByName(summed)


def _only(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """row and text of those `rows`, found by a bit per row, so that no other text is shuffled."""
    block, bit = F.bitmap_bucket_number("row"), F.bitmap_bit_position("row")
    marks = rows.groupBy(block.alias("block")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0
    # A block is 4 KB for 32,768 rows of neighbouring numbers.
    return texts.join(F.broadcast(marks), block == F.col("block")).where(marked).select("row", "text")


def _same(texts: DataFrame, open_rows: DataFrame, chunk: int, members: int) -> DataFrame:
    """row, first, same: whether each open row's bytes are those of the first row of its group."""
    copies = F.ceil(F.col("m") / members).cast("int")
    asked = open_rows.select("row", "first", F.pmod(F.xxhash64("row"), copies).cast("int").alias("copy"))
    held = asked.select(F.col("first.row").alias("row"), "first", "copy").distinct()
    data = F.col("text").cast("binary").alias("data")
    met_texts = _only(texts, asked.select("row").unionByName(held.select("row")))

    def cut(rows: DataFrame) -> DataFrame:
        met = met_texts.join(rows.hint("merge"), "row").select("first.row", "copy", F.col("row").alias("own"), data)
        return met.mapInArrow(_chunks(chunk), "row long, copy int, own long, at long, data binary")

    theirs = cut(held).select("row", "copy", "at", F.col("data").alias("held"))
    equal = cut(asked).join(theirs, ["row", "copy", "at"]).groupBy("own").agg(
        F.bool_and(F.col("data") == F.col("held")).alias("same")
    )
    return open_rows.select("row", "first").join(equal.withColumnRenamed("own", "row"), "row")


def _grouped(rows: DataFrame, *by: str) -> DataFrame:
    """row, first, m: every row but the first of each group of several, that first one and the group's size."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = rows.groupBy(*by).agg(F.min(order).alias("first"), F.count("*").alias("m")).where("m > 1")
    return rows.join(groups, list(by)).where(F.col("row") != F.col("first.row")).select("row", "id", "first", "m")


def duplicates(
    docs: DataFrame, text: str = "text", *, row: str | None = None,
    primes: tuple[int, ...] = PRIMES, chunk: int = CHUNK, members: int = MEMBERS,
) -> DataFrame:
    """A row per row of `docs`: row, doc_id, keep_id, group_size, kept, text_sha256.

    `row` names a column of `docs` that numbers its rows, as monotonically_increasing_id
    does, without large gaps; without it they are numbered here.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    kept_text = docs.select(
        number.alias("row"), F.col("doc_id").cast("long").alias("id"), normalised(text).alias("text")
    )
    texts = written(
        kept_text.select("row", "id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"), "text"),
        "exact-texts",
    )
    prints = written(fingerprints(texts, primes), "exact-prints")
    rest, found = written(_grouped(prints, "f1", "f2", "n"), "exact-open"), None
    while not rest.isEmpty():
        compared = written(_same(texts, rest, chunk, members), "exact-compared")
        same = compared.where("same").select("row", "first")
        found = same if found is None else found.unionByName(same)
        # Equal fingerprints of different texts: what is left of a group is a group of its own.
        apart = rest.join(compared.where("NOT same").select("row"), "row").withColumn("old", F.col("first.row"))
        order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        again = apart.groupBy("old").agg(F.min(order).alias("first"), F.count("*").alias("m"))
        rest = written(
            apart.select("row", "id", "old").join(again, "old")
            .where(F.col("row") != F.col("first.row")).select("row", "id", "first", "m"),
            "exact-open",
        )
    facts = texts.select("row", F.col("id").alias("doc_id"), F.col("sha").alias("text_sha256"))
    if found is None:
        return facts.select(
            "row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
            F.lit(True).alias("kept"), "text_sha256",
        )
    sizes = found.groupBy(F.col("first.row").alias("keeper")).agg((F.count("*") + 1).alias("more"))
    keeper = F.coalesce(F.col("first.row"), F.col("row")).alias("keeper")
    joined = facts.join(found, "row", "left").select("*", keeper).join(sizes, "keeper", "left")
    return joined.select(
        "row", "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("more", F.lit(1)).cast("long").alias("group_size"),
        F.col("first").isNull().alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    name = free_name(docs, "row_number")
    rows = written(docs.withColumn(name, F.monotonically_increasing_id()), "exact-rows")
    kept = duplicates(rows, text, row=name).where("kept").select(F.col("row").alias(name))
    return rows.join(kept, name, "left_semi").select(*docs.columns)
