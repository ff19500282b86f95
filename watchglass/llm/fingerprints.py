"""Document fingerprints: SimHash over weighted terms, and search within a Hamming radius.

A text's terms are its word triples (shorter texts: all their words as one term), of
words in lower case; a stretch without white space of more than LONG code points is cut
into words of SHORT. A term weighs 1 + ln of how often it occurs. Its hash has BITS bits,
each of which votes with the weight, up if set, down if not; the fingerprint has a bit
where the votes are above zero. The share of equal bits is the likeness of two texts:
1 - angle/pi of their term vectors, about 1/2 for unrelated ones, scaled here so that
this 1/2 is 0.

Search: RADIUS is a likeness of 3/4, which texts keep of which a few words are changed. A
fingerprint within RADIUS = 31 bits of another differs from it by at most one bit in at
least one of 16 blocks of 16 bits. So there is a table for each block, the fingerprint
permuted so that the block leads, keyed by that block; a fingerprint asked for looks in
each table under its own key and those one bit away, and what it meets is verified by the
full distance. Copies, of equal fingerprint, are one row of each table. As keys have 16
bits, 0.4% of unrelated pairs are compared.

Defined results: a null text is empty; a text without words has fingerprint zero; rows
of equal doc_id are ordered by their texts; a null doc_id comes first. In a table of one
row, that row is its own next document.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import ranged, tasks, text_or_empty, written

BITS = 256
WORDS = 3  # of a term
LONG, SHORT = 40, 8
RADIUS = 31  # bits in which fingerprints found by search may differ
BLOCKS = 16  # tables of the search
GROUP = 1 << 12  # fingerprints of a table's key that are compared in one piece
_SUMS = 1 << 13  # sums of a batch
_VOTES = 1 << 13  # terms that vote at once


def words(text: str) -> list[str]:
    found = []
    for w in text.lower().split():
        if len(w) <= LONG:
            found.append(w)
        else:
            found.extend(w[i : i + SHORT] for i in range(0, len(w), SHORT))
    return found


def fingerprint(text: str) -> bytes:
    """BITS bits, as bytes."""
    parts = words(text)
    if not parts:
        return bytes(BITS // 8)
    if len(parts) < WORDS:
        terms = {" ".join(parts): 1}
    else:
        terms = Counter(map(" ".join, zip(*(parts[i:] for i in range(WORDS)))))
    digest = xxhash.xxh3_128_digest
    votes, total, batch, weights = np.zeros(BITS), 0.0, [], []
    for term, n in terms.items():
        data = term.encode("utf-8", "surrogatepass")
        batch.append(digest(data, 1) + digest(data, 2))
        weights.append(1.0 if n == 1 else 1.0 + math.log(n))
        if len(batch) == _VOTES:
            votes, total = votes + _up(batch, weights), total + sum(weights)
            batch, weights = [], []
    if batch:
        votes, total = votes + _up(batch, weights), total + sum(weights)
    return np.packbits(2 * votes > total).tobytes()


def _up(hashes: list[bytes], weights: list[float]) -> np.ndarray:
    """Weight of the votes for each bit."""
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, BITS // 8), axis=1)
    return np.array(weights, np.float32) @ bits.astype(np.float32)


def likeness(a: bytes, b: bytes) -> float:
    """0 for unrelated texts, 1 for equal ones."""
    differ = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count()
    return max(0.0, 1.0 - 2.0 * differ / BITS)


def edited(text: str, following: str) -> str:
    """`text` whose last half is replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fp binary, edited_fp binary, "
    "near_edited double, near_next double"
)
_EDGE = f"{_RESULT}, part int, side string, text string"


def _row(doc_id, text: str, fp: bytes, following: str, next_fp: bytes) -> tuple:
    changed = edited(text, following)
    changed_fp = fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, fp, changed_fp, likeness(fp, changed_fp), likeness(fp, next_fp)


_KINDS = [
    pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(),
    pa.int32(), pa.string(), pa.string(),
]
_FIELDS = [f.split()[0] for f in _EDGE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=_FIELDS)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all documents but a partition's last, and the first and last ones with their texts."""
    held = None
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text, part in zip(*batch.columns):
            doc_id, text = doc_id.as_py(), text.as_py()
            fp = fingerprint(text)
            if held is None:
                part = part.as_py()
                rows.append((doc_id, len(text), None, fp, None, None, None, part, "first", text))
            else:
                rows.append((*_row(*held, text, fp), None, None, None))
            held = doc_id, text, fp
        if rows:
            yield _batch(rows)
    if held is not None:
        doc_id, text, fp = held
        yield _batch([(doc_id, len(text), None, fp, None, None, None, part, "last", text)])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the partitions' last documents, each beside the next partition's first."""
    for batch in batches:
        rows = [_row(*(x.as_py() for x in row)) for row in zip(*batch.columns)]
        yield _batch([(*r, None, None, None) for r in rows]).select(_FIELDS[:7])


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint and its edited text's, and how near it is to that and the next."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sorted_texts = ranged(texts, F.col("doc_id"), F.xxhash64("text"))
    made = written(sorted_texts.mapInArrow(_within, _EDGE), "fingerprints")
    edges = made.where("side IS NOT NULL")
    # One row per partition; a window over their numbers finds the next that is not empty.
    numbers = edges.where("side = 'first'").select("part")
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    least = numbers.agg(F.min("part")).first()[0]
    after = numbers.withColumn("next", F.coalesce(F.lead("part").over(order), F.lit(least)))
    first = edges.where("side = 'first'").select(
        F.col("part").alias("next"), F.col("text").alias("following"), F.col("fp").alias("next_fp")
    )
    pairs = edges.where("side = 'last'").join(after, "part").join(first, "next")
    last = pairs.select("doc_id", "text", "fp", "following", "next_fp").mapInArrow(_across, _RESULT)
    done = made.where("side IS NULL").select(*_FIELDS[:7])
    return done.unionByName(last)


def _least_changes(radius: int) -> list[int]:
    """For each block, a number of bits such that a pair within the radius is within it in one block.

    The numbers plus 1 add up to radius + 1: were a pair further apart in every block, it
    would differ in more bits than the radius. -1 leaves a block out.
    """
    share, more = divmod(radius + 1, BLOCKS)
    return [share - (i >= more) for i in range(BLOCKS)]


def _block(fp: Column, number: int) -> Column:
    """Key of the table of a block: the bits that lead once the fingerprint is permuted."""
    size = BITS // 8 // BLOCKS
    return F.conv(F.hex(F.substring(fp, number * size + 1, size)), 16, 10).cast("int")


def _table(prints: DataFrame, number: int, bits: int) -> DataFrame:
    """block, key, fp: of each fingerprint, the keys that differ from its own in `bits` bits at most."""
    width = BITS // BLOCKS
    changes = [sum(1 << b for b in c) for n in range(bits + 1) for c in combinations(range(width), n)]
    masks = F.split(F.lit(",".join(map(str, changes))), ",").cast("array<int>")
    keyed = prints.select("fp", _block(F.col("fp"), number).alias("own"))
    return keyed.select(
        F.lit(number).alias("block"), F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("key"), "fp"
    )


def _met(prints: DataFrame, asked: DataFrame, radius: int) -> DataFrame:
    """block, key, chunk, asked, fp, copies: the rows of both sides, dealt and sorted so that what meets is together.

    A key of more than GROUP fingerprints is dealt to chunks; those asked go to each.
    """
    used = [(i, t) for i, t in enumerate(_least_changes(radius)) if t >= 0]
    keys = F.array(*(F.struct(F.lit(i).alias("block"), _block(F.col("fp"), i).alias("key")) for i, _ in used))
    rows = prints.select(F.explode(keys).alias("k"), "fp", "copies").select("k.block", "k.key", "fp", "copies")
    # Only keys of many fingerprints are listed: at most a row for GROUP rows of the tables.
    large = rows.groupBy("block", "key").count().where(F.col("count") > GROUP).select(
        "block", "key", F.ceil(F.col("count") / GROUP).cast("int").alias("c")
    )
    large = written(large, "large-blocks")
    probes = reduce(DataFrame.unionByName, (_table(asked, i, t) for i, t in used))

    def chunks(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(large), ["block", "key"], "left").withColumn("c", F.coalesce("c", F.lit(1)))

    ours = chunks(rows).select(
        "block", "key", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int").alias("chunk"),
        F.lit(False).alias("asked"), "fp", "copies",
    )
    theirs = chunks(probes).select(
        "block", "key", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("chunk"),
        F.lit(True).alias("asked"), "fp", F.lit(0).cast("long").alias("copies"),
    )
    order = ["block", "key", "chunk"]
    n = tasks(prints.sparkSession)
    return ours.unionByName(theirs).repartition(n, *order).sortWithinPartitions(*order, "asked")


def _pairs(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[tuple]:
    """asked, fingerprints within the radius, their copies and distances, where each pair is met first.

    What is held are the fingerprints of one chunk.
    """
    least = np.array(_least_changes(radius))
    place, parts, held = None, [], None
    for batch in batches:
        sides, copies = batch.column(3).to_pylist(), batch.column(5).to_numpy()
        places = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        prints = _matrix(batch.column(4))
        at = 0
        while at < len(places):
            end = at + 1
            while end < len(places) and places[end] == places[at] and sides[end] == sides[at]:
                end += 1
            if places[at] != place:
                place, parts, held = places[at], [], None
            if not sides[at]:
                parts.append((prints[at:end], copies[at:end]))
            elif parts:
                if held is None:
                    held = tuple(np.concatenate(c) for c in zip(*parts))
                for q in prints[at:end]:
                    changed = np.bitwise_count(held[0] ^ q)
                    distance = changed.sum(axis=1, dtype=np.int64)
                    keep = np.flatnonzero(distance <= radius)
                    if len(keep):
                        blocks = changed[keep].reshape(len(keep), BLOCKS, -1).sum(axis=2, dtype=np.int64)
                        keep = keep[(blocks <= least).argmax(axis=1) == place[0]]
                    if len(keep):
                        yield q.tobytes(), held[0][keep], held[1][keep], distance[keep]
            at = end


def within_radius(prints: DataFrame, asked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """asked, found, distance: for each fingerprint `asked`, all of `prints` within the radius.

    Both have a binary column `fp`; give each fingerprint once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for q, found, _, distance in _pairs(batches, radius):
            yield pa.RecordBatch.from_arrays(
                [pa.array([q] * len(found), pa.binary()), pa.array([f.tobytes() for f in found], pa.binary()),
                 pa.array(distance, pa.int32())], names=["asked", "found", "distance"],
            )

    met = _met(prints.select("fp", F.lit(1).cast("long").alias("copies")), asked.select("fp"), radius)
    return met.mapInArrow(run, "asked binary, found binary, distance int")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), BITS // 8)


def near_counts(made: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """`made` with n_near: documents within the radius of those `asked` for, the row itself included.

    Null for rows that are not asked. No row is made for a pair: a chunk gives a sum for each
    fingerprint that is asked there.
    """
    classes = written(made.groupBy("fp").agg(F.count("*").alias("copies")), "fingerprint-classes")
    queries = made.where(asked).select("fp").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[bytes, int]] = []
        for q, _, copies, _ in _pairs(batches, radius):
            sums.append((q, int(copies.sum())))
            if len(sums) == _SUMS:
                yield _as_sums(sums)
                sums = []
        yield _as_sums(sums)

    found = _met(classes, queries, radius).mapInArrow(run, "asked binary, near long")
    near = found.groupBy("asked").agg(F.sum("near").alias("near"))
    joined = made.join(near, made["fp"] == near["asked"], "left")
    return joined.select(*made.columns, F.when(asked, F.col("near")).alias("n_near"))


def _as_sums(sums: list[tuple[bytes, int]]) -> pa.RecordBatch:
    columns = [pa.array([q for q, _ in sums], pa.binary()), pa.array([n for _, n in sums], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["asked", "near"])
