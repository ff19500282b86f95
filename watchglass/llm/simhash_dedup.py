"""Near-duplicate documents by SimHash: all links within a few bits, through anchor points.

A fingerprint has 64 bits: of the hashes of the text's word shingles, bit by bit, what
more than half of them have. To find all pairs within 4 bits, the fingerprint is cut
into three blocks of 21, 21 and 22 bits; a pair differs by at most one bit in one block.
In a block, anchors are the words of a covering code: the Hamming code of 15 bits, whose
words come within one bit of any word, times all values of the bits left over. A
fingerprint goes to every anchor within covering radius plus threshold, 1 + 1, of its
block: 14 or 22 of them to a block of 21 bits. The anchor nearest to one
fingerprint of a pair is then also an anchor of the other.

Equal fingerprints are collapsed before. At an anchor, links are found block against
block in numpy, and of them only a spanning forest is emitted: a group of near copies
gives as many rows as it has members, and the components are the same.

Defined results: null and empty texts have fingerprint zero and are linked like others;
rows without doc_id take part and count for a component's smallest doc_id only if there
is no other. Of rows that share the smallest doc_id, the first one stays when near
duplicates are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ROW, numbered, tasks, text_or_empty, written
from .graph import components

WORDS = 4  # in a shingle
BITS = 4  # most bits in which linked fingerprints differ
SEED = 42
BLOCKS = ((0, 21), (21, 21), (42, 22))  # first bit and length; one more than BITS // 2
CODED = 15  # bits of a block under the Hamming code
GROUP = 1 << 14  # fingerprints of an anchor that are compared in one piece
_VOTES = 1 << 16  # hashes counted at once


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, A-Z in lower case, words between ASCII white space."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[: -words]))
    spans = zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """As a signed number of 64 bits."""
    found = shingle_hashes(text, words)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), _VOTES):
        octets = found[i : i + _VOTES].astype(">u8").view(np.uint8)
        counts += np.unpackbits(octets.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(found)) if len(found) else np.zeros(8, np.uint8)
    return int(bits.view(">i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """`docs`, whose column `text` is replaced by the fingerprint."""
    kept = [c for c in docs.columns if c != text]
    schema = docs.select(*kept).schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*kept, name]
            )

    return docs.select(*kept, text_or_empty(text).alias(text)).mapInArrow(run, schema)


def _errors(free: int) -> list[list[int]]:
    """By syndrome of the coded bits: the changes of up to 2 bits of a block that end in an anchor."""
    by_syndrome: list[list[int]] = [[] for _ in range(16)]
    for weight in range(3):
        for bits in combinations(range(CODED + free), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= b + 1 if b < CODED else 0
            by_syndrome[syndrome].append(sum(1 << b for b in bits))
    return by_syndrome


def _changed(block: Column, changes: Column) -> Column:
    return F.transform(changes, lambda e: block.bitwiseXOR(e))


def _anchors(fp: Column) -> Column:
    """All anchors of a fingerprint, as numbers with that of the block on top."""
    each = []
    for number, (first, length) in enumerate(BLOCKS):
        block = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1))
        syndrome = F.lit(0)
        for i in range(4):
            mask = sum(1 << b for b in range(CODED) if (b + 1) >> i & 1)
            odd = F.bit_count(block.bitwiseAND(F.lit(mask))).bitwiseAND(F.lit(1))
            syndrome = syndrome + odd * (1 << i)
        table = ";".join(",".join(map(str, e)) for e in _errors(length - CODED))
        changes = F.transform(F.split(F.lit(table), ";"), lambda t: F.split(t, ",").cast("array<bigint>"))
        base = block + F.lit(number << 22)  # a change of the block leaves the number alone
        each.append(_changed(base, F.get(changes, syndrome)))
    return F.concat(*each)


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Pairs of places that span the components of the links among `prints`."""
    left, edges = np.arange(len(prints)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]) <= bits
            if near.any():
                found = left[near].tolist()
                edges.extend((x, y) for y in found)
                queue.extend(found)
                left = left[~near]
    return edges


def _linked_groups(key: np.ndarray, prints: np.ndarray, bits: int) -> np.ndarray:
    """Starts of the runs of `key` that hold a link."""
    at, step, hit = np.arange(len(key)), 1, np.zeros(len(key), bool)
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(key))))
    while len(at):
        at = at[at + step < len(key)]
        at = at[(key[at] == key[at + step]) & ~hit[run[at]]]
        near = np.bitwise_count(prints[at] ^ prints[at + step]) <= bits
        hit[run[at[near]]] = True
        step += 1
    return starts[hit[: len(starts)]]


def _edges(bits: int, fields: int):
    """Edges of the groups of sorted rows (key fields..., fp); a group is held, not a partition."""
    def solve(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
        us, vs = [], []
        for start in _linked_groups(keys, prints, bits):
            end = ends[np.searchsorted(ends, start, side="right")]
            group = np.unique(prints[start:end])
            for x, y in _forest(group, bits):
                us.append(group[x])
                vs.append(group[y])
        out = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (us, vs)]
        return pa.RecordBatch.from_arrays(out, names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            keys = columns[0] if fields == 1 else np.rec.fromarrays(columns[:fields])
            held.append((keys, columns[fields].view(np.uint64)))
            if keys[0] == keys[-1]:
                continue
            keys, prints = (np.concatenate(c) for c in zip(*held))
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
            yield solve(keys[:last], prints[:last])
            held = [(keys[last:], prints[last:])]
        if held:
            yield solve(*(np.concatenate(c) for c in zip(*held)))

    return run


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """u, v: pairs of the distinct fingerprints `fp` that span the components of all links.

    Anchors of more than GROUP fingerprints are dealt to chunks, and each pair of chunks is a
    group of its own.
    """
    n = tasks(prints.sparkSession)
    at = written(prints.select(F.explode(_anchors(F.col("fp"))).alias("anchor"), "fp"), "anchors")
    large = at.groupBy("anchor").count().where(F.col("count") > GROUP).select(
        "anchor", F.ceil(F.col("count") / GROUP).cast("int").alias("c")
    )
    large = written(large, "large-anchors")
    small = at.join(large, "anchor", "left_anti") if not large.isEmpty() else at
    dealt = small.repartition(n, "anchor").sortWithinPartitions("anchor")
    found = dealt.mapInArrow(_edges(bits, 1), "u long, v long")
    if not large.isEmpty():
        chunk = F.pmod(F.xxhash64("fp"), F.col("c")).cast("int")
        pairs = at.join(large, "anchor").withColumn("k", chunk).withColumn(
            "o", F.explode(F.sequence(F.lit(0), F.col("c") - 1))
        ).select("anchor", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "fp")
        keys = ["anchor", "i", "j"]
        split = pairs.repartition(n, *keys).sortWithinPartitions(*keys)
        found = found.union(split.mapInArrow(_edges(bits, 3), "u long, v long"))
    return found.distinct()


def component_roots(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """fp, root: of each distinct fingerprint of `prints` that is linked, but the roots themselves."""
    found = components(links(prints.select("fp").distinct(), bits))
    return found.select(F.col("u").alias("fp"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, *, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """A row per document: doc_id, fp, component_id, the smallest doc_id of its component."""
    if words != WORDS or bits != BITS:
        raise ValueError("anchors are laid for shingles of 4 words and 4 bits")
    prints = written(with_fingerprint(docs.select("doc_id", "text")), "prints")
    rooted = _with_root(prints, F.min("doc_id"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp")


def _with_root(prints: DataFrame, least: Column) -> DataFrame:
    """fp, root, least: a row per distinct fingerprint."""
    classes = prints.groupBy("fp").agg(least.alias("least"))
    rooted = classes.join(component_roots(classes), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    return written(rooted, "roots")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each component, the first of the smallest doc_id."""
    rows = numbered(docs)
    prints = written(with_fingerprint(rows.select("doc_id", ROW, "text")), "prints")
    rooted = _with_root(prints, F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return rows.join(kept, ROW, "left_semi").select(*docs.columns)
