"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence has a probability p of being toxic, logistic in the sum of its words' weights.
A document is toxic with 1 - prod(1 - p), the noisy-or of its sentences. The weights are
learnt from the labels of documents, by stochastic gradient steps (AdaGrad) on that
likelihood. The sentences to blame for a toxic document are then those of high p, and
besides these its most probable ones, as many as it takes for the noisy-or of the rest
to stay under THRESHOLD; so a toxic document always has one at least.

A word counts by itself and by its beginnings of four and five letters, hashed into
SLOTS weights, so that inflected forms share weight.

Training takes a documented sample, at most MAX_TRAINING labelled documents, those of the
least hash of doc_id. Spark finds and hashes them; as their number is bounded, one task
can take the steps. Weights are drawn to zero (L1), so that few words count at all. What
passes through the driver are at most SLOTS numbers.

Defined results: a null or empty text, or one without words, is one empty sentence; labels
that are null or of other values than 0 and 1 are not learnt from; of several labels of a
document the highest counts. Without a toxic label all scores come from the start weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_or_empty, written

SLOTS = 1 << 18
MAX_TRAINING = 8_000  # labelled documents that the weights are fitted to
ROUNDS, PASSES = 3, 3  # the step sizes start anew with a round
RATE = 0.1
SPARSITY = 0.01  # of the penalty on the weights' absolute values
BIAS = -6.0  # of an empty sentence, at the start
THRESHOLD = 0.3  # a document of this score or more is toxic
SENTENCE_THRESHOLD = 0.5  # a sentence of this probability or more is always to blame
_CACHED = 200_000  # words whose weight a task remembers
_END = "\x00"

_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def slots(word: str) -> tuple[int, int, int]:
    """The slots of a word as it stands in a text; slot 0 counts nothing."""
    bare = _EDGE.sub("", word).lower()
    if not bare:
        return 0, 0, 0
    found = (bare, f"4{bare[:4]}", f"5{bare[:5]}")
    return tuple(1 + zlib.crc32(f.encode("utf-8", "surrogatepass")) % (SLOTS - 1) for f in found)


def _pieces(text: str) -> list[str]:
    """Words, with _END for each end of line."""
    return text.replace(_END, " ").replace("\n", f" {_END} ").split()


def _ends(word: str) -> bool:
    return word == _END or word[-1] in ".!?"


def _starts(ends: np.ndarray) -> np.ndarray:
    """First places of the sentences, given which words end one."""
    return np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1)) if len(ends) else np.zeros(1, int)


def _noisy_or(logits: np.ndarray) -> float:
    """Log of the probability that no sentence is toxic."""
    return -float(np.logaddexp(0.0, logits).sum())


def _to_blame(found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Of sentences (start, end, logit) those to blame, in order, with their probabilities."""
    logits = np.array([x for _, _, x in found])
    p = 1 / (1 + np.exp(-np.clip(logits, -500, 500)))
    order = np.argsort(-logits, kind="stable")
    none = -np.logaddexp(0.0, logits[order])
    rest = -np.expm1(np.cumsum(none[::-1])[::-1])  # noisy-or of a sentence and all less probable ones
    n = max(1, int((p >= SENTENCE_THRESHOLD).sum()), int((rest >= THRESHOLD).sum()))
    return [(*found[i][:2], float(p[i])) for i in sorted(order[:n].tolist())]


class Weights:
    """Scores texts; remembers the weights of the words that it met last."""

    def __init__(self, values: np.ndarray, bias: float) -> None:
        self.values, self.bias, self.cache = values, bias, {}

    def _look_up(self, word: str) -> float:
        if len(self.cache) >= _CACHED:
            self.cache.clear()
        found = 0.0 if word == _END else float(self.values[list(slots(word))].sum())
        self.cache[word] = found
        return found

    def score(self, text: str) -> float:
        """The probability that a text is toxic."""
        words = _pieces(text)
        if not words:
            return -math.expm1(_noisy_or(np.array([self.bias])))
        get, look_up = self.cache.get, self._look_up
        weights = [x if (x := get(w)) is not None else look_up(w) for w in words]
        ends = np.fromiter((w[-1] in ".!?\x00" for w in words), bool, len(words))
        return -math.expm1(_noisy_or(np.add.reduceat(weights, _starts(ends)) + self.bias))

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and probability of the sentences to blame if `text` is toxic, in code points."""
        found = []
        for line in re.finditer(r"[^\n]+", text.replace(_END, " ")):
            words = list(re.finditer(r"\S+", line.group()))
            total, first = self.bias, None
            for i, m in enumerate(words):
                first = m.start() if first is None else first
                known = self.cache.get(m.group())
                total += self._look_up(m.group()) if known is None else known
                if _ends(m.group()) or i == len(words) - 1:
                    found.append((line.start() + first, line.start() + m.end(), total))
                    total, first = self.bias, None
        return _to_blame(found or [(0, 0, self.bias)])


def _examples(docs: DataFrame, labels: DataFrame, learn: Column) -> DataFrame:
    """y, slots, starts: the training documents as hashed words; `learn` picks doc_ids."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING)
    # at most MAX_TRAINING rows of two numbers: small enough for every executor
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    joined = texts.join(F.broadcast(sample), "doc_id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int, int]] = {}
        for batch in batches:
            rows, firsts = [], []
            for text in batch.column(1).to_pylist():
                words = _pieces(text)
                for w in words:
                    if w not in known:
                        if len(known) >= _CACHED:
                            known.clear()
                        known[w] = (0, 0, 0) if w == _END else slots(w)
                rows.append(list(chain.from_iterable(known[w] if w in known else slots(w) for w in words)))
                firsts.append(_starts(np.array([_ends(w) for w in words], bool)).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int32())), pa.array(firsts, pa.list_(pa.int32()))],
                names=["y", "slots", "starts"],
            )

    return joined.mapInArrow(run, "y int, slots array<int>, starts array<int>")


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights of the training documents, where they are not zero."""
    docs = []
    for batch in batches:
        for y, s, f in zip(*batch.columns):
            flat = s.values.to_numpy() if len(s) else np.zeros(0, np.int32)
            starts, n = f.values.to_numpy(), len(flat) // 3
            counts = np.diff(np.append(starts, n)) if n else np.zeros(1, int)
            where, back = np.unique(np.append(flat, np.full(len(counts), SLOTS)), return_inverse=True)
            docs.append((y.as_py(), flat, starts, counts, where, back))
    w, order = np.zeros(SLOTS + 1), np.random.default_rng(0)
    w[SLOTS] = BIAS
    for _ in range(ROUNDS):
        past = np.full(SLOTS + 1, 1e-2)
        for i in chain.from_iterable(order.permutation(len(docs)) for _ in range(PASSES)):
            y, flat, starts, counts, where, back = docs[i]
            words = w[flat].reshape(-1, 3).sum(axis=1)
            logits = (np.add.reduceat(words, starts) if len(words) else np.zeros(1)) + w[SLOTS]
            step = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            if y:
                none = _noisy_or(logits)
                step = step * math.exp(none) / min(-1e-12, math.expm1(none))
            each = np.append(np.repeat(np.repeat(step, counts), 3) if len(words) else [], step)
            g = np.bincount(back, weights=each)
            past[where] += g * g
            rate = RATE / np.sqrt(past[where])
            moved = w[where] - rate * g
            shrunk = np.sign(moved) * np.maximum(np.abs(moved) - rate * SPARSITY, 0.0)
            shrunk[-1] = moved[-1]  # the bias, whose slot is the last
            w[where] = shrunk
            w[0] = 0.0
    slot = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(w[slot])], names=["slot", "w"])


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, float]:
    """Weights of the slots and the bias; `learn` is a condition on doc_id."""
    examples = written(_examples(docs, labels, learn), "toxic-examples")
    values = np.zeros(SLOTS + 1)
    values[SLOTS] = BIAS
    if examples.groupBy().agg(F.sum("y")).first()[0]:
        fitted = examples.coalesce(1).mapInArrow(_fit, "slot int, w double").toPandas()
        values[SLOTS] = 0.0
        values[fitted["slot"].to_numpy()] = fitted["w"].to_numpy()
    return values[:SLOTS], float(values[SLOTS])


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, locate: bool = True) -> DataFrame:
    """doc_id, score, sentences: (start, end, score) of those to blame, in documents that are toxic."""
    values, bias = model[0].astype(np.float32), model[1]
    places = "array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(values, bias)
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1):
                text = text.as_py()
                scores.append(weights.score(text))
                toxic = locate and scores[-1] >= THRESHOLD
                found.append([dict(zip(("start", "end", "score"), s)) for s in weights.sentences(text)] if toxic else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)],
                names=["doc_id", "score", "sentences"],
            )

    texts = docs.select("doc_id", text_or_empty().alias("text"))
    kept = docs.select("doc_id").schema.add("score", "double")
    schema = f"doc_id {kept['doc_id'].dataType.simpleString()}, score double, sentences {places}"
    return texts.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training, by the checksum of its id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` whose score is under THRESHOLD; the weights are learnt from their labels."""
    values, bias = train(docs, labels, ~held_out())
    values = values.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(values, bias)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            keep = [weights.score(t.as_py() or "") < THRESHOLD for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
