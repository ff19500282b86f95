"""Encoding with the pieces of a SentencePiece vocabulary, as the best way through a lattice of substrings.

A text gets a space in front, spaces become U+2581, and it is cut before each run of that
character into words, nowhere else: no piece goes on behind such a place. The substrings of
a word that are pieces, a fixed vocabulary, are the edges of a lattice over the word's
places. It is folded from place to place: the best way to a place is the best of the ways
to the edges' starts plus the edge. The ways are then walked back. A code point that is no
piece is an edge by itself, written as the vocabulary's byte pieces. Of equal ways the one
whose last piece is longer wins.

The file holds merge ranks, not probabilities. An edge scores -ln(rank + 2), the
probability that Zipf's law gives to the rank, so that the best way has few and frequent
pieces.

Documents are encoded where they are read, in Arrow batches, and nothing is shuffled or
written: a row per word would be several times the input. Words of all lengths are folded by
the same code, with a few numbers per code point; the tasks that meet a word remember its ids,
REMEMBERED words at once, words over JOINED code points apart, which seldom come again.
Decoding looks the ids up in the table of the pieces' bytes.

Defined results: a null or empty text has no pieces; every row has a result of its own,
whatever its doc_id. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import text_or_empty

SPACE = "▁"
LONGEST = (1 << 31) - 1  # code points of a word, more than a text can have: none is cut
JOINED = 128  # code points of the longest words whose places in the texts share one fold
REMEMBERED = 1 << 18  # words whose ids a task holds; it begins anew when it has met so many
FLUSH = 1 << 22  # ids from which a task hands its rows on
_UNKNOWN = -30.0  # score of a code point that is no piece, under any piece's
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


@dataclass
class Pieces:
    """A vocabulary: `text`, `id`, `rank` of the normal pieces, and the bytes of all as hexadecimal text."""

    rows: list[tuple[str, int, int]]
    octets: list[str]
    byte_ids: list[int]

    @classmethod
    def load(cls, path: str) -> "Pieces":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows, octets, byte_ids = [], [], [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            special = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                octets.append(piece[3:5])
            else:
                octets.append("" if special else piece.encode().hex())
                if not special:
                    rows.append((piece, i, len(rows)))
        return cls(rows, octets, byte_ids)

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, score: as many rows as the vocabulary has, whatever the data."""
        df = spark.createDataFrame(self.rows, "piece string, id int, rank int")
        return df.select("piece", "id", (-F.log(F.col("rank") + 2.0)).alias("score"))


class _Words(dict):
    """The packed ids of words, each folded when it is first asked for."""

    def __init__(self, known: dict[str, tuple[int, float]], byte_ids: list[int]) -> None:
        self.known, self.byte_ids = known, byte_ids
        # By code point: what the pieces go on with there, and the score of the piece that ends there, if any.
        self.tree: dict[str, tuple[dict, float | None]] = {}
        for piece, (_, score) in sorted(known.items(), key=lambda x: len(x[0])):
            node = self.tree
            for c in piece[:-1]:
                node = node.setdefault(c, ({}, None))[0]
            node[piece[-1]] = ({}, score)

    def fold(self, word: str) -> list[int]:
        """The ids of the best way through a word. Edges to a place come longest first, so that of equal ways it wins."""
        n = len(word)
        scores, backs = [0.0, *[-math.inf] * n], [0] * (n + 1)
        for start in range(n):
            here, node = scores[start], self.tree
            for end in range(start, n):
                found = node.get(word[end])
                if found is None:
                    break
                node, score = found
                if score is not None and here + score > scores[end + 1]:
                    scores[end + 1], backs[end + 1] = here + score, start
            if word[start] not in self.known and here + _UNKNOWN > scores[start + 1]:
                scores[start + 1], backs[start + 1] = here + _UNKNOWN, start
        out, at = [], n
        while at:
            piece = word[backs[at] : at]
            if found := self.known.get(piece):
                out.append(found[0])
            else:
                out += [self.byte_ids[b] for b in reversed(piece.encode())]
            at = backs[at]
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.fold(word)).tobytes()
        if len(word) <= JOINED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


def decoded(ids: list[int], octets: list[bytes]) -> str:
    """The text of ids; `octets` has the bytes of each piece."""
    whole = b"".join([octets[i] for i in ids]).decode()
    return whole.replace(SPACE, " ")[1:]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """doc_id, ids and the text that they give back, a row per document."""
    pieces = Pieces.load(path)
    # The vocabulary's rows, whatever the data, with scores that Spark computed.
    known = {r.piece: (r.id, r.score) for r in pieces.table(docs.sparkSession).collect()}
    byte_ids, octets = pieces.byte_ids, [bytes.fromhex(x) for x in pieces.octets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words(known, byte_ids)
        for batch in batches:
            first, ids, ends, texts = 0, array("i"), [0], []
            for k, text in enumerate(batch.column(1), 1):
                whole = SPACE + text.as_py().replace(" ", SPACE)
                if len(whole) > 1:
                    ids.frombytes(b"".join(words[m[0]] for m in _WORD.finditer(whole)))
                texts.append(decoded(ids[ends[-1] :].tolist(), octets))
                ends.append(len(ids))
                if len(ids) >= FLUSH or k == len(batch):
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.intc), pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, k - first), lists, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"]
                    )
                    first, ids, ends, texts = k, array("i"), [0], []

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
