"""Token ids of texts by the tokenizers library, with a memory of words."""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

END = 0  # the id behind each document
_CACHED = 1_000_000  # units that a worker remembers
_LONGEST = 64  # code points of a unit worth remembering

# A byte-level vocabulary never joins what these units separate, if a text has no white
# space but spaces and line ends: letters with the space before them, up to white space or
# a mark of punctuation; else a word with its space, marks and all; or a run of space.
_UNIT = re.compile(
    r" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+(?![^ \n.,:;!?])| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]+"
)
_OTHER_SPACE = re.compile(
    "[\\x00-\\x09\\x0b-\\x1f\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200f\\u2028-\\u202f\\u205f-\\u206f\\u3000\\ufeff]"
)


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printed else next(others)) for b in range(256)}


class Encoder:
    """Ids of whole texts; units met before are not encoded again."""

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.units: dict[str, bytes] = {}
        made = json.loads(self.tokenizer.to_str())
        before = made["pre_tokenizer"] or {}
        #: Whether the model can be asked for words at once, without the steps around it.
        self.byte_level = (
            made["normalizer"] is None and made["model"]["type"] == "BPE" and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
        )
        self.letters = _byte_letters()

    @property
    def width(self) -> np.dtype:
        """The narrowest type that holds every id."""
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        return np.dtype("<u2" if small else "<u4")

    def _direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        """The ids of units, from the library's model."""
        tokenize, parts, letters = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str, self.letters
        found, space = {}, letters[32]
        for u in new:
            word = u[1:] if u[0] == " " else u
            if not word.isalpha():
                ids = [t.id for part, _ in parts(u) for t in tokenize(part)]
            elif word.isascii():  # one word, whole, whose bytes are written as they are
                ids = [t.id for t in tokenize(u if word is u else space + word)]
            else:
                ids = [t.id for t in tokenize(u.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))]
            found[u] = np.array(ids, "<u4").tobytes() if sys.byteorder == "big" else array("I", ids).tobytes()
        return found

    def encode(self, text: str) -> bytes:
        """The ids, as unsigned little-endian numbers of 32 bits, without the end id."""
        if not text:
            return b""
        if not self.byte_level or _OTHER_SPACE.search(text) or any(s in text for s in self.special):
            return self._direct(text)
        units, held = _UNIT.findall(text), self.units
        try:
            return b"".join([held[u] for u in units])
        except KeyError:
            found = self._learn([u for u in dict.fromkeys(units) if u not in held])
        out = b"".join([held[u] if u in held else found[u] for u in units])
        for u, ids in found.items():
            if len(u) <= _LONGEST:
                if len(held) >= _CACHED:
                    held.clear()
                held[u] = ids
        return out

    def document(self, text: str) -> bytes:
        """The ids of a document with the end id."""
        return self.encode(text) + END.to_bytes(4, "little")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this process: what it remembers serves all tasks of a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks are the parallel part
    return Encoder(path)
