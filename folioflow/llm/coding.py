"""Token ids of whole texts as bytes, through the tokenizers library and a bounded memory of distinct runs.

A run is a piece of text that the tokenizer's splitting never joins with its neighbours, so the ids of a text are those of
its runs in order: for a byte-level vocabulary a space with the non-space run after it, for a vocabulary that drops white
space a word. Texts for which that is not certain (other white space, strings of added tokens) go to the library whole.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np

from folioflow.llm.token_counts import ByteRuns


class ByteIds(ByteRuns):
    """text -> ids as unsigned 32-bit numbers in the machine's order, which is little-endian wherever Spark runs."""

    @staticmethod
    def value(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    @staticmethod
    def total(values: Iterator[bytes]) -> bytes:
        return b"".join(values)

    @staticmethod
    def cut(ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        raw, places = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in itertools.pairwise(places)]

    def ids(self, some: list[str]) -> list[bytes]:
        """The ids of each text."""
        return [v if v is not None else self.value(self.tok.encode(x, add_special_tokens=False).ids) for x, v in zip(some, self.values(some), strict=True)]


class WordIds(ByteIds):
    """For a vocabulary that drops white space and case and marks the ends of words."""

    glue, remembered = " ", 400_000

    @staticmethod
    def marks(token: str) -> bool:
        return token.endswith("</w>")

    @staticmethod
    def is_word(part: str) -> bool:
        return part.isalpha()

    def edges(self, ids: np.ndarray) -> np.ndarray:
        last = np.flatnonzero(self.marked[ids])
        return np.append(0, last[:-1] + 1) if len(last) and last[-1] == len(ids) - 1 else last[:0]

    def runs(self, text: str) -> list[str]:
        """Words, and signs from a full stop or comma on, in lower case where the text's characters leave no doubt of it."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            pass
        else:
            text = text.lower()
        return text.replace(".", " .").replace(",", " ,").split()


@cache
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)
