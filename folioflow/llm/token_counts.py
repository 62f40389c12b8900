"""Token counts with overlap resynchronisation.

A text up to CHUNK characters is encoded whole. A longer one is cut into chunks that overlap; each chunk is encoded with
offsets and spliced to what came before at a boundary that is proven stable: a place in the overlap where a pre-token of
both encodings starts, at least MARGIN characters before the left chunk ends. Merges never cross pre-tokens, and the
splitting pattern reads on from a pre-token's start without looking back, so from such a place on both encodings agree
with that of the whole text; MARGIN exceeds what the pattern or an added token looks ahead. If the overlap has no such
place, it is doubled, up to the rest of the text, which is then encoded whole.

Short texts are encoded by distinct words: a space with the non-space run after it, up to a full stop or comma, is a whole
number of pre-tokens, so the counts of distinct runs are kept and summed. Texts with white space other than ASCII, with an
added token's string or with a sign right before a full stop or comma go to the library whole. Defined results: null counts as empty, with 0 tokens;
repeated rows, and rows without a doc_id (-1), are counted one by one; other columns are not looked at; an empty table gives
an empty one.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from folioflow.llm.common import texts

CHUNK = 1 << 16
OVERLAP = 512
MARGIN = 32
LIMIT = 1024
#: Distinct runs that one worker remembers (memory bound, no effect on results).
REMEMBERED = 600_000

_RUN = re.compile(r" ?[^ \t\n\r.,]+| ?[.,][^ \t\n\r]*|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: A full stop or comma in one pre-token with the sign before it: not a place to cut.
_SIGNS = re.compile(r"[.,](?<=[^\w\s].)|[.,](?<=_.)")
#: Characters that some engine counts as white space beyond space, tab, line feed and carriage return.
_ODD_ASCII = "\x0b\x0c\x1c\x1d\x1e\x1f"
_ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff]")


@cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def added_tokens(path: str) -> re.Pattern:
    names = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]
    return re.compile("|".join(map(re.escape, names)) or r"(?!)")


class ByteRuns:
    """Token ids of texts by remembered runs, for a byte-level vocabulary that keeps white space."""

    pattern, glue, remembered = _RUN, "", REMEMBERED

    def __init__(self, path: str):
        self.tok, self.added, self.known = tokenizer(path), added_tokens(path), {}
        self.marked = np.zeros(self.tok.get_vocab_size(), bool)
        self.marked[[i for x, i in self.tok.get_vocab().items() if self.marks(x)]] = True

    @staticmethod
    def marks(token: str) -> bool:
        return token.startswith("\u0120")  # a space's sign in byte-level vocabularies

    def plain(self, text: str) -> bool:
        odd = any(c in text for c in _ODD_ASCII) if text.isascii() else _ODD_SPACE.search(text)
        return not (odd or self.added.search(text) or _SIGNS.search(text))

    def runs(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def learn(self, runs: set[str]) -> None:
        """Encodes runs that are not known, all at once."""
        new = list(runs)
        words = [x for x in new if self.is_word(x)]
        for lo in range(0, len(words), 1000):
            self.known.update(zip(words[lo : lo + 1000], self.words(words[lo : lo + 1000]), strict=True))
        rest = [x for x in new if x not in self.known]
        for x, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self.known[x] = self.value(e.ids)

    def forget(self) -> None:
        """Keeps the runs that were met first, among which are the common ones."""
        if len(self.known) > self.remembered:
            for run in list(itertools.islice(self.known, self.remembered, None)):
                del self.known[run]

    @staticmethod
    def is_word(part: str) -> bool:
        """A space and letters: one pre-token, whose first token alone begins with the space's sign."""
        return part[:1] == " " and part[1:].isalpha()

    def edges(self, ids: np.ndarray) -> np.ndarray:
        """Where the words begin in the ids of words in a row."""
        return np.flatnonzero(self.marked[ids])

    def words(self, words: list[str]) -> list:
        """The values of words, read in a row; one by one should the edges not tell them apart."""
        ids = np.asarray(self.tok.encode_batch_fast([self.glue.join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = self.edges(ids)
        if len(at) != len(words) or at[0]:
            return [self.value(e.ids) for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        return self.cut(ids, at)

    @staticmethod
    def cut(ids: np.ndarray, at: np.ndarray) -> list:
        return np.diff(at, append=len(ids)).tolist()

    def values(self, some: list[str]) -> list:
        """For each text the sum of its runs' values; None where the library has to read the whole text."""
        runs = [self.runs(x) if self.plain(x) else [] for x in some]
        found = [list(map(self.known.get, x)) for x in runs]
        self.learn({x for some_runs, values in zip(runs, found, strict=True) for x, v in zip(some_runs, values, strict=True) if v is None})
        known = self.known
        out = [self.total([known[x] if v is None else v for x, v in zip(some_runs, values, strict=True)]) for some_runs, values in zip(runs, found, strict=True)]
        out = [v if x or not text else None for text, x, v in zip(some, runs, out, strict=True)]
        self.forget()
        return out

    total = staticmethod(sum)

    @staticmethod
    def value(ids: list[int]):
        return len(ids)


@cache
def byte_counts(path: str) -> ByteRuns:
    return ByteRuns(path)


def pretokens(tok, text: str) -> tuple[list[int], list[int]]:
    """The start of each word group of the encoding, and the tokens before it; a last entry for the end.

    Offsets may leave out a group's leading space, so they are rebuilt from the text that the groups cover.
    """
    e = tok.encode(text, add_special_tokens=False)
    starts, before, last, end = [], [], object(), 0
    for i, (w, (s, t)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
        if w != last or w is None:
            starts.append(end)
            before.append(i)
            last = w
        end = max(end, t)
    return [*starts, len(text)], [*before, len(e.ids)]


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """The number of tokens of text, by overlapping chunks."""
    total, at = 0, 0  # at: a proven pre-token start; total: tokens before it
    while True:
        if len(text) - at <= chunk:
            return total + len(tok.encode(text[at:], add_special_tokens=False).ids)
        starts, before = pretokens(tok, text[at : at + chunk])
        size, found = overlap, None
        while found is None and size < chunk:
            lo = at + chunk - size
            right = {lo + s for s in pretokens(tok, text[lo : lo + 2 * size])[0][1:-1]}
            found = next((i for i in range(len(starts) - 2, 0, -1) if lo < at + starts[i] <= at + chunk - margin and at + starts[i] in right), None)
            size *= 2
        if found is None:
            chunk *= 2  # one run without a boundary: widen and encode again
            continue
        total += before[found]
        at += starts[found]


def count_tokens(df: DataFrame, vocabulary: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of df; vocabulary: a byte-level tokenizer's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = byte_counts(vocabulary)
        for b in batches:
            some = b.column("text").to_pylist()
            short = coder.values([x if len(x) <= chunk else "" for x in some])
            found = [spliced_count(coder.tok, x, chunk, overlap) if len(x) > chunk else v if v is not None else len(coder.tok.encode(x, add_special_tokens=False).ids) for x, v in zip(some, short, strict=True)]
            size = pa.compute.binary_length(b.column("text")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(found, pa.int64()), pa.array([n > limit for n in found])], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
