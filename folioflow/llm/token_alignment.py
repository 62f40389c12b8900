"""Alignment of two tokenizers' ids of one text, and how often the corpus links each pair of ids.

Both id lists of a text cover the same bytes. Two dictionaries, from each cumulative end to the number of tokens up to it,
are intersected as hash sets; the sorted common ends slice both lists into groups, and in each slice the tokens whose byte
ranges overlap are linked.

Most of a text consists of runs that occur in many texts: white space with the other characters after it. Neither tokenizer
has a token that begins before a run and ends in it (the first by its splitting pattern; of the second it is read off the
vocabulary), so every end of a run is a common end, and a text's groups and links are those of its runs in order. New runs
are read in a row, aligned as one text and remembered; a text with white space of other kinds, or with a run that one of
the tokenizers changes, is aligned as a whole.

On Spark: one pass writes each text's digest and its distinct pairs with how often it holds them; the pairs are counted
with partial aggregation (at most one row for each pair of ids, whatever the input), and the counts are joined back, by
broadcast up to BROADCAST_PAIRS rows and by merge beyond; sums by row are again aggregated before they move.

Defined results: a null or empty text, and one that a tokenizer changes (its tokens' bytes are not a space and the text),
has no tokens: zeros and an empty groups_sha256; repeated rows, and rows without a doc_id (-1), are documents of their own;
a very long text is read whole in one task and needs some times its size; other columns are not looked at; an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SLICE_BYTES, slices, stored, texts
from folioflow.llm.token_counts import _ODD_SPACE

#: Distinct runs that one worker remembers (memory bound, no effect on results).
REMEMBERED = 300_000
#: Pairs whose counts are sent to all executors (some 60 bytes each there); more are joined by merge.
BROADCAST_PAIRS = 2_000_000
#: New runs that are read in a row.
_CHUNK = 2000

_RUN = re.compile(r"[ \t\n]*[^ \t\n]+|[ \t\n]+")
#: Characters other than space, tab and line feed that some splitting pattern counts as white space.
_ODD = re.compile(f"\r|{_ODD_SPACE.pattern}")
_JOINED = re.compile("[^▁ \t\n][▁ \t\n]")


def byte_signs() -> dict[str, int]:
    """The byte for each sign of a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if chr(b) not in signs]
    return signs | {chr(256 + k): b for k, b in enumerate(hidden)}


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens up to each common end, in both lists: hash-set intersection of the end-to-index dictionaries."""
    index_a = dict(zip(ends_a.tolist(), range(1, len(ends_a) + 1), strict=True))
    index_b = dict(zip(ends_b.tolist(), range(1, len(ends_b) + 1), strict=True))
    common = sorted(index_a.keys() & index_b.keys())
    n = len(common)
    return np.fromiter(map(index_a.__getitem__, common), np.int64, n), np.fromiter(map(index_b.__getitem__, common), np.int64, n)


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in a, in b) of all overlapping tokens, slice by slice, in the order of a."""
    in_slice = np.repeat(np.arange(len(cut_a)), np.diff(cut_a, prepend=0))
    first, last = np.append(0, cut_b[:-1])[in_slice], cut_b[in_slice]
    starts = np.append(0, ends_a[:-1])
    lo = np.maximum(first, np.searchsorted(ends_b, starts, "right"))
    hi = np.minimum(last, np.searchsorted(ends_b, ends_a, "left") + 1)
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + lo[a]


class Aligner:
    """Aligns texts and remembers runs. a: a byte-level vocabulary's file, b: a sentencepiece model's."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b)
        signs = byte_signs()
        self.bytes_a = [bytes(signs[c] for c in self.a.id_to_token(i)) if all(c in signs for c in self.a.id_to_token(i)) else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.asarray([len(x) for x in some], np.int64) for some in (self.bytes_a, self.bytes_b))
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.by_runs = not any(_JOINED.search(p) for i, p in enumerate(pieces) if not self.b.is_control(i) and not self.b.is_unknown(i)) and "▁" in pieces
        self.space = pieces.index("▁") if "▁" in pieces else -1
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((1 << 12, 3), np.int64)  # tokens of a, tokens of b, groups; for each remembered run
        self.link_at = np.zeros(1 << 12, np.int64)  # where its links begin; the next entry is their end
        self.links = np.zeros(1 << 14, np.int64)

    def aligned(self, a: list[int], b: list[int], want: bytes) -> tuple | None:
        """(ends of a, ends of b, tokens up to each cut in a, in b), or None where the bytes are others."""
        if b"".join(map(self.bytes_a.__getitem__, a)) != want or b"".join(map(self.bytes_b.__getitem__, b)) != want:
            return None
        ends_a, ends_b = np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b])
        return ends_a, ends_b, *groups_of(ends_a, ends_b)

    def named(self, a: list[int], b: list[int], cut_a: np.ndarray, cut_b: np.ndarray) -> list[str]:
        """Each group as a1,a2|b1."""
        x, y = list(map(self.names.__getitem__, a)), list(map(self.names.__getitem__, b))
        out, i, j = [], 0, 0
        for k, m in zip(cut_a.tolist(), cut_b.tolist(), strict=True):
            out.append(f"{x[i] if k == i + 1 else ','.join(x[i:k])}|{y[j] if m == j + 1 else ','.join(y[j:m])}")
            i, j = k, m
        return out

    def whole(self, text: str) -> tuple[tuple[int, int, int], str, np.ndarray]:
        """(tokens of a, of b, groups), the groups' names and the links' pairs of one text."""
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        b = self.b.encode(text, num_threads=1)
        found = self.aligned(a, b, f" {text}".encode()) if text else None
        if found is None:
            return (0, 0, 0), "", np.zeros(0, np.int64)
        ends_a, ends_b, cut_a, cut_b = found
        i, j = links_of(ends_a, ends_b, cut_a, cut_b)
        return (len(a), len(b), len(cut_a)), ";".join(self.named(a, b, cut_a, cut_b)), self.pairs(np.asarray(a)[i], np.asarray(b)[j])

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) * len(self.bytes_b) + b

    def learn(self, new: list[str]) -> None:
        """Aligns runs in a row, in chunks; a run that can't be told apart so, or that is changed, gets no entry (-1)."""
        for lo in range(0, len(new), _CHUNK):
            self._learn([x for x in new[lo : lo + _CHUNK] if not x.isspace()])
        for x in new:
            if x.isspace():  # only at a text's end
                self.known.setdefault(x, -1)

    def _learn(self, runs: list[str]) -> None:
        if not runs:
            return
        raw = [x.encode() for x in runs]
        a = self.a.encode_batch_fast(["".join(runs)], add_special_tokens=False)[0].ids
        parts = self.b.encode([x[1:] if x[0] == " " else x for x in runs], num_threads=1)
        plain = all(x[0] == " " or p[:1] == [self.space] for x, p in zip(runs, parts, strict=True))
        b = list(chain.from_iterable(p if x[0] == " " else p[1:] for x, p in zip(runs, parts, strict=True)))
        found = self.aligned(a, b, b"".join(raw)) if plain else None
        if found:
            ends_a, ends_b, cut_a, cut_b = found
            at = np.cumsum([len(x) for x in raw])
            common = ends_a[cut_a - 1]
            g = np.searchsorted(common, at)
            if (common[np.minimum(g, len(common) - 1)] == at).all():
                self._remember(runs, a, b, found, np.append(0, g + 1))
                return
        if len(runs) == 1:
            self.known[runs[0]] = -1
            return
        self._learn(runs[: len(runs) // 2])
        self._learn(runs[len(runs) // 2 :])

    def _remember(self, runs: list[str], a: list[int], b: list[int], found: tuple, g: np.ndarray) -> None:
        """g: groups up to each run."""
        ends_a, ends_b, cut_a, cut_b = found
        n, at = len(self.groups), len(self.groups) + len(runs)
        upto = np.stack([np.append(0, cut_a)[g], np.append(0, cut_b)[g], g], 1)
        i, j = links_of(ends_a, ends_b, cut_a, cut_b)
        pairs = self.pairs(np.asarray(a)[i], np.asarray(b)[j])
        ends = self.link_at[n] + np.searchsorted(i, upto[1:, 0])
        while len(self.sizes) <= at + 1:
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
            self.link_at = np.concatenate([self.link_at, np.zeros_like(self.link_at)])
        while len(self.links) < self.link_at[n] + len(pairs):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.sizes[n:at] = np.diff(upto, axis=0)
        self.links[self.link_at[n] : self.link_at[n] + len(pairs)] = pairs
        self.link_at[n + 1 : at + 1] = ends
        names = self.named(a, b, cut_a, cut_b)
        self.groups += [names[lo] if hi == lo + 1 else ";".join(names[lo:hi]) for lo, hi in zip(g[:-1].tolist(), g[1:].tolist(), strict=True)]
        self.known.update(zip(runs, range(n, at), strict=True))

    def forget(self) -> None:
        """Keeps the runs that were met first, among which are the common ones."""
        if len(self.known) > REMEMBERED:
            for x in [x for k, (x, i) in enumerate(self.known.items()) if k >= REMEMBERED or i >= REMEMBERED]:
                del self.known[x]
            del self.groups[REMEMBERED:]

    def run_numbers(self, some: list[str]) -> list[list[int] | None]:
        """The entries of each text's runs; None for a text that has to be aligned as a whole (or has no tokens)."""
        runs = [_RUN.findall(" " + x) if x and self.by_runs and not _ODD.search(x) else [] for x in some]
        out = [list(map(self.known.get, x)) for x in runs]
        new = {r: None for x, at in zip(runs, out, strict=True) for r, i in zip(x, at, strict=True) if i is None}
        self.learn(list(new))
        known = self.known
        out = [[known[r] if i is None else i for r, i in zip(x, at, strict=True)] if None in at else at for x, at in zip(runs, out, strict=True)]
        return [x if x and -1 not in x else None for x in out]

    def table(self, some: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """For all texts: (tokens of a, of b, groups), links, digests; and of their distinct pairs: offsets, pairs, how often."""
        found = self.run_numbers(some)
        sizes, digests = np.zeros((len(some), 3), np.int64), [""] * len(some)
        docs, pairs = [], []
        by_runs = [k for k, x in enumerate(found) if x is not None]
        if by_runs:
            idx = np.fromiter(chain.from_iterable(found[k] for k in by_runs), np.int64)
            n = np.asarray([len(found[k]) for k in by_runs])
            of = np.repeat(np.asarray(by_runs), n)
            for c in range(3):
                sizes[:, c] = np.bincount(of, self.sizes[idx, c], len(some))
            lens = self.link_at[idx + 1] - self.link_at[idx]
            docs.append(np.repeat(of, lens))
            pairs.append(self.links[np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(self.link_at[idx], lens)])
            for k in by_runs:
                digests[k] = hashlib.sha256(";".join(map(self.groups.__getitem__, found[k])).encode()).hexdigest()
        for k, x in enumerate(found):
            if x is None and some[k]:
                sizes[k], names, own = self.whole(some[k])
                digests[k] = hashlib.sha256(names.encode()).hexdigest() if sizes[k][0] else ""
                docs.append(np.full(len(own), k))
                pairs.append(own)
        self.forget()
        doc, pair = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (docs, pairs))
        most = len(self.bytes_a) * len(self.bytes_b)
        key, often = np.unique(doc * most + pair, return_counts=True)
        at = np.searchsorted(key, np.arange(len(some) + 1) * most)
        return sizes, np.bincount(doc, minlength=len(some)), digests, at, key % most, often


@cache
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def aligned_rows(df: DataFrame, a: str, b: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs and often (of the distinct linked pairs) of each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = aligner(a, b), TaskContext.get().partitionId() << 40
        for batch in slices(batches, slice_bytes):
            sizes, links, digests, at, pairs, often = coder.table(batch.column("text").to_pylist())
            at = pa.array(at, pa.int32())
            cols = [pa.array(np.arange(row, row + batch.num_rows)), batch.column("doc_id"), *(pa.array(sizes[:, c]) for c in range(3)), pa.array(links, pa.int64()), pa.array(digests, pa.string())]
            cols += [pa.ListArray.from_arrays(at, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(at, pa.array(often, pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "often"])
            row += batch.num_rows

    return texts(df).mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, often array<int>")


def pair_counts(rows: DataFrame, n_b: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of its first id has more); n_b: ids of the second tokenizer."""
    counts = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts.withColumn("a", F.expr(f"pair div {n_b}")), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return stored(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def align(df: DataFrame, a: str, b: str, broadcast_pairs: int = BROADCAST_PAIRS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of df."""
    rows = stored(aligned_rows(df, a, b, slice_bytes), "aligned", "zstd")
    counts = pair_counts(rows, len(aligner(a, b).bytes_b))
    counts = F.broadcast(counts) if counts.count() <= broadcast_pairs else counts.hint("merge")
    held = rows.select("row", F.explode(F.arrays_zip("pairs", "often")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.often").alias("often"))
    best = F.sum(F.when(F.col("best"), F.col("often")).otherwise(F.lit(0))).alias("n_best")
    sums = held.join(counts, "pair").groupBy("row").agg(best, F.sum(F.col("often") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "often").join(sums.hint("merge"), "row", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
