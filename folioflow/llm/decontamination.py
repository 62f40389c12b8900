"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and items are lower-cased, character by character, and runs of white space read as one space. An item is cut into
passages of at most PIECE characters. A document is contaminated when it holds one of them with edits in at most a tenth
of its characters; so it is in particular when it holds the whole item so, as the passages' budgets add up, but a part of
an item is enough. A passage of m characters with k edits shares at least m - q + 1 - k * q of its q-grams with the place
where it stands, on at most k + 1 neighbouring diagonals (text position less passage position). So the shared q-grams are
counted in diagonal bands; two neighbouring bands, which overlap the next two, together hold any such place. Regions that
reach the bound are kept and each is verified by an alignment within its band, all regions of a slice at once. q is Q, and
less for a passage so short that the bound would be below one.

The items are the query set: they go to all tasks in blocks of at most BLOCK_CHARS characters, about (dealt by a hash of id and
text; an item is not cut), one pass over the texts for each block. Defined results: null and empty texts are clean; null and blank items are not looked for, items of any other
length are, those below 10 characters without edits; repeated items count each by its item_id, those without one as -1;
repeated rows of a document are judged alike, rows that share a doc_id, or have none, each by its own text; very long texts
are read in stretches that overlap by more than a passage, each of which answers for its own diagonals, so that the same
passages are found as in the whole; other columns are carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import SLICE_BYTES, doc_id, keyed, mixed, slices, stored, whole_row

Q = 8
PIECE = 120
#: One edit for so many characters.
PER_EDIT = 10
BLOCK_CHARS = 4_000_000
#: Regions aligned at once.
ALIGNED = 2048

_END = 0x110000  # beyond all characters


@cache
def _lower() -> np.ndarray:
    """The lower case of each character (itself, if that takes more than one); all white space is one character."""
    out = np.arange(_END + 1, dtype=np.int32)
    for c in range(_END):
        if 0xD800 <= c < 0xE000:
            continue
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    out[ord("\u03c2")] = ord("\u03c3")  # the two small sigmas have one capital
    out[[9, 10, 11, 12, 13, 0xA0]] = 32
    return out


def folded(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts' folded characters, each part closed by _END; their places in the joined parts; where each part begins."""
    raw = _lower()[np.frombuffer("\0".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
    size = np.asarray([len(x) for x in parts], np.int64) + 1
    ends = np.cumsum(size) - 1
    raw[ends] = _END
    space = raw == 32
    keep = np.ones(len(raw), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = np.flatnonzero(keep)
    begins = np.searchsorted(place, ends + 1 - size)
    return raw[keep], place, np.append(begins, len(place))


def stretches(text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, tuple[int, int]]]:
    """A long text in stretches of about size that overlap by 4 * PIECE folded characters.

    Each with its folded characters, their places in the text, how many folded characters come before it, and the diagonals
    that are its own: what stands on them lies in it as a whole.
    """
    chars, place, begin, own = np.zeros(0, np.int32), np.zeros(0, np.int64), 0, -2 * PIECE
    for lo in range(0, len(text), size):
        new, at, _ = folded([text[lo : lo + size]])
        new, at = new[:-1], at[:-1] + lo
        if len(chars) and len(new) and chars[-1] == new[0] == 32:
            new, at = new[1:], at[1:]
        chars, place = np.concatenate([chars, new]), np.concatenate([place, at])
        left = max(0, len(chars) - 4 * PIECE)  # the next one begins here
        ends = lo + size >= len(text)
        upto = begin + (len(chars) + PIECE if ends else left + PIECE) if ends or begin + left else own
        yield np.append(chars, np.int32(_END)), np.append(place, len(text)), begin, (own, upto)
        chars, place, begin, own = chars[left:], place[left:], begin + left, upto


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Names of the q characters from each position on (those that would pass the end are left out)."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    c = mixed(chars.astype(np.uint64) + np.uint64(1))
    for i in range(q):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n]
    return mixed(h)


def passages(items: list[tuple[int, str]], q: int = Q) -> dict[int, list[tuple[int, np.ndarray]]]:
    """(item, characters) of all passages by the q that their bounds allow."""
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item, text in items:
        body = folded([text.strip()])[0][:-1]
        for part in np.array_split(body, -(-len(body) // PIECE)) if len(body) else []:
            out.setdefault(min(q, len(part) // (len(part) // PER_EDIT + 1)), []).append((item, part))
    return out


class Pieces:
    """Passages with an index of their q-grams."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], q: int):
        self.q, self.item, chars = q, [i for i, _ in parts], [x for _, x in parts]
        self.size = np.asarray([len(x) for x in chars], np.int64)
        self.edits = self.size // PER_EDIT
        self.least = self.size - q + 1 - self.edits * q
        self.band = int(self.edits.max(initial=0)) + 1
        self.chars = np.full((len(chars), int(self.size.max(initial=1))), -1, np.int64)
        names, piece, at = [], [], []
        for i, part in enumerate(chars):
            self.chars[i, : len(part)] = part
            g = grams(part, q)
            names.append(g)
            piece.append(np.full(len(g), i))
            at.append(np.arange(len(g)))
        names = np.concatenate(names or [np.zeros(0, np.uint64)])
        order = np.argsort(names, kind="stable")
        self.piece = np.concatenate(piece or [np.zeros(0, np.int64)])[order]
        self.at = np.concatenate(at or [np.zeros(0, np.int64)])[order]
        self.names, self.first = np.unique(names[order], return_index=True)
        self.first = np.append(self.first, len(names))
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.names >> np.uint64(42)).astype(np.int64)] = True

    def regions(self, chars: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and first diagonals of the double bands whose shared q-grams reach the bound.

        begins: where each text begins in chars (below 0, if chars are a stretch of it). Bands are counted from a text's
        begin, so that they don't depend on what it is read with.
        """
        g = grams(chars, self.q)
        i = np.flatnonzero(self.bits[(g >> np.uint64(42)).astype(np.int64)])
        slot = np.searchsorted(self.names, g[i])
        slot[slot == len(self.names)] = 0
        hit = self.names[slot] == g[i] if len(self.names) else np.zeros(0, bool)
        i, slot = i[hit], slot[hit]
        times = self.first[slot + 1] - self.first[slot]
        entry = np.repeat(self.first[slot], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        piece = self.piece[entry]
        before = (begins - begins[0]) // self.band + np.arange(len(begins)) * (PIECE + 4)  # bands of the texts before, and room
        text = np.repeat(np.searchsorted(begins, i, "right") - 1, times)
        band = (np.repeat(i, times) - begins[text] - self.at[entry]) // self.band + PIECE + 1 + before[text]  # never below 1
        bands = (len(chars) - begins[0]) // self.band + (len(begins) + 1) * (PIECE + 4)
        key, count = np.unique(piece * bands + band, return_counts=True)
        nxt = np.searchsorted(key, key + 1)
        nxt[nxt == len(key)] = 0
        with_next = count + np.where(key[nxt] == key + 1, count[nxt], 0) if len(key) else count
        ok = with_next >= self.least[key // bands] if len(key) else np.zeros(0, bool)
        band = key[ok] % bands
        text = np.searchsorted(before + 1, band, "right") - 1
        return key[ok] // bands, (band - before[text] - PIECE - 1) * self.band + begins[text]

    def align(self, chars: np.ndarray, piece: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least edits for each region, and where the place that needs them starts and ends."""
        k = self.edits[piece]
        width = 2 * self.band + 2 * int(k.max(initial=0))
        low = diagonal - k  # the band's first diagonal
        step, d = 1 << 32, np.arange(width, dtype=np.int64)
        padded = np.concatenate([np.full(PIECE + width, -2), chars, np.full(PIECE + 2 * width, -2)])
        weight = np.where((padded == _END) | (padded == -2), 1000, 1) * step  # no passage goes on behind a text's end
        upto = np.cumsum(weight)
        base = low[:, None] + d + PIECE + width
        cost = np.where((low[:, None] + d >= 0) & (low[:, None] + d <= len(chars)), low[:, None] + d, np.int64(1) << 60)  # the start is carried in the low bits
        best = np.full(len(piece), np.int64(1) << 60)
        end = np.zeros(len(piece), np.int64)
        for j in range(self.chars.shape[1]):
            at = np.minimum(base + j, len(padded) - 1)
            went = cost + weight[at] * (padded[at] != self.chars[piece, j][:, None])
            went[:, :-1] = np.minimum(went[:, :-1], cost[:, 1:] + step)
            cost = np.minimum.accumulate(went - upto[at], axis=1) + upto[at]
            last = np.flatnonzero(self.size[piece] == j + 1)
            if len(last):
                x = cost[last].argmin(1)
                best[last] = cost[last, x]
                end[last] = low[last] + x + j + 1
        return best >> 32, best & (step - 1), np.minimum(end, len(chars))


    def found(self, chars: np.ndarray, begins: np.ndarray, own: tuple[int, int] | None = None) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the passages that stand in chars within their budgets; own: of these diagonals of the text only."""
        piece, diagonal = self.regions(chars, begins)
        if own:
            inside = (diagonal - begins[0] >= own[0]) & (diagonal - begins[0] < own[1])
            piece, diagonal = piece[inside], diagonal[inside]
        for lo in range(0, len(piece), ALIGNED):
            p = piece[lo : lo + ALIGNED]
            edits, start, end = self.align(chars, p, diagonal[lo : lo + ALIGNED])
            for i in np.flatnonzero((edits <= self.edits[p]) & (end > start)):
                yield self.item[p[i]], int(start[i]), int(end[i]), int(edits[i])


def _matches(docs: DataFrame, items: DataFrame, q: int = Q, block_chars: int = BLOCK_CHARS, size: int = SLICE_BYTES) -> DataFrame:
    """doc_id, twin, item_id, start, end (code points in the text), edits: a row for each passage found in keyed rows."""
    spark = docs.sparkSession
    names = ["doc_id", "twin", "item_id", "start", "end", "edits"]
    schema = ", ".join(f"{x} long" for x in names)
    items = items.select(doc_id("item_id"), "text").filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars)

    def searched(block: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            indexes = [Pieces(parts, n) for n, parts in passages(block, q).items()]
            for b in slices(batches, size):
                docs_, twins, found = b.column("doc_id").to_numpy(), b.column("twin").to_numpy(), set()
                some = b.column("text").to_pylist()
                if len(some) == 1 and len(some[0]) > size:
                    for chars, place, begin, own in stretches(some[0], size):
                        found.update((0, i, int(place[s]), int(place[e - 1] + 1), n) for x in indexes for i, s, e, n in x.found(chars, np.asarray([-begin]), own))
                else:
                    chars, place, begins = folded(some)
                    for x in indexes:
                        for i, s, e, n in x.found(chars, begins[:-1]):
                            d = int(np.searchsorted(begins, s, "right")) - 1
                            if d < len(docs_):
                                zero = place[begins[d]]
                                found.add((d, i, int(place[s] - zero), int(place[e - 1] + 1 - zero), n))
                rows = sorted(found)
                d = np.asarray([r[0] for r in rows], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(docs_[d]), pa.array(twins[d]), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 5))], names=names)

        return docs.select("doc_id", "twin", "text").mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for i in range(blocks):
        block = [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).collect()]
        out = searched(block) if not i else out.unionByName(searched(block))
    return out


def matches(df: DataFrame, items: DataFrame, q: int = Q, block_chars: int = BLOCK_CHARS, size: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, start, end (code points in the text), edits: a row for each passage found, in any document."""
    return _matches(keyed(df), items, q, block_chars, size).drop("twin")


def contamination(df: DataFrame, items: DataFrame, q: int = Q, size: int = SLICE_BYTES) -> DataFrame:
    """doc_id, contaminated, n_items, n_spans, item_ids (ascending) for each row of df."""
    docs = keyed(df)
    found = stored(_matches(docs, items, q, size=size), "leaks")
    per_doc = found.groupBy("doc_id", "twin").agg(F.count("*").alias("n_spans"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select("doc_id", "twin").join(per_doc, ["doc_id", "twin"], "left")
    return out.select(
        "doc_id",
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
    )


def clean(df: DataFrame, items: DataFrame, q: int = Q) -> DataFrame:
    """The rows of df, with df's columns, in which no item was found."""
    docs = keyed(df, whole_row(df))
    found = stored(_matches(docs, items, q, size=SLICE_BYTES // 2).select("doc_id", "twin").distinct(), "leaks")
    return docs.drop("text").join(found.hint("merge"), ["doc_id", "twin"], "left_anti").select("_row.*")
