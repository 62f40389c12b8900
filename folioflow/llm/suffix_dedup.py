"""Removal of byte strings that occur earlier, by distributed prefix doubling over synchronised positions.

A byte goes when a SPAN-byte string (100) that covers it also starts earlier. Sorting every position of the corpus at every
round would shuffle some twenty times the input, so ranks are kept for positions that equal strings must share:

1. Anchors. In each SPAN-byte window the positions with the least K-gram hash (K is 40) are anchors, about 3 in 100. Equal
   windows have equal anchors at equal places, so a window repeats only if an anchor in it has the K-gram of another.
2. Rank at offset K. (K-gram, hull, document, position) of all anchors is sorted; the hull is all that windows around the
   anchor reach, SPAN - K bytes to its left and SPAN to its right. Anchors whose K-gram is unique end here. An anchor whose
   hull is not the first of its name makes all windows around it repeats. First hulls that share their K-gram go on.
3. Doubling. The windows of such an anchor start at offsets 0 to SPAN - K before it. Each round halves the range of
   offsets, so that what its windows have in common, the core, grows: 40, 70, 85, 93, ... bytes, to SPAN when one offset is
   left. Spark sorts the pairs (core, hull) with their positions; a range whose core is unique ends, one whose hull is not
   the first of its name is a repeat as a whole. The others go to the next round, or, if the rows of their core are few and
   have come together, have their remaining offsets ranked at once where they are.

Step 2 moves most rows, so tasks pack what they gathered by ranges of the K-gram's name, and each range is sorted where it
arrives; steps 3 are plain rows, range partitioned by (core, hull), so that a core that a third of all documents hold is
spread over tasks. Equal hulls met in one task are settled there, so a passage that stands in a third of all documents is
sent once a task and not once a document; of a K-gram with more than HOT different hulls in one task two are sent to step
2 as witnesses, as all its anchors are known to go on. Names are 64 (K-grams, cores, hulls) and 48 bits (first hulls).

Defined results: null, empty and shorter texts lose nothing; strings never cross documents; repeated rows (of one doc_id
and one text) are the same document at the same places and do not remove each other; rows without a doc_id, or that share
one, with different texts are documents of their own, in the order of their texts' hashes; a text longer than a slice is
read in slices, and held whole only where its bytes are cut out; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import Names, keyed, mixed, partitions, stored, string_bytes

SPAN = 100
K = 40
#: Different hulls of one K-gram that a task sends to be compared before it takes the K-gram for common.
HOT = 16
#: Rows of one core that are settled in the task where they meet.
WHOLE = 4000
#: Bytes of text read in one step.
SLICE_BYTES = 1 << 20
#: Anchors that a task gathers before it deals them out.
GATHERED = 600_000

def _sliding(x: np.ndarray, w: int, best) -> np.ndarray:
    """best over x[i .. i + w - 1] for each i where that lies inside."""
    size = 1
    while 2 * size <= w:
        x = best(x[:-size], x[size:])
        size *= 2
    return x if size == w else best(x[: len(x) - (w - size)], x[w - size :])


def anchors(data: np.ndarray, at: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc index, position, K-gram name, hull name and reach to the left of the anchors of texts data[at[i]:at[i+1]]."""
    w = span - k + 1
    if len(data) < span:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    names = Names(data)
    grams = names.grams(k)
    pick = np.maximum((grams >> np.uint64(32)).astype(np.uint32), 1)
    least = _sliding(pick, w, np.minimum)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        least[max(s, e - span + 1) : e] = 0  # windows that would cross the end
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    p = np.flatnonzero(_sliding(padded, w, np.maximum)[: len(pick)] == pick)
    doc = np.searchsorted(at, p, "right") - 1
    left = np.minimum(p - at[doc], span - k)
    right = np.minimum(at[doc + 1] - p, span)
    hull = names.of(p - left, p + right) ^ mixed((left << 32 | right).astype(np.uint64))
    # anchors are least hashes: mixed again, their names spread evenly over the ranges
    return doc, p - at[doc], mixed(grams[p] + np.uint64(1)), hull >> np.uint64(16), left


def _packed(key: np.ndarray, hull: np.ndarray, doc: np.ndarray, twin: np.ndarray, pos: np.ndarray) -> bytes:
    """Rows sorted by key: differences of the keys, the other columns as they are, by byte planes."""
    parts = [np.diff(key, prepend=np.uint64(0)), hull, doc.view(np.uint64), twin.view(np.uint64), pos.astype(np.uint64)]
    planes = [np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, : 6 if i == 1 else 8].T).tobytes() for i, x in enumerate(parts)]
    return len(key).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpacked(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[4:]), np.uint8)
    out, at = [], 0
    for width in (8, 6, 8, 8, 8):
        full = np.zeros((n, 8), np.uint8)
        full[:, :width] = raw[at : at + n * width].reshape(width, n).T
        out.append(full.view(np.uint64).ravel())
        at += n * width
    return [np.cumsum(out[0], dtype=np.uint64), out[1], *(x.view(np.int64) for x in out[2:])]


def _pieces(batches: Iterator[pa.RecordBatch], span: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc ids and twins, offsets of the texts in data, place of each in its document, length of its document, and data."""
    reach = 2 * span
    for b in batches:
        data, at = string_bytes(b.column("text"))
        docs, twins = b.column("doc_id").to_numpy(), b.column("twin").to_numpy()
        lo = 0
        while lo < len(docs):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
            n = int(at[lo + 1] - at[lo])
            if hi == lo + 1 and n > size:
                for c in range(0, n, size):
                    s, e = max(0, c - reach), min(n, c + size + reach)
                    yield docs[lo:hi], twins[lo:hi], np.asarray([0, e - s]), np.asarray([s]), np.asarray([n]), data[at[lo] + s : at[lo] + e]
            else:
                yield docs[lo:hi], twins[lo:hi], at[lo : hi + 1] - at[lo], np.zeros(hi - lo, np.int64), np.diff(at[lo : hi + 1]), data[at[lo] : at[hi]]
            lo = hi


def _firsts(key: np.ndarray, hull: np.ndarray, doc: np.ndarray, twin: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows' order by (key, hull, document, position); in it, which are the first of their key and hull, and which of
    the others are not that same place again."""
    order = np.lexsort((pos, twin, doc, hull, key))
    key, hull, doc, twin, pos = (x[order] for x in (key, hull, doc, twin, pos))
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (hull[1:] != hull[:-1])
    lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    return order, first, (doc != doc[lead]) | (twin != twin[lead]) | (pos != pos[lead])


def _merged(doc: np.ndarray, twin: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ranges lo .. hi (both included) of each document, joined where they touch."""
    if not len(doc):
        return doc, twin, lo, hi
    order = np.lexsort((lo, twin, doc))
    doc, twin, lo, hi = (x[order] for x in (doc, twin, lo, hi))
    base = np.cumsum(np.append(False, (doc[1:] != doc[:-1]) | (twin[1:] != twin[:-1]))) * (int(hi.max()) + 2)
    reach = np.maximum.accumulate(hi + base)
    first = np.flatnonzero(np.append(True, lo[1:] + base[1:] > reach[:-1] + 1))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], twin[first], lo[first], reach[last] - base[last]


_RANGES = "kind int, doc_id long, twin long, a long, b long"


def _rows(kind: int, doc: np.ndarray, twin: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    if kind == 0:
        doc, twin, a, b = _merged(doc, twin, a, b)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), kind, np.int32)), *map(pa.array, (doc, twin, a, b))], names=["kind", "doc_id", "twin", "a", "b"])


def _ranked(docs: DataFrame, span: int, k: int, size: int, gathered: int, hot: int) -> DataFrame:
    """Steps 1 and 2: ranges a .. b of repeated window starts (kind 0) and the anchors, at a, that go on (kind 1)."""
    n = partitions(docs.sparkSession)

    def dealt(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, hull, doc, twin, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, first, again = _firsts(key, hull, doc, twin, pos)
        key, hull, doc, twin, pos = (x[order] for x in (key, hull, doc, twin, pos))
        lo = np.maximum(pos - (span - k), 0)
        out = [_rows(0, doc[again], twin[again], lo[again], pos[again])]
        key, hull, doc, twin, pos = (x[first] for x in (key, hull, doc, twin, pos))
        group = np.flatnonzero(np.diff(key, prepend=key[:1] + np.uint64(1))) if len(key) else np.zeros(0, np.int64)
        nth = np.arange(len(key)) - np.repeat(group, np.diff(np.append(group, len(key))))
        crowd = np.repeat(np.diff(np.append(group, len(key))) > hot, np.diff(np.append(group, len(key)))) & (nth >= 2)
        out.append(_rows(1, doc[crowd], twin[crowd], pos[crowd], pos[crowd]))
        key, hull, doc, twin, pos = (x[~crowd] for x in (key, hull, doc, twin, pos))
        for rows in out:
            yield pa.RecordBatch.from_arrays([pa.array((rows.column("doc_id").to_numpy() % n).astype(np.int32)), pa.nulls(rows.num_rows, pa.binary()), *rows.columns], names=["shard", "blob", *rows.schema.names])
        ends = np.searchsorted((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))
        has = np.flatnonzero(np.diff(ends))
        blobs = [_packed(*(x[ends[i] : ends[i + 1]] for x in (key, hull, doc, twin, pos))) for i in has]
        none = np.zeros(len(has), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(blobs, pa.binary()), *_rows(2, none, none, none, none).columns], names=["shard", "blob", "kind", "doc_id", "twin", "a", "b"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for docs_, twins, at, place, length, data in _pieces(batches, span, size):
            doc, pos, key, hull, left = anchors(data, at, span, k)
            # reach cut off by a slice of a long text: that anchor stands in the next slice with its full hull
            ends = np.diff(at)[doc]
            cut = (place[doc] > 0) & (left < span - k) | (place[doc] + ends < length[doc]) & (ends - pos < span)
            doc, pos, key, hull = (x[~cut] for x in (doc, pos + place[doc], key, hull))
            held.append([key, hull, docs_[doc], twins[doc], pos])
            many += len(doc)
            if many > gathered:
                yield from dealt(held)
                held, many = [], 0
        if held:
            yield from dealt(held)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            blob = batch.column("blob")
            yield batch.filter(blob.is_null()).select(["kind", "doc_id", "twin", "a", "b"])
            blobs += [x for x in blob.to_pylist() if x is not None]
        if not blobs:
            return
        key, hull, doc, twin, pos = (np.concatenate(x) for x in zip(*map(_unpacked, blobs), strict=True))
        order, first, again = _firsts(key, hull, doc, twin, pos)
        key, doc, twin, pos = (x[order] for x in (key, doc, twin, pos))
        yield _rows(0, doc[again], twin[again], np.maximum(pos[again] - (span - k), 0), pos[again])
        key, doc, twin, pos = (x[first] for x in (key, doc, twin, pos))
        same = key[1:] == key[:-1]
        more = np.append(same, False) | np.append(False, same)
        yield _rows(1, doc[more], twin[more], pos[more], pos[more])

    rows = docs.mapInArrow(read, "shard int, blob binary, " + _RANGES).repartitionById(n, "shard")
    return rows.mapInArrow(rank, _RANGES)


def _cover(n: int, lo: np.ndarray, hi: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Which window starts of a text of n bytes repeat, and which bytes those windows cover."""
    change = np.zeros(n + 1, np.int64)
    hi = np.minimum(hi, n - span)
    ok = lo <= hi
    np.add.at(change, lo[ok], 1)
    np.add.at(change, hi[ok] + 1, -1)
    starts = np.cumsum(change[:n]) > 0
    cover = np.zeros(n + 1, np.int64)
    s = np.flatnonzero(starts)
    np.add.at(cover, s, 1)
    np.add.at(cover, np.minimum(s + span, n), -1)
    return starts, np.cumsum(cover[:n]) > 0


_NODES = _RANGES + ", core long, hull long, lo int, hi int, before int, bytes binary"


class Nodes:
    """Ranges lo .. hi of offsets before anchors, each with the bytes from `before` ahead of its anchor on."""

    def __init__(self, doc, twin, at, lo, hi, before, size, data):
        self.doc, self.twin, self.at, self.lo, self.hi, self.before, self.size, self.data = doc, twin, at, lo, hi, before, size, data

    @classmethod
    def of(cls, b: pa.RecordBatch) -> Nodes:
        cols = [b.column(x).to_numpy().astype(np.int64) for x in ("doc_id", "twin", "a", "lo", "hi", "before")]
        data, at = string_bytes(b.column("bytes"))
        return cls(*cols, np.diff(at), data)

    def reach(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest offset at which a window lies in the document."""
        return np.maximum(self.lo, span - (self.size - self.before)), np.minimum(self.hi, self.before)

    def halves(self, span: int, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        """The halves of the nodes in `which`, with their names; those of one name are settled here, but for the first."""
        begin = np.cumsum(self.size) - self.size
        names = Names(self.data)
        parts = []
        for half in (0, 1):
            i = which[self.hi[which] > self.lo[which]]
            middle = (self.lo[i] + self.hi[i]) >> 1
            lo, hi = (self.lo[i], middle) if half == 0 else (middle + 1, self.hi[i])
            first, last = np.maximum(lo, span - (self.size[i] - self.before[i])), np.minimum(hi, self.before[i])
            ok = first <= last
            i, lo, hi, first, last = (x[ok] for x in (i, lo, hi, first, last))
            anchor = begin[i] + self.before[i]
            core = names.of(anchor - lo, anchor + span - hi) ^ mixed((lo << 16 | hi).astype(np.uint64))
            hull = names.of(anchor - last, anchor + span - first) ^ mixed((last << 16 | first).astype(np.uint64))
            parts.append((core, hull, self.doc[i], self.twin[i], self.at[i], lo, hi, first, last, anchor))
        cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order, is_first, again = _firsts(*cols[:5])
        core, hull, doc, twin, at, lo, hi, first, last, anchor = (x[order] for x in cols)
        yield _node_rows(_rows(0, doc[again], twin[again], at[again] - last[again], at[again] - first[again]))
        core, hull, doc, twin, at, lo, hi, first, last, anchor = (x[is_first] for x in (core, hull, doc, twin, at, lo, hi, first, last, anchor))
        data = self.data.tobytes()
        cut = [data[s:e] for s, e in zip((anchor - last).tolist(), (anchor + span - first).tolist(), strict=True)]
        yield _node_rows(_rows(1, doc, twin, at, at), core.view(np.int64), hull.view(np.int64), lo.astype(np.int32), hi.astype(np.int32), last.astype(np.int32), cut)


def _node_rows(ranges: pa.RecordBatch, *more) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    cols = [pa.array(x, t) for x, t in zip(more, types, strict=True)] if more else [pa.nulls(ranges.num_rows, t) for t in types]
    return pa.RecordBatch.from_arrays([*ranges.columns, *cols], names=[*ranges.schema.names, "core", "hull", "lo", "hi", "before", "bytes"])


def _cut_out(docs: DataFrame, found: DataFrame, span: int, k: int) -> DataFrame:
    """The first halves of all anchors of found that go on and have windows that are not known as repeats yet."""
    per_doc = found.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("kind", "a", "b")).alias("found"), F.max("kind").alias("any")).filter("any = 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_bytes(batch.column("text"))
            lists = batch.column("found")
            flat, ends = lists.values, lists.offsets.to_numpy()
            kinds, av, bv = (flat.field(i).to_numpy() for i in range(3))
            rows = []
            for i in range(batch.num_rows):
                n, mine = int(at[i + 1] - at[i]), slice(ends[i], ends[i + 1])
                kind, a, b = kinds[mine], av[mine], bv[mine]
                before = np.concatenate([[0], np.cumsum(_cover(n, a[kind == 0], b[kind == 0], span)[0])])
                p = a[kind == 1]
                lo, hi = np.maximum(p - (span - k), 0), np.minimum(p, n - span)
                p = p[(before[np.maximum(hi + 1, 0)] - before[lo] < hi - lo + 1) & (hi >= lo)]
                rows.append((np.full(len(p), i), p, np.minimum(p, span - k), np.minimum(n - p, span)))
            i, p, left, right = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 4
            for s in range(0, len(i), 4096):
                x, q, l, r = (v[s : s + 4096] for v in (i, p, left, right))
                size = l + r
                begin = np.cumsum(size) - size
                where = np.repeat(at[x] + q - l - begin, size) + np.arange(size.sum())
                docs_, twins = batch.column("doc_id").to_numpy()[x], batch.column("twin").to_numpy()[x]
                nodes = Nodes(docs_, twins, q, np.zeros(len(q), np.int64), np.full(len(q), span - k), l, size, data[where])
                yield from nodes.halves(span, np.arange(len(q)))

    return docs.join(per_doc.hint("merge"), ["doc_id", "twin"]).mapInArrow(run, _NODES)


def _classes(b: pa.RecordBatch, nodes: Nodes, span: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """The first rows of each (core, hull) of sorted rows, and the others as ranges: all their windows are repeats."""
    core, hull = b.column("core").to_numpy(), b.column("hull").to_numpy()
    new = np.append(True, (core[1:] != core[:-1]) | (hull[1:] != hull[:-1]))
    lead = np.flatnonzero(new)
    of = lead[np.cumsum(new) - 1]
    again = (nodes.doc != nodes.doc[of]) | (nodes.twin != nodes.twin[of]) | (nodes.at != nodes.at[of])
    low, high = nodes.reach(span)
    return lead, _node_rows(_rows(0, nodes.doc[again], nodes.twin[again], nodes.at[again] - high[again], nodes.at[again] - low[again]))


def _sent_on(b: pa.RecordBatch, span: int) -> Iterator[pa.RecordBatch]:
    """Of sorted rows: the repeats as ranges, the halves of the others."""
    nodes = Nodes.of(b)
    lead, ranges = _classes(b, nodes, span)
    yield ranges
    yield from nodes.halves(span, lead)


def _settled(b: pa.RecordBatch, span: int) -> Iterator[pa.RecordBatch]:
    """All repeats among sorted rows that hold all rows of their cores."""
    nodes = Nodes.of(b)
    lead, ranges = _classes(b, nodes, span)
    yield ranges
    core = b.column("core").to_numpy()[lead]
    same = core[1:] == core[:-1]
    i = lead[np.append(same, False) | np.append(False, same)]
    if not len(i):
        return
    names, begin = Names(nodes.data), np.cumsum(nodes.size) - nodes.size
    low, high = nodes.reach(span)
    out = []
    for offset in range(int(low[i].min()), int(high[i].max()) + 1):
        x = i[(low[i] <= offset) & (offset <= high[i])]
        start = begin[x] + nodes.before[x] - offset
        window = names.of(start, start + span)
        order, _, again = _firsts(window, window, nodes.doc[x], nodes.twin[x], nodes.at[x])
        x = x[order][again]
        out.append((nodes.doc[x], nodes.twin[x], nodes.at[x] - offset))
    doc, twin, start = (np.concatenate(x) for x in zip(*out, strict=True))
    yield _node_rows(_rows(0, doc, twin, start, start))


def _joined(*some: pa.RecordBatch | None) -> pa.RecordBatch:
    return pa.Table.from_batches([x for x in some if x is not None]).combine_chunks().to_batches()[0]


def _doubled(nodes: DataFrame, span: int, whole: int) -> DataFrame:
    """A round: the pairs (core, hull) of nodes, sorted with their positions. A core's rows that come together, at most
    `whole`, are settled where they are; the repeats of the others leave as ranges, their firsts go on as halves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ready, many = None, [], 0  # rows of the last core; rows of whole cores that wait
        on = True  # the last core's rows are sent on: it is the first of the partition, or has too many
        for b in batches:
            if not b.num_rows:
                continue
            b = _joined(held, b)
            core = b.column("core").to_numpy()
            cuts = np.flatnonzero(np.append(True, core[1:] != core[:-1])).tolist()
            for lo, hi in itertools.pairwise(cuts):
                if on or hi - lo > whole:
                    yield from _sent_on(b.slice(lo, hi - lo), span)
                else:
                    ready.append(b.slice(lo, hi - lo))
                    many += hi - lo
                on = False
            held = b.slice(cuts[-1])
            if held.num_rows > whole:
                yield from _sent_on(held, span)
                hull, on = held.column("hull").to_numpy(), True
                held = held.slice(int(np.flatnonzero(hull == hull[-1])[0]), 1)  # the first of its name stands for it
            if many > whole:
                yield from _settled(_joined(*ready), span)
                ready, many = [], 0
        if ready:
            yield from _settled(_joined(*ready), span)
        if held is not None:  # the core may go on in the next partition
            yield from _sent_on(held, span)

    cols = ["core", "hull", "doc_id", "twin", "a"]
    # rows of one core may lie in two partitions, rows of one pair may not
    return nodes.repartitionByRange(partitions(nodes.sparkSession), "core", "hull").sortWithinPartitions(*cols).mapInArrow(run, _NODES)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(docs: DataFrame, ranges: DataFrame, span: int, keep_bytes: bool) -> DataFrame:
    """The results, from all ranges of repeated window starts."""
    per_doc = ranges.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("a", "b")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = string_bytes(batch.column("text"))
            lists, out = batch.column("found"), []
            flat, ends = lists.values, lists.offsets.to_numpy()
            av, bv = (flat.field(i).to_numpy() for i in range(2))
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = data[at[i] : at[i + 1]]
                mine = slice(ends[i], ends[i + 1])
                gone = _cover(len(text), av[mine], bv[mine], span)[1] if lists[i].is_valid else np.zeros(len(text), bool)
                kept = text[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                out.append((doc, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string(), pa.binary()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    # a merge join at every size: whether one side could be broadcast would depend on the corpus
    return docs.join(per_doc.hint("merge"), ["doc_id", "twin"], "left").drop("twin").mapInArrow(run, _OUT)


def remove_repeats(df: DataFrame, span: int = SPAN, k: int = K, keep_bytes: bool = True, size: int = SLICE_BYTES, gathered: int = GATHERED, hot: int = HOT, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept: the bytes that stay) for each row of df."""
    docs = keyed(df)
    found = stored(_ranked(docs, span, k, size, gathered, hot), "ranked", "zstd")
    state = stored(_cut_out(docs, found, span, k), "round-0", "zstd")
    names = ["doc_id", "twin", "a", "b"]
    ranges = found.filter("kind = 0").select(names).unionByName(state.filter("kind = 0").select(names))
    left, number = span - k + 1, 0
    while left > 1:  # the last round has one offset for each node, so that none goes on
        left, number = -(-left // 2), number + 1
        state = stored(_doubled(state.filter("kind = 1"), span, whole), f"round-{number}", "zstd")
        ranges = ranges.unionByName(state.filter("kind = 0").select(names))
    out = _removed(docs, ranges, span, keep_bytes)
    return out if keep_bytes else out.drop("kept")
