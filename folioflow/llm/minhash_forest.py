"""Near-duplicate classes by a MinHash LSH forest.

Each text becomes its set of distinct shingle hashes (64 bit). Texts with equal sets are one class from the start. For the
class representatives, TREES signature orders of DEPTH MinHash values each are sorted as wholes (range partitioned by tree
and values, so that equal values spread over tasks). Rows that share the first MIN_DEPTH values of an order form a region.
The depth to which an order is descended adapts to the region: in one of at most WINDOW + 1 rows the common prefix of
MIN_DEPTH is enough and all are candidates of each other; in a larger (crowded) one a row's candidates are the NEXT rows
that follow it in the order, which are those with the longest common prefixes. Candidates are confirmed on full sets: rows
of the sorted order are cut into blocks, and a block's texts meet in one task once, whatever the number of its pairs.
Confirmed links are joined to components.

Then the rest of the crowded regions follows: their rows are sorted by component and cut into chunks, and every two chunks of
a region meet unless all their rows are of one component already. In such a block all pairs of two components are compared
by the sizes and signatures of their sets, each in the first order in which the two share a region; those that agree in the
threshold less SLACK or more are confirmed on full sets, in the block, and only links that join what the block's other
links leave apart come out. So the only pairs of a region that nothing looks at are those that confirmed links already
join, and no pair becomes a row of its own. The comparisons grow with the square of the rows of a region that nothing joins,
the rows that are moved with their number times the number of chunks.

A pair at the threshold 0.85 shares a region in one of 20 orders with a probability of 1 - 4e-7, at 0.8 with 1 - 3e-5. In a
crowded region its 120 values must also agree in the threshold less SLACK: at 0.85 all but 2e-8, at 0.8 all but 1e-7 do.

Defined results: null, empty or wordless texts have no shingles, link with nothing and are kept; texts with fewer words
than a shingle have their whole sequence as one; repeated rows (of one doc_id and one text) are one node, and each gets its
row; rows that share a doc_id, or have none (-1), with different texts are nodes of their own; a text longer than a slice
makes a slice of its own, so a worker holds some times its size; other columns are not looked at, or carried in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioflow.llm.common import keyed, mixed, partitions, shingle_hashes, slices, stored, string_bytes, whole_row, word_hashes
from folioflow.llm.components import components

TREES = 20
DEPTH = 6
MIN_DEPTH = 4
WINDOW = 4
BLOCK = 256
#: Followers of each row of a crowded region that are its candidates at first.
NEXT = 2
#: Rows of a crowded region on each side of a comparison, and the shingles that they have at most.
CHUNK = 2048
CHUNK_SHINGLES = 1 << 20
#: A candidate of a crowded region agrees in at least the threshold less this; six times the estimate's deviation.
SLACK = 0.2

_rng = np.random.default_rng(99)
_ODD = _rng.integers(1, 1 << 63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, 4096, np.uint64)


def signatures(hashes: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """n 16-bit MinHash values for each set; sets without elements get zeros."""
    out = np.zeros((len(counts), n), np.uint16)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        for k in range(n):
            least = np.minimum.reduceat(hashes * _ODD[k] + _ADD[k], starts)
            out[full, k] = mixed(least) >> np.uint64(48)
    return out


def node() -> Column:
    """One number for (doc_id, twin): the doc_id, where it has one text only."""
    return F.when(F.col("twin") == 0, F.col("doc_id")).otherwise(-F.shiftrightunsigned(F.xxhash64("doc_id", "twin"), 1) - 2)


def profiles(docs: DataFrame, shingle: int, n: int) -> DataFrame:
    """doc_id, twin, n_shingles, fp1 and fp2 (the set's 128-bit name), sig of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets, counts = shingle_hashes(*word_hashes(*string_bytes(b.column("text"))), shingle)
            full = np.flatnonzero(counts)
            names = np.zeros((2, len(counts)), np.uint64)
            if len(full):
                starts = (np.cumsum(counts) - counts)[full]
                names[0, full] = np.add.reduceat(mixed(sets), starts)
                names[1, full] = np.add.reduceat(mixed(sets * _ODD[-1] + _ADD[-1]), starts)
            sig = signatures(sets, counts, n)
            sig = pa.Array.from_buffers(pa.binary(2 * n), len(counts), [None, pa.py_buffer(np.ascontiguousarray(sig))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("twin"), pa.array(counts), *(pa.array(x.view(np.int64)) for x in names), sig], names=["doc_id", "twin", "n_shingles", "fp1", "fp2", "sig"])

    return docs.select("doc_id", "twin", "text").mapInArrow(run, "doc_id long, twin long, n_shingles long, fp1 long, fp2 long, sig binary")


def orders(reps: DataFrame, trees: int) -> DataFrame:
    """tree, k1 (the first MIN_DEPTH values), k2 (the others), rep: one row for each order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1 << 14):
                part = b.slice(lo, 1 << 14)
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, trees, DEPTH).astype(np.uint64)
                k1 = np.zeros(sig.shape[:2], np.uint64)
                k2 = k1.copy()
                for i in range(MIN_DEPTH):
                    k1 = k1 << np.uint64(16) | sig[:, :, i]
                for i in range(MIN_DEPTH, DEPTH):
                    k2 = k2 << np.uint64(16) | sig[:, :, i]
                tree = np.tile(np.arange(trees, dtype=np.int32), len(sig))
                rep = np.repeat(part.column("rep").to_numpy(), trees)
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(k1.ravel().view(np.int64)), pa.array(k2.ravel().view(np.int64)), pa.array(rep)], names=["tree", "k1", "k2", "rep"])

    return reps.select("rep", "sig").mapInArrow(run, "tree int, k1 long, k2 long, rep long")


_PAIRS = "kind int, a long, b long, block long, tree int, k1 long, k2 long, part long"


def _rows(kind: int, part: int, **cols: np.ndarray) -> pa.RecordBatch:
    """Rows of _PAIRS; columns that aren't given are null."""
    n = len(next(iter(cols.values())))
    types = {"tree": pa.int32()}
    all_ = {c: pa.array(cols[c]).cast(types.get(c, pa.int64())) if c in cols else pa.nulls(n, types.get(c, pa.int64())) for c in ("a", "b", "block", "tree", "k1", "k2")}
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *all_.values(), pa.array(np.full(n, part, np.int64))], names=["kind", *all_, "part"])


def _neighbours(tree: np.ndarray, k1: np.ndarray, window: int, fresh: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j, of which j >= fresh: at most window apart in one region of at most window + 1 rows so far,
    at most NEXT apart in a larger one; and the rows of larger regions (their first rows, once, when a region grows large)."""
    n = len(tree)
    same = lambda j, d: (tree[j] == tree[j - d]) & (k1[j] == k1[j - d])
    j = np.arange(max(fresh, window + 1), n)
    large = np.zeros(n, bool)
    big = j[same(j, window + 1)]
    large[big] = True
    opening = big[(big == window + 1) | ~same(np.maximum(big, window + 2), window + 2)]
    crowded = np.unique(np.concatenate([big, *(opening - d for d in range(1, window + 2))])) if len(big) else big
    left, right = [], []
    for d in range(1, window + 1):
        j = np.arange(max(fresh, d), n)
        j = j[~large[j] | (d <= NEXT)]
        j = j[same(j, d)]
        left.append(j - d)
        right.append(j)
    return np.concatenate(left), np.concatenate(right), crowded


def candidates(rows: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """a < b and the block in which both stand, each pair once; and tree, k1, rep of the rows of crowded regions (some twice)."""
    spark, names = rows.sparkSession, ["tree", "k1", "k2", "rep"]
    n = partitions(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind 0: pairs; 1: the first and last rows of the partition; 2: rows of crowded regions."""
        part, seen, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            new = [b.column(x).to_numpy() for x in names]
            if not len(new[0]):
                continue
            if seen <= window:
                yield _rows(1, part, **dict(zip(("tree", "k1", "k2", "a"), (x[: window + 1 - seen] for x in new), strict=True)))
            table = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            old = len(table[0]) - len(new[0])
            i, j, crowded = _neighbours(table[0], table[1], window, old)
            x, y = table[3][i], table[3][j]
            real = x != y
            yield _rows(0, part, a=np.minimum(x, y)[real], b=np.maximum(x, y)[real], block=((part << 32) + (seen + j - old) // BLOCK)[real])
            yield _rows(2, part, a=table[3][crowded], tree=table[0][crowded], k1=table[1][crowded])
            seen += len(new[0])
            held = [x[-(window + 2) :] for x in table]
        if seen > window + 1:
            yield _rows(1, part, **dict(zip(("tree", "k1", "k2", "a"), (x[-min(window + 1, seen - window - 1) :] for x in held), strict=True)))

    def joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ends of all partitions, sorted: pairs across their borders (kind 0), and rows of crowded regions that lie
        across a border (kind 2). A few rows for each partition."""
        held = list(batches)
        batch = pa.Table.from_batches(held).combine_chunks() if held else None
        if batch and batch.num_rows:
            tree, k1, rep, part = (batch.column(x).to_numpy() for x in ("tree", "k1", "rep", "part"))
            j = np.concatenate([np.arange(d, len(tree)) for d in range(1, window + 1)])
            i = j - np.repeat(np.arange(1, window + 1), [max(0, len(tree) - d) for d in range(1, window + 1)])
            keep = (part[i] != part[j]) & (rep[i] != rep[j]) & (tree[i] == tree[j]) & (k1[i] == k1[j])
            x, y = rep[i][keep], rep[j][keep]
            yield _rows(0, -1, a=np.minimum(x, y), b=np.maximum(x, y), block=(part[j][keep] << 32) + (1 << 30))
            region = np.cumsum((np.diff(tree, prepend=tree[0]) != 0) | (np.diff(k1, prepend=k1[0]) != 0))
            first = np.flatnonzero(np.diff(region, prepend=-1))
            wide = (np.bincount(region) > window + 1) & (np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first))
            rows_ = np.flatnonzero(wide[region])
            yield _rows(2, -1, a=rep[rows_], tree=tree[rows_], k1=k1[rows_])

    ordered = rows.repartitionByRange(n, "tree", "k1", "k2", "rep").sortWithinPartitions("tree", "k1", "k2", "rep")
    found = stored(ordered.mapInArrow(run, _PAIRS), "forest")
    ends = found.filter("kind = 1").select("tree", "k1", "k2", F.col("a").alias("rep"), "part")
    across = stored(ends.coalesce(1).sortWithinPartitions("tree", "k1", "k2", "rep").mapInArrow(joints, _PAIRS), "forest-joints")
    both = found.unionByName(across)
    pairs = both.filter("kind = 0").select("a", "b", "block")
    return pairs.groupBy("a", "b").agg(F.min("block").alias("block")), both.filter("kind = 2").select("tree", "k1", F.col("a").alias("rep"))


_MET = "block long, doc_id long, others binary"


def _met(block: int, doc: np.ndarray, others: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(doc), block, np.int64)), pa.array(doc), pa.array(others, pa.binary())], names=["block", "doc_id", "others"])


def regions_of(crowded: DataFrame) -> DataFrame:
    """rep, regions (tree, crowd) of rows (tree, k1, rep), some of them repeated: one row for each rep, with a region for each tree at most."""
    return crowded.groupBy("rep").agg(F.collect_set(F.struct("tree", F.xxhash64("tree", "k1").alias("crowd"))).alias("regions"))


def across_components(crowded: DataFrame, roots: DataFrame, reps: DataFrame, num: int, den: int, chunk: int) -> DataFrame:
    """block, doc_id, others of the rows of crowded regions (tree, k1, rep) that roots (node, root) doesn't join: in each
    block the rows that have a partner there (others: null), and then each row with those partners (others: their numbers)
    that may be linked with it by size and signature and share no region of a smaller tree with it. A row of the result
    stands for all partners of one row."""
    n, names = partitions(crowded.sparkSession), ["crowd", "tree", "root", "rep", "size"]
    least = num / den - SLACK

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunks of at most `chunk` rows, and of at most CHUNK_SHINGLES shingles but for a single longer row."""
        at, rows, held = TaskContext.get().partitionId() << 32, 0, 0
        for b in batches:
            out = []
            for size in b.column("size").to_pylist():
                if rows and (rows == chunk or held + size > CHUNK_SHINGLES):
                    at, rows, held = at + 1, 0, 0
                rows, held = rows + 1, held + size
                out.append(at)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(out, pa.int64())], names=[*names, "chunk"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key: tuple, at: np.ndarray, tree: np.ndarray, root: np.ndarray, rep: np.ndarray, size: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            left, right = np.flatnonzero(at == key[1]), np.flatnonzero(at == key[2])
            block = int(mixed(np.array(key).view(np.uint64) * _ODD[:3]).sum().view(np.int64))
            seen, rows, others = np.zeros(len(rep), bool), [], []
            for i in left.tolist():
                j = right[(root[right] != root[i]) & ((rep[right] > rep[i]) | (key[1] != key[2]))]
                j = j[den * np.minimum(size[j], size[i]) >= num * np.maximum(size[j], size[i])]
                equal = sig[j] == sig[i]
                near = np.flatnonzero(equal.sum(1) >= least * sig.shape[1])
                shared = equal[near].reshape(len(near), sig.shape[1] // DEPTH, DEPTH)[:, :, :MIN_DEPTH].all(2)
                j = j[near[shared.argmax(1) == tree[0]]]
                if len(j):
                    seen[i] = seen[j] = True
                    rows.append(rep[i])
                    others.append(rep[j].astype("<i8").tobytes())
            if rows:
                there = rep[seen]
                yield _met(block, there, [None] * len(there))
                yield _met(block, np.asarray(rows, np.int64), others)

        key, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(x).to_numpy() for x in ("crowd", "one", "two")])
            cuts = np.append(np.flatnonzero(np.append(True, (np.diff(keys) != 0).any(0))), b.num_rows)
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (new := tuple(keys[:, lo].tolist())) != key:
                    if held:
                        yield from done(key, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    key, held = new, []
                sig = np.frombuffer(b"".join(b.column("sig").slice(lo, hi - lo).to_pylist()), np.uint16).reshape(hi - lo, -1)
                held.append((*(b.column(x).to_numpy()[lo:hi] for x in ("chunk", "tree", "root", "rep", "size")), sig))
        if held:
            yield from done(key, *(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = regions_of(crowded).join(roots.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").join(reps.select("rep", "size").hint("merge"), "rep")
    rows = rows.select(F.coalesce("root", "rep").alias("root"), "rep", "size", F.explode("regions").alias("x"))
    rows = rows.select("x.crowd", "x.tree", "root", "rep", "size").repartitionByRange(n, *names).sortWithinPartitions(*names)
    rows = stored(rows.mapInArrow(numbered, "crowd long, tree int, root long, rep long, size long, chunk long"), "crowded")
    spans = stored(rows.groupBy("crowd", "chunk").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "chunks")
    one, two = (spans.select("crowd", *(F.col(x).alias(f"{x}{i}") for x in ("chunk", "lo", "hi"))) for i in (1, 2))
    meet = one.hint("merge").join(two, "crowd").filter("chunk1 <= chunk2 AND least(lo1, lo2) <> greatest(hi1, hi2)")
    meet = stored(meet.select("crowd", F.col("chunk1").alias("one"), F.col("chunk2").alias("two")), "chunk-pairs")
    sides = meet.withColumn("chunk", F.explode(F.array_distinct(F.array("one", "two"))))
    rows = sides.hint("merge").join(rows, ["crowd", "chunk"]).join(reps.select("rep", "sig").hint("merge"), "rep")
    rows = rows.repartition(n, "crowd", "one", "two").sortWithinPartitions("crowd", "one", "two")
    return rows.select("crowd", "one", "two", "chunk", "tree", "root", "rep", "size", "sig").mapInArrow(compared, _MET)


def _sets(b: pa.RecordBatch, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its set) of the rows of b that have a text."""
    chosen = np.flatnonzero(b.column("text").is_valid().to_numpy(zero_copy_only=False))
    n = 0
    for piece in slices(iter([b.take(pa.array(chosen))])) if len(chosen) else ():
        h, c = shingle_hashes(*word_hashes(*string_bytes(piece.column("text"))), shingle)
        for e, k in zip(np.cumsum(c), c, strict=True):
            yield int(chosen[n]), h[e - k : e].copy()
            n += 1


def joining(met: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Of the pairs in met, confirmed on full sets, (a, b) that join what the others of their block leave apart."""
    texts = docs.select(node().alias("doc_id"), "text")
    whole = met.filter("others IS NULL").drop("others").hint("merge").join(texts, "doc_id").select("block", "doc_id", F.lit(None).cast("binary").alias("others"), "text")
    both = whole.unionByName(met.filter("others IS NOT NULL").withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets, root = None, {}, {}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for b in batches:
            found: list[tuple[int, int]] = []
            ready = dict(_sets(b, shingle))
            for i, (at, doc, others) in enumerate(zip(*(b.column(x).to_pylist() for x in ("block", "doc_id", "others")), strict=True)):
                if at != block:
                    block, sets, root = at, {}, {}
                if i in ready:
                    sets[doc], root[doc] = ready[i], doc
                    continue
                mine = sets[doc]
                apart = [x for x in np.frombuffer(others, "<i8").tolist() if find(x) != find(doc)]
                if not apart:
                    continue
                size = np.asarray([len(sets[x]) for x in apart])
                all_ = np.concatenate([sets[x] for x in apart])
                place = np.searchsorted(mine, all_)
                place[place == len(mine)] = 0
                common = np.add.reduceat((mine[place] == all_).astype(np.int64), np.cumsum(size) - size)
                for x in np.flatnonzero(den * common >= num * (size + len(mine) - common)).tolist():
                    if find(apart[x]) != find(doc):
                        root[find(apart[x])] = find(doc)
                        found.append((doc, apart[x]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    ordered = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.col("others").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets meet den * intersection >= num * union."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x) or den * len(x) < num * len(y):
        return False
    place = np.searchsorted(y, x)
    place[place == len(y)] = 0
    common = int((y[place] == x).sum())
    return den * common >= num * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets meet den * intersection >= num * union."""
    rows = pairs.select("block", F.col("a").alias("doc_id"), F.col("b").alias("other"))
    members = pairs.select("block", F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # a merge join at every size: whether members could be broadcast would depend on the corpus
    whole = members.hint("merge").join(docs.select(node().alias("doc_id"), "text"), "doc_id").select("block", "doc_id", F.lit(None).cast("long").alias("other"), "text")
    both = whole.unionByName(rows.withColumn("text", F.lit(None).cast("string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for b in batches:
            found: list[tuple[int, int]] = []
            at, doc, other = (b.column(n).to_pylist() for n in ("block", "doc_id", "other"))
            ready = dict(_sets(b, shingle))
            for i in range(b.num_rows):
                if at[i] != block:
                    block, sets = at[i], {}
                if i in ready:
                    sets[doc[i]] = ready[i]
                elif _linked(sets[doc[i]], sets[other[i]], num, den):
                    found.append((doc[i], other[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    ordered = both.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", F.col("other").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long")


def _classed(docs: DataFrame, shingle: int, num: int, den: int, trees: int, window: int, chunk: int) -> DataFrame:
    """doc_id, twin, n_shingles and first, the smallest (doc_id, twin) of its class (null without shingles), of keyed rows."""
    seen = stored(profiles(docs, shingle, trees * DEPTH), "profiles")
    classes = seen.filter("n_shingles > 0").groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "twin", "sig", F.col("n_shingles").alias("size"))).alias("x"))
    classes = classes.select("fp1", "fp2", "x.*").withColumn("rep", node())
    classes = stored(classes, "classes")
    pairs, crowded = candidates(orders(classes, trees), window)
    pairs = stored(pairs, "candidates")
    links = stored(confirmed(pairs, docs, shingle, num, den), "links")
    roots = stored(components(links), "roots")
    met = stored(across_components(crowded, roots, classes, num, den, chunk), "met")
    more = stored(joining(met, docs, shingle, num, den), "more-links")
    if not more.isEmpty():
        roots = stored(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))), "all-roots")
    linked = classes.select("rep", F.struct("doc_id", "twin").alias("own")).join(roots.withColumnRenamed("node", "rep"), "rep")
    firsts = linked.groupBy("root").agg(F.min("own").alias("first"))
    roots = roots.join(firsts, "root").select(F.col("node").alias("rep"), "first")
    named = classes.select("fp1", "fp2", "rep", F.struct("doc_id", "twin").alias("own")).join(roots, "rep", "left")
    named = stored(named.select("fp1", "fp2", F.coalesce("first", "own").alias("first")), "named")
    # rows without shingles have no class: they would all meet on one key
    none = seen.filter("n_shingles = 0").select("doc_id", "twin", "n_shingles", F.lit(None).cast(named.schema["first"].dataType).alias("first"))
    return seen.filter("n_shingles > 0").join(named, ["fp1", "fp2"], "left").select("doc_id", "twin", "n_shingles", "first").unionByName(none)


def near_duplicates(df: DataFrame, shingle: int = 5, num: int = 80, den: int = 100, trees: int = TREES, window: int = WINDOW, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id), one row for each row."""
    out = _classed(keyed(df), shingle, num, den, trees, window, chunk)
    root = F.coalesce("first.doc_id", "doc_id")
    return out.select("doc_id", "n_shingles", root.alias("component_id"), (F.col("doc_id") == root).alias("kept"))


def one_of_each(df: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of df, with df's columns, of the smallest doc_id of each class; of equal rows without a doc_id one."""
    docs = keyed(df, whole_row(df))
    out = _classed(docs, shingle, num, den, TREES, WINDOW, CHUNK)
    gone = out.filter("first.doc_id <> doc_id OR first.twin <> twin").select("doc_id", "twin").distinct()
    kept = docs.join(gone.hint("merge"), ["doc_id", "twin"], "left_anti")
    kept = kept.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "twin").orderBy("twin")))
    alone = F.col("_row.doc_id").isNotNull() | (F.col("_nth") == 1) | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.filter(alone).select("_row.*")
