"""Language-model scores from an n-gram trie (up to three words) with Elias-Fano levels in memory-mapped files.

Level 1 holds the vocabulary: sorted word hashes; a word's id is its place. Level 2 holds, for each word as a context, the
ids of the words that follow it: a sequence made monotone by the context's place, with monotone pointers to where each
context begins. Level 3 holds, for each bigram as a context, the followers as places among those of its last word, so the
numbers are small; to look up (a, b, c), c is first searched among the followers of b, and its place there among those of
(a, b). Sequences and pointers are in Elias-Fano form; probabilities and back-off weights are one byte each with 256
representatives a shard.

The levels are built by three counting passes. Each task counts its documents in numpy and deals packed (n-gram, count)
tables by ranges of the first id; each range is merged, smoothed and written by one task as a file in the shared folder.
N-grams of order two and three seen fewer than min_count times are left out of the levels, but count in the totals (1, as
in the registered query, keeps all; MIN_COUNT is the functions' default); a trigram can only reach it if both of its bigrams
do, which spares the others the shuffle. Smoothing: interpolated absolute
discounting; what is discounted or left out is the context's back-off weight to the next shorter context, and the last is
the add-one unigram over the vocabulary and one unknown word, so probabilities of a context sum to 1 (but for rounding).

Defined results: null and empty texts have the end token alone; without training documents all tokens are unknown; rows
that repeat a doc_id, and those without one (-1), are all counted and scored; a text longer than a slice makes a slice of
its own, so a worker holds some times its size; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import arrow_limits, fresh_dir, packed_sorted, partitions, slices, string_bytes, texts, unpacked_sorted, word_hashes, write_file
from folioflow.llm.elias_fano import EliasFano, encode, from_file, to_bytes

MIN_COUNT = 2
DISCOUNT = 0.75
#: Entries that a counting task gathers before it deals them out.
GATHERED = 3_000_000
#: Stands before and after each text.
END = np.uint64(0x5DEECE66D1234567)


def _deal(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> pa.RecordBatch:
    """A packed table for each shard; keys are sorted and shard does not fall."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = np.append(cuts[1:], len(keys))
    z = zstandard.ZstdCompressor(level=1)
    planes = lambda x: z.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(shard[cuts].astype(np.int32)), pa.array([packed_sorted(keys[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array([planes(counts[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())],
        names=["shard", "keys", "counts"],
    )


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def _counted(df: DataFrame, keys_of, shard_of) -> DataFrame:
    """shard, keys, counts: the packed counts of keys_of(batch) of the training rows of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in slices(batches):
            k, c = np.unique(keys_of(b), return_counts=True)
            keys.append(k)
            counts.append(c.astype(np.int64))
            held += len(k)
            if held > 2 * GATHERED:
                k, c = _merge(keys, counts)
                keys, counts, held = [k], [c], len(k)
                if held > GATHERED:
                    yield _deal(k, c, shard_of(k))
                    keys, counts, held = [], [], 0
        if held:
            k, c = _merge(keys, counts)
            yield _deal(k, c, shard_of(k))

    return df.filter("NOT held_out").mapInArrow(run, "shard int, keys binary, counts binary").repartitionById(partitions(df.sparkSession), "shard")


def _built(dealt: DataFrame, folder: str, level: int, build) -> list[dict]:
    """Writes a file for each shard by build(shard, keys, counts) -> (arrays, n, total); what the files hold, by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for b in batches:
            for s, k, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                held.setdefault(s, []).append((k, c))
        for s in sorted(held):
            d = zstandard.ZstdDecompressor()
            counts = [np.ascontiguousarray(np.frombuffer(d.decompress(c), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64) for _, c in held[s]]
            k, c = _merge([unpacked_sorted(k) for k, _ in held[s]], counts)
            arrays, n, total = build(s, k, c)
            uri = f"{folder}/level{level}-{s:06d}.eft"
            write_file(uri, to_bytes(arrays))
            yield pa.RecordBatch.from_pydict({"shard": [s], "uri": [uri], "n": [n], "total": [total]})

    return sorted((r.asDict() for r in dealt.mapInArrow(run, "shard long, uri string, n long, total long").collect()), key=lambda r: r["shard"])


def _quantised(x: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """One byte for each number, and the 256 representatives: means of equally filled classes."""
    values, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    if len(values) > 256:
        bin_of = np.minimum((np.cumsum(counts) - counts) * 256 // len(x), 255)
        _, bin_of = np.unique(bin_of, return_inverse=True)
        table = np.bincount(bin_of, values * counts) / np.bincount(bin_of, counts)
        codes = bin_of[inverse]
    else:
        table, codes = values, inverse
    return {f"{name}.codes": codes.astype(np.uint8).ravel(), f"{name}.table": table.astype(np.float64)}


class Shard:
    def __init__(self, uri: str):
        self.arrays = from_file(uri)
        self.ids = EliasFano(self.arrays, "ids")
        self.pointers = EliasFano(self.arrays, "pointers") if "pointers.head" in self.arrays else None

    def value(self, name: str, i: np.ndarray) -> np.ndarray:
        return self.arrays[f"{name}.table"][self.arrays[f"{name}.codes"][i]]


@cache
def shard(uri: str) -> Shard:
    return Shard(uri)


class Level:
    """A level's shards as one; files: dicts with shard, uri, n."""

    def __init__(self, files: list[dict], shards: int):
        self.files, self.n = files, sum(f["n"] for f in files)
        self.total = sum(f["total"] for f in files)
        self.slot = np.full(shards, -1, np.int64)
        self.slot[[f["shard"] for f in files]] = np.arange(len(files))
        self.start = np.concatenate([[0], np.cumsum([f["n"] for f in files])]).astype(np.int64)

    def split(self, slot: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(number of a file, indices of the queries that go to it)."""
        if not len(slot):
            return
        order = np.argsort(slot.astype(np.int16 if len(self.files) < 32000 else np.int64), kind="stable")
        sorted_slot = slot[order]
        cuts = np.flatnonzero(np.diff(sorted_slot, prepend=-2))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            if sorted_slot[a] >= 0:
                yield int(sorted_slot[a]), order[a:b]

    def of_place(self, i: np.ndarray) -> np.ndarray:
        """The number of the file that holds the entry at each place (-1: no place)."""
        return np.where(i >= 0, np.searchsorted(self.start, i, "right") - 1, -1)


class Model:
    """The levels that have been built. Everything in here is small; the files are opened by the tasks."""

    def __init__(self, shards: int):
        self.shards, self.levels = shards, {}

    # level 1
    def word_shard(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def word_ids(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct word hashes, -1 for unknown ones, and which of them each entry of h is."""
        words, inverse = np.unique(h, return_inverse=True)
        level, out = self.levels[1], np.full(len(words), -1, np.int64)
        for f, q in level.split(level.slot[self.word_shard(words)]):
            got = shard(level.files[f]["uri"]).ids.find(words[q])
            out[q] = np.where(got >= 0, got + level.start[f], -1)
        return out, inverse.ravel()

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        level, out = self.levels[1], np.zeros(len(ids), np.int64)
        for f, q in level.split(level.of_place(ids)):
            out[q] = shard(level.files[f]["uri"]).arrays["counts"][ids[q] - level.start[f]]
        return out

    def log_unigram(self, counts: np.ndarray) -> np.ndarray:
        level = self.levels[1]
        return np.log10((counts + 1) / (level.total + level.n + 1))

    # levels 2 and 3: contexts are the entries of the level before, dealt by equal ranges
    def context_shard(self, order: int, context: np.ndarray) -> np.ndarray:
        size = max(1, -(-self.levels[order - 1].n // self.shards))
        return context // size

    def first_context(self, order: int, s: int) -> int:
        return s * max(1, -(-self.levels[order - 1].n // self.shards))

    def find(self, order: int, context: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the level of the distinct (context, follower), -1 where one isn't there, in the level's order; the
        queries without an unknown word, and which of the distinct ones each of these is."""
        level = self.levels[order]
        ok = np.flatnonzero((context >= 0) & (follower >= 0))
        pairs, inverse = np.unique(context[ok] << 32 | follower[ok], return_inverse=True)
        c, w = pairs >> 32, pairs & 0xFFFFFFFF
        found = np.full(len(pairs), -1, np.int64)
        for f, q in level.split(level.slot[self.context_shard(order, c)]):
            s = shard(level.files[f]["uri"])
            local = (c[q] - self.first_context(order, level.files[f]["shard"])).astype(np.uint64)
            got = s.ids.find(local * s.arrays["bound"][0] + w[q].astype(np.uint64))
            found[q] = np.where((got >= 0) & (w[q] < s.arrays["bound"][0].astype(np.int64)), got + level.start[f], -1)
        return found, ok, inverse.ravel()

    def begins(self, order: int, context: np.ndarray) -> np.ndarray:
        """Where the followers of contexts begin in the level; 0 for unknown contexts."""
        level, out = self.levels[order], np.zeros(len(context), np.int64)
        ok = np.flatnonzero(context >= 0)
        for f, q in level.split(level.slot[self.context_shard(order, context[ok])]):
            s = shard(level.files[f]["uri"])
            out[ok[q]] = s.pointers[context[ok[q]] - self.first_context(order, level.files[f]["shard"])].astype(np.int64) + level.start[f]
        return out

    def log_probability(self, order: int, place: np.ndarray) -> np.ndarray:
        """0 where there is no place."""
        level, out = self.levels[order], np.zeros(len(place))
        for f, q in level.split(level.of_place(place)):
            out[q] = shard(level.files[f]["uri"]).value("p", place[q] - level.start[f])
        return out

    def log_weight(self, order: int, context: np.ndarray) -> np.ndarray:
        """Back-off weights of contexts; 0 for those that the level doesn't know."""
        level, out = self.levels[order], np.zeros(len(context))
        ok = np.flatnonzero(context >= 0)
        for f, q in level.split(level.slot[self.context_shard(order, context[ok])]):
            out[ok[q]] = shard(level.files[f]["uri"]).value("w", context[ok[q]] - self.first_context(order, level.files[f]["shard"]))
        return out


class Sequences:
    """All texts of a batch, each between two end tokens.

    words: ids of the distinct words; word: which of them stands at each position; begin: where each text begins; at: the
    positions that are scored. What a word or a pair of words says is looked up once and dealt to its positions.
    """

    def __init__(self, model: Model, b: pa.RecordBatch):
        h, counts = word_hashes(*string_bytes(b.column("text")))
        self.model, self.begin = model, np.concatenate([[0], np.cumsum(counts + 2)])
        full = np.full(self.begin[-1], END, np.uint64)
        real = np.ones(len(full), bool)
        real[self.begin[:-1]] = False
        real[self.begin[1:] - 1] = False
        full[real] = h
        scored = np.ones(len(full), bool)
        scored[self.begin[:-1]] = False
        self.at = np.flatnonzero(scored)
        self.words, self.word = model.word_ids(full)
        self.ids = self.words[self.word]

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places in level 2 of the distinct bigrams, the positions that end one, and which one it is."""
        found, ok, inverse = self.model.find(2, self.ids[self.at - 1], self.ids[self.at])
        return found, self.at[ok], inverse

    def trigrams(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The positions that end two bigrams with a place, the place of the first, and where the last word stands among the
        followers of the second's first word."""
        need = self.at[(place[self.at] >= 0) & (place[self.at - 1] >= 0)]
        follow = self.model.begins(2, self.words)[self.word]
        return need, place[need - 1], place[need] - follow[need - 1]


def _level(level: int, order_shards: int, model: Model, min_count: int):
    """build() for level 2 or 3."""

    def build(s: int, keys: np.ndarray, counts: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        first = model.first_context(level, s)
        n_contexts = max(0, min(model.levels[level - 1].n, model.first_context(level, s + 1)) - first)
        context, follower = (keys >> np.uint64(32)).astype(np.int64) - first, (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        if level == 2:
            total = np.bincount(context, counts, n_contexts)
        else:
            total = np.zeros(n_contexts)
            at = np.arange(first, first + n_contexts)
            for f, q in model.levels[2].split(model.levels[2].of_place(at)):
                total[q] = shard(model.levels[2].files[f]["uri"]).arrays["counts"][at[q] - model.levels[2].start[f]]
        keep = counts >= min_count
        context, follower, counts = context[keep], follower[keep], counts[keep]
        part = (counts - DISCOUNT) / total[context]
        weight = np.maximum(1 - np.bincount(context, part, n_contexts), 1e-12)
        if level == 2:
            lower = model.log_unigram(model.word_counts(follower))
        else:  # the follower is a place among those of the bigram's last word
            last = _last_words(model, context + first)
            lower = model.log_probability(2, model.begins(2, last) + follower)
        p = np.log10(part + weight[context] * 10**lower)
        size = np.bincount(context, minlength=n_contexts)
        bound = int(follower.max(initial=0)) + 1
        arrays = {"bound": np.asarray([bound], np.uint64)}
        arrays |= encode(context.astype(np.uint64) * np.uint64(bound) + follower.astype(np.uint64), "ids")
        arrays |= encode(np.concatenate([[0], np.cumsum(size)]), "pointers")
        arrays |= _quantised(p, "p") | _quantised(np.log10(weight), "w")
        if level == 2:
            arrays["counts"] = counts.astype(np.uint32 if counts.max(initial=0) < 1 << 32 else np.uint64)
        return arrays, len(counts), int(counts.sum())

    return build


def _last_words(model: Model, place: np.ndarray) -> np.ndarray:
    """The last word of the bigram at each place of level 2."""
    level, out = model.levels[2], np.zeros(len(place), np.int64)
    for f, q in level.split(level.of_place(place)):
        s = shard(level.files[f]["uri"])
        out[q] = (s.ids[place[q] - level.start[f]] % s.arrays["bound"][0]).astype(np.int64)
    return out


def train(df: DataFrame, folder: str, min_count: int = MIN_COUNT) -> Model:
    """The model of the rows of df (doc_id, text, held_out) that are not held out."""
    model = Model(partitions(df.sparkSession))

    def words(b: pa.RecordBatch) -> np.ndarray:
        h, _ = word_hashes(*string_bytes(b.column("text")))
        return np.concatenate([h, np.full(b.num_rows, END, np.uint64)])

    def vocabulary(s: int, keys: np.ndarray, counts: np.ndarray) -> tuple[dict[str, np.ndarray], int, int]:
        return encode(keys, "ids") | {"counts": counts}, len(keys), int(counts.sum())

    model.levels[1] = Level(_built(_counted(df, words, model.word_shard), folder, 1, vocabulary), model.shards)
    if model.levels[1].n >= 1 << 32:
        raise ValueError("word ids need more than 32 bits")

    def bigrams(b: pa.RecordBatch) -> np.ndarray:
        some = Sequences(model, b)
        return some.ids[some.at - 1].astype(np.uint64) << np.uint64(32) | some.ids[some.at].astype(np.uint64)

    by_context = lambda order: lambda k: model.context_shard(order, (k >> np.uint64(32)).astype(np.int64))
    model.levels[2] = Level(_built(_counted(df, bigrams, by_context(2)), folder, 2, _level(2, model.shards, model, min_count)), model.shards)
    if model.levels[2].n >= 1 << 32:
        raise ValueError("bigram places need more than 32 bits")

    def trigrams(b: pa.RecordBatch) -> np.ndarray:
        some = Sequences(model, b)
        found, at, which = some.bigrams()
        place = np.full(len(some.ids), -1, np.int64)
        place[at] = found[which]
        _, context, follower = some.trigrams(place)
        return context.astype(np.uint64) << np.uint64(32) | follower.astype(np.uint64)

    model.levels[3] = Level(_built(_counted(df, trigrams, by_context(3)), folder, 3, _level(3, model.shards, model, min_count)), model.shards)
    return model


def scores(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df (doc_id, text, held_out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            some = Sequences(model, b)
            counts = model.word_counts(some.words)
            base, n = np.zeros(len(some.ids)), len(some.ids)
            base[some.at] = model.log_unigram(counts)[some.word[some.at]]
            scored = np.zeros(n, bool)
            scored[some.at] = True
            known = scored & (counts > 0)[some.word]
            found, at, which = some.bigrams()
            place, log2, weight3 = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n)
            place[at], log2[at], weight3[at] = found[which], model.log_probability(2, found)[which], model.log_weight(3, found)[which]
            rest = some.at[place[some.at] < 0]
            log2[rest] = model.log_weight(2, some.words)[some.word[rest - 1]] + base[rest]
            need, context, follower = some.trigrams(place)
            whole = np.zeros(n)
            whole[some.at] = log2[some.at] + weight3[some.at - 1]
            found, ok, which = model.find(3, context, follower)
            has = np.flatnonzero(found[which] >= 0)
            whole[need[ok[has]]] = model.log_probability(3, found)[which[has]]
            sums = lambda x: np.add.reduceat(x, some.begin[:-1])
            cols = [sums(scored.astype(np.int64)), sums(known.astype(np.int64)), np.full(b.num_rows, model.levels[1].total), sums(base), sums(whole)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, cols)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return df.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(df: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Trains on the rows of df whose crc32(doc_id as text) mod 7 is not 2, and scores all."""
    arrow_limits(df.sparkSession)
    rows = texts(df, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)).alias("held_out"))
    return scores(rows, train(rows, fresh_dir(df.sparkSession, "ngram-trie"), min_count))
