import hashlib
import math
import random
import re
import zlib

import brute
import compare
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import coding, common, decontamination, elias_fano, line_dedup, minhash_forest, ngram_trie, packing, personal_data, quality_rules, suffix_dedup, token_counts, token_files
from folioflow.llm.queries import QUERIES, SQL, vocabulary

BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, found string, block long, _row string, text_1 string"


def corpus() -> list[tuple[int, str | None]]:
    r = random.Random(4)
    vocab = ["alpha", "Beta", "gamma", "delta", "of", "the", "and", "über", "çà", "x1", "THE"]
    line = "A very common line that many documents share, it is long."
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, "a" * 3000), (5, "ab " * 900)]
    long = " ".join(r.choice(vocab) + str(r.randint(0, 99)) for _ in range(6000))
    out.append((6, long))
    out.append((7, long[:9000] + " changed " + long[9100:]))
    for d in range(8, 60):
        body = " ".join(r.choice(vocab) + r.choice(["", str(r.randint(0, 400))]) for _ in range(r.randint(1, 120)))
        if d % 3 == 0:
            body += "\n" + ("  " + line.upper() if d % 2 else line) + "\nmore of it"
        out.append((d, body))
    for d in range(60, 75):  # copies and near copies
        text = out[20 + d % 4][1] or ""
        w = text.split(" ")
        if d % 2 and len(w) > 60:
            w[r.randrange(len(w))] = "edited"
        out.append((d, " ".join(w)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, None, "s", None if t is None else len(t), "clash", d, "clash", None) for d, t in corpus()]
    common.arrow_limits(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def repeated(docs):
    """Rows twice, and rows without an id."""
    return docs.unionByName(docs).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))


def by_id(df, *cols):
    return {r.doc_id: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


OPERATORS = {
    "op1": ngram_trie.score,
    "op2": lambda df: token_counts.count_tokens(df, BYTE),
    "op3": line_dedup.digest,
    "op4": personal_data.personal_data,
    "op5": suffix_dedup.remove_repeats,
    "op6": quality_rules.judge,
    "op7": lambda df: packing.pack(df, WORD),
    "op8": lambda df: token_files.round_trip(df, BYTE),
    "op9": minhash_forest.near_duplicates,
    "op10": lambda df: decontamination.contamination(df, df.sparkSession.createDataFrame([(1, "alpha beta " * 9), (None, None), (2, "x")], "item_id long, text string")),
    "keep": quality_rules.keep,
    "lines": line_dedup.dedup_table,
    "one_of_each": minhash_forest.one_of_each,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_repeated_rows_and_missing_ids(repeated, name):
    n, out = repeated.count(), OPERATORS[name](repeated).collect()
    assert len(out) == n or name in ("keep", "one_of_each") or name == "op7" and len(out) >= n
    if name.startswith("op"):
        assert -1 in {r.doc_id for r in out}


def test_op1_against_plain_model(docs):
    end, cut = "<end>", ngram_trie.DISCOUNT
    rows = [(d, [end, *brute.words(t), end], zlib.crc32(str(d).encode()) % 7 == 2) for d, t in corpus()]
    one, two, three, follows = {}, {}, {}, {}
    for _, w, held in rows:
        if not held:
            for i in range(1, len(w)):
                one[w[i]] = one.get(w[i], 0) + 1
                two[tuple(w[i - 1 : i + 1])] = two.get(tuple(w[i - 1 : i + 1]), 0) + 1
                follows[w[i - 1]] = follows.get(w[i - 1], 0) + 1
                if i > 1:
                    three[tuple(w[i - 2 : i + 1])] = three.get(tuple(w[i - 2 : i + 1]), 0) + 1
    n, v = sum(one.values()), len(one)
    k2, k3 = ({g: c for g, c in x.items() if c >= 2} for x in (two, three))
    w2, w3 = {}, {}
    for (a, _), c in k2.items():
        w2[a] = w2.get(a, 1) - (c - cut) / follows[a]
    for (a, b, _), c in k3.items():
        w3[a, b] = w3.get((a, b), 1) - (c - cut) / two[a, b]
    p1 = lambda c: (one.get(c, 0) + 1) / (n + v + 1)
    p2 = lambda b, c: ((k2[b, c] - cut) / follows[b] if (b, c) in k2 else 0) + w2.get(b, 1) * p1(c)
    p3 = lambda a, b, c: p2(b, c) if (a, b) not in k2 else ((k3[a, b, c] - cut) / two[a, b] if (a, b, c) in k3 else 0) + w3.get((a, b), 1) * p2(b, c)
    got = by_id(ngram_trie.score(docs), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for d, w, held in rows:
        base = sum(math.log10(p1(x)) for x in w[1:])
        exact = sum(math.log10(p3(w[i - 2] if i > 1 else None, w[i - 1], w[i])) for i in range(1, len(w)))
        assert got[d][:4] == (held, len(w) - 1, sum(x in one for x in w[1:]), n)
        assert got[d][4] == pytest.approx(base, rel=1e-9)
        assert got[d][5] == pytest.approx(exact, abs=0.03 * len(w))
    assert sum(p2("the", c) for c in one) + w2.get("the", 1) / (n + v + 1) == pytest.approx(1)


def test_op1_query_keeps_ngrams_seen_once(docs, spark, tmp_path):
    end, cut = "<end>", ngram_trie.DISCOUNT
    one, two, three, follows = {}, {}, {}, {}
    rows = [(d, [end, *brute.words(t), end], zlib.crc32(str(d).encode()) % 7 == 2) for d, t in corpus()]
    for _, w, held in rows:
        for i in range(1, len(w) if not held else 0):
            for x, g in ((one, w[i]), (two, (w[i - 1], w[i])), (follows, w[i - 1]), *([(three, (w[i - 2], w[i - 1], w[i]))] if i > 1 else [])):
                x[g] = x.get(g, 0) + 1
    n, v = sum(one.values()), len(one)
    w2, w3 = {}, {}
    for (a, _), c in two.items():
        w2[a] = w2.get(a, 1) - (c - cut) / follows[a]
    for (a, b, _), c in three.items():
        w3[a, b] = w3.get((a, b), 1) - (c - cut) / two[a, b]
    p1 = lambda c: (one.get(c, 0) + 1) / (n + v + 1)
    p2 = lambda b, c: ((two[b, c] - cut) / follows[b] if (b, c) in two else 0) + w2.get(b, 1) * p1(c)
    p3 = lambda a, b, c: ((three[a, b, c] - cut) / two[a, b] if (a, b, c) in three else 0) + w3.get((a, b), 1) * p2(b, c)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = by_id(QUERIES["op1_ngram_trie"](spark, f"file://{tmp_path}"), "score")
    for d, w, _ in rows:
        exact = sum(math.log10(p3(w[i - 2] if i > 1 else None, w[i - 1], w[i])) for i in range(1, len(w)))
        assert got[d] == pytest.approx(exact, abs=0.03 * len(w))


def test_elias_fano():
    r = np.random.default_rng(1)
    for values in (np.sort(r.choice(10**6, 5000, False)), np.arange(3), np.array([7]), np.concatenate([np.arange(1000), [1 << 60]]), np.sort(r.integers(0, 1 << 63, 3000, np.uint64))):
        raw = pa.py_buffer(elias_fano.to_bytes(elias_fano.encode(values, "x")))
        assert len(raw) > 0
        ef = elias_fano.EliasFano(elias_fano.encode(values, "x"), "x")
        assert (ef[np.arange(len(values))] == values.astype(np.uint64)).all()
        found = ef.find(values.astype(np.uint64))
        assert (found == np.arange(len(values))).all()
        missing = np.setdiff1d(r.integers(0, 1 << 62, 500, np.uint64), values.astype(np.uint64))
        assert (ef.find(missing) == -1).all()
    assert (elias_fano.EliasFano(elias_fano.encode(np.zeros(0, np.uint64), "x"), "x").find(np.arange(3)) == -1).all()


def plain_count(text):
    return len(token_counts.tokenizer(BYTE).encode(text or "", add_special_tokens=False).ids)


def test_op2(docs):
    got = by_id(token_counts.count_tokens(docs, BYTE, chunk=500, overlap=32), "n_bytes", "n_tokens", "over_limit")
    for d, t in corpus():
        n = plain_count(t)
        assert got[d] == (len((t or "").encode()), n, n > 1024)


HARD = ["a" * 5000, "ab " * 900 + "<|endoftext|> x" * 90 + "q" * 900, " \n" * 1500 + "hé" * 600, "'s don't " * 400, "x" * 995 + "<|endoftext|>" * 90, "foo,,. bar##. ..x .y , z q\x1ct _. a.b 4.0 ", "", "  lead", "tail  ", "\n\n\nA", "日本語 テスト。" * 300, "é. ö,x", "ÀÉ ẞ İI Σ. ς", "<|startoftext|>a <|endoftext|>"]


@pytest.mark.parametrize("text", HARD)
def test_splicing_and_runs(text):
    assert token_counts.spliced_count(token_counts.tokenizer(BYTE), text, 300, 32) == plain_count(text)
    for coder, path in ((coding.byte_ids(BYTE), BYTE), (coding.word_ids(WORD), WORD)):
        want = token_counts.tokenizer(path).encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.ids([text])[0], "<u4").tolist() == want


def test_op3(docs):
    assert by_id(line_dedup.digest(docs), "n_lines", "n_dropped", "kept_sha256") == brute.line_dedup(corpus())


PRIVATE = ["call +1 (569) 555-6633 4795326016703902 now", "a@b.c%d@e.f, x@y.zz.", "1.2.3.4.5.6.7.8 and 300.1.1.1", "4444 4444 4444 4448", "+1 234", "@@a@b", "+49 30 1234567 12345678", "", "0" * 500]


@pytest.mark.parametrize("text", PRIVATE)
def test_op4_base(text):
    checks = {"email": lambda x: True, "ip": personal_data.is_ip, "card": personal_data.is_card, "phone": personal_data.is_phone}
    assert personal_data.base_spans(text) == [[m.span() for m in re.finditer(p, text) if checks[k](m[0])] for k, p in brute.PII.items()]


def test_op4_held_out(spark):
    model = personal_data.trained(personal_data.labelled_table(spark))
    right = found = there = 0
    for words, labels in personal_data.labelled_rows(200, seed=5):
        guess = ["O"] * len(words)
        runs = personal_data.runs(words)
        for (lo, hi), y in zip(runs, model.decode([[personal_data.features(words, i) for i in range(lo, hi)] for lo, hi in runs]), strict=True):
            guess[lo:hi] = [personal_data.LABELS[k] for k in y]
        right += sum(a == b != "O" for a, b in zip(guess, labels, strict=True))
        found += sum(g != "O" for g in guess)
        there += sum(x != "O" for x in labels)
    assert right > 0.93 * found
    assert right > 0.93 * there
    base, more = personal_data.find([PRIVATE[0]], model)[0]
    assert base == [[], [], [], []]
    assert more == [[], [], [(23, 39)], [(5, 22)]]


@pytest.mark.parametrize("how", [{}, {"size": 700}, {"hot": 2, "gathered": 100}, {"size": 1500, "hot": 2, "gathered": 1, "whole": 2}, {"k": 20, "whole": 0}])
def test_op5(docs, how):
    assert by_id(suffix_dedup.remove_repeats(docs, keep_bytes=False, **how), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(corpus())


def test_op6(docs):
    got = by_id(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == {d: brute.quality(t) for d, t in corpus()}
    kept = {d for d, k in by_id(quality_rules.judge(docs), "kept").items() if k}
    assert {r.doc_id for r in quality_rules.keep(docs).collect()} == kept
    assert quality_rules.keep(docs).columns == docs.columns


def test_op7(docs):
    seen = {}
    for r in packing.pack(docs, WORD, capacity=64, keep_ids=True).collect():
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert zlib.crc32(r.ids) == r.ids_crc32
    for parts in seen.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    got = {}
    for r in packing.pack(docs, WORD).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for d, t in corpus():
        ids = np.asarray([*token_counts.tokenizer(WORD).encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert sorted(got[d]) == [(k, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for k, a in enumerate(range(0, len(ids), 4096))]


def test_plan_is_tight():
    r = random.Random(3)
    counts = {n: r.randint(0, 30) for n in range(1, 101)}
    rows = packing.plan(counts, 100)
    fill = {}
    for size, _, n, first, offset in rows.tolist():
        for b in range(first, first + n):
            fill.setdefault(b, []).append((offset, size))
    assert sum(len(x) for x in fill.values()) == sum(counts.values())
    for parts in fill.values():
        parts.sort()
        assert all(a == sum(s for _, s in parts[:i]) for i, (a, _) in enumerate(parts))
        assert sum(s for _, s in parts) <= 100
        assert sum(3 * s > 100 for _, s in parts) <= 2
    assert len(fill) <= 1.05 * sum(n * c for n, c in counts.items()) / 100 + 1


def test_op8(docs):
    got, start = by_id(token_files.round_trip(docs, BYTE), "start", "n_tokens", "ids_crc32"), 0
    for d, t in sorted(corpus(), key=lambda x: x[0]):
        ids = np.asarray([*token_counts.tokenizer(BYTE).encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert got[d] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_block_round_trip():
    r = np.random.default_rng(2)
    for n in (0, 1, 5, 1003):
        ranks = r.integers(0, 1 << 32, n, np.uint64).astype(np.uint32) >> r.integers(0, 32, n).astype(np.uint32)
        docs, lengths = np.arange(2), np.asarray([n // 2, n - n // 2])
        blob = token_files.encode_block(docs, lengths, ranks)
        a, b, c, end = token_files.decode_block(blob)
        assert (a == docs).all() and (b == lengths).all() and (c == ranks).all() and end == len(blob)


@pytest.mark.parametrize(("k", "num"), [(3, 85), (5, 80)])
def test_op9(docs, k, num):
    assert by_id(minhash_forest.near_duplicates(docs, k, num, 100), "n_shingles", "component_id") == brute.near_classes(corpus(), k, num, 100)


def test_op9_crowded_region(spark):
    r = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(60)] = f"e{r.randrange(1000)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(minhash_forest.near_duplicates(df, 3, 85, 100), "n_shingles", "component_id") == brute.near_classes(rows, 3, 85, 100)


@pytest.mark.parametrize("how", [{}, {"chunk": 4}])
def test_op9_two_families(spark, how):
    """Families of near copies whose members agree better with each other than with the other family, above the threshold."""
    r, rows = random.Random(3), []
    for f in range(8):
        base = [f"b{f}_{i}" for i in range(500)]
        for side in range(2):
            for m in range(8):
                w = list(base)
                for i in range(10 * side):
                    w[20 + 40 * i] = f"o{f}_{i}"
                w[r.randrange(450, 490)] = f"m{f}_{side}_{m}"
                rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_classes(rows, 3, 85, 100)
    assert len({root for _, root in want.values()}) == 8
    assert by_id(minhash_forest.near_duplicates(df, 3, 85, 100, **how), "n_shingles", "component_id") == want


def test_op9_pages_of_one_template(spark):
    """600 texts, 300 pairs of which are just above the threshold and all others just below: one region of over 512 rows."""
    template, rows = [f"t{i}" for i in range(400)], []
    for pair in range(300):
        for side in range(2):
            rows.append((len(rows), " ".join(template + [f"p{pair}_{i}" for i in range(14)] + [f"u{pair}_{side}_{i}" for i in range(31)])))
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near_classes(rows, 3, 85, 100)
    assert len({root for _, root in want.values()}) == 300
    assert by_id(minhash_forest.near_duplicates(df, 3, 85, 100), "n_shingles", "component_id") == want


def test_op9_link_recall(spark, sf):
    """Queries against all rows: every hundredth row and all rows of the small table."""
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    got = by_id(minhash_forest.near_duplicates(df, 3, 85, 100), "component_id")
    sets = {d: brute.shingles(t, 3) for d, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links
    assert sum(got[a] == got[b] for a, b in links) == len(links)


def test_op9_rows_without_an_id_and_shared_ids(spark):
    text = [" ".join(f"w{k}_{i}" for i in range(80)) for k in range(4)]
    rows = [(None, text[0]), (None, text[0]), (None, text[1]), (7, text[0] + " more"), (9, text[1]), (5, text[2]), (5, text[3]), (6, text[3] + " x"), (None, ""), (None, None), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, 3, 85, 100).collect())
    assert got == sorted([(-1, 78, -1, True)] * 3 + [(7, 79, -1, False), (9, 78, -1, False)] + [(5, 78, 5, True)] * 2 + [(6, 79, 5, False), (-1, 0, -1, True), (-1, 0, -1, True), (8, 0, 8, True)])
    kept = sorted(minhash_forest.one_of_each(df, 3, 85).collect(), key=repr)
    assert [tuple(r) for r in kept] == sorted([(None, text[0]), (None, text[1]), (5, text[2]), (5, text[3]), (None, ""), (None, None), (8, None)], key=lambda x: repr(spark_row(x)))


def spark_row(x):
    return Row(doc_id=x[0], text=x[1])


def test_op10(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((16, 30, 60))] + [(9, None), (10, "short")]
    rows, want = [], {}
    for d in range(40):
        text = " ".join(word() for _ in range(80))
        want[d] = []
        if d % 2 == 0:
            i = (d // 2) % 3
            body = list(items[i][1])
            for _ in range(len(body) // 14 if d % 4 else 0):  # within the budget
                body[r.randrange(len(body))] = r.choice("xyz")
            text = text[:100] + "  " + "".join(body).replace(" ", "\n ", 2).upper() + " " + text[100:]
            want[d] = [i]
        rows.append((d, text))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert by_id(decontamination.contamination(df, bench), "item_ids") == want
    one, many = decontamination.matches(df, bench), decontamination.matches(df, bench, block_chars=100)
    assert sorted(one.collect()) == sorted(many.collect())
    assert {x.doc_id for x in decontamination.clean(df, bench).collect()} == {d for d, x in want.items() if not x}


def test_op10_against_brute(spark):
    r = random.Random(16)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate((1, 2, 3, 4, 5, 6, 9, 16, 40))]
    items += [(20, "xyz"), (21, "Qq"), (22, "İstanbul UND die STRASSE des Ortes"), (23, "ΟΔΟΣ ΤΗΣ ΠΟΛΗΣ"), (None, "no id but a text of its own"), (24, ""), (25, None), (26, "  ")]
    docs: list[tuple] = [(0, None), (1, ""), (2, "see İSTANBUL und DIE strasse DES ortes there"), (3, "İ NO ID\t but a Text of its own"), (4, "οδος της πολης"), (5, "ab xyz"), (6, "QQ")]
    for d in range(7, 60):
        body = list(items[d % 9][1])
        budget = len(body) // 10
        for _ in range(r.randint(0, budget + 2) if len(body) > 3 else 0):
            at, kind = r.randrange(len(body)), r.randrange(3)
            body[at : at + 1] = [] if kind == 0 else [r.choice("qrs")] if kind == 1 else [body[at], r.choice("qrs")]
        cut = r.choice([0, 0, len(body) // 2])
        docs.append((d, " ".join(word() for _ in range(r.randint(0, 12))) + " " * r.randint(0, 2) + "".join(body[cut:]).upper() + "  " + word()))
    # the halves of a passage at the end of one text and at the start of the next are no passage
    docs += [(60, "w " + items[7][1][:60]), (61, items[7][1][60:] + " w"), (None, items[7][1]), (None, "clean"), (5, "other " + items[8][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((-1 if d is None else d, x) for (d, _), x in zip(docs, brute.leaks(docs, items), strict=True))
    for size in (common.SLICE_BYTES, 150):
        got = decontamination.contamination(df, bench, size=size).collect()
        assert sorted((x.doc_id, tuple(x.item_ids)) for x in got) == want
        assert all(x.contaminated == bool(x.item_ids) and x.n_items == len(x.item_ids) for x in got)
    left = {x.text for x in decontamination.clean(df, bench).collect()}
    assert left == {t for (_, t), x in zip(docs, brute.leaks(docs, items), strict=True) if not x}


def test_op10_long_text(spark):
    passage = "these are the words of a question that nobody should have seen before the test " * 2
    long = ("filler text of no importance. " * 9000)[: (1 << 17) - 40] + passage.replace(" ", " " * 700, 1) + "end of it all. " * 30000
    df = spark.createDataFrame([(1, long), (2, long.replace("nobody", "everyone and his dog"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = decontamination.matches(df, bench, size=1 << 16).collect()
    assert {(x.doc_id, x.item_id) for x in got} >= {(1, 7)}
    assert sorted(map(tuple, got)) == sorted(map(tuple, decontamination.matches(df, bench, size=1 << 24).collect()))
    assert all(passage[:20] in re.sub(" +", " ", long[x.start : x.end]) or passage.strip()[-20:] in long[x.start : x.end] for x in got if x.doc_id == 1 and x.edits == 0)


@pytest.mark.parametrize("size", [300, 1000, 4096])
def test_op10_stretches_find_what_the_whole_has(spark, size):
    r = random.Random(size)
    words = [f"w{k}" for k in range(300)]
    passage = " ".join(r.choice(words) for _ in range(90))
    edited = lambda: "".join(r.choice("xyz") if r.random() < 0.04 else c for c in passage)
    texts = [" ".join([" ".join(r.choices(words, k=r.randint(5, 900))) + " " * r.randint(0, 900), edited(), *r.choices(words, k=r.randint(0, 700)), edited(), "end"]) for _ in range(25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(1, passage), (2, passage[40:200])], "item_id long, text string")
    whole = sorted(map(tuple, decontamination.matches(df, bench, size=1 << 24).collect()))
    assert len(whole) > 100 and sorted(map(tuple, decontamination.matches(df, bench, size=size).collect())) == whole
    alone = [x for k in (3, 4) for x in decontamination.matches(df.filter(F.col("doc_id") == k), bench, size=1 << 24).collect()]
    assert sorted(map(tuple, alone)) == [x for x in whole if x[0] in (3, 4)]


def test_op10_items_without_an_id_in_many_blocks(spark):
    items = [f"passage number {k} of a benchmark that nobody knows about {k * k}" for k in range(60)]
    df = spark.createDataFrame([(k, f"before {x} after") for k, x in enumerate(items)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, x) for x in items], "item_id long, text string")
    got = decontamination.matches(df, bench, block_chars=400).collect()
    assert {x.doc_id for x in got} == set(range(60)) and {x.item_id for x in got} == {-1}


def test_op1_trains_on_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "alpha beta"), (None, "alpha gamma"), (4, "alpha")], "doc_id long, text string")
    held = {4: zlib.crc32(b"4") % 7 == 2}
    got = [tuple(r) for r in ngram_trie.score(df, min_count=1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens").collect()]
    n = 6 + (0 if held[4] else 2)
    assert sorted(got) == sorted([(-1, False, 3, 3, n), (-1, False, 3, 3, n), (4, held[4], 2, 2, n)])


NO_ID = [(None, "one line that is long enough to be a key of its own, surely\nmine alone"), (None, "another\none line that is long enough to be a key of its own, surely"), (None, "z"), (3, "short"), (3, "one line that is long enough to be a key of its own, surely\nthree"), (4, "one line that is long enough to be a key of its own, surely"), (5, "one line that is long enough to be a key of its own, surely"), (5, "one line that is long enough to be a key of its own, surely")]


def test_op3_rows_without_an_id_and_shared_ids(spark):
    df = spark.createDataFrame(NO_ID, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect())
    line = NO_ID[5][1]
    assert got == sorted([(-1, "mine alone"), (-1, "another"), (-1, "z"), (3, "short"), (3, "three"), (4, ""), (5, line), (5, line)])


def test_op5_rows_without_an_id_and_shared_ids(spark):
    r = random.Random(1)
    a, b, c = ("".join(r.choice("abcdefghij ") for _ in range(900)) for _ in range(3))
    rows = [(None, a + b[:300]), (None, c), (2, a), (2, b), (2, c), (3, a + c), (3, a + c)]
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([(-1, 1200, 0), (-1, 900, 0), (2, 900, 900), (2, 900, 300), (2, 900, 900), (3, 1800, 1800), (3, 1800, 1800)])


def test_op5_common_passage(spark):
    """A passage in all texts, whose edges have as many contexts as there are texts."""
    r = random.Random(2)
    passage = "".join(r.choice("abcdefghij ") for _ in range(260))
    rows = [(d, "".join(r.choice("klmnopq ") for _ in range(r.randint(0, 160))) + passage[r.choice([0, 0, 3]) : 240 + r.randint(0, 20)] + "".join(r.choice("klmnopq ") for _ in range(r.randint(0, 160)))) for d in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for how in ({}, {"hot": 3, "gathered": 300}, {"whole": 3}):
        assert by_id(suffix_dedup.remove_repeats(df, keep_bytes=False, **how), "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.repeats(rows)


def test_op4_whole_output(spark):
    """Every column against regular expressions and a plain Viterbi search, one sequence at a time."""
    texts = [*PRIVATE, None, "see 1.2.3.\u00b2 now, or \u0661.2.3.4 and 5.6.7.\u0968", "\u00b2" * 16 + " 4444 4444 4444 4448.", "mail a.b@c.de, +49 30 1234567; 10.0.0.1 is 999.1.1.1"]
    texts += [" ".join(w) for w, _ in personal_data.labelled_rows(150, seed=77)]
    model = personal_data.trained(personal_data.labelled_table(spark))
    t = np.where(model.allowed, model.move, -1e9)
    checks = {"email": lambda x: re.fullmatch(brute.PII["email"], x), "ip": lambda x: re.fullmatch(brute.PII["ip"], x) and brute.private(x)[1], "card": lambda x: brute.private("".join(c for c in x if c in "0123456789"))[2], "phone": lambda x: 8 <= sum(c in "0123456789" for c in x) <= 15}
    want = []
    for n, text in enumerate(texts):
        text = text or ""
        base, added = brute.private(text), [[], [], [], []]
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        words = [text[s:e] for s, e in at]
        marked = [bool(re.search("[0-9@]", w)) for w in words]
        for lo in (i for i in range(len(words)) if marked[i] and (i == 0 or not marked[i - 1])):
            hi = next((i for i in range(lo, len(words)) if not marked[i]), len(words))
            emit = [sum((model.emit[model.features[f]] for f in personal_data.features(words, i) if f in model.features), np.zeros(len(personal_data.LABELS))) for i in range(lo, hi)]
            best, back = emit[0] + t[0], []
            for e in emit[1:]:
                back.append((best[:, None] + t).argmax(0))
                best = (best[:, None] + t).max(0) + e
            path = [int(best.argmax())]
            for x in reversed(back):
                path.append(int(x[path[-1]]))
            labels, i = [personal_data.LABELS[k] for k in reversed(path)], 0
            while i < len(labels):
                j = i + 1
                if labels[i][0] == "B":
                    kind = labels[i][2:]
                    while j < len(labels) and labels[j] == "I-" + kind:
                        j += 1
                    s, e = at[lo + i][0], at[lo + j - 1][1]
                    lead, tail = "\"'<[{:;,=" + "(" * (kind != "phone"), ".,;:!?\"'>]})"
                    s += len(text[s:e]) - len(text[s:e].lstrip(lead))
                    e -= len(text[s:e]) - len(text[s:e].rstrip(tail))
                    if e > s and checks[kind](text[s:e]) and not any(s < y and x < e for some in base for x, y in some):
                        added[personal_data.KINDS.index(kind)].append((s, e))
                i = j
        listed = lambda some: ",".join(f"{k}:{s}:{e}" for k, one in zip(brute.PII, some, strict=True) for s, e in sorted(one))
        want.append((n, *map(len, base), hashlib.sha256(listed(base).encode()).hexdigest(), listed([x + y for x, y in zip(base, added, strict=True)]), sum(map(len, added))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, personal_data.personal_data(df).collect())) == want
    assert sum(x[-1] for x in want) > 20


def test_pipeline(spark, sf):
    """All rows of run() against plain versions of the five stages, none of which calls the code under test."""
    rows = corpus_pipeline.run(spark, sf).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    stop = set(quality_rules.STOP_WORDS)
    texts = brute.kept_lines([(d, t or "") for d, t in docs if brute.passes_quality(t, stop)])
    kept = {d for d, (_, root) in brute.near_classes(list(texts.items()), 5, 80, 100).items() if d == root}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = [(d, t) for d, t in texts.items() if d in kept]
    clean = {d: t for (d, t), found in zip(left, brute.leaks(left, items), strict=True) if not found}
    assert 0 < len(clean) < len(kept) < len(texts) < len(docs)
    got, places = {}, {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {}
    for d, t in clean.items():
        ids = np.asarray([*token_counts.tokenizer(WORD).encode(t, add_special_tokens=False).ids, 1], "<u4")
        want[d] = [(k, x, len(ids[x : x + 4096]), zlib.crc32(ids[x : x + 4096].tobytes())) for k, x in enumerate(range(0, len(ids), 4096))]
    assert {d: sorted(x) for d, x in got.items()} == want
    for parts in places.values():
        parts.sort()
        assert all(x == sum(n for _, n in parts[:i]) for i, (x, _) in enumerate(parts))
        assert sum(n for _, n in parts) <= 4096
    total = sum(n for x in want.values() for _, _, n, _ in x)
    assert len(places) <= -(-total // 4096) * 1.1 + 1


def test_stages_keep_the_columns(spark, sf):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.read.parquet(f"{sf}/documents.parquet")
        assert stage(spark, frame, sf).columns == frame.columns, name


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, name):
    assert compare.difference(spark, name, QUERIES[name], SQL[name], sf, compare.connection(sf)) == ""


def test_queries_cover_all_ten():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 11))
