"""Token alignment, hard negatives and license scans against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import compare
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import common, hard_negatives, license_scan, token_alignment
from folioflow.llm.queries import QUERIES, SQL, vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
DOCS = "doc_id long, text string, row string, pairs string, w string, best long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    common.arrow_limits(spark)
    return spark.createDataFrame([(d, t, "clash", None, "clash", 7) for d, t in texts], DOCS).repartition(3)


def alignment(texts):
    """Per document (n_a, n_b, n_groups, n_links, groups, links) by whole texts, then the counts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    signs = token_alignment.byte_signs()
    out = []
    for _, text in texts:
        a = [(i, bytes(signs[c] for c in ta.id_to_token(i))) for i in ta.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode()) for i in tb.encode(text or "")]
        if not text or any(b"".join(x for _, x in y) != f" {text}".encode() for y in (a, b)):
            out.append((0, 0, 0, "", []))
            continue
        spans = []
        for some in (a, b):
            at, own = 0, []
            for i, x in some:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, lo, links = [], 0, []
        for hi in ends:
            part = [[x for x in some if lo < x[2] <= hi] for some in spans]
            groups.append("|".join(",".join(str(i) for i, _, _ in some) for some in part))
            links += [(x[0], y[0]) for x in part[0] for y in part[1] if x[1] < y[2] and y[1] < x[2]]
            lo = hi
        out.append((len(a), len(b), len(groups), ";".join(groups), links))
    counts = Counter(p for *_, links in out for p in set(links))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted(
        (-1 if d is None else d, n_a, n_b, n_g, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if n_a else "")
        for (d, _), (n_a, n_b, n_g, g, links) in zip(texts, out, strict=True)
    )


def texts_of():
    r = random.Random(3)
    words = ["the", "Alignment", "naïve", "über", "1234", "x=1;", "don't", "日本語", "🙂", "tokenisation", "e.g.", "<s>", "<|endoftext|>"]
    some = [" ".join(r.choice(words) + r.choice(["", ",", ".", "\n", "\tq", "  b"]) for _ in range(r.randint(1, 60))) for _ in range(60)]
    some += ["", None, " ", "\n", "a", "a ", " a", "a\n", "\n\na", "a\r\nb", "a b", "▁x", "x▁", " ", "a\x00b", "\x85", "a　 b", "ab" * 4000, "same text", "same text", "é", "tab\t\tend\t"]
    return [(k, x) for k, x in enumerate(some)] + [(None, "no id"), (None, "no id"), (3, some[3]), (5, some[6])]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("limit, size", [(10**6, 1 << 21), (0, 300)])
def test_op11_against_whole_texts(spark, limit, size):
    """By broadcast and by merge, in slices of any size."""
    texts = texts_of()
    got = rows_of(token_alignment.align(frame(spark, texts), A, B, broadcast_pairs=limit, slice_bytes=size))
    assert got == alignment(texts)


def test_op11_remembers_few_runs(spark, monkeypatch):
    texts = [(d, t) for d, t in texts_of() if t]
    monkeypatch.setattr(token_alignment, "REMEMBERED", 20)
    coder = token_alignment.Aligner(A, B)
    whole = [coder.whole(t) for _, t in texts]
    for _ in range(2):
        for lo in range(0, len(texts), 7):
            sizes, links, digests, at, pairs, often = coder.table([t for _, t in texts[lo : lo + 7]])
            for k, (n, names, own) in enumerate(whole[lo : lo + 7]):
                assert tuple(sizes[k]) == n and links[k] == len(own)
                assert digests[k] == (hashlib.sha256(names.encode()).hexdigest() if n[0] else "")
                assert Counter(own.tolist()) == dict(zip(pairs[at[k] : at[k + 1]].tolist(), often[at[k] : at[k + 1]].tolist(), strict=True))


def test_op11_long_text(spark):
    """A text of 5 MB beside short ones: its groups are those of its parts."""
    part = "Some words, repeated 12 times; naïve ones. "
    n = 5_000_000 // len(part)
    long = frame(spark, [(1, part * n + "end"), (2, "Some words"), (3, None)])
    got = {r[0]: r for r in rows_of(token_alignment.align(long, A, B))}
    one = token_alignment.Aligner(A, B).whole(part * 2 + "end")[0]
    two = token_alignment.Aligner(A, B).whole(part * 3 + "end")[0]
    assert got[1][1:4] == tuple(x + (y - x) * (n - 2) for x, y in zip(one, two, strict=True))
    assert got[2][1] == 2 and got[3][1:] == (0, 0, 0, 0, 0, 0, "")


def test_op11_empty_table(spark):
    assert token_alignment.align(frame(spark, []), A, B).count() == 0


def negatives(rows, positives=5, count=10):
    used = []
    for r, (i, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        used.append((r, -1 if i is None else i, label, [math.floor(256 * float(x)) for x in v], i is not None and i % 100 == 0))
    out = []
    for r, i, label, v, anchor in used:
        if not anchor:
            continue
        score = [(-sum(x * y for x, y in zip(v, c[3], strict=False)), c[1], c[2]) for c in used if c[0] != r]
        for s, p, _ in sorted(x for x in score if x[2] == label)[:positives]:
            found = sorted(x for x in score if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s)[:count]
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def vector_rows():
    r = random.Random(8)
    base = [[r.uniform(-1, 1) for _ in range(16)] for _ in range(6)]
    rows = []
    for i in range(900):
        v = [float(np.float32(x + r.gauss(0, 0.3))) for x in base[i % 6]]
        rows.append((i, v, r.randint(0, 9) if i % 3 else 1))  # label 1 is hot
    rows += [(1000, rows[0][1], 1), (1000, rows[0][1], 1), (1000, rows[5][1], 2), (None, rows[0][1], 1), (None, rows[3][1], 4)]
    rows += [(1100, None, 1), (1101, [None, 1.0], 1), (1102, [math.nan] * 16, 1), (1103, [math.inf] * 16, 2), (1104, rows[1][1], None), (1200, [], 3), (1201, rows[0][1][:7], 1), (1300, rows[0][1] + [2.0] * 5, 1)]
    return rows


def vector_frame(spark, rows):
    common.arrow_limits(spark)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("row", F.lit("clash")).withColumn("anchor", F.lit(1)).withColumn("tile", F.lit(None).cast("string")).repartition(3)


@pytest.mark.parametrize("anchors, candidates", [(512, 2048), (3, 50)])
def test_op12_against_plain_scores(spark, anchors, candidates):
    rows = vector_rows()
    got = rows_of(hard_negatives.mine(vector_frame(spark, rows), anchors=anchors, candidates=candidates))
    want = negatives(rows)
    assert len(want) > 300 and got == want


def test_op12_copies_of_one_vector(spark):
    """Ties everywhere: all rows alike, and the window holds no row but at the score itself times 0.9 or less."""
    rows = [(i, [1.0, 0.5], i % 3) for i in range(300)] + [(i, [0.5, 0.25], 5) for i in range(300, 420)]
    assert rows_of(hard_negatives.mine(vector_frame(spark, rows), candidates=40)) == negatives(rows)


def test_op12_without_rows_or_anchors(spark):
    assert hard_negatives.mine(vector_frame(spark, [])).count() == 0
    assert hard_negatives.mine(vector_frame(spark, [(1, [1.0], 1), (2, [1.0], 1)])).count() == 0


@pytest.mark.parametrize("shape", [(1, 1, 1), (0, 4, 5), (70, 33, 129), (200, 64, 90), (40, 300, 41)])
def test_op12_strassen_is_exact(shape):
    m, k, n = shape
    r = np.random.default_rng(1)
    for most in (3, 1 << 20, 1 << 28):
        a, b = r.integers(-most, most, (m, k)), r.integers(-most, most, (k, n))
        for leaf in (2, 16, 512):
            assert (hard_negatives.strassen(a, b, leaf) == a @ b).all()


def licences(texts, rare=license_scan.RARE, need=license_scan.NEED):
    base = [(p.split(), label) for p, label in license_scan.BASE]
    words = [[w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)) if w] for _, t in texts]
    noted = set(license_scan.WORDS)
    df = Counter(w for x in words for w in set(x) & noted)
    out = []
    for (d, _), w in zip(texts, words, strict=True):
        at = [(i, label) for i in range(len(w)) for p, label in base if w[i : i + len(p)] == p]
        labels, score, joined = {x for _, x in at}, 0.0, f" {' '.join(w)} "
        for label, text, phrases in license_scan.TEMPLATES:
            t = text.split()
            chosen = sorted(set(t) & noted, key=lambda x: (df[x], x))[:rare]
            agree = defaultdict(set)
            for i, x in enumerate(w):
                for p, y in enumerate(t):
                    if x == y and x in chosen:
                        agree[i - p].add(x)
            n = max([0, *map(len, agree.values())])
            if n >= min(need, len(chosen)) and all(f" {p} " in joined for p in phrases):
                labels, score = labels | {label}, max(score, n / len(chosen))
        starts = [i for i, _ in at]
        out.append((-1 if d is None else d, len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def licence_texts():
    t = [x for _, x, _ in license_scan.TEMPLATES]
    some = [None, "", "MIT", "mit license", "The MIT\nLICENSE. apache-license; MIT  License", "license mit license apache license", "general public license general PUBLIC license", "public license"]
    some += [x.capitalize() + "." for x in t] + [f"prose before {x} and {y}" for x, y in zip(t, t[1:], strict=False)]
    some += [t[1].replace("without restriction", "with restriction"), " ".join(reversed(t[3].split())), " ".join(t), "license " * 5000, "software license copy " * 300, "Licensed under CC BY-NC 4.0.", "lizenz ünder the mït license", "granted permission free charge person obtaining"]
    return [(k, x) for k, x in enumerate(some)] + [(None, t[0]), (None, t[0]), (4, t[2])]


def test_op13_against_plain_scan(spark):
    texts = licence_texts()
    got = sorted((tuple(r) for r in license_scan.scan(frame(spark, texts)).collect()), key=repr)
    want = licences(texts)
    assert got == want
    assert {x[6] for x in want} >= {"mit", "apache", "gpl", "bsd", "cc-by-nc", ""}


def test_op13_long_text_and_empty_table(spark):
    long = "word " * 1_000_000 + license_scan.TEMPLATES[1][1]
    got = license_scan.scan(frame(spark, [(1, long), (2, "x")])).collect()
    assert {(r.doc_id, r.n_words, r.labels) for r in got} == {(1, 1_000_000 + len(license_scan.TEMPLATES[1][1].split()), "mit"), (2, 1, "")}
    assert license_scan.scan(frame(spark, [])).count() == 0


def test_op13_runs_no_python(spark, sf):
    plan = QUERIES["op13_license_scan"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_license_scan"])
def test_new_sql(spark, sf, name):
    assert compare.difference(spark, name, QUERIES[name], SQL[name], sf, compare.connection(sf)) == ""
