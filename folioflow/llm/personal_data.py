"""Personal data: patterns with checks, and a linear-chain conditional random field that adds what the patterns drop.

The field labels words ([^\\x20\\x09-\\x0D]+) by their shapes and those of their neighbours. The four kinds are written with
digits or an @ in every word, so a word without either is outside, and the chain falls into runs of words that have one;
Viterbi decodes all runs of a batch of documents together, and a text without such a word costs one search. It learns from a small labelled table (rows of words
with labels, see `labelled_rows`), on the driver, in seconds. A span that it finds is trimmed of punctuation, must pass
the check of its kind and must not overlap a pattern's span.

Defined results: null and empty texts have no spans; repeated rows, and rows without a doc_id (-1), are treated one by
one; only the digits 0-9 count, whatever other signs a text holds; equal scores go to the label that stands first; a very
long text is read whole, its runs are decoded some at a time; other columns are not looked at; an empty table gives an
empty one. The counts n_* are those of the patterns (base), n_added those of the field.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import texts
from folioflow.llm.crf import Crf

KINDS = ["email", "ip", "card", "phone"]
LABELS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
#: Rows of the labelled table; documented bound of what the field is fitted on.
LABELLED = 600

_ANY = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a number's first digit is not after a digit: a match that starts inside a run of digits would have started before it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile("[^0-9]")
_RUNS = re.compile(r"[0-9]+|[A-Za-z]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def is_card(text: str) -> bool:
    digits = _NOT_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 8 <= len(_NOT_DIGIT.sub("", text)) <= 15


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, looked for around each @."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = start < at and _DOMAIN.match(text, at + 1)
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The spans of each kind, in code points, end exclusive."""
    if not _ANY.search(text):
        return [[], [], [], []]
    return [
        emails(text),
        [m.span() for m in _IP.finditer(text) if is_ip(m[0])],
        [m.span() for m in _CARD.finditer(text) if is_card(m[0])],
        [m.span() for m in _PHONE.finditer(text) if is_phone(m[0])],
    ]


def shape(word: str) -> str:
    return "".join("9" if r[0].isdigit() and r.isascii() else "a" if r.isalpha() and r.isascii() else r for r in _RUNS.findall(word))[:24]


def features(words: list[str], i: int) -> list[str]:
    word = words[i]
    digits = _NOT_DIGIT.sub("", word)
    core = word.strip(".,;:!?\"'()[]<>{}")
    runs = "".join(f"d{min(len(r), 20)}" if r[0] in "0123456789" else "a" if r.isalpha() else r for r in _RUNS.findall(core))[:32]
    near = lambda j: shape(words[j].strip(".,;:!?")) if 0 <= j < len(words) and _ANY.search(words[j]) else "w" if 0 <= j < len(words) else "-"
    out = ["1", "s=" + shape(core), "r=" + runs, f"n={min(len(digits), 20)}", "p=" + near(i - 1), "f=" + near(i + 1), f"s={shape(core)} p={near(i - 1)}", f"s={shape(core)} f={near(i + 1)}"]
    out += ["at"] * ("@" in word) + ["alpha"] * any(c.isalpha() for c in word) + ["plus"] * word.startswith("+") + ["(9)"] * (word.startswith("(") and word.rstrip(".,").endswith(")"))
    out += ["card"] * (core.isdigit() and is_card(core)) + ["ip"] * is_ip(core)
    out += ["mail"] * bool("@" in core and _DOMAIN.fullmatch(core.rpartition("@")[2]))
    return out


def labelled_rows(n: int = LABELLED, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The labelled table: words and labels, made by rule from formats of personal data and of other numbers."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    syllables = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def not_card() -> str:
        x = card()
        return x[:-1] + str((int(x[-1]) + r.randint(1, 9)) % 10)

    ip = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    four = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, 16, 4))
    mail = lambda: f"{word()}{r.choice(['.', '_', ''])}{d(r.randint(0, 2))}@{word()}{r.choice(['', d(1)])}.{r.choice(['com', 'example.com', 'org', 'co.uk', 'net'])}"
    good = {
        "email": [mail],
        "ip": [ip],
        "card": [card, card, lambda: four(card(), " "), lambda: four(card(), "-")],
        "phone": [lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}"] * 4
        + [lambda: f"+{d(2)} {d(2)} {d(4)} {d(4)}", lambda: f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(11)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(3)}"],
    }
    other = [
        lambda: str(r.randint(0, 99)), lambda: str(r.randint(1900, 2100)), lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)}.{d(1)}.{d(1)}", lambda: f"20{d(2)}-0{d(1)}-1{d(1)}",
        lambda: f"{d(2)}:{d(2)}", lambda: f"{d(2)}%", lambda: f"${d(3)}.{d(2)}", lambda: f"{word()}{d(2)}", lambda: f"@{word()}", lambda: f"{d(1)},{d(3)},{d(3)}", lambda: not_card(),
        lambda: f"password={''.join(r.choice('0123456789abcdef') for _ in range(17))}", lambda: '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', lambda: f"A{d(4)}",
        lambda: f"{r.randint(256, 999)}.{d(3)}.{d(2)}.{d(3)}", lambda: f"({d(4)})", lambda: f"[{d(2)}]", lambda: d(r.randint(5, 12)), lambda: f"{d(3)}-{d(2)}", lambda: f"{d(1)}/{d(2)}", lambda: f"{word()}@{word()}", lambda: "4.0", lambda: "2.0.",
    ]
    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.choice([0, 1, 2])):
                words.append(word())
                labels.append("O")
            for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
                if r.random() < 0.62:
                    kind = r.choice(["email", "ip", "card", "card", "phone", "phone", "phone"])
                    parts = r.choice(good[kind])().split(" ")
                    labels += [f"B-{kind}"] + [f"I-{kind}"] * (len(parts) - 1)
                    parts[-1] += r.choice(["", "", "", ".", ","])
                else:
                    parts = [r.choice(other)()]
                    labels.append("O")
                words += parts
        rows.append((words + [word()], labels + ["O"]))
    return rows


def labelled_table(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    return spark.createDataFrame(labelled_rows(n), "words array<string>, labels array<string>")


def runs(words: list[str]) -> list[tuple[int, int]]:
    """The maximal runs of words with a digit or an @."""
    out, start = [], None
    for i, w in enumerate([*words, ""]):
        has = bool(_ANY.search(w))
        if has and start is None:
            start = i
        elif not has and start is not None:
            out.append((start, i))
            start = None
    return out


def trained(table: DataFrame, limit: int = LABELLED) -> Crf:
    """The field, from at most `limit` labelled rows."""
    allowed = np.ones((len(LABELS), len(LABELS)), bool)
    for j, name in enumerate(LABELS):
        if name[0] == "I":
            allowed[:, j] = [x in (f"B-{name[2:]}", name) for x in LABELS]
    number = {x: i for i, x in enumerate(LABELS)}
    sequences, truth = [], []
    for row in table.select("words", "labels").limit(limit).collect():
        for lo, hi in runs(row["words"]):
            sequences.append([features(row["words"], i) for i in range(lo, hi)])
            truth.append([number[x] for x in row["labels"][lo:hi]])
    return Crf(LABELS, allowed).fit(sequences, truth)


_CHECK = {"email": lambda x: bool(emails(x)) and emails(x)[0] == (0, len(x)), "ip": is_ip, "card": is_card, "phone": is_phone}


def _trim(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    lead, tail = "\"'<[{:;,=" + "(" * (kind != "phone"), ".,;:!?\"'>]})"
    while start < end and text[start] in lead:
        start += 1
    while start < end and text[end - 1] in tail:
        end -= 1
    return start, end


def find(batch: list[str], model: Crf) -> list[tuple[list[list[tuple[int, int]]], list[list[tuple[int, int]]]]]:
    """Base spans and added spans, by kind, of each text."""
    base = [base_spans(x) for x in batch]
    added: list[list[list[tuple[int, int]]]] = [[[], [], [], []] for _ in batch]
    sequences, where = [], []
    for n, text in enumerate(batch):
        if not _ANY.search(text):
            continue
        at = [m.span() for m in _WORD.finditer(text)]
        words = [text[s:e] for s, e in at]
        for lo, hi in runs(words):
            sequences.append([features(words, i) for i in range(lo, hi)])
            where.append((n, at[lo:hi]))
    for (n, at), labels in zip(where, model.decode(sequences), strict=True):
        i = 0
        while i < len(labels):
            name = LABELS[labels[i]]
            j = i + 1
            if name[0] == "B":
                while j < len(labels) and LABELS[labels[j]] == f"I-{name[2:]}":
                    j += 1
                kind = name[2:]
                s, e = _trim(batch[n], at[i][0], at[j - 1][1], kind)
                if e > s and _CHECK[kind](batch[n][s:e]) and not any(s < y and x < e for spans in base[n] for x, y in spans):
                    added[n][KINDS.index(kind)].append((s, e))
            i = j
    return list(zip(base, added, strict=True))


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, some in zip(KINDS, spans, strict=True) for s, e in sorted(some))


def personal_data(df: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of df."""
    model = trained(labelled if labelled is not None else labelled_table(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column("text").to_pylist(), model)
            cols = [pa.array([len(base[k]) for base, _ in found], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found]
            spans = [_listed([x + y for x, y in zip(base, more, strict=True)]) for base, more in found]
            n_added = pa.array([sum(map(len, more)) for _, more in found], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols, pa.array(sha), pa.array(spans), n_added], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return texts(df).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
