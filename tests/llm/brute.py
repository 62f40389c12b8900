"""Plain versions of the operators, one document at a time, for small inputs."""

from __future__ import annotations

import collections
import hashlib
import re

import numpy as np

SPACE = r"[\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None, lower: bool = True) -> list[str]:
    text = text or ""
    return [w for w in re.split(SPACE, text.translate(LOWER) if lower else text) if w]


def line_dedup(docs: list[tuple[int, str | None]], chars: int = 40, at_least: int = 5) -> dict[int, tuple[int, int, str]]:
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = collections.defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= chars and len(holders[key(x)]) >= at_least and max(holders[key(x)]) != d)]
        out[d] = (len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def repeats(docs: list[tuple[int, str | None]], span: int = 100) -> dict[int, tuple[int, int, int, str]]:
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - span + 1):
            w = b[x : x + span]
            if w in seen:
                gone[x : x + span] = b"\1" * span
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def kept_lines(docs: list[tuple[int, str]], chars: int = 40, at_least: int = 5) -> dict[int, str]:
    """The text of each document without the lines that go."""
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    holders = collections.defaultdict(set)
    for d, t in docs:
        for x in t.split("\n"):
            holders[key(x)].add(d)
    goes = lambda d, k: len(k) >= chars and len(holders[k]) >= at_least and max(holders[k]) != d
    return {d: "\n".join(x for x in t.split("\n") if not goes(d, key(x))) for d, t in docs}


def passes_quality(text: str | None, stop_words: set[str]) -> bool:
    """The verdict of all quality rules."""
    text = text or ""
    n, chars, symbols, again, repeated, failed = quality(text)
    if failed:
        return False
    w, lines = words(text, lower=False), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda p: sum(bool(re.search(p, x)) for x in lines) / len(lines)
    blank = "[\t\n\f\r\x0b ]*"
    return (
        2 <= chars / n <= 12 and symbols / n <= 0.3 and text.count("!!") / n <= 0.3 and sum(x.lower() in stop_words for x in w) / n >= 0.02
        and repeated / n <= 0.3 and again / len(lines) <= 0.5 and share(f"^{blank}[-*•]") <= 0.9 and share(f"(\\.\\.\\.|…){blank}$") <= 0.3
    )


def quality(text: str | None) -> tuple:
    text = text or ""
    w = words(text, lower=False)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count, covered = collections.Counter(windows), set()
    for i, v in enumerate(windows):
        if count[v] > 1:
            covered.update(range(i, i + 8))
    out = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
    return (*out, out[0] < 20 or 100 * out[4] > 30 * out[0])


def shingles(text: str | None, k: int) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def near_classes(docs: list[tuple[int, str | None]], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fold(text: str) -> str:
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text).replace("\u03c2", "\u03c3")
    return re.sub("[\t-\r \xa0]+", " ", low)


def holds(passage: str, text: str, edits: int) -> bool:
    """Whether text holds passage with so many edits at most: one of edits + 1 parts of it must stand in the text as it is."""
    size, more = divmod(len(passage), edits + 1)
    at, any_part = 0, False
    for k in range(edits + 1):
        n = size + (k < more)
        any_part |= passage[at : at + n] in text
        at += n
    if not any_part:
        return False
    t, row = np.frombuffer(text.encode("utf-32-le"), "<u4"), np.zeros(len(text) + 1, np.int64)
    j = np.arange(len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = np.minimum(row + 1, np.append(i, row[:-1] + (t != ord(c))))
        row = np.minimum.accumulate(new - j) + j
    return int(row.min()) <= edits


def leaks(docs: list[tuple], items: list[tuple[int | None, str | None]], passage: int = 120, per_edit: int = 10) -> list[tuple]:
    """For each document the ascending ids of the items of which it holds a passage."""
    out = []
    for _, text in docs:
        found, folded = set(), fold(text or "")
        for item, body in items:
            body = fold((body or "").strip())
            parts = -(-len(body) // passage)
            size, more = divmod(len(body), parts or 1)
            at = 0
            for k in range(parts):
                n = size + (k < more)
                if holds(body[at : at + n], folded, n // per_edit):
                    found.add(-1 if item is None else item)
                at += n
        out.append(tuple(sorted(found)))
    return out


def private(text: str | None) -> list[list[tuple[int, int]]]:
    """The spans of the patterns, by kind."""
    digits = lambda x: [int(c) for c in x if c in "0123456789"]

    def luhn(x: str) -> bool:
        doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits(x)))]
        return 16 <= len(doubled) <= 19 and sum(doubled) % 10 == 0

    checks = {"email": lambda x: True, "ip": lambda x: all(int(p) <= 255 for p in x.split(".")), "card": luhn, "phone": lambda x: 8 <= len(digits(x)) <= 15}
    return [[m.span() for m in re.finditer(p, text or "") if checks[k](m[0])] for k, p in PII.items()]
