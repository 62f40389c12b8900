"""License scans by a positional index of rare words, in built-in expressions only.

Licence templates are word sequences. One pass over the texts notes where each file holds words of the templates; how many
files hold each word gives its inverse document frequency, and each template is indexed by its RARE words of the highest
one (postings: word, template, position). A file's indexed words are looked up, and template postings are intersected by
relative position: a template is a candidate where NEED of its rare words stand at the same distance from their places in
the template. It is found if the file also holds all its mandatory key phrases. Phrases of BASE are found wherever their
words stand consecutively.

Everything is local to a row but the document frequencies, which are summed with partial aggregation and have one row for
each word of the templates; what is stored between the two steps is positions of such words, not texts.

Defined results: a null or empty text has no words; repeated rows, and rows without a doc_id (-1), are files of their own;
a very long text is split in one row and needs some times its size; words of equal frequency are taken in alphabetical
order; other columns are not looked at; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import stored, texts
from folioflow.llm.quality_rules import STOP_WORDS

# Fixed values of the contract: phrases and their labels, each ending in the word "license"; what separates words.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Label, words of the licence or of a usual notice, phrases that it can't do without.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    ("apache", "licensed under the apache license version 2 0", ["apache license version"]),
    (
        "apache",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing "
        "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        ["except in compliance with the license", "unless required by applicable law"],
    ),
    ("gpl", "this work is licensed under the gnu general public license version", ["gnu general public license"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ["redistribute it and or modify it", "gnu general public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions",
        ["redistribution and use in source and binary forms"],
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial international license", ["creative commons attribution noncommercial"]),
]

#: Rare words that index a template, and how many must agree on one relative position.
RARE, NEED = 8, 3

#: Words that are noted: those of the templates, without function words.
WORDS = sorted({w for _, text, _ in TEMPLATES for w in text.split()} - set(STOP_WORDS))
PHRASES = sorted({p for _, _, phrases in TEMPLATES for p in phrases})

# A place in a file and a posting meet as template * 2**44 + (place - position + 2**20) * 2**8 + word.
_TEMPLATE, _PLACE, _SHIFT = 1 << 44, 1 << 8, 1 << 20


def files(df: DataFrame) -> DataFrame:
    """doc_id, n_words, at and word (places of noted words), base (places and labels of BASE) and phrases of each row of df."""
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), SEPARATORS), lambda x: x != "")
    rows = texts(df).select("doc_id", words.alias("w"))
    noted = ", ".join(f"'{w}'" for w in WORDS)
    rows = rows.select("doc_id", "w", F.size("w").cast("long").alias("n_words"), F.expr(f"CASE WHEN size(w) > 0 THEN filter(sequence(0, size(w) - 1), i -> w[i] IN ({noted})) ELSE array() END").alias("at"))
    # a file with fewer noted words than have to agree can't match, so its words need not be joined
    rows = rows.withColumn("joined", F.when(F.size("at") >= NEED, F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))))
    cases = []
    for phrase, label in BASE:
        *before, last = phrase.split()
        test = " AND ".join([f"w[i] = '{last}'", *(f"get(w, i - {k}) = '{x}'" for k, x in enumerate(reversed(before), 1))])
        cases.append(f"WHEN {test} THEN named_struct('start', cast(i - {len(before)} AS long), 'label', '{label}')")
    base = F.expr(f"filter(transform(filter(at, i -> w[i] IN ({', '.join(sorted({repr(p.split()[-1]) for p, _ in BASE}))})), i -> CASE {' '.join(cases)} END), x -> x IS NOT NULL)")
    held = F.array_compact(F.array(*[F.when(F.contains("joined", F.lit(f" {p} ")), F.lit(p)) for p in PHRASES]))
    return rows.select("doc_id", "n_words", "at", F.expr("transform(at, i -> w[i])").alias("word"), base.alias("base"), held.alias("phrases"))


def rarest(seen: DataFrame, rare: int = RARE) -> list[list[str]]:
    """The rare words of each template by the files' document frequencies; one row for each noted word comes to the driver."""
    counts = seen.select(F.explode(F.array_distinct("word")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    n = {r.word: r.n for r in counts}
    noted = set(WORDS)
    return [sorted({w for w in text.split() if w in noted}, key=lambda w: (n.get(w, 0), w))[:rare] for _, text, _ in TEMPLATES]


def postings(rare: list[list[str]]) -> Column:
    """Word to the codes of its places in the templates that it indexes."""
    index = sorted({w for words in rare for w in words})
    codes: dict[str, list[int]] = {w: [] for w in index}
    for t, ((_, text, _), words) in enumerate(zip(TEMPLATES, rare, strict=True)):
        for p, w in enumerate(text.split()):
            if w in words:
                codes[w].append(t * _TEMPLATE + (_SHIFT - p) * _PLACE + index.index(w))
    return F.create_map(*[x for w in index for x in (F.lit(w), F.array(*[F.lit(c).cast("long") for c in codes[w]]))])


def aligned(rare: list[list[str]]) -> Column:
    """For each template the most rare words that agree on one relative position, as an array."""
    index = sorted({w for words in rare for w in words})
    hits = F.filter(F.arrays_zip("at", "word"), lambda h: h["word"].isin(index))
    found = F.transform(hits, lambda h: F.transform(postings(rare)[h["word"]], lambda c: c + h["at"].cast("long") * _PLACE))
    codes = F.sort_array(F.array_distinct(F.flatten(found)))
    none = F.struct(F.lit(-1).cast("long").alias("key"), F.lit(0).alias("n"), F.array_repeat(F.lit(0), len(TEMPLATES)).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        key = F.shiftright(x, 8)
        n = F.when(acc["key"] == key, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(key.alias("key"), n.alias("n"), F.transform(acc["best"], lambda b, k: F.when(k == F.shiftright(x, 44), F.greatest(b, n)).otherwise(b)).alias("best"))

    return F.aggregate(codes, none, step, lambda acc: acc["best"])


def scan(df: DataFrame, rare_words: int = RARE, need: int = NEED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, one row for each row of df."""
    seen = stored(files(df), "license-words", "zstd")
    rare = rarest(seen, rare_words)
    rows = seen.select("*", F.when(F.size("at") >= need, aligned(rare)).alias("best"))
    found = []
    for t, ((label, _, phrases), words) in enumerate(zip(TEMPLATES, rare, strict=True)):
        verified = F.col("best")[t] >= min(need, len(words))
        for p in phrases:
            verified = verified & F.array_contains("phrases", p)
        found.append(F.when(verified, F.struct(F.lit(label).alias("label"), (F.col("best")[t] / len(words)).alias("share"))))
    rows = rows.withColumn("found", F.array_compact(F.array(*found)))
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    labels = F.array_sort(F.array_union("base.label", "found.label"))
    start = F.col("base.start")
    score = F.coalesce(F.array_max("found.share"), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def twin() -> str:
    """The same in DuckDB's SQL, from rows of words instead of arrays."""
    quoted = lambda some: ", ".join(f"'{x}'" for x in some)
    templates = ", ".join(f"({t}, '{label}', '{text}')" for t, (label, text, _) in enumerate(TEMPLATES))
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, _, some) in enumerate(TEMPLATES) for p in some)
    base = " UNION ALL ".join(
        f"SELECT d, i - {len(p.split()) - 1} AS start, '{label}' AS label FROM near WHERE x = '{p.split()[-1]}'" + "".join(f" AND b{k} = '{w}'" for k, w in enumerate(reversed(p.split()[:-1]), 1))
        for p, label in BASE
    )
    words = SEPARATORS.replace("[", "[^", 1)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{words}') AS w FROM documents),
words AS (SELECT d, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM docs),
near AS (SELECT d, x, i, lag(x) OVER o AS b1, lag(x, 2) OVER o AS b2 FROM words WINDOW o AS (PARTITION BY d ORDER BY i)),
base AS ({base}),
noted AS (SELECT d, x, i FROM words WHERE x IN ({quoted(WORDS)})),
held AS (SELECT x, count(DISTINCT d) AS n FROM noted GROUP BY x),
template AS (SELECT * FROM (VALUES {templates}) v(t, label, body)),
place AS (SELECT t, unnest(string_split(body, ' ')) AS x, generate_subscripts(string_split(body, ' '), 1) - 1 AS p FROM template),
chosen AS (
  SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), x) AS k
  FROM (SELECT DISTINCT t, x FROM place WHERE x IN ({quoted(WORDS)})) LEFT JOIN held USING (x)),
rare AS (SELECT t, x, count(*) OVER (PARTITION BY t) AS size FROM chosen WHERE k <= {RARE}),
agree AS (
  SELECT d, t, i - p AS offs, max(size) AS size, count(DISTINCT x) AS n
  FROM noted JOIN rare USING (x) JOIN place USING (t, x) GROUP BY d, t, i - p),
best AS (SELECT d, t, max(n) AS n, any_value(size) AS size FROM agree GROUP BY d, t),
phrase AS (SELECT * FROM (VALUES {phrases}) v(t, p)),
joined AS (SELECT d, ' ' || array_to_string(w, ' ') || ' ' AS j FROM docs),
found AS (
  SELECT d, t, n / size AS share FROM best JOIN joined USING (d) JOIN phrase USING (t)
  WHERE n >= least({NEED}, size) GROUP BY d, t, n, size HAVING bool_and(contains(j, ' ' || p || ' '))),
b AS (SELECT d, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY d),
f AS (SELECT d, max(share) AS score, list(DISTINCT label) AS labels FROM found JOIN template USING (t) GROUP BY d)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, f.labels))), ','), '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN b ON b.d = docs.d LEFT JOIN f ON f.d = docs.d"""
