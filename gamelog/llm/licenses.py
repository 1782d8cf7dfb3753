"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

The lines, paragraphs and runs of lines (as long as a template) of every text are compared with
license templates as sparse TF-IDF vectors. Terms are weighted by the number of documents that hold them, counted over all
documents for the terms of the templates; a term of no template weighs as if unseen. A segment
can only reach the threshold if it has one of a template's heaviest terms (its anchors: without
them the rest of the template's length is too short), so only segments with an anchor are
compared, and none that could pass is lost. Files named like a license also count as a whole.
A file without a license of its own takes that of the license file in its nearest directory
upwards, found by joining each directory with all its ancestors.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gamelog.llm.common import materialize, rows_per_batch, table

# ---- fixed values: short public license notices ----
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
LICENSE_FILE = r"(?i)(^|/)(un)?licen[sc]e[^/]*$|(^|/)copying[^/]*$|(^|/)notice[^/]*$"
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
PARAGRAPHS = r"\n[ \t]*\n"
# ---- end of fixed values ----

THRESHOLD = 0.6
#: Line ends, and what a line starts or ends with as part of a comment.
LINES = r"\r\n|\r|\n"
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/|<!--|-->|[#*;%]+|//+|--+)[ \t]*|[ \t]*(?:\*+/|-->)[ \t]*$"


def template_terms() -> list[Counter]:
    return [Counter(re.findall(WORD, text.lower())) for _, text in TEMPLATES]


def _weights(held: dict[str, int], total: int) -> tuple[list[dict[str, float]], dict[str, float], float, set[str]]:
    """Unit vectors of the templates, weights of their terms, of any other term, and anchors."""
    idf = {t: math.log((1 + total) / (1 + held.get(t, 0))) + 1 for c in template_terms() for t in c}
    vectors, anchors = [], set()
    for terms in template_terms():
        v = {t: n * idf[t] for t, n in terms.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        v = {t: x / norm for t, x in v.items()}
        vectors.append(v)
        rest = 1.0
        for t in sorted(v, key=lambda t: (-v[t], t)):
            if rest < THRESHOLD ** 2 * (1 - 1e-9):
                break
            anchors.add(t)
            rest -= v[t] ** 2
    return vectors, idf, math.log(1 + total) + 1, anchors


def _runs(text: str | None, like, anchors: frozenset[str], sizes: list[int]) -> list[str]:
    """Paragraphs, and runs of lines about as long as a template, that ``like`` takes for a template.

    Lines end at any line end; those of comment marks alone count as blank. From each line a run
    is given for each length of a template: up to the line that reaches it, and one line less.
    """
    lines = [re.sub(MARKS, "", line) for line in re.split(LINES, text or "")]
    words = [re.findall(WORD, line.lower()) for line in lines]
    held = [not anchors.isdisjoint(w) for w in words]
    out, at = [], 0
    while at < len(lines):
        to = at
        while to < len(lines) and lines[to].strip():
            to += 1
        if any(held[at:to]):
            spans = {(at, to)}
            for a in range(at, to):
                n, b = 0, a
                for size in sizes:
                    while b < to and n < size:
                        n, b = n + len(words[b]), b + 1
                    spans.update(((a, b), (a, max(b - 1, a + 1))))
                    if b == to:
                        break
            out += [(a, b) for a, b in sorted(spans) if any(held[a:b]) and like(words[a:b])]
        at = max(to, at + 1)
    return list(dict.fromkeys("\n".join(lines[a:b]) for a, b in out))


def _like(vectors: list[dict[str, float]], idf: dict[str, float], other: float):
    def like(lines: list[list[str]]) -> bool:
        x = {t: n * idf.get(t, other) for t, n in Counter(w for line in lines for w in line).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return any(sum(w * x[t] for t, w in v.items() if t in x) >= (THRESHOLD - 1e-5) * norm for v in vectors)
    return like


def _own_words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _held(known: frozenset[str]):
    """Rows of a term and the number of texts of a batch that hold it."""
    def run(frames):
        for frame in frames:
            held = Counter()
            for text in frame["text"]:
                held.update(known.intersection(_own_words(text or "")))
            yield pd.DataFrame(list(held.items()), columns=["term", "n"])
    return run


def _parts(text: str, whole: bool, like, anchors: frozenset[str], sizes: list[int]) -> list[tuple[str, str]]:
    """(how, segment) of each different segment of a text that holds an anchor."""
    if anchors.isdisjoint(_own_words(text)):
        return []
    parts = dict.fromkeys(("header", s) for s in (*text.split("\n"), *re.split(PARAGRAPHS, text)))
    parts = [(how, s) for how, s in parts if not anchors.isdisjoint(_own_words(s))]
    parts += [("header", s) for s in _runs(text, like, anchors, sizes)]  # these hold one
    return list(dict.fromkeys(([("file", text)] if whole else []) + parts))


def _segments(vectors: list[dict[str, float]], idf: dict[str, float], other: float, anchors: set[str]):
    """The ``_parts`` of every text, as rows."""
    sizes, known = sorted({sum(c.values()) for c in template_terms()}), frozenset(anchors)

    def run(frames):
        like = _like(vectors, idf, other)
        for frame in frames:
            rows = [(key, doc, *part) for key, doc, whole, text in zip(*(frame[c] for c in ("key", "doc", "whole", "text")))
                    for part in _parts(text or "", whole, like, known, sizes)]
            yield pd.DataFrame(rows, columns=["key", "doc", "how", "segment"])
    return run


def _words(text):
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def license_scan(files: DataFrame) -> DataFrame:
    """License of every file of ``files`` (doc_id, path, text).

    Returns doc_id, path, license, score, how: the best template of its own text with a cosine of
    0.6 or more ('header', or 'file' when it is the whole text of a license file), else that of
    the nearest license file upwards ('inherited', with that file's score), else nulls. Ties go
    to the template that comes first.

    - A missing or empty text has no license of its own; a missing path has no directory and
      inherits nothing. A path without a directory is in the root.
    - Several license files of a directory: the highest score counts.
    - Rows that repeat are answered each; an empty table gives an empty table; other columns are
      ignored.
    """
    spark = files.sparkSession
    rows_per_batch(spark)
    rows = files.select("doc_id", "path", "text", F.xxhash64("path", "text").alias("key"),
                        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"))
    # texts are cut in Python: Spark's own regular expressions leave so many objects that an executor's heap fills up
    text = F.make_valid_utf8("text").alias("text")
    total = rows.count()
    known = frozenset(t for c in template_terms() for t in c)
    held = {r["term"]: r["n"] for r in rows.select(text).mapInPandas(_held(known), "term string, n long").groupBy(
        "term").agg(F.sum("n").alias("n")).collect()}  # at most one line per term of the templates
    vectors, idf, other, anchors = _weights(held, total)

    whole = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)).alias("whole")
    segments = (rows.select("key", "doc", whole, text).mapInPandas(
        _segments(vectors, idf, other, anchors), "key long, doc long, how string, segment string")
        .withColumn("at", F.xxhash64("segment")))
    segments = materialize(segments, "segments")
    # tables of fixed size: the terms of the templates
    weight = spark.createDataFrame([(t, float(w)) for t, w in idf.items()], "term string, w double")
    lines = spark.createDataFrame([(t, i, float(w)) for i, v in enumerate(vectors) for t, w in v.items()],
                                  "term string, template int, v double")
    terms = (segments.select("key", "doc", "how", "at", F.explode(_words("segment")).alias("term"))
             .groupBy("key", "doc", "how", "at", "term").agg(F.count(F.lit(1)).alias("n"))
             .join(F.broadcast(weight), "term", "left")
             .withColumn("x", F.col("n") * F.coalesce("w", F.lit(other))))
    one = ["key", "doc", "how", "at"]
    norms = terms.groupBy(*one).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = terms.join(F.broadcast(lines), "term").groupBy(*one, "template").agg(
        F.sum(F.col("x") * F.col("v")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = (dots.join(norms, one).withColumn("score", cosine).filter(F.col("score") >= THRESHOLD)
            .groupBy("key", "doc").agg(F.max(F.struct(
                "score", (-F.col("template")).alias("first"), "how")).alias("b")))
    names = F.array(*[F.lit(n) for n, _ in TEMPLATES])
    found = materialize(best.select("key", "doc", F.element_at(names, 1 - F.col("b.first")).alias("license"),
                                    F.col("b.score").alias("score"), F.col("b.how").alias("how")), "licenses")

    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(
        F.col("path").isNotNull(), F.lit(""))
    slim = rows.select("doc_id", "path", "key", "doc", folder.alias("dir"))
    single = slim.join(found, ["key", "doc"], "left")
    holders = single.filter(F.col("path").rlike(LICENSE_FILE) & F.col("license").isNotNull()).groupBy(
        F.col("dir").alias("above")).agg(F.max(F.struct("score", "license")).alias("h"))
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(
        i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("above")))
    near = (slim.filter("dir IS NOT NULL").select("dir").distinct()
            .select("dir", F.explode(steps).alias("s")).select("dir", "s.depth", "s.above")
            .join(holders, "above").groupBy("dir").agg(F.max(F.struct("depth", "h")).alias("n"))
            .select("dir", F.col("n.h").alias("h")))
    out = single.join(near, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("license", "h.license").alias("license"),
        F.when(mine, F.col("score")).otherwise(F.col("h.score")).alias("score"),
        F.when(mine, F.col("how")).when(F.col("h").isNotNull(), F.lit("inherited")).alias("how"))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """License of every document, laid out as a tree of source, thousand and fifty.

    The documents have no paths of their own: the first of each fifty is taken for the license
    file of its folder, the first of each thousand for that of the folder above.
    """
    docs = table(spark, sf_dir, "documents")
    name = F.expr("""concat(source, '/', doc_id div 1000, '/',
      CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE'
           WHEN doc_id % 50 = 0 THEN concat(doc_id div 50, '/LICENSE')
           ELSE concat(doc_id div 50, '/', doc_id, '.txt') END)""")
    return license_scan(docs.select("doc_id", name.alias("path"), "text"))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP4_SQL = f"""
WITH template(i, license, text) AS (VALUES {", ".join(
    f"({i}, {_quote(n)}, {_quote(t)})" for i, (n, t) in enumerate(TEMPLATES))}),
tt AS (SELECT i, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM template),
tn AS (SELECT i, term, count(*) AS n FROM tt GROUP BY i, term),
d AS (SELECT doc_id, text, source || '/' || (doc_id // 1000) || '/' || CASE
        WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 50 = 0 THEN (doc_id // 50) || '/LICENSE'
        ELSE (doc_id // 50) || '/' || doc_id || '.txt' END AS path FROM documents),
dt AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM d),
df AS (SELECT term, count(*) AS n FROM dt WHERE term IN (SELECT term FROM tn) GROUP BY term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + coalesce(max(df.n), 0))) + 1 AS w
        FROM tn LEFT JOIN df USING (term) GROUP BY term),
tv AS (SELECT i, term, n * w AS v FROM tn JOIN idf USING (term)),
tl AS (SELECT i, sqrt(sum(v * v)) AS l FROM tv GROUP BY i),
sg AS (SELECT doc_id, 'file' AS how, text AS seg FROM d WHERE regexp_matches(path, '(^|/)LICENSE$')
       UNION SELECT doc_id, 'header', unnest(string_split(text, chr(10))) FROM d
       UNION SELECT doc_id, 'header', unnest(regexp_split_to_array(text, '{PARAGRAPHS}')) FROM d),
st AS (SELECT doc_id, how, seg, unnest(regexp_extract_all(lower(seg), '{WORD}')) AS term FROM sg),
sn AS (SELECT doc_id, how, seg, term, count(*) * coalesce(max(w), ln(1 + (SELECT count(*) FROM d)) + 1) AS x
       FROM st LEFT JOIN idf USING (term) GROUP BY doc_id, how, seg, term),
sl AS (SELECT doc_id, how, seg, sqrt(sum(x * x)) AS l FROM sn GROUP BY doc_id, how, seg),
sc AS (SELECT doc_id, how, i, round(sum(x * v) / any_value(tl.l) / any_value(sl.l), 6) AS score
       FROM sn JOIN tv USING (term) JOIN tl USING (i) JOIN sl USING (doc_id, how, seg)
       GROUP BY doc_id, how, seg, i),
ow AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, b.score, b.how
       FROM d LEFT JOIN (SELECT doc_id, arg_max({{'i': i, 'score': score, 'how': how}},
                           {{'s': score, 'f': -i, 'h': how}}) AS b
                         FROM sc WHERE score >= {THRESHOLD} GROUP BY doc_id) USING (doc_id)
       LEFT JOIN template ON template.i = b.i),
h AS (SELECT dir AS above, max({{'score': score, 'license': license}}) AS h FROM ow
      WHERE regexp_matches(path, '(^|/)LICENSE$') AND license IS NOT NULL GROUP BY dir),
up AS (SELECT dir, arg_max(h, length(above)) AS h FROM (SELECT DISTINCT dir FROM ow) x
       JOIN h ON above = '' OR dir = above OR starts_with(dir, above || '/') GROUP BY dir)
SELECT doc_id, path, coalesce(license, h.license) AS license,
       CASE WHEN license IS NOT NULL THEN score ELSE h.score END AS score,
       CASE WHEN license IS NOT NULL THEN how WHEN h IS NOT NULL THEN 'inherited' END AS how
FROM ow LEFT JOIN up USING (dir)
"""
