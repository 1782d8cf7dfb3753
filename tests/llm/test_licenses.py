import math
import re
from collections import Counter

from gamelog.llm import licenses
from gamelog.llm.licenses import LICENSE_FILE, PARAGRAPHS, TEMPLATES, THRESHOLD, WORD, license_scan, template_terms


def plain(rows):
    total = len(rows)
    split = lambda t: re.findall(WORD, t.lower())
    held = Counter(w for _, _, t in rows for w in set(split(t or "")))
    known = {t for c in template_terms() for t in c}
    idf = lambda w: math.log((1 + total) / (1 + (held[w] if w in known else 0))) + 1
    vector = lambda c: {w: n * idf(w) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [vector(c) for c in template_terms()]

    def own(path, text):
        parts = [("header", s) for s in (text or "").split("\n") + re.split(PARAGRAPHS, text or "")]
        if path and re.search(LICENSE_FILE[4:], path, re.I):
            parts.append(("file", text or ""))
        best = None
        for how, s in parts:
            v = vector(Counter(split(s)))
            for i, t in enumerate(vectors):
                if v:
                    c = round(sum(x * t.get(w, 0) for w, x in v.items()) / norm(v) / norm(t), 6)
                    if c >= THRESHOLD:
                        best = max(best or (c, -i, how), (c, -i, how))
        return best and (TEMPLATES[-best[1]][0], best[0], best[2])

    folder = lambda p: None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
    mine = [own(p, t) for _, p, t in rows]
    holders = {}
    for (_, p, _), o in zip(rows, mine):
        if o and p and re.search(LICENSE_FILE[4:], p, re.I):
            holders[folder(p)] = max(holders.get(folder(p), (o[1], o[0])), (o[1], o[0]))
    out = []
    for (d, p, _), o in zip(rows, mine):
        at = folder(p)
        while not o and at is not None:
            if at in holders:
                o = (holders[at][1], holders[at][0], "inherited")
            at = (at.rsplit("/", 1)[0] if "/" in at else "") if at else None
        out.append((d, p, *(o or (None, None, None))))
    return out


MIT = TEMPLATES[1][1]
ROWS = [
    (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words only"), (3, "a/b/c/y.txt", None),
    (4, "a/b/c/LICENSE.md", "# Apache\n\nLicensed under the Apache License,\nVersion 2.0."), (5, "a/b/c/d/z.py", ""),
    (6, "a/b/w.py", "header\nLicensed under CC BY-NC 4.0.\nmore"), (7, "ab/x", "the license of the software"),
    (8, "COPYING", "This work is licensed under the GNU General Public License, version 3."), (9, "q.txt", "words"),
    (10, None, "SPDX-License-Identifier: MIT"), (11, None, "nothing"), (12, "a/NOTICE", "Licensed under CC BY 4.0. by us"),
    (13, "z/LICENSE", MIT + " and more words"), (14, "z/t", "w " * 50_000 + "license"), (14, "z/t", "w " * 50_000 + "license"),
    (None, "z/u", "Unter der MIT License"), (15, "z/v/COPYING", "no such thing"), (16, "z/v/k", "k"),
    (17, "n/p", MIT.replace(",", "\n")),
]


def test_equals_a_plain_scan(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, path string, text string, license string, key int")
    got = [tuple(r) for r in license_scan(df.repartition(3)).collect()]
    order = lambda rows: sorted(rows, key=str)
    assert order(got) == order(plain(ROWS))
    assert {r[4] for r in got} == {None, "header", "file", "inherited"} or "file" not in {r[4] for r in plain(ROWS)}


def test_notices_wrapped_over_lines(spark):
    w = MIT.split()
    lines = [" ".join(w[i:i + 9]) for i in range(0, len(w), 9)]
    more = ["value = compute(alpha, beta, gamma, delta)"] * 40
    rows = [(1, "\r\n\r\n".join(["words of another kind " * 30, "\r\n".join(lines), "and an end " * 30])),
            (2, "\n".join(["# " + " ".join(more), "#", *("# " + x for x in lines), "#", *more])),
            (3, "\n".join(["/*", " * " + " ".join(more), " *", *(" * " + x for x in lines), " */", *more])),
            (4, "\n".join([*more, *lines, *more])), (5, "\r".join([*more, *lines, *more])), (6, "\n".join(more))]
    rows += [(10 + i, "plain text number " + str(i)) for i in range(20)]
    df = spark.createDataFrame([(i, None, t) for i, t in rows], "doc_id long, path string, text string")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in license_scan(df).collect()}
    assert {i for i, x in got.items() if x == ("MIT", "header")} == {1, 2, 3, 4, 5}


def test_texts_are_cut_in_python(spark, monkeypatch):
    plans, keep = {}, licenses.materialize

    def seen(df, tag):
        plans[tag] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(df, tag)

    monkeypatch.setattr(licenses, "materialize", seen)
    rows = [(1, "a/x", "RELEASED under the M\u0130T license\n\nreleased under the MIT LICEN\u017fE. \u212aind\n \t\n"), (2, "a/COPYING", MIT),
            (3, None, "\n\n\nDedicated to the public domain\r\nunder CC0 1.0 Universal."), (4, "a/y", "\n"), (5, "a/z", None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    broken = df.selectExpr("doc_id + 10 AS doc_id", "path", "cast(concat(cast('license ' AS binary), X'FF41') AS string) AS text")
    got = {r["doc_id"]: (r["license"], r["how"]) for r in license_scan(df.unionByName(broken)).collect()}
    assert got[2] == ("MIT", "header") and got[3] == ("CC0-1.0", "header") and got[4] == got[14] == ("MIT", "inherited")
    assert "regexp_extract_all" not in plans["segments"] and "split(" not in plans["segments"]


def test_empty_table(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, path string, text string")).collect() == []
