import hashlib
import random
import re
import time

import pytest

from gamelog.llm.pii import all_spans, base_spans, find_pii, luhn, op8_pii, redact

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_rules():
    rng = random.Random(8)
    texts = ["".join(rng.choice("a@.-+ 1290()x%b5é") for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    texts += ["4111 1111 1111 1111 and 4111-1111-1111-1112", "0.0.0.0 256.1.1.1 001.2.3.4", "a@b.c.@d.e", "+1 (555) 123-4567 x"]
    for t in texts:
        assert sorted(base_spans(t)) == sorted(plain(t)), t


@pytest.mark.parametrize("text, kind, found", [
    ("mail john (dot) smith [at] example (dot) com now", "email", "john (dot) smith [at] example (dot) com"),
    ("john dot smith at example dot com is", "email", "john dot smith at example dot com"),
    ("see john_at_example_dot_com", "email", "john_at_example_dot_com"),
    ("é jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("j＠ｅxample．com", "email", "j＠ｅxample．com"),
    ("call plus one four one five five five five two six seven one now", "phone",
     "plus one four one five five five five two six seven one"),
    ("card four one one one 1111 1111 1111 ok", "card", "four one one one 1111 1111 1111"),
    ("4111 1111 1111 1l11", "card", "4111 1111 1111 1l11"),
    ("ip 1[.]2[.]3[.]4 x", "ip", "1[.]2[.]3[.]4"),
    ("ip one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
    ("+1 (4O7) 555-71l3", "phone", "+1 (4O7) 555-71l3"),
    ("+​1 407​ 555 7113", "phone", "+​1 407​ 555 7113"),
    ("+٤٩ 30 1234567", "phone", "+٤٩ 30 1234567"),
])
def test_disguises_give_source_offsets(text, kind, found):
    assert [(k, text[a:b], base) for k, a, b, base in all_spans(text)] == [(kind, found, False)]


@pytest.mark.parametrize("text, kind, found", [
    ("call +1 415 five five five 0100 now", "phone", "+1 415 five five five 0100"),
    ("call +1 (415) 555 zero 100 now", "phone", "+1 (415) 555 zero 100"),
    ("call +1 415 triple 5 0100 now", "phone", "+1 415 triple 5 0100"),
    ("card 4111 1111 1111 one 111 ok", "card", "4111 1111 1111 one 111"),
    ("ip 192 dot 168 dot 1 dot 10 x", "ip", "192 dot 168 dot 1 dot 10"),
    ("two 192 dot 168 dot 1 dot 10 x", "ip", "192 dot 168 dot 1 dot 10"),
    ("ip 192.168.one.10 x", "ip", "192.168.one.10"),
    ("mail john.smith at example.com now", "email", "john.smith at example.com"),
    ("mail john_at_example.com now", "email", "john_at_example.com"),
])
def test_a_single_spelled_part_is_enough(text, kind, found):
    assert [(k, text[a:b], base) for k, a, b, base in all_spans(text)] == [(kind, found, False)]


@pytest.mark.parametrize("text", ["in 2024 one 5 and 3 point 5", "version 1 dot 2 dot 3", "300 dot 1 dot 1 dot 1",
                                  "http://x.org/notes_at_home.html", "e.g. at example.com"])
def test_numbers_that_are_no_identifiers(text):
    assert all_spans(text) == []


@pytest.mark.parametrize("text", ["look at example.com please", "she was at one dot", "two or three or four", "un deux",
                                  "meet at noon. dot the i", "+1 (599) 555 | oo"])
def test_ordinary_text_has_none(text):
    assert all_spans(text) == []


@pytest.mark.parametrize("text", ["1" * 300_000, "a" * 300_000, "a@" * 100_000, "a." * 100_000 + " dot ",
                                  "a-at-" * 50_000 + " dot ", "one " * 50_000, "a dot " * 50_000, " " * 300_000 + "(at",
                                  "+1 " * 100_000, "1 " * 100_000, "O0" * 100_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    all_spans(text)
    assert time.time() - began < 20


def test_table_columns_and_digest(spark, scratch):
    text = "x@y.org 10.0.0.1 and 4111 1111 1111 1111, a (at) b (dot) com"
    rows = [(1, text), (2, None), (3, ""), (None, "é +1 555 123 4567"), (1, text)]
    spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, pii int").write.parquet(
        scratch + "/documents.parquet")
    got = op8_pii(spark, scratch).collect()
    one = [r for r in got if r["doc_id"] == 1]
    base = "email:0:7,ip:8:16,card:21:40"
    assert len(got) == 5 and len(one) == 2
    assert one[0].asDict() == {"doc_id": 1, "n_email": 2, "n_ip": 1, "n_card": 1, "n_phone": 0, "spans": base + ",email:42:60",
                               "base_sha256": hashlib.sha256(base.encode()).hexdigest()}
    empty = [r for r in got if r["doc_id"] in (2, 3)]
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in empty)
    assert [r["spans"] for r in got if r["doc_id"] is None] == ["phone:2:17"]
    df = spark.read.parquet(scratch + "/documents.parquet")
    assert set(redact(df).filter("doc_id = 1").toPandas()["text"]) == {"<email> <ip> and <card>, <email>"}
    assert find_pii(df.limit(0)).collect() == []


def test_many_identifiers_take_linear_time():
    import time

    from gamelog.llm.pii import all_spans
    took = []
    for n in (2000, 8000):
        text = " ".join(f"user{i}@example{i}.com" for i in range(n)) + " and anna (at) example (dot) org"
        began = time.perf_counter()
        spans = all_spans(text)
        took.append(time.perf_counter() - began)
        assert len(spans) == n + 1 and sum(not plain for *_, plain in spans) == 1
    assert took[1] < 8 * took[0] + 0.3
