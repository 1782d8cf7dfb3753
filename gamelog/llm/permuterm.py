"""Spelling variants by permuterm rotations.

Every word gets an end mark and all its rotations. Two words that differ by one replaced
character have rotations that start just behind the edited place and agree in all but their last
character; a word with one character left out is itself such a prefix. So each rotation is
entered under itself without its last character (an "open" entry of the word that has the
character), and each word also under its whole rotations (a "whole" entry). Sorting all entries
brings the words that differ by one edit side by side, in groups no larger than the alphabet
plus one; a scan of each group emits, for every member, how many neighbours it has there and the
most frequent of them.

Words and their counts come from one scan of the texts, counted per task before the shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gamelog.llm.common import NO_ID, id_or_none, materialize, rows_per_batch, table

MIN_LENGTH, MIN_COUNT, SHARE, SLIP = 5, 3, 2, 97
END = "$"
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_FLUSH = 200_000


def words_of(doc, text: str | None, slip: int = SLIP) -> Counter:
    """The lower-cased runs of letters of a text, counted; one in ``slip`` loses a character.

    Which runs and characters is decided by the crc32 of "<doc>:<run>" (no id: empty), so it is
    the same for all occurrences of a run in a document.
    """
    runs = Counter(RUN.findall(text.translate(_LOWER))) if text else Counter()
    seed = crc32(f"{'' if doc is None else doc}:".encode())
    out = Counter()
    for run, n in runs.items():
        h = crc32(run.encode(), seed)
        if slip and h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def _count(slip, min_length):
    def frame(words):
        return pd.DataFrame({"word": list(words), "n": list(words.values())})

    def run(frames):
        words = Counter()
        for part in frames:
            for doc, text in zip(part["id"], part["text"]):
                for word, n in words_of(None if doc == NO_ID else doc, text, slip).items():
                    if len(word) >= min_length:
                        words[word] += n
                if len(words) > _FLUSH:
                    yield frame(words)
                    words = Counter()
        if words:
            yield frame(words)
    return run


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """Words of at least ``min_length`` characters with at least ``min_count`` occurrences: word, n."""
    rows_per_batch(docs.sparkSession)
    return (docs.select(id_or_none("doc_id").alias("id"), "text")
            .mapInPandas(_count(slip, min_length), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count))


def rotations(words: DataFrame) -> DataFrame:
    """Entries of the permuterm index: key, word, n, open, lead.

    ``open`` entries stand under a rotation less its last character; ``lead`` marks those whose
    character does not repeat the one before it, so that leaving out either of two equal
    neighbours counts once. Whole entries (not ``open``) stand under a whole rotation.
    """
    def char(i):
        return F.substring("word", i, 1)

    def turned(i):  # from behind the i-th character round to just before it
        return F.concat(F.substring("word", i + 1, F.length("word")), F.lit(END), F.substring("word", F.lit(1), i - 1))

    places = F.sequence(F.lit(1), F.length("word"))
    opened = F.transform(places, lambda i: F.struct(
        turned(i).alias("key"), F.lit(True).alias("open"),
        ((i == 1) | (char(i) != char(i - 1))).alias("lead")))
    whole = F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.struct(
        F.concat(F.substring("word", i, F.length("word")), F.lit(END), F.substring("word", F.lit(1), i - 1)).alias("key"),
        F.lit(False).alias("open"), F.lit(False).alias("lead")))
    return words.select("word", "n", F.explode(F.concat(opened, whole)).alias("e")).select("e.*", "word", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """For each of ``words`` (word, n) with a neighbour one edit away: word, n_near, near, near_n.

    ``near`` is the neighbour of largest n, the smallest of equals. The words must differ.
    """
    group = Window.partitionBy("key")
    by_count = group.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.struct((-F.col("n")).alias("n"), "word")
    scan = rotations(words).select(
        "word", "open", "lead",
        F.count_if("open").over(group).alias("opens"), F.count_if("lead").over(group).alias("leads"),
        F.count_if(~F.col("open")).over(group).alias("wholes"),
        F.first(best).over(by_count).alias("top"), F.nth_value(best, 2).over(by_count).alias("second"))
    # an open entry is one replacement away from the others, and one insertion from the whole word
    links = F.when(F.col("open"), F.col("opens") - 1 + F.when(F.col("lead"), F.col("wholes")).otherwise(0)).otherwise(
        F.col("leads"))
    other = F.when(F.col("top.word") == F.col("word"), F.col("second")).otherwise(F.col("top"))
    return (scan.filter("opens + wholes > 1").groupBy("word")
            .agg(F.sum(links).alias("n_near"), F.min(other).alias("b"))
            .select("word", "n_near", F.col("b.word").alias("near"), (-F.col("b.n")).alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """The last of each chain of ``forms`` (word, form): word, root.

    Pointers are doubled until none moves: a form has at least twice the count of its word, so a
    chain has at most some 60 links and six doublings are enough.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(at.join(step, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, share: int = SHARE,
             slip: int = SLIP) -> DataFrame:
    """Spelling variants among the words of ``docs``: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z lower-cased, with at least
    ``min_length`` characters and ``min_count`` occurrences in all texts. Two words are near if one
    inserted, deleted or replaced character makes one the other. ``form`` is the near word of
    largest count (of equals, the smallest) if it occurs at least ``share`` times as often; ``root``
    the last form of the chain, the word itself if it has none.

    - Null, empty and letterless texts have no words; a document without an id counts like any
      other (its id is taken as empty text); repeated rows count each.
    - One in ``slip`` runs loses a character first (see ``words_of``); 0 turns this off.
    - Empty tables give no rows; other columns are ignored.
    """
    words = materialize(word_counts(docs, min_length, min_count, slip), "words")
    near = materialize(neighbours(words), "near")
    formed = materialize(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(F.col("near_n") >= share * F.col("n"), F.struct(F.col("near").alias("form"), F.col("near_n").alias("n"))).alias("f")),
        "formed")
    ends = roots(formed.filter("f IS NOT NULL").select("word", "f.form"))
    return formed.join(ends, "word", "left").select(
        "word", F.col("f.form").alias("form"), F.coalesce("root", "word").alias("root"),
        "n", "n_near", F.col("f.n").alias("form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of the documents."""
    return variants(table(spark, sf_dir, "documents"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

OP12_SQL = f"""
WITH RECURSIVE bit0 AS (SELECT range AS i, range AS c FROM range(256)),
crc8 AS (
  SELECT i, 0 AS step, c FROM bit0
  UNION ALL
  SELECT i, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc8 WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc8 WHERE step = 8),
runs AS (
  SELECT id, run, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents) GROUP BY id, run),
codes AS (
  SELECT id, run, n, list_transform(string_split(id || ':' || run, ''), lambda x: unicode(x)) AS cs FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(cs, lambda x:
    CASE WHEN x < 128 THEN [CAST(x AS BIGINT)]
         ELSE [CAST(192 + (x >> 6) AS BIGINT), CAST(128 + (x & 63) AS BIGINT)] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM codes, crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole,
         substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
  FROM pairs GROUP BY word),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form,
         CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM formed
  UNION ALL
  SELECT c.word, c.next, f.form FROM chain c JOIN formed f ON f.word = c.next)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON c.word = f.word AND c.next IS NULL
"""
