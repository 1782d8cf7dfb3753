import hashlib
from collections import Counter, defaultdict

from gamelog.llm.sharding import assign_shards, write_shards


def plain(rows, limit):
    """Shards by splitting, from the root, every prefix whose rows are too large."""
    bits = {i: bin(int(hashlib.md5(str("null" if k is None else k).encode()).hexdigest()[:15], 16))[2:].zfill(60)
            for i, (k, _) in enumerate(rows)}
    size = {i: len((t or "").encode()) for i, (_, t) in enumerate(rows)}
    out, todo = {}, [("", list(bits))]
    while todo:
        prefix, inside = todo.pop()
        total = sum(size[i] for i in inside)
        if total <= limit or len(inside) == 1:
            out |= dict.fromkeys(inside, (prefix, total))
            continue
        sides = defaultdict(list)
        for i in inside:
            sides[bits[i][len(prefix)]].append(i)
        todo += [(prefix + b, s) for b, s in sides.items()]
    return out


def test_shards_equal_splitting_one_by_one(spark):
    rows = [(i, "é" * (i % 50)) for i in range(400)] + [(1000, "y" * 5000), (1001, None), (1002, ""), (None, "z")]
    df = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, shard int")
    got = {(r["doc_id"], r["text"]): (r["shard"], r["shard_depth"], r["shard_bytes"])
           for r in assign_shards(df, max_bytes=300).collect()}
    want = plain(rows, 300)
    assert got == {rows[i]: (s, len(s), n) for i, (s, n) in want.items()}
    assert all(n <= 300 for _, _, n in got.values() if n != 5000)


def test_rows_of_one_key_split_by_a_second_hash(spark):
    rows = [(5, "x" * 10)] * 200 + [(i, "y") for i in range(10, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = assign_shards(df, max_bytes=64).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
    held = Counter()
    for r in got:
        held[r["shard"]] += len(r["text"])
    assert all(n <= 64 for n in held.values())
    assert all(r["shard_bytes"] == held[r["shard"]] and r["shard_depth"] == len(r["shard"]) for r in got)


def test_empty_table_and_files(spark, scratch):
    assert assign_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    df = spark.createDataFrame([(i, "abc") for i in range(50)], "doc_id long, text string")
    write_shards(df, scratch + "/s", max_bytes=20)
    back = spark.read.option("basePath", scratch + "/s").parquet(scratch + "/s")
    assert back.count() == 50 and back.select("shard").distinct().count() >= 8
