import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gamelog.llm.packing import PAD, best_fit_plan, encode_with, encoder, pack, read_vocabulary, write_packed


def plain_best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in range(len(free)) if free[r] >= n]
        if fits:
            free[min(fits, key=lambda r: free[r])] -= n
        else:
            free.append(capacity - n)
    return sorted(free)


def test_plan_equals_best_fit_one_piece_at_a_time():
    rng = random.Random(3)
    for _ in range(300):
        capacity = rng.randint(1, 60)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        lines, rows = best_fit_plan(dict(Counter(lengths)), capacity)
        used, seen = np.zeros(rows, int), Counter()
        for length, first, count, row, per in lines:
            assert first == seen[length]
            seen[length] += count
            for i in range(count):
                used[row + i // per] += length
        assert seen == Counter(lengths) and sorted(capacity - used) == plain_best_fit(lengths, capacity)


def test_round_trip_matrix_and_resets(spark, scratch):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice(["the", "été", "x1", "\n\n", "語"]) for _ in range(rng.randint(1, 300)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "a" + " " * 3000 + "b"), (103, "long text " * 5000), (None, "no id"), (7, docs[7][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n int")
    rows = pack(df.repartition(3), capacity=128).collect()
    encode = encode_with(encoder(read_vocabulary()))
    found = defaultdict(list)
    for r in rows:
        ids, places = (np.frombuffer(r[c], np.uint16) for c in ("input_ids", "position_ids"))
        ends = r["cu_seqlens"]
        assert len(ids) == len(places) == 128 and ends[0] == 0 and ends[-1] == r["n_tokens"] <= 128
        assert (ids[r["n_tokens"]:] == PAD).all() and ends[:-1] == r["position_resets"]
        for d, k, a, b in zip(r["doc_ids"], r["pieces"], ends, ends[1:]):
            found[d, k].append(ids[a:b].tolist())
            assert places[a:b].tolist() == list(range(b - a))
    times = Counter(d for d, _ in docs)
    for d, text in docs:
        ids = encode(text or "")
        parts = [ids[a:a + 128] for a in range(0, len(ids), 128)]
        for k, part in enumerate(parts):
            assert found.pop((d, k), None) == [part] * times[d] or times[d] > 1
    assert not found
    lengths = [n for d, t in docs for n in [128] * (len(encode(t or "")) // 128) + [len(encode(t or "")) % 128] if n]
    assert sorted(128 - r["n_tokens"] for r in rows) == plain_best_fit(lengths, 128)
    assert sorted(r["row_id"] for r in rows) == list(range(len(rows)))
    write_packed(df, scratch + "/p", capacity=128)
    assert spark.read.parquet(scratch + "/p").count() == len(rows)


def test_empty_and_wrong_capacity(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pack(df).collect() == []
    with pytest.raises(ValueError):
        pack(df, capacity=0)


@pytest.mark.parametrize("text", ["ab" + " " * 600 + "cd", " " * 513 + "\nx", "x" + "\n" * 700 + " y", "q" + " " * 2000, ""])
def test_long_gaps_do_not_change_ids(text):
    enc = encoder(read_vocabulary())
    assert encode_with(enc)(text) == enc.encode_ordinary(text)
