"""Each stage against a plain version on its own input, and the whole run."""

from collections import Counter

import corpus_pipeline as P
from gamelog.llm.decontaminate import contaminated
from gamelog.llm.hamming_dedup import near_groups
from gamelog.llm.toxicity import fit, strength, automaton

SF = "/root/testdata/sf0.001"


def docs_of(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    text = docs.orderBy("doc_id").limit(1).collect()[0]["text"]
    more = [(9001, text, "en", "s", 1), (9002, None, None, None, None), (9003, "", "en", "s", 0), (None, "no id", "en", "s", 5),
            (9004, "twice", "en", "s", 5), (9004, "twice", "en", "s", 5)]
    return docs.unionByName(spark.createDataFrame(more, docs.schema))


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_do_what_they_say(spark):
    docs = docs_of(spark).cache()
    before = ids(docs)
    labels = spark.read.parquet(SF + "/labels.parquet")
    model = fit(docs, labels)
    auto, (a, b) = automaton(model.terms, model.phrases), model.curve
    plain = Counter(r["doc_id"] for r in docs.collect() if a + b * strength(auto, r["text"]) < 0)
    kept = P.toxicity(spark, docs, SF)
    assert kept.columns == docs.columns and ids(kept) == plain
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    assert sum(d in plain for d in toxic) <= 0.3 * len(toxic)

    groups = {r["doc_id"]: r["component_id"] for r in near_groups(docs, width=5, percent=80).collect()}
    single = P.near_dedup(spark, docs, SF)
    assert single.columns == docs.columns
    assert ids(single) == Counter({d: 1 for d in before if d is None or groups[d] == d})
    assert len({groups[d] for d in ids(single) if d is not None}) == len(ids(single)) - 1

    bench = spark.read.parquet(SF + "/benchmark.parquet")
    leaks = {r["doc_id"] for r in contaminated(docs, bench).collect()}
    items = [" ".join(r["text"].split()) for r in bench.collect()]
    whole = {r["doc_id"] for r in docs.collect() if any(t in " ".join((r["text"] or "").split()) for t in items)}
    clean = P.decontaminate(spark, docs, SF)
    assert clean.columns == docs.columns and whole <= leaks
    assert ids(clean) == Counter({d: n for d, n in before.items() if d not in leaks})

    mixed = P.mix(spark, docs, SF)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(before)
    assert len(set(before) - set(ids(mixed))) < 0.2 * len(before)

    packed = P.pack_tokens(spark, docs, SF).collect()
    full = Counter(r["doc_id"] for r in docs.collect() if r["text"])
    assert Counter(d for r in packed for d, k in zip(r["doc_ids"], r["pieces"]) if k == 0) == full


def test_run_on_given_and_empty_tables(spark, scratch):
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_dedup", "decontaminate", "mix", "pack"]
    assert P.run(spark, SF).count() > 0
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{scratch}/{name}.parquet")
    assert P.run(spark, scratch).count() == 0
