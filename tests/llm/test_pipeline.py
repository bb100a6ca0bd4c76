import re
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from stratalog.llm import pieces
from stratalog.llm.queries import tokenizer_path

from .edge import docs, empty
from .test_dedup import brute_components, norm

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    names, functions = zip(*corpus_pipeline.STAGES)
    assert len(names) == 5
    good = functions[0](spark, d, SF)
    assert good.columns == d.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    whole = {r["doc_id"]: r["text"] for r in d.collect()}
    words = {i: len(re.findall("[^\x20\x09-\x0d]+", t)) for i, t in whole.items()}
    assert all(kept[i] == whole[i] and words[i] >= 50 for i in kept)
    clean = [i for i, q in labels.items() if q == 1 and words[i] >= 200]
    assert sum(i in kept for i in clean) > 0.97 * len(clean)
    assert sum(i in kept for i, q in labels.items() if q == 0) < 0.1 * sum(q == 0 for q in labels.values())

    exact = functions[1](spark, good, SF)
    first: dict[str, int] = {}
    for i, t in kept.items():
        first[norm(t)] = min(first.get(norm(t), i), i)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values()) and exact.columns == d.columns

    near = functions[2](spark, exact, SF)
    rows = [(i, kept[i]) for i in sorted(first.values())]
    want = {eval(r)[2] for r in brute_components(rows)}
    assert {r["doc_id"] for r in near.collect()} == want and near.count() == len(want) and near.columns == d.columns

    mixed = functions[3](spark, near, SF)
    assert mixed.columns == d.columns and {r["doc_id"] for r in mixed.collect()} <= want
    sizes = {r["source"]: r["s"] for r in mixed.groupBy("source").agg(F.sum(F.length("text")).alias("s")).collect()}
    assert len(sizes) > 10

    coded = functions[4](spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in coded) == Counter(r["doc_id"] for r in mixed.collect())
    table = pieces.loaded(tokenizer_path("piece_bpe_32k.model"))
    assert all(r["n_tokens"] == len(table.encode(kept[r["doc_id"]])) for r in coded[:20])


def test_stages_take_edge_rows_and_empty_tables(spark):
    for d in (docs(spark), empty(spark)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, d, "/root/testdata/sf0.001")
            if i < 4:
                assert out.columns == d.columns
            if i != 3:  # sources of a few characters repeat often to reach their weight
                assert out.count() <= d.count()
            elif d.isEmpty():
                assert out.isEmpty()
