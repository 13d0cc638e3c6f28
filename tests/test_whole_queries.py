"""Queries over the whole tables that have no SQL, against plain Python."""

import re

from citeloom.plans import catalog
from citeloom.sources.articles import sentences

catalog.load()
SF = "/root/testdata/sf0.001"


def test_study_clusters_over_all_lines(spark):
    customer = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        if r.l_orderkey in customer:
            a, b = top(("part", r.l_partkey)), top(("customer", customer[r.l_orderkey]))
            up[a] = b
    least = {}
    parts = [x for x in up if x[0] == "part"]
    for x in parts:
        least[top(x)] = min(least.get(top(x), x[1]), x[1])
    got = catalog.QUERIES["study_clusters_all"](spark, SF).collect()
    assert sorted((r.id, r.cluster) for r in got) == sorted((x[1], least[top(x)]) for x in parts)


def test_items_align_with_sentences_of_documents(spark):
    words = lambda t: set(re.split("[^a-z0-9]+", t.lower())) - {""}
    every = [(r.doc_id, n, words(x)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for n, x in enumerate(sentences(r.text))]
    want = []
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = words(r.text)
        j, d, a = max((len(own & w) / len(own | w), -d, -a) for d, a, w in every if own & w)
        want.append((r.item_id, -d, -a, round(j, 6)))
    got = catalog.QUERIES["word_alignment_sentences"](spark, SF).collect()
    assert sorted((r.item_id, r.doc_id, r.sentence, r.jaccard) for r in got) == sorted(want)


def test_alignment_of_odd_rows_in_parts_shuffles_no_pairs(spark, monkeypatch):
    from citeloom.operators import alignment

    texts = [(3, "Cold Water. Warm water!"), (1, "Warm water. Cold water."), (1, "Cold water."), (7, None), (8, ""), (None, "One two three."), (9, "İstanbul Kelvin.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = [(1, ["cold", "water"]), (2, ["one", "two"]), (3, []), (4, ["water", "ice"]), (4, ["warm"]), (None, ["kelvin", "i"])]
    items = spark.createDataFrame(own, "item_id long, words array<string>")
    monkeypatch.setattr(alignment, "SCORES", 4)
    for limit in (1, 1 << 16):
        monkeypatch.setattr(alignment, "ITEM_WORDS", limit)
        got = alignment.best_sentences(docs, items)
        # Spark and Python find i, stanbul and kelvin in the last text
        assert {r.item_id: (r.doc_id, r.sentence, round(r.score, 6)) for r in got.collect()} == {1: (1, 0, 1.0), 4: (1, 0, 0.5), None: (9, 0, round(2 / 3, 6))}
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange") <= 2
    assert alignment.best_sentences(docs.limit(0), items).collect() == alignment.best_sentences(docs, items.limit(0)).collect() == []
