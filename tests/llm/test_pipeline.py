"""The pipeline against plain Python, stage by stage on each stage's own input."""

import re

import corpus_pipeline
from citeloom.llm import mixing

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    told = steps["language ID"](spark, docs, SF)
    assert told.columns == docs.columns
    assert told.count() >= 0.98 * docs.count()

    single = steps["exact dedup"](spark, docs, SF).collect()
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert sorted(r.doc_id for r in single) == sorted(first.values())

    near = steps["n-gram Jaccard join"](spark, docs, SF)
    sets = {}
    for r in docs.collect():
        w = r.text.encode().lower().split()
        k = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    least = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if least[b] < least[a] and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                    least[a], changed = least[b], True
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, x in least.items() if d == x)

    mixed = steps["mixing sources"](spark, docs, SF)
    assert mixed.columns == docs.columns
    want = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


def test_language_stage_keeps_long_short_and_mixed_texts_and_all_if_nothing_was_learned(spark):
    import random

    rng = random.Random(3)
    step = dict(corpus_pipeline.STAGES)["language ID"]
    # 40 languages of the same letters, told apart by their words
    stems = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8))) for _ in range(600)]
    own = {f"l{i:02}": rng.sample(stems, 60) for i in range(40)}
    say = lambda lang, n: " ".join(rng.choice(own[lang]) for _ in range(n))
    rows = [(n, say(lang, rng.randrange(1, 40)), lang) for n, lang in enumerate([x for x in own for _ in range(15)])]
    long = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789.,;:-") for _ in range(5)) for _ in range(400_000))
    rows += [(5000, long, "l00"), (5001, "ab.", "l01"), (5002, say("l00", 30) + " " + say("l01", 30), "l00")]
    gone = [(6000, "12 34 ...", "l00"), (6001, "\u0436\u0437 \u0438", None), (6002, None, "l00")]
    docs = spark.createDataFrame(rows + gone, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in step(spark, docs, SF).collect()) == [r[0] for r in rows]
    unnamed = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert step(spark, unnamed, SF).count() == len(rows) + len(gone)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, target double, key long"


def write(spark, path, rows):
    spark.createDataFrame([(*r, "clash", 0.5, 7) for r in rows], SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and long texts, repeated rows, columns that the operators use themselves, and no rows."""
    text = "the calm words of one long and quiet day in the fields"
    rows = [(i, f"{text} number {i} " * 4, "en", "a" if i % 2 else None, 9) for i in range(8)]
    rows += [(None, "no id here at all", "en", "a", 1), (20, None, "en", "a", None), (21, "", "en", "b", 0), rows[0], rows[0], (22, "x y " * 100_000, "en", "b", 1), (23, "12 34", None, "b", 1)]
    out = corpus_pipeline.run(spark, write(spark, tmp_path / "odd", rows)).collect()
    assert {r.doc_id for r in out} <= {r[0] for r in rows} and 22 in {r.doc_id for r in out}
    assert max(r.offset + r.length for r in out) <= 1024
    nothing = corpus_pipeline.run(spark, write(spark, tmp_path / "none", []))
    assert nothing.collect() == [] and "sequence_id" in nothing.columns
    unnamed = [(d, t, None, s, n) for d, t, _, s, n in rows if t]
    assert corpus_pipeline.run(spark, write(spark, tmp_path / "unnamed", unnamed)).count() > 0
