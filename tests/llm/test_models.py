"""Held-out quality, brute force on small fixtures, and odd rows of the fitted operators and the mix."""

import pytest
from pyspark.sql import functions as F

from citeloom.llm import exact_dedup, language_id, mixing, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(None, "the one and the other", "en", "b"), (1, None, None, None), (2, "", "en", "a"), (2, "", "en", "a"), (3, " \n\t", "fr", "b"), (4, "12 34 ...", "fr", "b"), (5, "x" * 200_000, "de", "b"), (2, "other text", "de", "é")]


@pytest.fixture
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return docs.withColumns({"score": F.lit(1), "size": F.lit("x"), "n": F.lit(2), "digest": F.lit(0)})


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = language_id.op3_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_of_odd_rows(spark, odd):
    model = language_id.train(odd, F.lit(True))
    rows = language_id.classify(odd, model).collect()
    assert len(rows) == len(ODD)
    assert all((r.lid_lang == "und") == (not any(map(str.isalpha, r.text or ""))) for r in rows)
    none = language_id.train(odd.limit(0), F.lit(True))
    assert {r.lid_lang for r in language_id.classify(odd, none).collect()} == {"und"}


def test_long_texts_are_marked_whole(monkeypatch):
    import numpy as np

    whole, parts = np.zeros(1 << language_id.SPACE_BITS), np.zeros(1 << language_id.SPACE_BITS)
    text = "".join(chr(97 + i * i % 23) for i in range(1000))
    language_id.mark(whole, text)
    monkeypatch.setattr(language_id, "CHUNK", 7)
    language_id.mark(parts, text)
    assert (whole == parts).all()


def test_toxicity_tells_held_out_rows_apart(spark):
    clean = [(i, f"the kind word {i % 17} and a calm day {i % 5} of rest " * (1 + i % 4)) for i in range(300)]
    rude = [(1000 + i, f"the kind word {i % 17} you idiot and a calm day {i % 5} of rest " * (1 + i % 4)) for i in range(120)]
    docs = spark.createDataFrame([*clean, *rude, (None, None), (5000, "")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in clean + rude] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, language_id.fold(docs["doc_id"], 3) != 1)
    rows = toxicity.score(docs, model).where(language_id.fold(F.col("doc_id"), 3) == 1).collect()
    told = [(r.score >= 0.7) == (r.doc_id >= 1000) for r in rows if r.doc_id not in (None, 5000)]
    assert sum(told) / len(told) > 0.95
    assert len(toxicity.score(docs, model).collect()) == 422
    none = toxicity.train(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


def test_targets_reshare_the_excess():
    for sizes in ([("a", 10), ("b", 1000), ("c", 100)], [("a", 0), ("b", 7)], [("a", 5)] * 7):
        t = mixing.targets(sizes)
        assert sum(t) == pytest.approx(1.5 * sum(n for _, n in sizes))
        assert all(x <= 2 * n + 1e-9 for x, (_, n) in zip(t, sizes))
    assert mixing.targets([]) == []


def test_mix_takes_near_targets_and_reruns_agree(spark):
    first, again = (sorted(tuple(r) for r in mixing.op5_mixing(spark, SF).collect()) for _ in range(2))
    assert first == again and len(first) == 1000
    by = {}
    for r in first:
        assert 0 <= r[4] <= 2 * r[1]
        taken, target, largest = by.get(r[5], (0, r[3], 0))
        by[r[5]] = taken + r[4], target, max(largest, r[1])
    for taken, target, largest in by.values():
        assert abs(taken - target) <= max(0.05 * target, largest)


def test_mix_of_odd_rows(spark, odd):
    assert mixing.mix(odd).count() == len(ODD)
    out = mixing.repeat(odd)
    assert out.columns == odd.columns
    assert out.count() <= 2 * len(ODD)
    assert mixing.repeat(odd.limit(0)).collect() == []


@pytest.mark.parametrize("files", [None, 1])
@pytest.mark.parametrize("bits", [64, 1])
def test_exact_dedup_equals_brute_force(spark, bits, files):
    """Also with digests of one hexadecimal digit, so that bytes decide."""
    texts = ["a b", "a\t b", "a  b ", "", None, " ", "\n", "c", "c", "d", "long " * 50, "long\n" * 50, "a b"] + [f"t{i % 30}" for i in range(60)]
    rows = [(None if i % 11 == 5 else i * 7 % 73, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    digest = lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, bits))
    got = exact_dedup.deduplicate(docs, digest=digest, files_per_batch=files).collect()
    import re

    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for d, t, _ in rows:
        groups.setdefault(body(t), []).append(d)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    want = sorted(((d or -1), least(groups[body(t)]) or 0, len(groups[body(t)])) for d, t, _ in rows)
    assert sorted(((r.doc_id or -1), r.keep_id or 0, r.group_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_odd_rows(spark, odd):
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns
    assert kept.count() == 6
    assert exact_dedup.keep_first(odd.limit(0)).collect() == []


def test_toxic_words_and_pairs_keep_counts_of_their_own(spark):
    """Words that a table of 2^20 slots would count together, and pairs that were never seen."""
    import numpy as np
    import xxhash

    at, same = {}, []
    for i in range(20_000):
        word = f"w{i}"
        same += [(at[slot], word)] if (slot := xxhash.xxh3_64_intdigest(word.encode()) % ((1 << 20) - 1)) in at else []
        at[slot] = word
    kind, rude = zip(*same[:40])
    rows = [(f"{' '.join(kind)} calm", 0)] * 30 + [(f"{' '.join(rude)} calm", 1)] * 30
    model = toxicity.learn_models(spark.createDataFrame(rows, "text string, toxic long"))
    ratios = lambda words: model.word[toxicity.places(model.word_keys, toxicity.pairs(" ".join(words))[1])]
    assert (ratios(kind) < -1).all() and (ratios(rude) > 1).all()
    assert len(model.word_keys) == len(set(kind) | set(rude)) + 1
    v, w = (x.ravel() for x in np.meshgrid(np.arange(1, 2001), np.arange(5000, 7000)))
    assert not model.pair[toxicity.places(model.pair_keys, toxicity.pair_key(v, w))].any()


def test_scores_are_the_kernel_with_every_landmark_times_its_coefficients(spark):
    """The matrix product equals, text by text, the sum over landmarks of the normalised number of shared n-grams."""
    import numpy as np

    texts = [("a", "the cat sat on the mat"), ("a", "a cat on a mat"), ("b", "der hund und die katze"), ("b", "die katze und der hund im haus")] * 3
    bits = []
    for _, t in texts:
        row = np.zeros(1 << language_id.SPACE_BITS, np.uint8)
        language_id.mark(row, t)
        bits.append(np.packbits(row))
    model = language_id.learn([x for x, _ in texts], np.stack(bits))

    def grams(t):
        row = np.zeros(1 << language_id.SPACE_BITS, np.uint8)
        language_id.mark(row, t)
        return set(np.flatnonzero(row).tolist())

    for t in ("the hund sat", "katze", "zzz"):
        own = grams(t)
        by_hand = sum(model.weights[g].astype(float) for g in own) / np.sqrt(max(len(own), 1))
        assert np.allclose(model.scores([t])[0], by_hand, atol=1e-4)
    # the presence of a text is that of each of its n-grams, and no other
    alone = set().union(*[grams(x) for x in ("ab", "bc", "abc")])
    assert grams("abc") == alone


def test_classes_probabilities_sum_to_one_and_rare_words_have_a_ratio_of_one(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    counts = [rng.integers(0, 9, 50).astype(float), rng.integers(0, 4, 50).astype(float)]
    follows = rng.integers(1, 6, 50).astype(float)
    totals = {"c0": counts[0].sum(), "c1": counts[1].sum(), "d0": np.minimum(counts[0], 2).sum(), "d1": np.minimum(counts[1], 2).sum(), "follows": follows.sum(), "types": 50}
    p = toxicity.words_models([np.append(c, 0) for c in counts], np.append(follows, 0), totals)
    for x in p:
        assert x.sum() == pytest.approx(1)
    rare = np.append((counts[0] <= 2) & (counts[1] <= 2), True)
    assert np.allclose(p[0][rare], p[1][rare])
    seen, rest = toxicity.evened([np.asarray([0.5, 0.2]), np.asarray([0.1, 0.6])], [np.asarray(0.3), np.asarray(0.3)])
    assert [s.sum() + rest for s in seen] == pytest.approx([1, 1])


def test_toxicity_of_few_long_and_repeated_rows(spark):
    rows = [(i, "nice words of a calm day " * 3) for i in range(6)] + [(100 + i, "you idiot and moron " * 3) for i in range(6)]
    docs = spark.createDataFrame([*rows, rows[0], (900, "calm day " * 200_000), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 100)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r.score for r in got}
    assert min(by[i] for i in range(100, 106)) > 0.5 > max(by[i] for i in [*range(6), 900])
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert toxicity.score(docs.limit(0), model).collect() == []
