import random

import numpy as np

from citeloom.llm import jaccard_join
from citeloom.llm.jaccard_join import CountTree, counts, jaccard_components


def brute(rows, k=3, threshold=0.9):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= round(100 * threshold) * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted((d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(rows))


def corpus(rng, n):
    base = [[rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(rng.choice([0, 1, 2, 3, 9, 11, 12, 13, 25, 60, 300]))] for _ in range(25)]
    texts = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
            if w:
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [str(rng.randrange(10**6))] * rng.randrange(2)
        texts.append("\n ".join(w).replace("a", rng.choice("aA")))
    return texts


def test_components_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i * 3 % 1009, t) for i, t in enumerate([*corpus(rng, 300), "", "  ", None, "É x y", "é x y"])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n long")
    for k, threshold in ((3, 0.9), (5, 0.8)):
        got = sorted(tuple(r) for r in jaccard_components(docs, k=k, threshold=threshold).collect())
        assert got == brute(rows, k, threshold)
    assert len({c for _, _, c in got}) < len(rows)


def test_chains_and_many_trees(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_SHINGLES", 900)
    monkeypatch.setattr(jaccard_join, "STAR_SHINGLES", 400)
    rng = random.Random(6)
    words = [str(i) for i in range(400)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 200])) for i in range(40)]
    rows += [(100 + i, " ".join([*words[:80], str(rng.random())] + words[81 : 100 - i])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(docs).collect()) == brute(rows)


def test_tree_loses_nothing():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 20, rng.integers(1, 200), dtype=np.uint64)) for _ in range(150)]
    sizes = np.asarray([len(s) for s in sets])
    points = counts(np.concatenate(sets).view(np.int64), np.cumsum([0, *sizes]))
    tree = CountTree(points, sizes)
    for i in range(150):
        want = np.flatnonzero(np.minimum(points, points[i]).sum(1) >= 0.4 * (sizes + sizes[i]) - 1e-6)
        assert sorted(tree.near(points[i], int(sizes[i]), 0.4)) == sorted(want)


def test_nulls_repeats_and_no_rows(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (3, "a b c"), (3, "x y"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0] or -1), r[1], (r[2] or -1)) for r in jaccard_components(docs).collect())
    assert got == [(-1, 1, -1), (3, 1, 3), (3, 1, 3), (4, 0, 4), (7, 1, 3), (7, 1, 3)]
    assert jaccard_components(docs.limit(0)).collect() == []


def test_hot_passages_and_families_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TREE_SHINGLES", 3000)
    rng = random.Random(9)
    word = lambda: str(rng.randrange(10**6))
    shared = [word() for _ in range(60)]
    rows = []
    for i in range(120):
        own = [word() for _ in range(rng.choice([10, 40, 80, 200]))]
        at = rng.randrange(len(own) + 1)
        text = own[:at] + shared + own[at:]
        rows.append((2 * i, " ".join(text)))
        for _ in range(rng.randrange(3)):
            copy = list(text)
            for _ in range(rng.choice([1, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1001 + len(rows), " ".join(copy)))
    # sets of few shingles, whose groups are often empty
    few = [word() for _ in range(14)]
    rows += [(5000 + i, " ".join(few[: 10 + i % 4] + [word()] * (i % 2))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, threshold in ((3, 0.9), (5, 0.8), (1, 0.7)):
        assert sorted(tuple(r) for r in jaccard_components(docs, k=k, threshold=threshold).collect()) == brute(rows, k, threshold)


def test_very_long_texts_link(spark):
    rng = random.Random(3)
    long = [str(rng.randrange(10**7)) for _ in range(20_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:19_500])), (3, " ".join(long[:8000] + [str(rng.randrange(10**7)) for _ in range(12_000)])), (4, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_components(docs).collect()) == brute(rows)


def test_linked_sets_share_a_key_that_neither_drops():
    """Families with half of their shingles in common with others: every set drops as many of its commonest keys as its slack."""
    from collections import Counter

    from citeloom.llm.jaccard_join import group_keys, overlap, size_tops

    rng = np.random.default_rng(7)
    new = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    linked = 0
    for threshold, n in [(t, n) for t in (0.9, 0.8, 0.7) for n in (6, 9, 11, 14, 20, 33, 60, 150, 400)]:
        tops, family, common, sets = size_tops(threshold, 1 << 12), [new(n) for _ in range(3)], new(n // 2), []
        for _ in range(60):
            own = family[rng.integers(3)].copy()
            if rng.random() < 0.5:
                own[: len(common)] = common
            gone = rng.choice(n, rng.integers(0, max(2, int(n * (1 - threshold) * 1.2))), replace=False)
            sets.append(np.unique(np.concatenate([np.delete(own, gone[: len(gone) // 2]), new(rng.integers(0, len(gone) - len(gone) // 2 + 1))])))
        lists = [group_keys(s, threshold, tops) for s in sets]
        size = Counter(int(k) for own in lists for _, keys in own for k in keys)
        kept = []
        for own in lists:
            met = [(slack, sorted((size[int(k)], int(k)) for k in keys if size[int(k)] > 1)) for slack, keys in own]
            kept.append({k for slack, ks in met for _, k in ks[: max(len(ks) - max(slack, 0), 0)]})
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = overlap(a, b)
                if both >= threshold * (len(a) + len(b) - both) - 1e-9 and not np.array_equal(a, b):
                    linked += 1
                    assert kept[i] & kept[j]
    assert linked > 2000
