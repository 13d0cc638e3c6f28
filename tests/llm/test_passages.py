import random

import numpy as np

from citeloom.llm.passages import compact_windows, repeated_passages


def test_windows_cover_every_long_run_once():
    rng = np.random.default_rng(1)
    for values in [rng.integers(0, 1000, 60), rng.integers(0, 3, 60), np.zeros(60, int)]:
        found = compact_windows(values, 10)
        for a in range(60):
            for b in range(a + 9, 60):
                holds = [(x, c, y) for x, c, y in found if x <= a <= c <= b <= y]
                assert len(holds) == 1
                assert values[holds[0][1]] == values[a : b + 1].min()


def test_planted_passages_are_found_and_others_left_alone(spark):
    rng = random.Random(9)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(2000))
    passage = [word() for _ in range(70)]
    rows, has = [], {}
    for i in range(120):
        text = [word() for _ in range(rng.randrange(0, 300))]
        if i % 3 == 0:
            at = rng.randrange(len(text) + 1)
            own = list(passage)
            if i % 2:
                own[35] = "changed"
            text[at:at] = own
            has[i] = at
        rows.append((i, "\n ".join(text)))
    rows += [(500, rows[3][1].upper().replace("\n", "")), (None, rows[0][1]), (501, None), (502, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as p")
    members, found = repeated_passages(docs)
    assert members.count() == len(rows)
    assert {r.doc_id: r.rep_id for r in members.collect()}[500] == 3
    spans = {}
    for r in found.collect():
        spans.setdefault(r.doc_id, []).append((r.at, r.upto, r.first_id))
    assert set(spans) == set(has) - {0}
    for i, parts in spans.items():
        words = {w for a, b, _ in parts for w in range(a, b)}
        assert len(words & set(range(has[i], has[i] + 70))) >= 60
        assert len(words) <= 80
        assert all(first < i and first in has for _, _, first in parts)
    assert repeated_passages(docs.limit(0))[1].collect() == []


def test_short_passages_with_a_word_changed_near_an_edge_are_found():
    from citeloom.llm.passages import matches

    rng = np.random.default_rng(5)
    for n_words in (50, 51, 53):
        n = n_words - 4
        for word in [*range(5), *range(n_words - 5, n_words)]:
            for before in (0, 30):
                passage = rng.integers(0, 2**32, n)
                copy = passage.copy()
                copy[max(0, word - 4) : word + 1] = rng.integers(2**33, 2**34, len(copy[max(0, word - 4) : word + 1]))
                own = np.concatenate([rng.integers(2**34, 2**35, before), copy])
                other = np.concatenate([rng.integers(2**35, 2**36, 7), passage])
                shared = len(np.intersect1d(passage, copy))
                found = matches(own, other, 46, 0.8)
                assert shared / (2 * n - shared) >= 0.8
                assert [b - a >= 46 and a >= before and d - c >= 46 for a, b, c, d in found] == [True]
    assert matches(passage[:38], passage, 46, 0.8) == []


def identical_runs(rows):
    """Ids of texts that share a run of 50 words with an earlier one, by brute force."""
    seen, found = set(), set()
    for i, text in sorted(rows):
        w = text.lower().split()
        runs = {tuple(w[a : a + 50]) for a in range(len(w) - 49)}
        if runs & seen:
            found.add(i)
        seen |= runs
    return found


def test_identical_passages_of_common_sentences_equal_brute_force(spark):
    rng = random.Random(21)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(900))
    sentences = [[word() for _ in range(rng.randrange(8, 22))] for _ in range(60)]
    passages = [sum((rng.choice(sentences) for _ in range(5)), [])[:60] for _ in range(12)]
    rows = [(i, " ".join(sum((rng.choice(sentences) + [word() for _ in range(rng.randrange(30))] for _ in range(9)), []))) for i in range(120)]
    for i in range(200, 420):
        text = [word() for _ in range(rng.randrange(200))]
        at = rng.randrange(len(text) + 1)
        part = rng.choice(passages)
        cut = rng.randrange(0, 30) if rng.random() < 0.4 else 0
        text[at:at] = part[cut:]
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    members, found = repeated_passages(docs)
    got = {r.doc_id for r in found.collect()} | {r.doc_id for r in members.collect() if r.rep_id != r.doc_id and r.n_words >= 50}
    assert identical_runs(rows) - got == set()


def similar(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b)]
    both = len(sets[0] & sets[1])
    return both >= 0.8 * (len(sets[0] | sets[1]))


def test_variants_of_a_passage_reach_a_recall_of_nine_tenths(spark):
    rng = random.Random(22)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    rows, want = [], set()
    for family in range(3):
        base = [word() for _ in range(60)]
        variants = [base]
        for i in range(150):
            own = list(rng.choice(variants))
            for _ in range(rng.randrange(7)):
                own[rng.randrange(60)] = word()
            doc_id = family * 1000 + i
            if any(similar(own, v) for v in (variants if i else [])):
                want.add(doc_id)
            variants = variants + [own] if i else [own]
            text = [word() for _ in range(rng.randrange(200))]
            at = rng.randrange(len(text) + 1)
            text[at:at] = own
            rows.append((doc_id, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in repeated_passages(docs)[1].collect()}
    print("recall", len(want & got) / len(want), len(want), len(got - want))
    assert len(want & got) >= 0.9 * len(want)


def test_very_long_and_repeated_texts(spark):
    rng = random.Random(23)
    long = [str(rng.randrange(10**6)) for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[29_000:29_060])), (3, " ".join(["na"] * 20_000)), (4, " ".join(["na"] * 5_000))]
    got = {r.doc_id: r.first_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert got == {2: 1, 4: 3}


def test_every_near_copy_is_found_also_behind_other_holders_of_its_words(spark):
    rng = random.Random(24)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    filler = lambda: [word() for _ in range(rng.randrange(60))]
    rows, want = [], set()
    for i in range(250):
        base = [word() for _ in range(rng.randrange(50, 75))]
        own = list(base)
        at = rng.randrange(len(base))
        own[at : at + 1] = rng.choice([[word()], [], [base[at], word()]]) if len(base) > 52 else [word()]
        pieces = [base[a : a + 30] for a in (0, 10, 20, len(base) - 30)] if i % 2 else []
        texts = [*pieces, base, own]
        for n, text in enumerate(texts):
            rows.append((10 * i + n, " ".join(filler() + text + filler())))
        if len(own) >= 50 and similar(base, own):
            want.add(10 * i + len(texts) - 1)
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))[1].collect()}
    assert len(want) > 200
    assert sorted(want - got) == []


def test_a_known_order_of_the_other_text_changes_no_match():
    from citeloom.llm.passages import matches

    rng = np.random.default_rng(6)
    for shared in (31, 33, 40, 41, 60, 120):
        passage = rng.integers(0, 40 if shared == 120 else 2**32, shared)
        own = np.concatenate([rng.integers(2**34, 2**35, 30), passage, rng.integers(2**34, 2**35, 20)])
        other = np.concatenate([rng.integers(2**35, 2**36, 9), passage, rng.integers(2**35, 2**36, 50)])
        found = matches(own, other, 46, 0.8, np.argsort(other, kind="stable"))
        assert found == matches(own, other, 46, 0.8)
        assert bool(found) == (shared >= 41)


def test_a_line_that_many_documents_share_makes_no_pairs_and_hides_no_near_copy(spark, monkeypatch):
    from citeloom.llm import passages

    rng = random.Random(25)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(3000))
    some = lambda n: [word() for _ in range(n)]
    line = some(32)
    rows, want = [], set()
    for i in range(150):
        before, after = some(60), some(60)
        rows.append((10 * i, " ".join(before + line + after)))
        if i % 10 == 3:
            # near copies of what an earlier document has around the line
            own = before[-12:] + line + after[:12]
            own[4] = word()
            rows.append((10 * i + 5, " ".join(some(30) + own + some(30))))
            want.add(10 * i + 5)
    compared = []
    inner = passages._compared

    def counted(docs, members, met, ids):
        compared.append(met.count())
        return inner(docs, members, met, ids)

    monkeypatch.setattr(passages, "_compared", counted)
    found = repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))[1]
    assert {r.doc_id for r in found.collect()} == want
    assert sum(compared) <= 3 * len(rows)


def test_reach_goes_over_short_gaps_only():
    from citeloom.llm.passages import _reach

    hit = np.zeros((3, 40), bool)
    hit[:, 0] = True
    hit[1, [11, 22]] = True
    hit[2, [11, 23, 24]] = True
    assert _reach(hit).tolist() == [0, 22, 11]
    assert _reach(hit[:, :1]).tolist() == [0, 0, 0]
