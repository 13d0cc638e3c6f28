import random

from citeloom.llm.hamming_search import search
from citeloom.llm.line_dedup import drop_repeats


def test_search_equals_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(12)]
    codes = [(i, c - (c >> 63 << 64)) for i in range(400) for c in [rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (2**64 - 1)]]
    codes += [(1000 + i, 5) for i in range(30)] + [(2000, None), (None, 5), (3, codes[3][1])]
    rows = spark.createDataFrame(codes, "id long, code long")
    known = sorted({(i, c) for i, c in codes if i is not None and c is not None})
    got = search(rows, rows.where("id % 20 = 0"), 5).collect()
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = []
    for q, qc in known:
        if q % 20 == 0:
            near = sorted((far(qc, c), i) for i, c in known if i != q)[:5]
            want += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert search(rows.limit(0), rows.limit(0), 5).collect() == []
    assert len(search(rows.where("id in (20, 40)"), rows.where("id = 20"), 5).collect()) == 1


def test_probes_are_not_broadcast_where_the_index_is_large(spark, monkeypatch):
    from citeloom.llm import _common, hamming_search

    plans, staged = [], hamming_search.stage
    monkeypatch.setattr(_common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(hamming_search, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or staged(df, name))
    rng = random.Random(6)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(150)]
    rows = spark.createDataFrame(codes, "id long, code long")
    got = search(rows, rows.where("id % 50 = 0"), 3).collect()
    far = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = [(q, i, d, n + 1) for q, qc in codes if q % 50 == 0 for n, (d, i) in enumerate(sorted((far(qc, c), i) for i, c in codes if i != q)[:3])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert any("SortMergeJoin [segment" in p for p in plans)
    assert not any("BroadcastHashJoin [segment" in p for p in plans)


def test_long_repeated_runs_go_and_the_first_stays(spark):
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice("abcdefgh") * rng.randrange(3, 9) + str(rng.randrange(10**6)) for _ in range(6))
    passage = [line() for _ in range(4)]
    rows = []
    for i in range(40):
        own = [line() for _ in range(rng.randrange(1, 12))]
        if i % 4 == 1:
            at = rng.randrange(len(own) + 1)
            own[at:at] = [x.replace(" ", " \t" if i % 8 == 1 else " ") for x in passage]
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (None, rows[3][1]), (7, rows[7][1]), (103, "\n".join(passage + passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as at")
    got = drop_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        has = r.doc_id is not None and r.doc_id < 40 and r.doc_id % 4 == 1
        if r.doc_id == 103:
            assert r.cleaned == "" and r.n_lines == 8
        elif r.doc_id is None:
            assert r.cleaned == "" and r.first_ids == [3]
        elif has and r.doc_id > 1:
            assert len(r.dropped) == 4 and r.first_ids[0] == 1 and max(r.first_ids) < r.doc_id
            assert not any(p in r.cleaned for p in passage)
        else:
            assert not r.dropped
    assert drop_repeats(docs.limit(0)).collect() == []


def test_repeats_equal_brute_force_with_blank_one_line_and_common_lines(spark):
    rng = random.Random(12)
    pool = [f"{c} a line that is long enough to be a run by itself" for c in "abcdef"] + [f"{c} some twenty chars {c}" for c in "ghij"] + ["}", "- x", "end"] + [""] * 4 + [" "]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))) for i in range(60)]
    # a common line first stands elsewhere; paragraphs parted by blank lines; a tail that the first copy lacks
    para = [f"paragraph {i} of words that stand in two documents" for i in range(4)]
    rows += [(100, "}\nother 1"), (101, "one short\n}\nthen more words of it\n"), (102, "x1\none short\n}\nthen more words of it\n")]
    rows += [(103, "\n\n".join(para)), (104, "new\n\n" + "\n\n".join(para) + "\n\n\n"), (105, para[2]), (106, "\n" * 50 + para[3] + "\n" * 50), (107, "\n" * 40 + para[3] + "\n" * 60)]
    fold = lambda t: [" ".join(x.split()) for x in t.split("\n")]
    texts = [(i, fold(t)) for i, t in sorted(rows)]
    runs_of = lambda x: [(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(map(len, x[a:b])) >= 40]
    seen, want = set(), {}
    for i, x in texts:
        gone = set()
        for a, b in runs_of(x):
            if tuple(x[a:b]) in seen:
                gone |= set(range(a, b))
            seen.add(tuple(x[a:b]))
        want[i] = sorted(gone)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(r.dropped) for r in drop_repeats(docs).collect()}
    assert got == want
    assert want[104] and want[105] == [0] and len(want[107]) == 91


def test_very_long_texts_and_ties(spark):
    """A text of many lines that repeat, and two rows of one text under two ids: the smaller id is the first."""
    long = "\n".join(f"line {i % 3000} of a text with very many lines in it" for i in range(9000))
    rows = [(5, long), (2, "line 7 of a text with very many lines in it"), (9, "a tie of a line that two rows have, whole"), (8, "a tie of a line that two rows have, whole")]
    got = {r.doc_id: (r.n_lines, len(r.dropped), list(r.first_ids)) for r in drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: (9000, 6001, [2, 5]), 2: (1, 0, []), 8: (1, 0, []), 9: (1, 1, [8])}


def test_codes_hold_all_coordinates_or_fail(spark):
    from pyspark.errors import SparkRuntimeException
    from pyspark.sql import functions as F

    from citeloom.llm.hamming_search import sign_code

    rows = spark.createDataFrame([([1.0] * 64,), ([1.0, -1.0, None],), (None,)], "v array<double>")
    assert [r[0] for r in rows.select(sign_code(F.col("v"))).collect()] == [-1, 1, None]
    with __import__("pytest").raises(SparkRuntimeException):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(sign_code(F.col("v"))).collect()
