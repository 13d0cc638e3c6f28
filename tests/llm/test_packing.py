import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm.packing import cut, encoder, pack, plan


def spread(counts, cap):
    """All pieces of a plan as (sequence, offset, length)."""
    out = []
    for length, low, high, first, each, offset in plan(counts, cap):
        out += [(first + i // each, offset + i % each * length, length) for i in range(high - low)]
    return out


def plain_best_fit(lengths, cap):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(cap - n)
    return len(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_plan_equals_best_fit_piece_by_piece(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed = spread(counts, 20)
    assert sorted(x[2] for x in placed) == sorted(lengths)
    by = {}
    for sequence, offset, length in placed:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 20
    assert len(by) == plain_best_fit(lengths, 20)


def test_cut_leaves_only_the_first_piece_short():
    assert list(cut(5, 4)) == [(0, 1), (1, 4)]
    assert list(cut(8, 4)) == [(0, 4), (4, 4)]
    assert list(cut(3, 4)) == [(0, 3)]


def test_encoder_equals_the_tokenizers_library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["", " ", "a  b\n c", "\n\nx ", "don't  stop\t now", "é x  y", "<|endoftext|> x", "a\x1cb \x1c c", "日本 語 12 3!"]
    texts += ["".join(rng.choice("ab \n\t'é1., ") for _ in range(60)) for _ in range(500)]
    ids = encoder(None, None)
    for x in texts:
        assert np.frombuffer(ids(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)


def test_pack_places_every_token_once(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", None), (None, "z " * 50, "y"), (4, "word " * 300, "y"), (4, "word " * 300, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string")
    out = pack(docs, cap=64).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for doc_id, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 64 or min(len(ids), 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((doc_id or -1, k, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(docs.limit(0)).collect() == []


def test_added_tokens_have_their_ids(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|> <|endoftext|><|endoftext|>\n y", "<|endoftext|", "end <|endoftext|>"]
    assert t.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    want = [zlib.crc32(np.asarray(t.encode(x, add_special_tokens=False).ids + [2], "<u4").tobytes()) for x in texts]
    out = pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.ids_crc32 for r in out] == want
