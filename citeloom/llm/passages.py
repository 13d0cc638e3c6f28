"""Near-duplicate passages by compact windows over min-hashes of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm._common import mark, release, small, stage
from citeloom.llm.jaccard_join import FLUSH_ROWS, _mixed, _words

#: Words of a shingle, least words of a passage, least Jaccard similarity of two.
SHINGLE, LEAST_WORDS, SIMILARITY = 5, 50, 0.8
#: Shingles of the run that near copies share at least (see ``window_keys``), of context on one side of its minimum, and step of the stretches of whole passages.
RUN, CONTEXT, STEP = 21, 10, 5
#: Shingles of the documents that are verified against one other in a task's cell.
CELL_SHINGLES = 1 << 17
#: Rows of a context beyond which its centres meet only documents that are alike around them, shingles looked at on either side of a centre, and those more of a holder, and holders in a cell.
HOT, AROUND, SLACK, HOLDERS = 32, 64, 16, 2048

#: Base of the polynomial hash of a stretch of shingles.
BASE = 0xD6E8FEB86659FD93
_SEEDS = np.asarray([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0xDB4F0B9175AE2165], np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def sequence(text: str | None) -> tuple[int, np.ndarray]:
    """Number of words, and the hashes of the shingles in order; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(w) - SHINGLE + 1
    if n < 1:
        return len(w), np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = _mixed(h * _STEP + w[i : i + n])
    return len(w), h


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(left, centre, right): every run of values that holds the centre and lies in the
    window has its minimum there. From a Cartesian tree; of equal minima the one
    nearest the middle is the centre, so repeated text does not unbalance the tree."""
    out, todo = [], [(0, len(values) - 1)] if len(values) >= least else []
    while todo:
        left, right = todo.pop()
        part = values[left : right + 1]
        centre = left + int(part.argmin())
        if right - left > 4 * least and (ties := np.flatnonzero(part == values[centre])).size > 1:
            centre = left + int(ties[np.abs(ties - len(part) // 2).argmin()])
        out.append((left, centre, right))
        if centre - left >= least:
            todo.append((left, centre - 1))
        if right - centre >= least:
            todo.append((centre + 1, right))
    return out


def _padded(own: np.ndarray, other: np.ndarray, a: int, b: int, shift: int, least: int, similarity: float) -> tuple[int, int, int, int] | None:
    """A stretch shorter than ``least`` with changed shingles at its edges, if it is similar enough with them."""
    need = least - (b - a)
    for left in range(need + 1):
        p, q = a - left, b + need - left
        low, high = p + shift, q + shift
        if p >= 0 and q <= len(own) and low >= 0 and high <= len(other):
            x, y = np.unique(own[p:q]), np.unique(other[low:high])
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both >= similarity * (len(x) + len(y) - both):
                return p, q, low, high
    return None


def matches(own: np.ndarray, other: np.ndarray, least: int, similarity: float, order: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
    """Passages of ``own`` that are near-duplicates of passages of ``other``: (start, end, start, end) in shingles.

    Shingles of the other text are marked; marked runs are joined over short
    gaps as long as the marks stay dense, and each stretch is then verified by
    the Jaccard similarity of its shingles and those of its counterpart.
    ``order``: that of ``other``, if it is known.
    """
    if order is None:
        order = np.argsort(other, kind="stable")
    at = np.searchsorted(other, own, sorter=order)
    hit = at < len(other)
    hit[hit] = other[order[at[hit]]] == own[hit]
    if np.count_nonzero(hit) < 2 * similarity / (1 + similarity) * similarity * least:
        return []
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    runs = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    joined: list[list[int]] = []
    for a, b in runs:
        if joined and a - joined[-1][1] <= 2 * SHINGLE and joined[-1][2] + b - a >= (2 * similarity / (1 + similarity)) * (b - joined[-1][0]):
            joined[-1][1:] = [b, joined[-1][2] + b - a]
        else:
            joined.append([a, b, b - a])
    out = []
    for a, b, _ in joined:
        if b - a < similarity * least:
            continue
        places = order[at[a:b][hit[a:b]]]
        shift = int(np.median(places - np.flatnonzero(hit[a:b])))
        if b - a < least:
            # a change near an edge: the passage is as long with the changed shingles
            if longer := _padded(own, other, a, b, shift - a, least, similarity):
                out.append(longer)
            continue
        low, high = max(0, shift), min(len(other), shift + b - a)
        x, y = np.unique(own[a:b]), np.unique(other[low:high])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both >= similarity * (len(x) + len(y) - both):
            out.append((a, b, low, high))
        else:
            # the counterpart is not in one stretch: unbroken runs count by themselves
            out += [(p, q, 0, len(other)) for p, q in runs if a <= p and q <= b and q - p >= least]
    return out


_powers = {"base": np.ones(1, np.uint64), "back": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept for later texts."""
    if len(_powers["base"]) < n:
        for name, x in (("base", BASE), ("back", pow(BASE, -1, 1 << 64))):
            _powers[name] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, np.uint64(x)), dtype=np.uint64)])
    return _powers["base"][:n], _powers["back"][:n]


def window_keys(h: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Windows of both hash functions: key, centre, reach to the left and right of it, number of context keys, and these.

    A key stands for function and minimum. The context keys of the first function
    hash stretches of ``least - STEP + 1`` shingles in the window, the centre in
    them, starting every ``STEP`` shingles: any run of ``least`` shingles that
    two texts share gives both the window's key and one of these. Those of the
    second one hash the centre and ``CONTEXT`` shingles to its left, or right, so
    that any run of ``RUN`` shingles that two texts share gives both one of these.

    Near copies share such a run. A word that is changed, put in or left out takes
    at least 9 shingles from the two of them, a piece that is moved 8, and they may
    lack a quarter of what they share, which is 41 or more of 46: so 41 to 63 are
    in two pieces at most, 64 to 95 in three, and so on; the longest has 21.
    """
    base, back = powers(len(h))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * base, dtype=np.uint64)])
    span = least - STEP
    before = np.asarray([*range(0, span, STEP), span])
    shapes = [(least, before, span - before), (RUN, np.asarray([CONTEXT, 0]), np.asarray([0, CONTEXT]))]
    out: tuple[list, ...] = ([], [], [], [], [], [])
    for i, (run, a, b) in enumerate(shapes):
        values = _mixed(h ^ _SEEDS[i])
        left, centre, right = np.asarray(compact_windows(values, run), np.int64).T
        key, low, high = _mixed(values[centre] + np.uint64(i)), centre - left, right - centre
        fits = (low[:, None] >= a) & (high[:, None] >= b)
        row, shape = np.nonzero(fits)
        start, end = centre[row] - a[shape], centre[row] + b[shape] + 1
        context = _mixed((sums[end] - sums[start]) * back[start] + key[row] + shape.astype(np.uint64))
        for column, x in zip(out, (key, centre, low, high, fits.sum(1), context), strict=True):
            column.append(x)
    return tuple(map(np.concatenate, out))


def _nested(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = pa.array(np.cumsum([0, *map(len, arrays)], dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(arrays), kind))


def _windowed(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, h1, h2`` and the windows of both hash functions as arrays."""
    least = LEAST_WORDS - SHINGLE + 1

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, np.zeros(0, np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, FLUSH_ROWS):
                some = batch.slice(at, FLUSH_ROWS)
                n, h1, h2, found = [], [], [], []
                for text in some.column(1):
                    words, h = sequence(text.as_py())
                    place = np.arange(1, len(h) + 1, dtype=np.uint64) * _STEP
                    n.append(words)
                    h1.append(int(_mixed(h ^ place).sum(dtype=np.uint64).astype(np.int64)))
                    h2.append(int(_mixed(h + _mixed(place)).sum(dtype=np.uint64).astype(np.int64)))
                    found.append(window_keys(h, least) if len(h) >= least else none)
                keys, centre, low, high, sizes, contexts = zip(*found, strict=True)
                inner = pa.ListArray.from_arrays(
                    pa.array(np.cumsum(np.concatenate([np.zeros(1, np.int64), *sizes]), dtype=np.int32)), pa.array(np.concatenate(contexts).view(np.int64))
                )
                outer = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)], dtype=np.int32)), inner)
                numbers = [pa.array(x, pa.int64()) for x in (n, h1, h2)]
                lists = [_nested([x.view(np.int64) for x in keys], pa.int64()), *[_nested(list(x), pa.int32()) for x in (centre, low, high)], outer]
                yield pa.RecordBatch.from_arrays([some.column(0), *numbers, *lists], names=["doc_id", "n_words", "h1", "h2", "key", "centre", "low", "high", "context"])

    return docs.mapInArrow(make, "doc_id long, n_words long, h1 long, h2 long, key array<long>, centre array<int>, low array<int>, high array<int>, context array<array<long>>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (first, tile, own, doc_id, text), each first document before those that are compared with it, to passages."""
    least = LEAST_WORDS - SHINGLE + 1
    cell, other, order = None, None, None
    # texts that are compared with many others, up to 8 * CELL_SHINGLES of their shingles
    known, held = {}, 0
    names = ["doc_id", "at", "upto", "first_id", "first_at", "first_upto"]
    for batch in batches:
        out = []
        for first, tile, own, doc_id, text in zip(*batch.columns, strict=True):
            first = first.as_py()
            doc_id = doc_id.as_py()
            if (h := known.get(doc_id)) is None:
                h = sequence(text.as_py())[1]
                if held > 8 * CELL_SHINGLES:
                    known, held = {}, 0
                known[doc_id], held = h, held + len(h)
            if not own.as_py():
                cell, other, order = (first, tile.as_py()), h, np.argsort(h, kind="stable")
                continue
            if cell != (first, tile.as_py()):
                raise ValueError("a cell has no first document")
            out += [(doc_id, a, b + SHINGLE - 1, first, c, d + SHINGLE - 1) for a, b, c, d in matches(h, other, least, SIMILARITY, order)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Passages of at least ``LEAST_WORDS`` words that an earlier document has, or nearly.

    Returns two tables. The first has a row for every row of ``docs``:
    ``doc_id, n_words, rep_id``, the smallest doc_id with the same sequence of
    words (texts under ``SHINGLE`` words and null ids: their own id). The second
    has, for representatives, ``doc_id, at, upto, first_id, first_at,
    first_upto``: words ``at`` to ``upto`` (exclusive) and their counterpart in
    a document of a smaller id.

    Two functions cut a document into compact windows. Windows whose function and
    minimum two documents share are told apart by what surrounds the centre (see
    ``window_keys``), and each joins the window of the smallest doc_id with the
    same surroundings, where the two intervals can hold a common run of ``RUN``
    shingles; the documents are then compared on their shingles. A centre that no
    passage found so far covers is compared with every earlier document that has
    its surroundings. Where those are many, the shingles around the centre tell in
    each holder's cell which of them is alike there, and only the first of these is
    compared; where that leaves the centre bare, all of them are. So documents that
    share a line of fewer words make no pairs, and a hot passage a row for each that has it.

    Rows with a null id are not compared. Of an id that repeats with different
    texts, the text with the larger hash stands for it. No rows give no rows.
    Other columns are not read.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    since = mark()
    rows = stage(_windowed(own), "windows")
    whole = F.col("doc_id").isNotNull() & (F.col("n_words") >= SHINGLE)
    classes = rows.where(whole).groupBy("n_words", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    copies = stage(classes.where("copies > 1"), "copies")
    copies = small(copies, copies.count(), 48).drop("copies")
    members = rows.select("doc_id", "n_words", "h1", "h2").join(copies, ["n_words", "h1", "h2"], "left")
    members = members.select("doc_id", "n_words", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep_id"))
    slim = stage(members, "members")

    singles = rows.where(F.size("key") > 0).join(copies, ["n_words", "h1", "h2"], "left").where("doc_id is not null and (rep is null or rep = doc_id)")
    windows = singles.select("doc_id", F.explode(F.arrays_zip("key", "centre", "low", "high", "context")).alias("w")).select("doc_id", "w.*")
    multi = windows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key")
    multi = stage(multi, "multi").hint("merge")
    shared = windows.join(multi, "key", "left_semi").select("doc_id", "centre", "low", "high", F.explode("context").alias("context"))
    shared = stage(shared, "shared")
    # written, so that a hot key is combined before its shuffle and the join can split it
    pivots = shared.groupBy("context").agg(F.min(F.struct("doc_id", "low", "high")).alias("p"), F.max("doc_id").alias("last"))
    pivots = stage(pivots.where("p.doc_id < last").select("context", "p"), "pivots").hint("merge")
    common = F.least(F.col("low"), F.col("p.low")) + F.least(F.col("high"), F.col("p.high")) + 1
    met = shared.join(pivots, "context").where((F.col("doc_id") != F.col("p.doc_id")) & (common >= RUN))
    met = stage(met.select("doc_id", F.col("p.doc_id").alias("first")).distinct(), "met")
    ids = stage(met.select("doc_id").union(met.select("first")).distinct(), "ids")
    release(since, met, ids, slim, shared, pivots)
    found = stage(_compared(own, slim, met, ids), "passages")

    parts = [found]
    cold, hot = _others(own, slim, shared, pivots, found)
    release(since, met, slim, cold, hot, *parts)
    # of the hot contexts first: in a large family most documents need no more than one other
    done = met
    for every in (False, True):
        some = _alike(_bare(hot.where("bare").drop("bare"), parts), hot, every).select("doc_id", "first")
        if every:
            some = some.union(_bare(cold, parts).select("doc_id", "first"))
        pairs = stage(some.distinct().join(done, ["doc_id", "first"], "left_anti"), "pairs")
        done = done.union(pairs)
        ids = stage(pairs.select("doc_id").union(pairs.select("first")).distinct(), "ids")
        parts.append(stage(_compared(own, slim, pairs, ids), "passages"))
    release(since, slim, *parts)
    return slim, reduce(DataFrame.union, parts)


def _bare(rows: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """``rows`` (doc_id, centre) that no passage of ``parts`` covers."""
    spans = reduce(DataFrame.union, parts).groupBy("doc_id").agg(F.collect_set(F.struct("at", "upto")).alias("spans"))
    covered = F.exists("spans", lambda s: (s["at"] <= F.col("centre")) & (F.col("centre") < s["upto"]))
    return rows.join(spans, "doc_id", "left").where(~F.coalesce(covered, F.lit(False))).drop("spans")


def _others(docs: DataFrame, members: DataFrame, shared: DataFrame, pivots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What has the surroundings of a centre that no passage of ``found`` covers.

    For contexts of up to ``HOT`` rows ``doc_id, centre, first``, every earlier
    document; for the others the holders themselves: ``context, doc_id, centre,
    bare, at, around``, the shingles around the centre and its place there.
    """
    # written, so that a join can split a hot key
    bare = stage(_bare(shared.join(pivots.select("context"), "context", "left_semi"), [found]), "bare")
    many = shared.groupBy("context").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
    many = stage(many.join(bare.select("context"), "context", "left_semi").select("context"), "many")
    many = small(many, many.count(), 32)
    every = shared.select("context", F.col("doc_id").alias("first"), F.col("low").alias("first_low"), F.col("high").alias("first_high"))
    common = F.least("low", "first_low") + F.least("high", "first_high") + 1
    few = bare.join(many, "context", "left_anti")
    pairs = few.join(every.hint("merge"), "context").where((F.col("first") < F.col("doc_id")) & (common >= RUN))
    cold = stage(pairs.select("doc_id", "centre", "first").distinct(), "cold")

    holders = shared.join(many, "context").select("context", "doc_id", "centre").distinct()
    open_ = bare.join(many, "context", "left_semi").select("doc_id", "centre", F.lit(True).alias("bare")).distinct()
    holders = holders.join(open_, ["doc_id", "centre"], "left").withColumn("bare", F.coalesce("bare", F.lit(False)))
    places = stage(holders.groupBy("doc_id").agg(F.collect_list(F.struct("context", "centre", "bare")).alias("places")), "places")
    texts = _texts(docs, members, places.select("doc_id"))
    hot = places.join(texts, "doc_id").select("doc_id", "text", "places")
    return cold, stage(hot.mapInArrow(_around, "context long, doc_id long, centre int, bare boolean, at int, around binary"), "hot")


def _around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles around each place of a text, as 32 bits of their hashes, and the centre's place among them."""
    side = AROUND + SLACK
    names = ["context", "doc_id", "centre", "bare", "at", "around"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
    for batch in batches:
        for doc_id, text, places in zip(*batch.columns, strict=True):
            doc_id, h = doc_id.as_py(), sequence(text.as_py())[1].astype(np.uint32)
            out = []
            # bare centres so near that their contexts overlap lie in one run, which a passage has or has not;
            # of the others those stand for the holder that the slack doesn't reach
            last: dict[int, int] = {}
            kept: dict[int, int] = {}
            for c, context, bare in sorted((x["centre"], x["context"], x["bare"]) for x in places.as_py()):
                # of an id with several texts only one is compared
                if c >= len(h):
                    continue
                new = bare and c - last.get(context, -side) > CONTEXT
                if bare:
                    last[context] = c
                if new or c - kept.get(context, -side) > SLACK:
                    out.append((context, doc_id, c, new, min(c, side), h[max(0, c - side) : c + side + 1].tobytes()))
                    kept[context] = c
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def _reach(hit: np.ndarray) -> np.ndarray:
    """Of every row the last hit that is reached from the first column over gaps that ``matches`` joins."""
    at = np.arange(hit.shape[1])
    last = np.maximum.accumulate(np.where(hit, at, 0), axis=1)
    broken = hit[:, 1:] & (at[1:] - last[:, :-1] > 2 * SHINGLE + 1)
    # an end, so that every row has a stop
    stop = np.concatenate([broken, np.ones((len(hit), 1), bool)], axis=1).argmax(axis=1)
    return last[np.arange(len(hit)), stop]


def _can_pad(own: np.ndarray, a: int, b: int, shared: int, least: int) -> bool:
    """If a stretch shorter than ``least`` with so many different shared shingles can be similar enough with changed ones at its edges."""
    starts = range(max(0, b - least), min(a, len(own) - least) + 1)
    return any(shared >= SIMILARITY * len(np.unique(own[p : p + least])) for p in starts)


class Holders:
    """Documents that have the same context, in the order of their ids, with the shingles around it."""

    def __init__(self, ids: list[int], around: list[np.ndarray]):
        self.ids, self.around = np.asarray(ids, np.int64), around
        values = np.concatenate(around)
        order = np.argsort(values, kind="stable")
        self.values, self.rows = values[order], np.repeat(np.arange(len(ids)), [len(x) for x in around])[order]

    def _rows(self, left: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.rows[np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def alike(self, doc_id: int, at: int, around: np.ndarray, every: bool, named: set[int]) -> list[int]:
        """Earlier documents with a passage like one of ``around`` that holds the place ``at``: the first, or every one.

        Those that may have a passage that goes beyond ``around`` are told too: two if there is no such document before, or every one,
        and those ``named`` before are not looked at again.
        Passages have 33 shared shingles at least (41, if no shingle repeats), so one of
        those that remain without the 32 that most of the holders have.
        """
        least = LEAST_WORDS - SHINGLE + 1
        weak = int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * SIMILARITY * least))
        before = int(np.searchsorted(self.ids, doc_id))
        low = max(0, at - AROUND)
        own, c = around[low : at + AROUND + 1], at - low
        if not before or len(own) < weak:
            return []
        u, back = np.unique(own, return_inverse=True)
        left = np.searchsorted(self.values, u)
        n = np.searchsorted(self.values, u, side="right") - left
        rare = np.unique(back[np.argsort(n[back], kind="stable")[: len(own) - weak + 1]])
        some = np.unique(self._rows(left[rare], n[rare]))
        some = some[some < before]
        if not len(some):
            return []
        place = np.full(len(self.ids), -1)
        place[some] = np.arange(len(some))
        row, column = place[self._rows(left, n)], np.repeat(np.arange(len(u)), n)
        has = np.zeros((len(some), len(u)), bool)
        has[row[row >= 0], column[row >= 0]] = True
        need = weak if len(u) < len(own) else int(np.ceil(2 * SIMILARITY / (1 + SIMILARITY) * least))
        far, sure, padded = [], [], {}
        for start in range(0, len(some), 256):
            hit = has[start : start + 256][:, back]
            first, last = c - _reach(hit[:, c::-1]), c + _reach(hit[:, c:])
            total = np.concatenate([np.zeros((len(hit), 1), int), np.cumsum(hit, axis=1)], axis=1)
            row = np.arange(len(hit))
            hits = total[row, last + 1] - total[row, first]
            beyond = ((first <= 2 * SHINGLE) & (at > AROUND)) | ((last >= len(own) - 1 - 2 * SHINGLE) & (len(around) > at + AROUND + 1))
            for i in np.flatnonzero(hit[:, c] & (beyond | (hits >= need)) & (last - first >= SIMILARITY * least - 1)).tolist():
                other = some[start + i]
                if not every and len(far) > 1:
                    return far
                if (first_id := int(self.ids[other])) in named:
                    far.append(first_id)
                    continue
                if not beyond[i] and last[i] - first[i] + 1 < least:
                    p, q = int(first[i]), int(last[i]) + 1
                    if (shape := (p, hit[i, p:q].tobytes())) not in padded:
                        padded[shape] = _can_pad(own, p, q, len(np.unique(back[p:q][hit[i, p:q]])), least)
                    if not padded[shape]:
                        continue
                if any(a <= c < b for a, b, _, _ in matches(own, self.around[other], least, SIMILARITY)):
                    sure.append(first_id)
                    if not every:
                        return sure
                elif beyond[i]:
                    far.append(first_id)
                    named.add(first_id)
        return sure + far


def _alike(bare: DataFrame, hot: DataFrame, every: bool) -> DataFrame:
    """``doc_id, centre, first``: what the ``bare`` rows of ``hot`` are alike to, in cells of a context's holders."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, around, held, whose, named = None, [], [], None, None, set()
        for batch in batches:
            out = []
            for context, tile, own, doc_id, centre, at, near in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cell != (context, tile):
                    cell, ids, around, held, whose = (context, tile), [], [], None, None
                near = np.frombuffer(near, np.uint32)
                if not own:
                    ids.append(doc_id)
                    around.append(near)
                elif ids:
                    held = held or Holders(ids, around)
                    if whose != doc_id:
                        whose, named = doc_id, set()
                    out += [(doc_id, centre, x) for x in held.alike(doc_id, at, near, every, named)]
            if out:
                d, c, f = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(c, pa.int32()), pa.array(f, pa.int64())], names=["doc_id", "centre", "first"])

    hot = hot.join(bare.select("context").distinct(), "context", "left_semi")
    large = hot.groupBy("context").agg(F.ceil(F.count(F.lit(1)) / HOLDERS).cast("int").alias("tiles")).where("tiles > 1")
    large = stage(large, "large")
    large = small(large, large.count(), 32)
    hot, bare = (x.join(large, "context", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1))) for x in (hot, bare))
    holders = hot.select("context", F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int").alias("tile"), F.lit(False).alias("own"), "doc_id", "centre", "at", "around")
    tiles = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    rows = holders.union(bare.select("context", tiles, F.lit(True).alias("own"), "doc_id", "centre", "at", "around"))
    n_parts = max(int(hot.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // (64 * HOLDERS)))
    rows = rows.repartition(n_parts, "context", "tile").sortWithinPartitions("context", "tile", "own", "doc_id")
    return rows.mapInArrow(make, "doc_id long, centre int, first long")


def _texts(docs: DataFrame, members: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of ``ids``; of an id with several texts the one with the largest hash."""
    texts = docs.join(small(ids, ids.count(), 16), "doc_id", "left_semi")
    if members.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        texts = texts.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"))
    return texts


def _compared(docs: DataFrame, members: DataFrame, met: DataFrame, ids: DataFrame) -> DataFrame:
    """Passages of the pairs ``met`` (doc_id, first); a first document is read once for every ``CELL_SHINGLES`` of the others."""
    texts = _texts(docs, members, ids)
    sizes = members.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_words").alias("n"))
    pairs = met.join(sizes, "doc_id")
    tiles = pairs.groupBy("first").agg(F.greatest(F.ceil(F.sum("n") / CELL_SHINGLES), F.lit(1)).cast("int").alias("tiles"))
    tiles = stage(tiles, "tiles")
    tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    others = pairs.join(tiles, "first").select("first", tile.alias("tile"), F.lit(True).alias("own"), "doc_id")
    firsts = tiles.select("first", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.lit(False).alias("own"), F.col("first").alias("doc_id"))
    placed = others.union(firsts).join(texts, "doc_id").select("first", "tile", "own", "doc_id", "text")
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_parts = max(n_parts, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // (64 * CELL_SHINGLES)))
    placed = placed.repartition(n_parts, "first", "tile").sortWithinPartitions("first", "tile", "own")
    return placed.mapInArrow(_verified, "doc_id long, at long, upto long, first_id long, first_at long, first_upto long")


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class, its repeated words, and ``from:to:first document`` of each passage."""
    members, found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    per = found.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("at", "upto", "first_id"))).alias("spans"), F.sort_array(F.collect_set("first_id")).alias("first_ids")
    )
    # written, so that the join reads two shuffles and can split a text of many copies
    per = stage(per.withColumnRenamed("doc_id", "rep_id"), "spans").hint("merge")
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["at"], s["upto"], s["first_id"])), ",")
    copy = (F.col("rep_id") != F.col("doc_id")) & (F.col("n_words") >= LEAST_WORDS)
    return members.join(per, "rep_id", "left").select(
        "doc_id",
        "rep_id",
        "n_words",
        F.when(copy, F.concat_ws(":", F.lit(0), "n_words", "rep_id")).otherwise(F.coalesce(shown, F.lit(""))).alias("spans"),
        F.when(copy, F.array("rep_id")).otherwise(F.coalesce("first_ids", F.array().cast("array<bigint>"))).alias("first_ids"),
    )
