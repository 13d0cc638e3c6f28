"""Best aligned sentence of a corpus for every item of a list, by word Jaccard."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.sources.articles import sentences

#: Words of the items that are held at once, and scores of sentences and items that are counted at once.
ITEM_WORDS, SCORES = 1 << 16, 1 << 19

_WORD = re.compile("[a-z0-9]+")


class Best:
    """The best sentence of each item so far, ties to the smallest document and place."""

    def __init__(self, items: list[list[str]]):
        self.sizes = np.asarray([len(w) for w in items], np.int64)
        holders: dict[str, list[int]] = {}
        for i, own in enumerate(items):
            for w in own:
                holders.setdefault(w, []).append(i)
        self.known = {w: n for n, w in enumerate(holders)}
        self.ends = np.cumsum([0, *map(len, holders.values())])
        self.holders = np.asarray([i for x in holders.values() for i in x], np.int64)
        self.score, self.doc, self.at = np.zeros(len(items)), np.zeros(len(items), np.int64), np.zeros(len(items), np.int64)
        self.rows: list[tuple[int, int, int, int]] = []
        self.words: list[int] = []

    def add(self, doc_id: int, text: str) -> None:
        known = self.known
        for at, sentence in enumerate(sentences(text)):
            own = set(_WORD.findall(sentence.lower()))
            shared = [known[w] for w in own if w in known]
            if shared:
                self.rows.append((doc_id, at, len(own), len(shared)))
                self.words += shared
                if len(self.rows) * len(self.sizes) >= SCORES:
                    self.fold()

    def fold(self) -> None:
        if not self.rows:
            return
        doc, at, size, n = np.asarray(self.rows, np.int64).T
        words = np.asarray(self.words, np.int64)
        self.rows, self.words = [], []
        # the earliest first, so that it is the one found of equal scores
        rank = np.empty(len(doc), np.int64)
        order = np.lexsort((at, doc))
        rank[order] = np.arange(len(doc))
        doc, at = doc[order], at[order]
        start, count = self.ends[words], self.ends[words + 1] - self.ends[words]
        item = self.holders[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]
        row = np.repeat(np.repeat(rank, n), count)
        both = np.bincount(row * len(self.sizes) + item, minlength=len(doc) * len(self.sizes)).reshape(len(doc), -1)
        score = both / (self.sizes + size[order][:, None] - both)
        best = score.argmax(axis=0)
        score, doc, at = score[best, np.arange(len(self.sizes))], doc[best], at[best]
        earlier = (doc < self.doc) | ((doc == self.doc) & (at < self.at))
        better = (score > self.score) | ((score == self.score) & (score > 0) & earlier)
        for own, new in ((self.score, score), (self.doc, doc), (self.at, at)):
            own[better] = new[better]


def best_sentences(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, doc_id, sentence, score``: the sentence of all texts of ``docs`` (doc_id, text) with the largest word Jaccard.

    ``items``: item_id and its distinct words as ``words``. Ties go to the
    smallest doc_id, then to the earliest sentence. Items that share no word with
    any sentence, and rows without a doc_id, give no row; a null text has no
    sentence. Items with the same id are one, by the best of them.

    Every sentence is compared where it is read and each task tells its best for
    each item, so no pair of them is shuffled or kept. The words of the items are
    dealt to parts of about ``ITEM_WORDS``; the texts are read once for each.
    """
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select("item_id", "words").where(F.size("words") > 0)
    kind = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, score double, doc_id long, sentence int"
    n_parts = -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // ITEM_WORDS)

    def part(i: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n_parts)) == i).collect()
        ids, words = [r.item_id for r in own], [r.words for r in own]

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(words)
            for batch in batches:
                for doc_id, text in zip(*batch.columns, strict=True):
                    best.add(doc_id.as_py(), text.as_py() or "")
            best.fold()
            some = np.flatnonzero(best.score > 0)
            if len(some):
                columns = [pa.array([ids[x] for x in some]), best.score[some], best.doc[some], best.at[some].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["item_id", "score", "doc_id", "sentence"])

        return docs.mapInArrow(make, schema)

    parts = [part(i) for i in range(n_parts)]
    found = reduce(DataFrame.union, parts) if parts else docs.sparkSession.createDataFrame([], schema)
    best = found.groupBy("item_id").agg(F.max(F.struct("score", (-F.col("doc_id")).alias("d"), (-F.col("sentence")).alias("a"))).alias("x"))
    return best.select("item_id", (-F.col("x.d")).alias("doc_id"), (-F.col("x.a")).alias("sentence"), F.col("x.score").alias("score"))
