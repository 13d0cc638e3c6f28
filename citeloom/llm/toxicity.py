"""Toxicity by class-conditional Kneser-Ney language models."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm._common import small, stage
from citeloom.llm.language_id import fold

#: Discount of words and of pairs in a class: what is no more frequent is wholly left to the shared backoff.
DISCOUNT = 2
#: Discount of the continuation counts.
CONTINUATION = 0.75
#: Words of the windows whose normalised ratios are compared.
WINDOWS = (1, 2, 4, 16)
#: Log ratio from which a word counts as telling.
TELLING = 2.0
#: Labelled rows that the calibration takes at most, and words counted before a task emits.
CALIBRATION_ROWS, CHUNK = 20_000, 1 << 21

_CACHE_WORDS = 200_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


class _Keys(dict):
    """64-bit key of a word: lower case without ASCII punctuation at its ends; 0 is the start of a text."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= _CACHE_WORDS:
            self.clear()
        bare = word.lower().strip(_EDGES) or word
        key = xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass"))
        self[word] = key = key - (key >> 63 << 64)
        return key


_keys = _Keys()


def pairs(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Each word's predecessor and the word, as keys."""
    words = (text or "").split()
    w = np.fromiter(map(_keys.__getitem__, words), np.int64, len(words))
    return np.concatenate([np.zeros(min(1, len(w)), np.int64), w[:-1]]), w


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit key of a pair of words."""
    h = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h = (h + w.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return (h * np.uint64(0x94D049BB133111EB)).view(np.int64)


def places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted in the sorted keys; those that aren't there get the place after the last."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, len(keys))


def pair_counts(rows: DataFrame) -> DataFrame:
    """``v, w, ordinary, toxic``: in how many rows (text, toxic) of each class w follows v; a text that repeats itself counts once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            v, w, toxic = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.lexsort((toxic, w, v))
            v, w, toxic = v[order], w[order], toxic[order]
            first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (toxic[1:] != toxic[:-1])]))
            n, toxic = np.diff(np.append(first, len(v))), toxic[first]
            columns = (v[first], w[first], np.where(toxic, 0, n), np.where(toxic, n, 0))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["v", "w", "ordinary", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                v, w = pairs(text.as_py())
                once = np.unique(pair_key(v, w), return_index=True)[1]
                v, w = v[once], w[once]
                kept.append((v, w, np.full(len(w), bool(toxic))))
                size += len(w)
                if size >= CHUNK:
                    yield out()
                    kept, size = [], 0
        if size:
            yield out()

    counted = rows.mapInArrow(count, "v long, w long, ordinary long, toxic long")
    return counted.groupBy("v", "w").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


@dataclass
class Model:
    """Log ratio of toxic to ordinary: that of the word and, where there is one, the gain of the pair (v, w).

    Keys are sorted, as many as there are words and kept pairs; the last entry of
    ``word`` and of ``pair`` is for keys that aren't there.

    Both classes give the same weight to what they share, so an expression that is
    rare in both has a ratio of one whatever the sizes of the classes.
    """

    word_keys: np.ndarray
    word: np.ndarray
    pair_keys: np.ndarray
    pair: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coefficients: np.ndarray | None = None

    def features(self, text: str | None) -> np.ndarray:
        """Length-normalised log ratios: of the whole text, of its telling words, and the highest of each window size."""
        v, w = pairs(text)
        out = np.zeros(len(WINDOWS) + 4)
        if len(w):
            ratios = self.word[places(self.word_keys, w)] + self.pair[places(self.pair_keys, pair_key(v, w))]
            sums = np.concatenate([[0.0], np.cumsum(ratios, dtype=np.float64)])
            telling = (ratios >= TELLING).sum()
            out[:4] = sums[-1] / len(w), np.log1p(len(w)), np.sqrt(telling / len(w)), np.log1p(telling)
            for i, n in enumerate(WINDOWS, 4):
                n = min(n, len(w))
                out[i] = (sums[n:] - sums[:-n]).max() / n
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(texts))
        x = (np.stack([self.features(t) for t in texts]) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[1:] + self.coefficients[0], -30, 30)))


def evened(seen: list[np.ndarray], left: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Shares of two classes, each scaled so that both leave the larger ``left`` of their masses to the backoff."""
    rest = np.maximum(*left)
    return [x * (1 - rest) / np.maximum(1 - y, 1e-12) for x, y in zip(seen, left, strict=True)], rest


def words_models(counts: list[np.ndarray], follows: np.ndarray, totals: dict) -> list[np.ndarray]:
    """Both classes' probabilities of words: discounted shares and, for the rest, the continuation counts of both classes.

    ``totals``: sums over all words, also those that aren't given: of the counts
    (c0, c1), of what is discounted (d0, d1), of predecessors (follows), and types.
    """
    n, off = [max(totals[c], 1) for c in ("c0", "c1")], [totals[d] for d in ("d0", "d1")]
    seen, rest = evened([np.maximum(c - DISCOUNT, 0) / t for c, t in zip(counts, n, strict=True)], [np.asarray(o / t) for o, t in zip(off, n, strict=True)])
    # the last share is that of a word that was never seen
    unseen = CONTINUATION * totals["types"] / (totals["types"] + 1)
    shared = (np.maximum(follows - CONTINUATION, 0) + unseen) / max(totals["follows"], 1)
    return [x + rest * shared for x in seen]


def learn_models(rows: DataFrame) -> Model | None:
    """Kneser-Ney models of both classes from rows (text, toxic); None if a class has no words.

    Pairs of words are discounted and interpolated with the class's words, these
    with the continuation counts of both classes. A word or pair seen no more
    than ``DISCOUNT`` times in either class is wholly left to the backoff, where
    it has a ratio of one (a pair: that of its word), so only the others are
    kept. The counts cover all rows and stand under full keys in written tables;
    what is collected and broadcast grows with the frequent words and pairs of
    labelled rows.
    """
    counted = stage(pair_counts(rows), "pairs")
    sums = [F.sum("ordinary").alias("c0"), F.sum("toxic").alias("c1")]
    words = stage(counted.groupBy("w").agg(*sums, F.count(F.lit(1)).alias("follows")), "words")
    off = lambda c: F.least(F.col(c), F.lit(DISCOUNT))
    totals = words.agg(F.sum("c0"), F.sum("c1"), F.sum(off("c0")), F.sum(off("c1")), F.sum("follows"), F.count(F.lit(1))).first()
    totals = dict(zip(("c0", "c1", "d0", "d1", "follows", "types"), [x or 0 for x in totals], strict=True))
    if not totals["c0"] or not totals["c1"]:
        return None
    words = words.where(F.greatest("c0", "c1") > DISCOUNT).toArrow().to_pandas().sort_values("w")
    keys = words["w"].to_numpy()
    # the last entry is for words that aren't kept: both classes give them the same
    counts, follows = [np.append(words[x].to_numpy(), 0).astype(float) for x in ("c0", "c1")], np.append(words["follows"].to_numpy(), 1).astype(float)
    p = words_models(counts, follows, totals)
    frequent = counted.where(F.greatest("ordinary", "toxic") > DISCOUNT)
    heads = counted.groupBy("v").agg(*sums, F.sum(off("ordinary")).alias("d0"), F.sum(off("toxic")).alias("d1")).join(frequent.select("v").distinct(), "v", "left_semi").toArrow().to_pandas().sort_values("v")
    head_keys = heads["v"].to_numpy()
    t = [np.append(heads[c].to_numpy(), 0).astype(float) for c in ("c0", "c1")]
    left = [np.where(n > 0, np.append(heads[d].to_numpy(), 0) / np.maximum(n, 1), 1.0) for d, n in zip(("d0", "d1"), t, strict=True)]
    weights, rest = evened([1 / np.maximum(n, 1) for n in t], left)
    held = rows.sparkSession.sparkContext.broadcast([keys, head_keys, *p, *weights, rest])

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, head_keys, p0, p1, w0, w1, rest = held.value
        for batch in batches:
            v, w, n0, n1 = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            head, at = places(head_keys, v), places(keys, w)
            logs = [np.log1p(np.maximum(n - DISCOUNT, 0) * x[head] / np.maximum(rest[head] * q[at], 1e-300)) for n, x, q in ((n0, w0, p0), (n1, w1, p1))]
            yield pa.RecordBatch.from_arrays([pa.array(pair_key(v, w), pa.int64()), pa.array((logs[1] - logs[0]).astype(np.float32))], names=["pair", "gain"])

    kept = frequent.select("v", "w", "ordinary", "toxic").mapInArrow(gains, "pair long, gain float").toArrow().to_pandas().sort_values("pair")
    return Model(keys, (np.log(p[1]) - np.log(p[0])).astype(np.float32), kept["pair"].to_numpy(), np.append(kept["gain"].to_numpy(), np.float32(0)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    keep = ridge * len(x) / 100 * np.eye(x.shape[1]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + keep, x.T @ (y - p) - keep @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, learnable: Column, *, calibration_rows: int = CALIBRATION_ROWS) -> Model:
    """Learn from labelled learnable rows: three quarters by hash for the models, the rest to calibrate.

    An id with several labels is toxic if one of them is; null labels and null
    ids are left out. If the rows to calibrate from lack a class, all learnable
    rows are taken. Without words of both classes all scores are 0. Repeated rows
    count as often as they come; no rows give such a model.
    """
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    known = known.select(F.col("doc_id").alias("label_id"), (F.col("toxic") > 0).cast("long").alias("toxic"))
    known = small(known, labels.count(), 32)
    rows = docs.where(learnable).join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic")
    part = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20))
    fitted, calibrated = part % 4 != 0, part % 4 == 0
    if rows.where(calibrated).agg(F.countDistinct("toxic")).first()[0] < 2:
        fitted = calibrated = F.lit(True)
    model = learn_models(rows.where(fitted).select("text", "toxic"))
    if model is None:
        return Model(*[np.zeros(0, np.int64), np.zeros(1)] * 2)
    n = rows.select("doc_id").where(calibrated).count()
    share = min(1.0, calibration_rows / max(n, 1))
    held = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [held.value.features(t.as_py()).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    some = rows.where(calibrated & (part < share * (1 << 20))).select("text", "toxic")
    found = sorted((tuple(r["x"]), r["y"]) for r in some.mapInArrow(measure, "x array<double>, y long").collect())
    y = np.asarray([r[1] for r in found], float)
    if len(set(y)) < 2:
        return model
    x = np.asarray([r[0] for r in found])
    model.mean, model.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    model.coefficients = logistic((x - model.mean) / model.scale, y)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` for every row; null text counts as empty."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = held.value.scores([t.as_py() for t in batch.column(1)]) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold(docs["doc_id"], 3) != 1)
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
