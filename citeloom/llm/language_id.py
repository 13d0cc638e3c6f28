"""Language identification with string kernels and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Lengths of the blended spectrum's character n-grams, and the hash space of their presence.
GRAMS, SPACE_BITS = (1, 2, 3), 15
#: Bounds of the fit: labelled rows of each language, and of all (every language has some), landmarks, and the ridge.
ROWS_PER_LANGUAGE, ROWS, LANDMARKS, RIDGE = 400, 24_000, 256, 1e-2
#: Code points that are hashed at once, and rows of a presence matrix.
CHUNK, BLOCK = 1 << 20, 128
#: Code points of a part of a long text: the presence of a longer one would fill the hash space.
PART = 1 << 16

UNDETERMINED = "und"
_SEEDS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


def mark(presence: np.ndarray, text: str) -> None:
    """Set the presence of every n-gram of the whole text, lower-cased, in one row."""
    low = text.lower()
    longest = max(GRAMS)
    for at in range(0, max(1, len(low)), CHUNK):
        codes = np.frombuffer(low[at : at + CHUNK + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        for n in GRAMS:
            if len(codes) >= n:
                h = np.full(len(codes) - n + 1, n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
                for i in range(n):
                    h += codes[i : len(codes) - n + 1 + i] * np.uint32(_SEEDS[i])
                    h ^= h >> np.uint32(15)
                    h *= np.uint32(0x2C1B3C6D)
                presence[h >> np.uint32(32 - SPACE_BITS)] = 1


def parts(text: str) -> list[str]:
    """The whole text in parts of about equal length, at most ``PART`` code points; overlapping, so that no n-gram is lost."""
    n = max(1, -(-len(text) // PART))
    edges = [len(text) * i // n for i in range(n + 1)]
    return [text[a : b + max(GRAMS) - 1] for a, b in zip(edges, edges[1:], strict=False)]


@dataclass
class Model:
    """One-versus-rest ridge regressors on Nyström features.

    A score is K(x, landmarks) · A with the kernel normalised by the numbers of
    present n-grams; ``weights`` is landmarks' presence times A, so a batch is
    scored by one product of its presence matrix. A long text's scores are the
    mean of its parts'. ``letters``: those of the learned rows, lower-cased.
    """

    languages: list[str]
    weights: np.ndarray
    letters: frozenset[str] = frozenset()

    def knows(self, text: str) -> bool:
        """Some letter of the text is one of a learned language."""
        return any(x in self.letters for x in set(text.lower()))

    def scores(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        every = [(i, part) for i, text in enumerate(texts) for part in parts(text)]
        for at in range(0, len(every), BLOCK):
            some = every[at : at + BLOCK]
            presence = np.zeros((len(some), 1 << SPACE_BITS), np.float32)
            for row, (_, part) in zip(presence, some, strict=True):
                mark(row, part)
            np.add.at(out, [i for i, _ in some], presence @ self.weights / np.sqrt(np.maximum(presence.sum(1, keepdims=True), 1)))
        return out / np.bincount([i for i, _ in every], minlength=len(texts))[:, None]


def learn(languages: list[str], presence: np.ndarray) -> Model:
    """Fit to rows of presence (bytes of packed bits) with their languages."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << SPACE_BITS, 0), np.float32))
    rows = lambda a, b: np.unpackbits(presence[a:b], axis=1).astype(np.float32)
    norm = lambda x: x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    marks = np.unique(np.linspace(0, len(languages) - 1, min(LANDMARKS, len(languages))).astype(int))
    landmarks = norm(np.concatenate([rows(i, i + 1) for i in marks]))
    kernel = np.concatenate([norm(rows(i, i + BLOCK)) @ landmarks.T for i in range(0, len(languages), BLOCK)]).astype(np.float64)
    values, vectors = np.linalg.eigh(landmarks.astype(np.float64) @ landmarks.T.astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ root
    wanted = np.where(np.asarray(languages)[:, None] == np.asarray(names)[None, :], 1.0, -1.0)
    share = np.asarray([languages.count(x) for x in names])
    balance = np.asarray([1 / share[names.index(x)] for x in languages])[:, None]
    left = features.T @ (balance * features) + RIDGE * len(names) / len(languages) * np.eye(features.shape[1])
    coefficients = root @ np.linalg.solve(left, features.T @ (balance * wanted))
    return Model(names, (landmarks.T @ coefficients).astype(np.float32))


def train(docs: DataFrame, learnable: Column, *, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Fit to at most ``per_language`` learnable rows of each language.

    The rows are those with the least hash of their text, among whole texts; a
    count by language narrows them down first, so that few texts are moved. A
    long row is learned by one of its parts, taken by the hash.
    Every language that a learnable row has is learned. Where there are so many
    that ``per_language`` rows of each would be more than ``ROWS``, each has fewer,
    but 4 at least: the driver holds packed presence (2^SPACE_BITS bits a row).
    """
    spark = docs.sparkSession
    named = docs.where(learnable & F.col("lang").isNotNull() & F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    counts = docs.where(learnable & F.col("lang").isNotNull()).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    per_language = max(min(per_language, 4), min(per_language, ROWS // max(len(counts), 1)))
    shares = [(r["lang"], min(1.0, 3.0 * per_language / r["n"] + 20.0 / r["n"])) for r in counts]
    if not shares:
        return learn([], np.zeros((0, (1 << SPACE_BITS) // 8), np.uint8))
    shares = F.broadcast(spark.createDataFrame(shares, "share_lang string, share double"))
    order = F.xxhash64(F.lit(11), "text")
    picked = (
        named.select("lang", "text", order.alias("order"))
        .join(shares, F.col("lang") == F.col("share_lang"))
        .where(F.pmod("order", F.lit(1 << 30)) < F.col("share") * (1 << 30))
        .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("order")))
        .where(F.col("nth") <= per_language)
        .select("lang", "text", "order")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, letters = [], []
            for text, order in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                row = np.zeros(1 << SPACE_BITS, np.uint8)
                some = parts(text.as_py())
                mark(row, some[order % len(some)])
                bits.append(np.packbits(row).tobytes())
                letters.append("".join(sorted(filter(str.isalpha, set(text.as_py().lower())))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2), pa.array(letters, pa.string())], names=["lang", "bits", "order", "letters"])

    found = picked.mapInArrow(pack, "lang string, bits binary, order long, letters string").collect()
    rows = sorted((r["order"], r["lang"], bytes(r["bits"])) for r in found)
    presence = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
    model = learn([r[1] for r in rows], presence)
    model.letters = frozenset("".join(r["letters"] for r in found))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and ``lid_lang``, ``lid_score`` (replaced if there).

    Null texts, texts without a letter and texts none of whose letters a learned
    row has are ``und`` with score 0, as is every text if nothing was learned. The score is the share of the best language in
    a softmax of the regressors. Ties go to the first language by name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lid_lang", "lid_score")
    schema = T.StructType([*docs.schema.fields, T.StructField("lid_lang", T.StringType()), T.StructField("lid_score", T.DoubleType())])
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            sure = [i for i, x in enumerate(texts) if x and model.languages and model.knows(x)]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if sure:
                raw = model.scores([texts[i] for i in sure]) * 3.0
                share = np.exp(raw - raw.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                for i, best, row in zip(sure, raw.argmax(1), share, strict=True):
                    names[i], scores[i] = model.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lid_lang", "lid_score"])

    return docs.mapInArrow(predict, schema)


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, fold(docs["doc_id"], 4) != 2)
    found = classify(docs.select("doc_id", (fold(docs["doc_id"], 4) == 2).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))
