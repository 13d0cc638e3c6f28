"""Best-fit packing of tokenised documents, planned over a histogram of lengths."""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.llm._common import stage

#: Entries of a worker's cache of encoded words, and the longest word that it keeps.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Pieces of a length that are ranked in one task.
CELL_ROWS = 50_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    A blank between two characters that aren't white space always starts a new
    pre-token, so texts are cut there and the ids of the parts are kept. The
    ranks file holds the same vocabulary as the tokenizer's JSON file and gives
    the same ids. Strings of added tokens are ordinary text here, see ``with_added``.
    """

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines)}
        encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        class Kept(dict):
            def __missing__(self, word: str) -> bytes:
                ids = np.asarray(encode(" " + word), dtype="<u4").tobytes()
                if len(word) <= CACHE_CHARS:
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.first = lambda text: np.asarray(encode(text), dtype="<u4").tobytes()
        self.kept = Kept()
        self.odd = re.compile(r"\s |\s\Z| \s|\A\s")
        self.between = re.compile(r"(?<=\S) (?=\S)")

    def __call__(self, text: str) -> bytes:
        parts = self.between.split(text) if self.odd.search(text) else text.split(" ")
        return self.first(parts[0]) + b"".join(map(self.kept.__getitem__, parts[1:]))


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Ids of the added tokens of the tokenizer's JSON file."""
    import json

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}


def with_added(ids_of: Encoder, added: dict[str, int]):
    """An encoder that gives added tokens their ids; the texts between them are encoded by themselves."""
    if not added:
        return ids_of
    marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    ids = {x: np.asarray([n], dtype="<u4").tobytes() for x, n in added.items()}

    def encode(text: str) -> bytes:
        if not marks.search(text):
            return ids_of(text)
        return b"".join(ids[x] if i % 2 else ids_of(x) for i, x in enumerate(marks.split(text)))

    return encode


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(ranks_path: str | None, pattern: str | None) -> Encoder:
    """The worker's encoder of these files, made once."""
    if ranks_path is None or pattern is None:
        import public_tokenizers

        ranks_path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
        pattern = pattern or public_tokenizers.PATTERN
    if (ranks_path, pattern) not in _encoders:
        _encoders[ranks_path, pattern] = Encoder(ranks_path, pattern)
    return _encoders[ranks_path, pattern]


def cut(n: int, cap: int) -> Iterator[tuple[int, int]]:
    """(start, length) of a document's pieces: all have ``cap`` tokens, but for a shorter first one."""
    start = n % cap or min(n, cap)
    yield 0, start
    while start < n:
        yield start, cap
        start += cap


def pieces(docs: DataFrame, *, cap: int, end_id: int, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tokenise whole texts (with the added tokens of the vocabulary that is the default), end each with ``end_id`` and cut those over ``cap`` tokens."""
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = with_added(encoder(ranks_path, pattern), added_tokens() if ranks_path is None else {})
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = ids_of(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, cap)):
                    for column, x in zip(out, (doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(x)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(encode, PIECES)


def plan(counts: dict[int, int], cap: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over how many pieces there are of each length.

    Sequences with the same room are kept as runs, and a run is filled at once,
    so the plan's size depends on ``cap`` only. Returns (length, from rank, to
    rank, first sequence, pieces in each sequence, offset of the first): a
    length's pieces of these ranks go to consecutive sequences.
    """
    slots, n_sequences = [], 0
    rooms: list[int] = []  # sorted rooms for which there are runs
    runs: dict[int, list[tuple[int, int]]] = {}

    def put(room: int, first: int, n: int) -> None:
        if room:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, n))

    for length in sorted((k for k, n in counts.items() if n), reverse=True):
        rank, n = 0, counts[length]
        while rank < n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, free = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first, free = cap, n_sequences, -(-(n - rank) // (cap // length))
                n_sequences += free
            each = room // length
            full = min(free, (n - rank) // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, cap - room))
                put(room - each * length, first, full)
                rank += full * each
            if full < free:
                some = min(n - rank, each)
                if some:
                    slots.append((length, rank, rank + some, first + full, some, cap - room))
                    put(room - some * length, first + full, 1)
                    rank += some
                    full += 1
                if full < free:
                    put(room, first + full, free - full)
    return slots


def pack(docs: DataFrame, *, cap: int = 1024, end_id: int = 2, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most ``cap`` tokens.

    Returns a row for every piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset``. The histogram of lengths (at most ``cap`` rows) is
    planned on the driver; a piece then takes the slot of its rank among the
    pieces of its length. Ranks are counted by cells of about ``CELL_ROWS`` rows,
    so a length that most pieces have is ranked by many tasks.

    Null or empty texts are one piece with the end id; null ids are kept;
    repeated rows are packed as often as they come. No rows give no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    rows = stage(pieces(docs, cap=cap, end_id=end_id, ranks_path=ranks_path, pattern=pattern), "pieces")
    n_cells = max(16, -(-rows.count() // CELL_ROWS))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_cells)))
    cells = rows.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, cap), "slot_length long, from_rank long, to_rank long, first_sequence long, each long, first_offset long"
    )
    before = Window.partitionBy("length").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("cells_before"))
    inside = Window.partitionBy("length", "cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        rows.withColumn("nth", F.row_number().over(inside) - 1)
        .join(cells, ["length", "cell"])
        .withColumn("rank", F.col("cells_before") + F.col("nth"))
    )
    inside_slot = F.col("rank") - F.col("from_rank")
    return ranked.join(
        F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank"))
    ).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("first_sequence") + F.floor(inside_slot / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (inside_slot % F.col("each")) * F.col("length")).cast("long").alias("offset"),
    )


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
