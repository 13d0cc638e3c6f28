"""Secret scan with multipart credential linking (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm._common import small, stage, text_of

# The contract's base patterns. A run of hexadecimal digits, and
# an access identifier, is matched whole, so its least length stands in the
# pattern; an assignment's can't, as a short value still uses up its text.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: Weak parts: opaque runs with both cases and a digit, and endpoints; both are matched whole.
OPAQUE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*[0-9])(?=[A-Za-z0-9+/_=-]*[A-Z])(?=[A-Za-z0-9+/_=-]*[a-z])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z0-9]{1,20}|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}"""

#: Names of a user, client or account: weak access identifiers.
IDENT = r"""(?<![A-Za-z0-9_])(?i:(?:user_?name|user|login|client_?id|account_?id|account|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""

#: Code points around an access identifier in which its other parts are looked for.
SCOPE = 200
#: The kinds by rank in a document's list of spans.
KINDS = ("assign", "access", "hex", "opaque", "endpoint", "ident")

_BLOCK = 256


_NONE = "array<struct<start:bigint,kind:int,end:bigint>>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where a lambda uses it for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _sums(xs: Column) -> Column:
    return F.aggregate(
        xs,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["all"], a["at"] + x).alias("all")),
        lambda a: a["all"],
    )


def _running(lengths: Column) -> Column:
    """Inclusive prefix sums of an array, by blocks: linear in its size but for a small square."""

    def over(blocks: Column) -> Column:
        before = F.concat(F.array(F.lit(0).cast("long")), _sums(F.transform(blocks, lambda b: F.element_at(b, -1))))
        return _let(before, lambda z: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.get(z, i)))))

    numbers = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK).cast("int"))
    return _let(F.transform(numbers, lambda b: _sums(F.slice(lengths, b * _BLOCK + 1, _BLOCK))), over)


def spans(text: Column, pattern: str, kind: str, value_chars: int = 0) -> Column:
    """Matches as an array of (start, rank of kind, end), in code points.

    The text is split at the matches; the lengths of what is between them and of
    the matches add up to the positions. ``value_chars``: least length of group 2.
    """
    parts = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern).alias("between")]
    if value_chars:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("values"))

    def positions(z: Column) -> Column:
        lengths = F.flatten(
            F.transform(z["matches"], lambda m, i: F.array(F.char_length(F.get(z["between"], i)).cast("long"), F.char_length(m).cast("long")))
        )
        return _let(_let(lengths, _running), lambda at: spots(z, at))

    def spots(z: Column, at: Column) -> Column:
        out = F.transform(
            z["matches"], lambda m, i: F.struct(F.get(at, i * 2).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), F.get(at, i * 2 + 1).alias("end"))
        )
        return F.filter(out, lambda s, i: F.char_length(F.get(z["values"], i)) >= value_chars) if value_chars else out

    return F.when(text.rlike(pattern), _let(F.struct(*parts), positions)).otherwise(F.array().cast(_NONE))


def joined(all_spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])
    return F.array_join(F.transform(F.array_sort(all_spans), one), ",")


def scan(docs: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """Secrets of every row: ``doc_id, assign, access, hex, linked``, arrays of spans.

    Base kinds are found in one pass over the whole text. Names of users, clients
    or accounts, opaque runs and endpoints are weak: they are linked, and
    reported, only where their complements are at most ``scope`` code points
    away: a secret (assigned or opaque) for a name, an access identifier (strong
    or a name) for an opaque run, both for an endpoint. The parts are joined as intervals: an
    anchor's scope is dealt to the stretches of ``scope`` code points that it
    covers, a weak part to those that it lies in, and a semi-join on text and
    stretch checks the distance, so no pairs are made. Parts of equal texts are
    joined once. Spans that overlap a base span aren't weak parts.

    Null or empty texts have no spans. Null and repeated ids are kept, rows stay
    one to one. No rows give no rows. Other columns are not read.
    """
    text = text_of(docs)
    base = docs.select(
        F.col("doc_id").cast("long"),
        text.alias("text"),
        spans(text, ASSIGN, "assign", ASSIGN_CHARS).alias("assign"),
        spans(text, ACCESS, "access").alias("access"),
        spans(text, HEX, "hex").alias("hex"),
    )
    none = F.array().cast(_NONE)
    strong = F.concat("assign", "access", "hex")
    weak = F.filter(
        F.concat(spans(F.col("text"), OPAQUE, "opaque"), spans(F.col("text"), ENDPOINT, "endpoint"), spans(F.col("text"), IDENT, "ident")),
        lambda w: ~F.exists(strong, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])),
    )
    found = stage(
        base.withColumn("weak", F.when((F.size("access") > 0) | F.col("text").rlike(IDENT), weak).otherwise(none))
        .withColumn("text_key", F.when(F.size("weak") > 0, F.sha2("text", 256)))
        .drop("text"),
        "spans",
    )

    linkable = found.where("text_key is not null").dropDuplicates(["text_key"])

    def reach(column: str) -> DataFrame:
        """Anchors with the stretches that their scope covers."""
        return linkable.select(F.col("text_key").alias("k"), F.explode(column).alias("a")).select(
            "k", "a", F.explode(F.sequence(F.floor((F.col("a.start") - scope) / scope), F.floor((F.col("a.end") + scope) / scope))).alias("stretch")
        )

    def near(parts: DataFrame, anchors: DataFrame) -> DataFrame:
        return parts.join(
            anchors.withColumnRenamed("stretch", "reached"),
            (F.col("text_key") == F.col("k"))
            & (F.col("stretch") == F.col("reached"))
            & (F.col("w.start") <= F.col("a.end") + scope)
            & (F.col("w.end") + scope >= F.col("a.start")),
            "left_semi",
        )

    parts = linkable.select("text_key", F.explode("weak").alias("w")).select(
        "text_key", "w", F.explode(F.sequence(F.floor(F.col("w.start") / scope), F.floor(F.col("w.end") / scope))).alias("stretch")
    )
    opaque, endpoint, ident = map(KINDS.index, ("opaque", "endpoint", "ident"))
    kind = F.col("w.kind")
    of_kind = lambda k: F.filter("weak", lambda w: w["kind"] == k)
    by_access = near(parts.where(kind != ident), reach(F.concat("access", of_kind(ident))))
    wanting = by_access.where(kind == endpoint).union(parts.where(kind == ident))
    by_secret = near(wanting, reach(F.concat("assign", of_kind(opaque))))
    linked = stage(
        by_access.where(kind == opaque).union(by_secret).select("text_key", "w").distinct().groupBy("text_key").agg(F.collect_list("w").alias("linked")),
        "linked",
    )
    size = linked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("linked")), F.lit(0)).alias("spans")).first()
    linked = small(linked, size["n"] * 128 + size["spans"] * 48, 1)
    return found.join(linked, "text_key", "left").select("doc_id", "assign", "access", "hex", F.coalesce("linked", none).alias("linked"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.concat("assign", "access", "hex")
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.concat(base, F.col("linked"))).alias("spans"),
        F.size("linked").cast("long").alias("n_linked"),
    )
