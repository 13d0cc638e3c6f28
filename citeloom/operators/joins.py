"""Joins that account for every row, and refuse what would publish a number over the wrong population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match


class ContractError(ValueError):
    """A run over the wrong population was refused."""


CLEAR = ("cleared", "accurate", "same_work")


def accounting(expected: DataFrame, supplied: DataFrame, key: str = "citation_id", sample: int = 10) -> DataFrame:
    """One row: matched, missing, extra, cleared, coverage and sorted samples. ``supplied``: key, label."""
    both = expected.select(key, F.lit(True).alias("e")).distinct().join(supplied.select(key, "label", F.lit(True).alias("s")).dropDuplicates([key]), key, "full_outer")
    e, s = F.coalesce("e", F.lit(False)), F.coalesce("s", F.lit(False))
    out = both.agg(
        F.count_if(e).alias("expected"),
        F.count_if(s).alias("supplied"),
        F.count_if(e & s).alias("matched"),
        F.count_if(e & ~s).alias("missing"),
        F.count_if(s & ~e).alias("extra"),
        F.count_if(e & s & F.col("label").isin(*CLEAR)).alias("cleared"),
    )
    first = lambda how: both.where(how).select(key).orderBy(key).limit(sample).agg(F.array_sort(F.collect_list(key)).alias("x"))
    coverage = F.when(F.col("expected") > 0, F.col("matched") / F.col("expected")).otherwise(0.0)
    out = out.withColumn("coverage", coverage).join(first(e & ~s).withColumnRenamed("x", "missing_sample"), how="left")
    return out.join(first(s & ~e).withColumnRenamed("x", "extra_sample"), how="left")


def refusal(account, *, supplied: bool = True, whole: bool = False) -> Column:
    """Why a join is refused, by the columns of ``accounting``; null if it isn't."""
    return first_match(
        [
            (F.lit(not supplied), "no_disposition"),
            (account("matched") == 0, "zero_overlap"),
            (F.lit(whole) & (account("missing") > 0), "missing_ids"),
        ]
    )


def enforced(expected: DataFrame, supplied: DataFrame | None, key: str = "citation_id", *, whole: bool = False) -> DataFrame:
    """``expected`` with its labels, left and fail-closed; raises ``ContractError`` where the join is refused."""
    if supplied is None:
        raise ContractError("no_disposition")
    why = accounting(expected, supplied, key).select(refusal(F.col, whole=whole).alias("why")).first()["why"]
    if why:
        raise ContractError(why)
    return expected.join(supplied.select(key, "label").dropDuplicates([key]), key, "left")


def all_missing(counts: DataFrame, missing: str, structural: list[str]) -> Column:
    """Aggregate of (disposition, n): every pair that reached the gate had no entry."""
    reached = F.sum(F.when(~F.col("disposition").isin(*structural), F.col("n")).otherwise(0))
    lost = F.sum(F.when(F.col("disposition") == missing, F.col("n")).otherwise(0))
    return (reached > 0) & (reached == lost)


def selected(rows: DataFrame, selection: DataFrame, key: str = "citation_id") -> DataFrame:
    """Rows of the selection; raises ``ContractError`` if a selected id is not among them."""
    lost = selection.select(key).distinct().join(rows.select(key), key, "left_anti").orderBy(key).limit(5).collect()
    if lost:
        raise ContractError(f"selected ids that aren't there: {[r[0] for r in lost]}")
    return rows.join(selection.select(key).distinct(), key, "left_semi")


def corpus_state(declared: DataFrame, found: DataFrame) -> DataFrame:
    """``name, state`` of declared and found files (name, sha256): same, absent, extra or changed."""
    both = declared.select("name", F.col("sha256").alias("d")).join(found.select("name", F.col("sha256").alias("f")), "name", "full_outer")
    state = first_match([(F.col("f").isNull(), "absent"), (F.col("d").isNull(), "extra"), (F.col("d") != F.col("f"), "changed")], "same")
    return both.select("name", state.alias("state"))


# Relations of entities, and what they are from the other side.
FLIPPED = {"broader": "narrower", "narrower": "broader"}


def entity_relation(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """``relation`` of (a, b): equal ids, a stated relation, one stated from the other side, or unknown. ``relations``: a, b, relation."""
    other = F.coalesce(*[F.when(F.col("relation") == k, F.lit(v)) for k, v in FLIPPED.items()], F.col("relation"))
    known = relations.select("a", "b", "relation", F.lit(0).alias("turned")).union(relations.select(F.col("b").alias("a"), F.col("a").alias("b"), other.alias("relation"), F.lit(1).alias("turned")))
    known = known.groupBy("a", "b").agg(F.min_by("relation", F.struct("turned", "relation")).alias("stated"))
    unknown = F.col("a").isNull() | F.col("b").isNull()
    return pairs.join(known, ["a", "b"], "left").withColumn("relation", F.when(unknown, "unknown").when(F.col("a") == F.col("b"), "equivalent").otherwise(F.coalesce("stated", F.lit("unknown")))).drop("stated")


def spans_of_clauses(tuples: DataFrame, clauses: DataFrame) -> DataFrame:
    """Tuples (claim_index, tuple_id, span) with the first clause (clause_id, clause) of their claim that holds the span; null if none does."""
    held = tuples.join(clauses, "claim_index", "left").where(F.col("clause").isNull() | F.col("clause").contains(F.col("span")))
    found = held.groupBy("claim_index", "tuple_id").agg(F.min("clause_id").alias("clause_id"))
    return tuples.select("claim_index", "tuple_id", "span").join(found, ["claim_index", "tuple_id"], "left")


def resolved_spans(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Span ids (label, sid) with their units' texts, and ``missing`` where there is no such unit."""
    found = spans.join(units.select("pmid", "label", "sid", "text"), ["pmid", "label", "sid"], "left")
    return found.withColumn("missing", F.col("text").isNull())


# Words that a search leaves out.
UNSEARCHED = (
    "about after among and are because been before between both but can compared could did does during effect effects for from had has have into its "
    "may more not our patients reported showed shows study than that the their there these this those through using was were which with within would"
).split()


def _any_of(terms: Column, field: str, most: int) -> Column:
    """The first distinct terms (whatever their case), quoted for a field and joined by OR."""
    clean = F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(t, r"[\"\\\[\](){}:\s]+", " "))), lambda t: t != "")
    low = F.transform(clean, lambda t: F.lower(t))
    first = F.slice(F.filter(clean, lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, most)
    quoted = F.transform(first, lambda t: F.concat(F.lit('"'), t, F.lit(f'"[{field}]')))
    return F.when(F.size(quoted) > 0, F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")"))).otherwise("")


def heading_query(headings: Column, terms: int = 12) -> Column:
    """Query of subject headings."""
    return _any_of(F.coalesce(headings, F.array().cast("array<string>")), "MeSH Terms", terms)


def claim_query(claim: Column, terms: int = 12) -> Column:
    """Title/abstract query of a claim: its first distinct words of four letters, joined by OR."""
    words = F.transform(F.regexp_extract_all(F.coalesce(claim, F.lit("")), F.lit(r"[A-Za-z0-9][A-Za-z0-9'’-]{2,}"), F.lit(0)), lambda w: F.regexp_replace(w, "^[-'’]+|[-'’]+$", ""))
    some = F.filter(words, lambda w: (F.length(w) >= 4) & ~F.lower(w).isin(UNSEARCHED))
    return _any_of(some, "Title/Abstract", terms)
