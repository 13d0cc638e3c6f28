"""Rollups of claims and tuples to pairs, and reports over logs; each is a grouped aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true


def entity_of_claim(tuples: DataFrame, *keys: str) -> DataFrame:
    """``tuple_id, outcome, reason`` rows to a claim's state: one that can't be judged decides, then the first mismatch."""
    first = lambda outcome: F.min(F.when(F.col("outcome") == outcome, F.struct("tuple_id", "reason")))
    found = tuples.groupBy(*keys).agg(first("UNJUDGEABLE").alias("held"), first("CONFIRMED_MISMATCH").alias("other"))
    state = first_match([(F.col("held").isNotNull(), "UNJUDGEABLE"), (F.col("other").isNotNull(), "DIFFERENT_ENTITY_SUPPORTED")], "SAME_ENTITY")
    reason = F.coalesce("held.reason", F.when(F.col("other").isNotNull(), "different_entity_supported"), F.lit("all_same_entity"))
    return found.select(*keys, state.alias("state"), reason.alias("reason"), F.coalesce("held.tuple_id", "other.tuple_id").alias("tuple_id"))


def temporal_of_pair(claims: DataFrame, *keys: str) -> DataFrame:
    """``claim_index, supported, applies, state`` rows to a pair's state: the first qualifying claim, else one that is held, else none.

    Only supported claims to which the question applies count.
    """
    asked = is_true(F.col("supported")) & is_true(F.col("applies"))
    found = claims.groupBy(*keys).agg(
        F.min(F.when(asked & (F.col("state") == "QUALIFYING_CONTRADICTION"), F.col("claim_index"))).alias("claim_index"),
        F.max(asked & (F.col("state") == "UNJUDGEABLE")).alias("held"),
        F.max(asked).alias("asked"),
        F.max(is_true(F.col("supported")) & ~is_true(F.col("applies"))).alias("beside"),
    )
    state = first_match([(F.col("claim_index").isNotNull(), "QUALIFYING_CONTRADICTION"), (F.col("held"), "UNJUDGEABLE")], "NO_QUALIFYING_CONTRADICTION")
    why = first_match(
        [(F.col("claim_index").isNotNull(), "qualifying"), (F.col("held"), "held"), (~F.col("asked") & F.col("beside"), "no applicable supported claim")], "none qualifies"
    )
    return found.select(*keys, state.alias("state"), "claim_index", why.alias("why"))


# Why the provenance of a claim is held.
_HELD = ("unclear claim held", "restatement without an anchoring span", "restatement span is not verbatim in the cited abstract", "restatement not confirmed within hop budget")


def provenance_of_pair(claims: DataFrame, *keys: str) -> DataFrame:
    """``claim_index, verdict, span, abstract, confirmed`` rows to a pair's provenance: the first confirmed restatement, else what is held, else proper."""
    span = F.coalesce(F.col("span"), F.lit(""))
    verbatim = F.coalesce(F.col("abstract").contains(span), F.lit(False))
    restated = F.col("verdict") == "restatement"
    sure = restated & (span != "") & verbatim & is_true(F.col("confirmed"))
    held = first_match([(F.col("verdict") == "unclear", _HELD[0]), (restated & (span == ""), _HELD[1]), (restated & ~verbatim, _HELD[2]), (restated & ~sure, _HELD[3])])
    found = claims.groupBy(*keys).agg(
        F.min(F.when(sure, F.col("claim_index"))).alias("claim_index"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(held.isNotNull(), F.struct("claim_index", held.alias("why"))))), lambda x: x["why"])).alias("held"),
        F.max(F.col("verdict").isin("originates", "not_origin_sensitive")).alias("proper"),
    )
    state = first_match([(F.col("claim_index").isNotNull(), "CONFIRMED"), (F.size("held") > 0, "UNJUDGEABLE"), (F.col("proper"), "PROPER_ORIGIN")], "UNJUDGEABLE")
    why = F.when(state == "UNJUDGEABLE", F.when(F.size("held") > 0, F.array_join("held", "; ")).otherwise("provenance unresolved"))
    return found.select(*keys, state.alias("state"), "claim_index", why.alias("why"))


# ---- reports ----

#: Columns of a log that ``measurement`` reads.
LOG = "label string, decided_by string, has_pmid boolean, fetch string, resolved boolean, hits map<string,double>, same_work string, unscoreable string, override boolean, flagged boolean"
# Decisions before a title search, benign ones and those that prevented it.
BENIGN = ("metadata_match", "noid_metadata_match", "same_work_variant_quarantine", "retracted_publication_pubtype")
PREVENTED = ("llm_formatting", "llm_uncertain", "no_llm", "no_confirm")


def measurement(log: DataFrame) -> DataFrame:
    """One row: counts of a run, and how far the search for fabrications got, in one pass."""
    c = F.col
    left = ~c("label").isin("unscoreable", "unverifiable")
    has_pmid, hits = is_true(c("has_pmid")), F.coalesce(F.size("hits"), F.lit(0)) > 0
    whole = F.forall(F.map_values("hits"), lambda v: v.isNotNull())
    recorded = F.coalesce(c("fetch"), F.lit("")) != ""
    counts = {
        "total": F.lit(True),
        "unverifiable": c("label") == "unverifiable",
        "unscoreable_total": c("label") == "unscoreable",
        "same_work_total": c("label") == "same_work",
        "pmid_bearing": left & has_pmid,
        "pmid_resolved": left & has_pmid & is_true(c("resolved")),
        "flagged_total": left & is_true(c("flagged")),
        "f1_count": c("label") == "F1",
        "f2_count": left & (c("label") == "F2"),
        "override_cleared": left & is_true(c("override")) & ~is_true(c("flagged")),
        "attempted": has_pmid,
        "answered": has_pmid & recorded & (c("fetch") != "resolver_error"),
        "transport_failed": has_pmid & (c("fetch") == "resolver_error"),
        "transport_unrecorded": has_pmid & ~recorded,
        "confirm_complete": hits & whole,
        "confirm_incomplete": hits & ~whole,
        "confirm_skipped_benign": ~hits & c("decided_by").isin(*BENIGN),
        "confirm_skipped_prevented": ~hits & c("decided_by").isin(*PREVENTED),
        "quarantine_exception": ~hits & (c("decided_by") == "quarantine_exception"),
    }
    out = log.agg(*[F.count_if(v).alias(k) for k, v in counts.items()])
    rate = F.when(c("pmid_bearing") > 0, F.round(c("f2_count") / c("pmid_bearing"), 6))
    return out.withColumns({"scoreable": c("total") - c("unscoreable_total") - c("unverifiable") - c("same_work_total"), "base_rate": rate})


def reasons(log: DataFrame) -> DataFrame:
    """``kind, reason, n`` of what is excluded: by unscoreable reason and by same-work reason."""
    kind = F.when(F.col("label").isin("unscoreable", "same_work"), F.col("label"))
    reason = F.nullif(F.when(kind == "unscoreable", F.col("unscoreable")).otherwise(F.col("same_work")), F.lit(""))
    return log.where(kind.isNotNull()).groupBy(kind.alias("kind"), F.coalesce(reason, F.lit("unspecified")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def complete_source(sections: DataFrame, key: str, least: int = 1000) -> DataFrame:
    """Whether a source's sections have ``least`` characters in all."""
    n = F.coalesce(F.sum(F.length("text")), F.lit(0))
    return sections.groupBy(key).agg(n.alias("chars"), (n >= least).alias("complete"))


# ---- scoring against gold ----


def same_references(gold: Column, said: Column) -> Column:
    """Whether two lists of (pmid, doi) share an identifier; no gold asks for none."""
    ids = lambda xs: F.array_compact(
        F.flatten(F.transform(xs, lambda x: F.array(F.when(x["pmid"] != "", F.concat(F.lit("pmid:"), x["pmid"])), F.when(x["doi"] != "", F.concat(F.lit("doi:"), F.lower(x["doi"]))))))
    )
    return F.when(F.size(ids(gold)) > 0, F.arrays_overlap(ids(gold), ids(said))).otherwise(F.size(ids(said)) == 0)


def gold_conflict(label: Column, supported: Column) -> Column:
    """What contradicts a gold label: insufficient support needs a claim that isn't supported, another label none."""
    gap = F.exists(supported, is_false)
    return first_match([((label == "F6") & ~gap, "F6 without an unsupported claim"), ((label != "F6") & gap, "unsupported claim without F6")])
