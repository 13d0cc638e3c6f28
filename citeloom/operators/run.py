"""Two runs from recorded tables: references to labels, and pairs to routes, dispositions and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.functions.rules import first_match, settled
from citeloom.functions.tri import is_false, is_true
from citeloom.operators import decide, decisions, judgment, matching, scope


def references(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """``id, label, confidence, decided_by`` of references.

    ``pairs``: ``matching.PAIRS``, the record null where the identifier resolved
    to none; ``evidence``: id, has_pmid, fetch, verdict (of the filter), hits,
    retracted, timing, doi_status, searched. A record that is missing is flagged.
    """
    there = F.col("cand").isNotNull()
    found = matching.with_verdict(pairs.where(there))
    found = found.select("id", matching.is_flagged(found).alias("apart"), F.col("work.reason").alias("same"), F.col("verdict").alias("pair_verdict"))
    c, r = F.col("claimed"), F.col("cand")
    columns = {
        "title": c["title"], "authors": c["authors"], "journal": c["journal"], "pmid": F.when(is_true(F.col("has_pmid")), F.lit("claimed")), "doi": c["doi"], "publication_type": F.lit(None).cast("string"),
        "resolved": there, "r_title": r["title"], "r_authors": r["authors"], "r_journal": r["journal"], "is_container": F.lit(False),
    }
    out = pairs.join(evidence, "id").join(found, "id", "left")
    out = out.withColumns(columns).withColumn("unscoreable", scope.unscoreable_bucket(F.col))
    variant = F.col("pair_verdict") == "review_same_work_variant"
    out = out.withColumns({"flagged": F.coalesce("apart", F.lit(True)), "same_work": F.when(variant, F.coalesce("same", F.lit("near_identical_title")))})
    out = settled(out.withColumn("identity", F.lit(None).cast("string")), "unscoreable", "flagged", "same_work", "identity")
    return out.withColumn("x", decide.decide(F.col)).select("id", "x.*")


def early_disposition(route: Column, excused: Column) -> Column:
    """Where a pair goes while only coverage is judged."""
    return first_match(
        [
            (route == "NO_CLAIMS", "held_no_atomic_claims"),
            (route == "UNSUPPORTED_MEMBER", "held_unsupported_cocitation_member"),
            ((route == "F6_FLAGGED") & is_true(excused), "held_cocitation_covered"),
            (route == "F6_FLAGGED", "predicted"),
            (route == "FULL_COVERAGE", "held_full_coverage_pending_F3_F5_F7"),
        ],
        "held_insufficient_evidence",
    )


def pairs(refs: DataFrame, labels: DataFrame, extracted: DataFrame, covered: DataFrame) -> DataFrame:
    """``citation_id, route, disposition, outcome, reason`` of every reference; each keeps its row.

    ``refs``: citation_id, citance, value, kind, claimed_pmid, cited_in_body;
    ``labels``: citation_id, label; ``extracted``: sentence, attempts, attested,
    claims; ``covered``: pmid, claim, established (a row for each answer, null
    where it is open).
    """
    out = refs.join(labels, "citation_id", "left")
    structural = scope.structural_exclusion(F.col("citance"), F.col("value"), F.col("kind"), F.col("claimed_pmid"))
    admitted = decisions.admission(F.col("label"))
    out = out.withColumn("excluded", F.coalesce(structural, F.when(admitted != "admitted", admitted)))
    asked = out.where("excluded is null").join(extracted, out["citance"] == extracted["sentence"], "left")
    asked = asked.withColumn("claims", F.coalesce("claims", F.array().cast("array<string>")))
    said = asked.select("citation_id", F.coalesce("value", "claimed_pmid").alias("pmid"), F.explode_outer("claims").alias("claim")).join(covered, ["pmid", "claim"], "left")
    per = said.groupBy("citation_id").agg(F.count("claim").alias("n"), F.max(is_false(F.col("established"))).alias("gap"), F.min(is_true(F.col("established"))).alias("whole"))
    route = first_match([(F.col("n") == 0, "NO_CLAIMS"), (F.col("gap"), "F6_FLAGGED"), (F.col("whole"), "FULL_COVERAGE")], "HELD_LOW_CONFIDENCE")
    judged = asked.select("citation_id", "attempts", "attested", F.size("claims").alias("n_claims")).join(per.select("citation_id", route.alias("route")), "citation_id")
    out = out.join(judged, "citation_id", "left")
    out = out.withColumn("disposition", F.coalesce("excluded", early_disposition(F.col("route"), F.lit(False))))
    none = F.lit(None)
    record = {
        "findings": F.when(F.col("disposition") == "predicted", F.array(F.lit("F6"))).otherwise(F.array().cast("array<string>")),
        "input": text.claim_input_status(F.col("citance")),
        "retrievable": none.cast("boolean"),
        "failure": none.cast("string"),
        "failure_outcome": none.cast("string"),
        "n_claims": F.coalesce("n_claims", F.lit(0)),
        "stage_failed": F.lit(False),
        "holds": F.when(F.col("disposition").startswith("held_"), F.array("disposition")).otherwise(F.array().cast("array<string>")),
    }
    out = out.withColumns(record).withColumn("x", judgment.outcome(F.col))
    return out.select("citation_id", "route", "disposition", "x.outcome", "x.reason")
