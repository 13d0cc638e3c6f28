"""Decision of a reference from recorded evidence: label, confidence and what decided it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.tri import is_true

#: Scores (0 to 100) from which a title search finds a work, and settles its identity (fixed values).
FOUND, IDENTITY = 85.0, 95.0
#: States of a fetch that gave no evidence (fixed values).
UNANSWERED = ("resolver_error",)

#: The evidence columns, by name; ``hits`` is a score by database, null where it did not answer.
EVIDENCE = (
    "id int, retracted boolean, unscoreable string, timing string, same_work string, identity string, has_pmid boolean, fetch string, "
    "doi string, doi_status string, flagged boolean, verdict string, hits map<string,double>, searched boolean"
)


def best_score(hits: Column) -> Column:
    """Best score of the databases that answered; null if none did."""
    return F.array_max(F.array_compact(F.map_values(hits)))


def answered(hits: Column) -> Column:
    """Every database answered, and there is one."""
    return F.coalesce((F.size(hits) > 0) & F.forall(F.map_values(hits), lambda v: v.isNotNull()), F.lit(False))


def silent(hits: Column) -> Column:
    return F.coalesce((F.size(hits) > 0) & F.forall(F.map_values(hits), lambda v: v.isNull()), F.lit(False))


def unanswered(hits: Column) -> Column:
    return F.array_sort(F.map_keys(F.map_filter(hits, lambda _, v: v.isNull())))


def found(hits: Column, least: float = FOUND) -> Column:
    return F.coalesce(best_score(hits) >= least, F.lit(False))


def decide(e) -> Column:
    """(label, confidence, decided_by) of ``EVIDENCE``; ``e`` gives a column by name. The first rule that holds.

    A fabrication is only said of a reference without an identifier whose DOI is
    absent everywhere and whose title every database was asked for.
    """
    hits, has_pmid, flagged = e("hits"), is_true(e("has_pmid")), is_true(e("flagged"))
    by_doi = ~has_pmid & (F.coalesce(e("doi"), F.lit("")) != "")
    status = F.coalesce(e("doi_status"), F.lit(""))
    absent = by_doi & (status == "answered_absent")
    some = lambda c: F.coalesce(e(c), F.lit("")) != ""
    verdict = e("verdict")
    timed = some("timing")
    table = [
        (is_true(e("retracted")) & timed, "F8", "HIGH", "f8_retracted_before_citation_timing_met"),
        (is_true(e("retracted")), "F8", "HIGH", "retracted_publication_pubtype"),
        (some("unscoreable"), "unscoreable", "HIGH", "unscoreable"),
        (e("timing") == "timing_indeterminate", "unscoreable", "HIGH", "f8_timing_indeterminate_excluded"),
        (e("timing") == "unresolved", "unscoreable", "HIGH", "f8_timing_boundary_unresolved"),
        (some("same_work") & (e("identity") == "mixed_identity_conflict"), "human_review", "MED", "mixed_identity_conflict_quarantine"),
        (some("same_work"), "same_work", "HIGH", "same_work_variant_resolved"),
        (has_pmid & e("fetch").isin(*UNANSWERED), "human_review", "LOW", "pmid_fetch_no_answer"),
        (by_doi & (status == "found") & flagged, "F2", "MED", "exact_doi_metadata_mismatch_f2"),
        (by_doi & (status == "found_no_metadata"), "human_review", "MED", "exact_doi_found_metadata_unavailable_hold"),
        (by_doi & status.isin("incomplete", "conflict", "not_attempted", ""), "human_review", "LOW", "exact_doi_incomplete_hold"),
        (absent & hits.isNull(), "human_review", "LOW", "exact_doi_no_confirm"),
        (absent & found(hits), "F2", "MED", "exact_doi_absent_title_found_f2"),
        (absent & ~answered(hits), "human_review", "LOW", "exact_doi_confirm_incomplete"),
        (absent, "F1", "HIGH", "exact_doi_absent_confirm_not_found_f1"),
        (~has_pmid & ~is_true(e("searched")), "unverifiable", "HIGH", "no_pmid_no_title"),
        (~flagged & ~has_pmid, "cleared", "HIGH", "noid_metadata_match"),
        (~flagged, "cleared", "HIGH", "metadata_match"),
        (verdict.isNull(), "human_review", "LOW", "no_llm"),
        (verdict == "formatting_discrepancy", "cleared", "MED", "llm_formatting"),
        ((verdict == "uncertain") & found(hits, IDENTITY), "cleared", "MED", "title_search_identity_settled"),
        (verdict == "uncertain", "unscoreable", "HIGH", "identity_unresolved_after_title_search"),
        (hits.isNull(), "human_review", "LOW", "no_confirm"),
        (silent(hits), "human_review", "LOW", "confirm_all_errored"),
        (found(hits) & ~has_pmid, "human_review", "MED", "noid_confirm_found_human_review"),
        (found(hits), "F2", "MED", "confirm_found_f2"),
        (~has_pmid, "human_review", "MED", "noid_confirm_not_found_human_review"),
        (~answered(hits), "human_review", "LOW", "confirm_incomplete_evidence"),
    ]
    value = lambda label, sure, by: F.struct(F.lit(label).alias("label"), F.lit(sure).alias("confidence"), F.lit(by).alias("decided_by"))
    out = None
    for when, *rest in table:
        out = F.when(when, value(*rest)) if out is None else out.when(when, value(*rest))
    return out.otherwise(value("human_review", "MED", "confirm_not_found_human_review"))


def needs(e) -> Column:
    """Which lookups the decision still waits for: DOI check, filter verdict, title search; by what is known before each."""
    open_ = ~is_true(e("retracted")) & (F.coalesce(e("unscoreable"), F.lit("")) == "") & (F.coalesce(e("same_work"), F.lit("")) == "")
    has_pmid = is_true(e("has_pmid"))
    by_doi = open_ & ~has_pmid & (F.coalesce(e("doi"), F.lit("")) != "")
    verdict = open_ & is_true(e("flagged")) & (has_pmid | is_true(e("searched")))
    search = (by_doi & (e("doi_status") == "answered_absent")) | (verdict & e("verdict").isNotNull() & (e("verdict") != "formatting_discrepancy"))
    return F.struct(by_doi.alias("doi_check"), F.coalesce(verdict, F.lit(False)).alias("filter"), F.coalesce(search, F.lit(False)).alias("title_search"))


# Names of the findings that people read, and what a label means for the data set.
NAMES = {
    "F1": "Unresolvable Reference", "F2": "Wrong Reference", "F3": "Misattribution", "F4": "Overstatement", "F5": "Supersession",
    "F6": "Insufficient Support", "F7": "Wrong Entity", "F8": "Retracted Source", "accurate": "Accurate",
}


def finding_name(label: Column) -> Column:
    """A finding's name; other labels as they are."""
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    return F.coalesce(names[label], label)


def annotated(key: Column) -> Column:
    """A key with the name of the finding whose code it holds, in parentheses."""
    code = F.regexp_extract(key, r"(?<![A-Za-z0-9])(F[1-8])(?![A-Za-z0-9])", 1)
    return F.when(code == "", key).otherwise(F.concat(key, F.lit("  ("), finding_name(code), F.lit(")")))


def data_set_label(label: Column) -> Column:
    """Label of a decided reference in the data set; null where it is left out."""
    return F.when(label == "cleared", "accurate").when(label.isin(*NAMES), label)
