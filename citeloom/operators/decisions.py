"""Ordered decision tables on columns. First rule that matches wins; unknown stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true


def _tri(table: list[tuple[Column, bool | None]], otherwise: bool | None) -> Column:
    out = None
    for when, value in table:
        value = F.lit(value).cast("boolean")
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.lit(otherwise).cast("boolean"))


def coverage_by_abstract(contradicts: Column, engages: Column, unconfirmed: Column) -> Column:
    """Whether an abstract establishes a claim; ``unconfirmed``: how many specifics it leaves open."""
    return _tri([(is_true(contradicts), False), (~is_true(engages), None), (unconfirmed > 0, None)], True)


def coverage_by_full_text(contradicts: Column, engages: Column, unconfirmed: Column, complete: Column) -> Column:
    """As above for a full text; only a complete one can say that a claim is not there."""
    return _tri([(is_true(contradicts), False), (is_true(engages) & (unconfirmed == 0), True), (is_true(complete), False)], None)


def coverage_bucket(contradicts: Column, engages: Column, unconfirmed: Column) -> Column:
    return first_match(
        [
            (is_true(contradicts), "contradicted"),
            (is_false(engages), "off_topic"),
            (is_true(engages) & (unconfirmed > 0), "unconfirmed_specific"),
            (is_true(engages), "established"),
        ]
    )


def absence_guard(established: Column, contradicts: Column) -> Column:
    """An abstract does not assert absence: false without a contradiction becomes unknown."""
    return F.when(is_false(established) & ~is_true(contradicts), F.lit(None).cast("boolean")).otherwise(established)


def admission(label: Column) -> Column:
    return first_match(
        [(label.isNull(), "excluded_preband_disposition_missing"), (label.isin("cleared", "accurate", "same_work"), "admitted")], "excluded_preband"
    )


def date_state(earliest: Column, latest: Column, cutoff: Column) -> Column:
    """A date interval against a cutoff."""
    return first_match(
        [
            (earliest.isNull() & latest.isNull(), "absent"),
            (earliest.isNull() | latest.isNull() | (earliest > latest), "unparseable"),
            (latest <= cutoff, "compared"),
            (earliest > cutoff, "after_cutoff"),
        ],
        "boundary_uncertain",
    )


def fetch_status(http_status: Column, has_record: Column) -> Column:
    """An error is no answer, and an answer without a record is one."""
    return first_match(
        [(http_status.isNull(), "not_attempted"), ((http_status == 200) & has_record, "answered_record"), (http_status.isin(200, 404), "answered_absent")],
        "resolver_error",
    )


def exact_doi(crossref: Column, proxy: Column, datacite: Column, openalex: Column) -> Column:
    """Combined status of four providers, each found, absent, conflict or error."""
    every = [crossref, proxy, datacite, openalex]
    found = [crossref, datacite, openalex]
    any_of = lambda cs, s: F.greatest(*[F.coalesce(c == s, F.lit(False)) for c in cs])
    all_absent = F.least(*[F.coalesce(c == "absent", F.lit(False)) for c in every])
    return first_match(
        [
            (any_of(every, "conflict") | ((proxy == "absent") & any_of(found, "found")), "conflict"),
            (any_of(found, "found"), "found"),
            (proxy == "found", "found_no_metadata"),
            (all_absent, "answered_absent"),
        ],
        "incomplete",
    )


def retracted(status: Column) -> Column:
    return F.when(status == "qualified", True).when(status.isin("clear", "not_applicable"), False)


def comparability(claim: Column, outcome: Column, population: Column) -> Column:
    return first_match(
        [
            ((claim == "mismatch") | (outcome == "not_same") | population.isin("narrower", "disjoint"), "not_comparable"),
            (
                (claim == "uncertain") | (outcome == "uncertain") | population.isin("encompassing_without_qualifying_direct_evidence", "unclear"),
                "uncertain",
            ),
        ],
        "comparable",
    )


def study_relation(same_id: Column, shared_registry: Column, both_primary: Column, version_or_doi: Column, shared_data: Column, distinct: Column) -> Column:
    not_independent = same_id | (shared_registry & both_primary) | version_or_doi | shared_data
    return first_match([(not_independent, "not_independent"), (distinct, "independent")], "unknown")


def evidence_pattern(mixed: Column, opposing: Column, confirming: Column, open_search: Column) -> Column:
    """Pattern from counts of clusters; ``open_search``: something is incomplete, plausible or not judgeable."""
    return first_match(
        [
            ((mixed > 0) | ((opposing > 0) & (confirming > 0)), "mixed_evidence"),
            (opposing > 1, "multiple_opposition"),
            (opposing > 0, "single_opposition"),
            (confirming > 0, "confirmation_only_found"),
            (open_search, "unassessable"),
        ],
        "no_controversy_found",
    )


def resolved_identifier(retrieved_pmid: Column, claimed_pmid: Column, doi: Column) -> Column:
    """(value, kind, source) of the first identifier there is."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    kinds = [(retrieved_pmid, "pmid", "retrieved"), (claimed_pmid, "pmid", "claimed"), (doi, "doi", "claimed")]
    value = F.coalesce(*[some(c) for c, _, _ in kinds])
    kind = first_match([(some(c).isNotNull(), k) for c, k, _ in kinds], "none")
    source = first_match([(some(c).isNotNull(), s) for c, _, s in kinds], "none")
    return F.struct(value.alias("value"), kind.alias("kind"), source.alias("source"))
