"""Findings, holds and outcomes of a pair of citing and cited work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match, primary
from citeloom.functions.tri import is_false, is_true


def support_state(established: Column) -> Column:
    """State of a claim's support from the coverage's answer."""
    return F.when(established.isNull(), "UNJUDGEABLE").when(established, "SUPPORTED").otherwise("UNESTABLISHED")


#: A pair's evidence: support before and after strength, gaps that co-cited works cover, entities, provenance, time.
PAIR = (
    "id int, cleared boolean, before array<string>, support array<string>, excused array<boolean>, entities array<string>, provenance string, temporal string, temporal_claim int"
)


def judge(e) -> Column:
    """(status, findings, primary, holds): findings stay when a hold keeps the pair open.

    ``e`` gives ``PAIR`` by name. Provenance and time may be missing; a pair
    that was not cleared is outside. A qualifying time whose claim isn't
    supported is an error of the contract.
    """
    support, excused = e("support"), e("excused")
    has = lambda xs, v: F.coalesce(F.array_contains(xs, v), F.lit(False))
    gaps = F.zip_with(support, excused, lambda s, x: (s == "UNESTABLISHED") & ~is_true(x))
    spared = F.zip_with(support, excused, lambda s, x: (s == "UNESTABLISHED") & is_true(x))
    whole = (F.size(e("before")) > 0) & F.forall(e("before"), lambda s: s == "SUPPORTED")
    rules = [
        (has(e("entities"), "DIFFERENT_ENTITY_SUPPORTED"), "F7"),
        (F.exists(gaps, lambda g: g), "F6"),
        (has(support, "WEAKER_STRENGTH"), "F4"),
        (whole & (e("provenance") == "CONFIRMED"), "F3"),
        (e("temporal") == "QUALIFYING_CONTRADICTION", "F5"),
    ]
    findings = F.array_compact(F.array(*[F.when(when, F.lit(f)) for when, f in rules]))
    holds = [
        (F.size(support) == 0, "no_claims"),
        (whole & (e("provenance").isNull() | (e("provenance") == "UNJUDGEABLE")), "provenance"),
        (has(support, "UNJUDGEABLE"), "support"),
        (has(e("entities"), "UNJUDGEABLE"), "entity"),
        (e("temporal").isNull() | (e("temporal") == "UNJUDGEABLE"), "temporal"),
        (F.exists(spared, lambda s: s) & (F.size(findings) == 0), "attributed_to_co_cited"),
    ]
    held = F.array_compact(F.array(*[F.when(when, F.lit(h)) for when, h in holds]))
    target = F.get(support, e("temporal_claim"))
    wrong = (e("temporal") == "QUALIFYING_CONTRADICTION") & ~F.coalesce(target == "SUPPORTED", F.lit(False))
    none = F.array().cast("array<string>")
    status = first_match([(~is_true(e("cleared")), "OUTSIDE_BAND"), (wrong | (~whole & e("provenance").isNotNull()), "CONTRACT_ERROR"), (F.size(held) > 0, "HELD")], "TERMINAL")
    shown = status.isin("HELD", "TERMINAL")
    return F.struct(
        status.alias("status"),
        F.when(shown, findings).otherwise(none).alias("findings"),
        F.when(status == "TERMINAL", F.coalesce(primary(findings), F.lit("accurate"))).alias("primary"),
        F.when(status == "HELD", held).otherwise(none).alias("holds"),
    )


#: What the disposition of a judged pair reads.
DISPOSED = "id int, retrievable boolean, n_claims int, extraction_failed boolean, findings array<string>, solo string, route string, excused boolean, unjudgeable_before boolean, unjudgeable boolean, provenance string"


def disposition(e) -> Column:
    """Where a judged pair goes; all discriminators wired. The first rule that holds."""
    has = lambda f: F.array_contains(e("findings"), f)
    none = F.size(e("findings")) == 0
    covered = (e("solo") == "F6_FLAGGED") & (e("route") == "GROUP_COVERED") & is_true(e("excused")) & none
    return first_match(
        [
            (~is_true(e("retrievable")), "held_insufficient_evidence"),
            ((e("n_claims") == 0) & is_true(e("extraction_failed")), "held_claim_extraction_failure"),
            (e("n_claims") == 0, "held_no_atomic_claims"),
            (has("F7"), "predicted_F7"),
            (has("F6"), "predicted_F6"),
            (covered, "held_cocitation_covered"),
            (has("F4"), "predicted_F4"),
            (has("F3"), "predicted_F3"),
            (has("F5"), "predicted_F5"),
            (e("route") == "UNSUPPORTED_MEMBER", "held_unsupported_cocitation_member"),
            (is_true(e("unjudgeable")) & is_true(e("unjudgeable_before")), "held_insufficient_evidence"),
            (is_true(e("unjudgeable")), "held_strength_unjudgeable"),
            (e("provenance") == "PROPER_ORIGIN", "held_pending_F5_F7"),
        ],
        "held_provenance_unjudgeable",
    )


#: A pair's record as the outcome reads it.
RECORD = (
    "id int, citation_id string, findings array<string>, sentence string, input string, cited_in_body boolean, retrievable boolean, disposition string, failure string, "
    "failure_outcome string, n_claims int, attested boolean, attempts int, stage_failed boolean, holds array<string>"
)


def outcome(e) -> Column:
    """(outcome, reason) of a record; nothing ends as NONE unless every stage ran. The first rule that holds."""
    first = primary(e("findings"))
    value = lambda o, r: F.struct(F.lit(o).alias("outcome"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    none = e("n_claims") == 0
    rules = [
        (F.coalesce(F.trim(e("citation_id")), F.lit("")) == "", "HUMAN_REVIEW_REQUIRED", "corrupt_source_record"),
        (first.isNotNull(), first, "taxonomy_finding"),
        ((e("input") == "empty") & is_false(e("cited_in_body")), "UNJUDGEABLE", "uncited_reference"),
        (e("input") == "empty", "HUMAN_REVIEW_REQUIRED", "empty_claim_input"),
        (e("input") != "prose", "HUMAN_REVIEW_REQUIRED", "malformed_claim_input"),
        (is_false(e("retrievable")), "UNJUDGEABLE", "cited_text_unavailable"),
        (e("disposition").startswith("excluded_"), "UNJUDGEABLE", F.concat(F.lit("preband_"), e("disposition"))),
        (e("failure").isNotNull(), e("failure_outcome"), e("failure")),
        (none & is_true(e("attested")) & (e("attempts") >= 2), "NONE", "prose_sentence_asserts_nothing_empirical"),
        (none, "HUMAN_REVIEW_REQUIRED", "claim_extraction_empty_after_retry"),
        (is_true(e("stage_failed")), "UNJUDGEABLE", "stage_failure"),
        (F.size(e("holds")) > 0, "UNJUDGEABLE", F.concat(F.lit("held_"), e("disposition"))),
    ]
    out = None
    for when, o, r in rules:
        v = F.struct((F.lit(o) if isinstance(o, str) else o).alias("outcome"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(value("NONE", "all_wired_stages_ran_no_fault"))


# ---- strength of a claim ----

#: Ladders from weak to strong, by dimension (ranks from 0).
STRENGTH = "id int, subject string, owned boolean, population string, dimension string, citing array<int>, cited array<int>, spans_verbatim boolean, citing_tokens int, cited_tokens int, verified array<boolean>"
DIMENSIONS = ("causality", "certainty", "magnitude", "population")


def strength(e) -> Column:
    """Whether a claim says more than its source: supported, hold, candidate or confirmed.

    ``citing`` and ``cited`` are the ranks on the ladders of ``DIMENSIONS``
    (null: not known), ``verified`` the verifier's answers.
    """
    dimension = e("dimension")
    at = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), dimension).cast("int") - 1
    own, other = F.get(e("citing"), at), F.get(e("cited"), at)
    level = F.forall(F.zip_with(e("citing"), e("cited"), lambda a, b: a <= b), lambda x: F.coalesce(x, F.lit(False)))
    spans = is_true(e("spans_verbatim")) & (e("citing_tokens") >= 2) & (e("cited_tokens") >= 2)
    sure = (F.size(e("verified")) == 4) & F.forall(e("verified"), is_true)
    return first_match(
        [
            (F.coalesce(e("subject"), F.lit("")) != "yes", "hold"),
            (is_true(e("owned")) | (e("population") == "citing_narrower"), "hold"),
            ((dimension == "none") & level & (e("population") == "equivalent"), "supported"),
            (dimension.isin("none", "unknown") | dimension.isNull(), "hold"),
            (own.isNull() | other.isNull() | (own <= other), "hold"),
            ((dimension == "population") & (e("population") != "citing_broader"), "hold"),
            (~spans, "hold"),
            (sure, "confirmed"),
        ],
        "candidate",
    )


# ---- time ----


def claim_time(e) -> Column:
    """State of a claim against later work: the cited source's notices first, then what the search found."""
    return first_match(
        [
            (e("notice") == "unresolved", "UNJUDGEABLE"),
            (e("notice") == "retracted", "UNJUDGEABLE"),
            (is_true(e("cited_gap")), "UNJUDGEABLE"),
            (e("n_qualifying") > 0, "QUALIFYING_CONTRADICTION"),
            (is_true(e("searched")) & is_true(e("adequate")) & (e("n_candidates") > 0) & is_true(e("cited_complete")) & (e("n_open") == 0), "NO_QUALIFYING_CONTRADICTION"),
        ],
        "UNJUDGEABLE",
    )


def time_path(state: Column, eligible: Column, deployed: Column, capped: Column, surfaced: Column) -> Column:
    return first_match(
        [
            ((state == "QUALIFYING_CONTRADICTION") & is_true(eligible) & is_true(deployed) & ~is_true(capped), "A"),
            (state == "QUALIFYING_CONTRADICTION", "B"),
            (state == "NO_QUALIFYING_CONTRADICTION", "not_F5"),
            (is_true(surfaced), "B"),
        ],
        "unknown",
    )


# Months by name.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def date_interval(year: Column, month: Column, day: Column, free: Column) -> Column:
    """(earliest, latest, precision) of a date's parts; free text gives a year and perhaps a month; null if there is no year or no such date."""
    own = F.trim(F.coalesce(year, F.lit("")))
    text = F.lower(F.coalesce(free, F.lit("")))
    from_text = own == ""
    y = F.when(from_text, F.regexp_extract(text, r"(?<!\d)((?:18|19|20)\d{2})(?!\d)", 1)).otherwise(own)
    named = F.when(from_text, F.regexp_extract(text, rf"\b({'|'.join(MONTHS)})\b", 1)).otherwise(F.lower(F.trim(F.coalesce(month, F.lit("")))))
    by_name = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), named).cast("int")
    number = F.when(named.rlike(r"^(0?[1-9]|1[0-2])$"), named.cast("int")).when(by_name > 0, by_name)
    d = F.when(from_text, F.lit("")).otherwise(F.trim(F.coalesce(day, F.lit(""))))
    start = F.try_to_date(F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(F.coalesce(number, F.lit(1)).cast("string"), 2, "0"), F.when((d != "") & number.isNotNull(), F.lpad(d, 2, "0")).otherwise("01")), "yyyy-MM-dd")
    precision = F.when(number.isNull(), "year").when(d == "", "month").otherwise("day")
    end = F.when(precision == "year", F.add_months(start, 12) - F.expr("interval 1 day")).when(precision == "month", F.last_day(start)).otherwise(start)
    value = F.struct(start.alias("earliest"), end.cast("date").alias("latest"), precision.alias("precision"))
    return F.when(y.rlike(r"^\d{1,4}$") & start.isNotNull(), value)
