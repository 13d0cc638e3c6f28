"""Later work against a claim: notices, candidates and what they prove; entities and their mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true

# Notices from severe to light.
SEVERITY = ("retraction", "expression_of_concern", "correction")
UNSETTLED = ("absent", "unparseable", "boundary_uncertain", "notice_pmid_absent")


def notice_of(notices: DataFrame, key: str) -> DataFrame:
    """(kind, resolution, linked_id) of a work's linked notices (kind, lookup, date_state, linked_id).

    A notice that applies flags the work, one that can't be dated leaves it
    unresolved: the severest decides, a flag before what is open, then the
    smaller id. Where every notice is after the cutoff, the work is clear.
    """
    rank = F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), F.col("kind"))
    flagged = (F.col("lookup") == "ok") & (F.col("date_state") == "compared")
    open_ = (F.col("lookup") != "ok") | F.col("date_state").isin(*UNSETTLED)
    chosen = F.min(F.when(flagged | open_, F.struct(rank.alias("rank"), (~flagged).alias("open"), "linked_id", "kind")))
    found = notices.groupBy(key).agg(chosen.alias("x"), F.min_by("linked_id", F.struct(rank, "linked_id")).alias("first_id"))
    state = F.when(F.col("x").isNull(), "resolved_clear").when(F.col("x.open"), "unresolved").otherwise("flagged")
    return found.select(key, F.coalesce("x.kind", F.lit("none")).alias("kind"), state.alias("resolution"), F.coalesce("x.linked_id", "first_id").alias("linked_id"))


#: What the assessment of a candidate reads.
CANDIDATE = (
    "id int, after_cited boolean, by_as_of boolean, notice string, source_gap boolean, span_verbatim boolean, relation string, directional boolean, comparability string, "
    "independence string, exempt boolean, confidence double, verifier array<boolean>, bound boolean, complete boolean, deployed boolean"
)
#: Least confidence of a candidate (fixed value).
FLOOR = 0.25


def assess(e) -> Column:
    """State of a later work as a candidate against a claim; the first exit that holds.

    A negative is only sure where the source is complete; what lacks something is
    borderline, not a contradiction.
    """
    negative = F.when(is_true(e("complete")), "no").otherwise("unassessable")
    low = F.when(is_true(e("deployed")), F.lit("borderline")).otherwise(negative)
    failed = F.exists(F.coalesce(e("verifier"), F.array().cast("array<boolean>")), is_false)
    none = F.coalesce(F.size(e("verifier")), F.lit(0)) <= 0
    exits = [
        (~is_true(e("after_cited")), F.lit("no")),
        (~is_true(e("by_as_of")), F.lit("no")),
        (F.coalesce(e("notice"), F.lit("")) != "clear", F.lit("unassessable")),
        (is_true(e("source_gap")), F.lit("unassessable")),
        (~is_true(e("span_verbatim")), F.lit("unassessable")),
        (e("relation") == "mixed", F.lit("mixed")),
        (e("relation") == "uncertain", F.lit("borderline")),
        ((e("relation") == "confirms") & (e("comparability") == "not_comparable"), negative),
        ((e("relation") == "confirms") & ~is_true(e("complete")), F.lit("unassessable")),
        (e("relation") == "confirms", F.lit("confirming")),
        ((e("relation") == "opposes") & ~is_true(e("directional")), F.lit("borderline")),
        (~is_true(e("directional")), negative),
        (e("comparability") == "not_comparable", negative),
        (e("independence") == "not_independent", negative),
        (e("confidence").isNull(), F.lit("borderline")),
        (e("confidence") < FLOOR, low),
        (e("comparability") == "uncertain", F.lit("borderline")),
        ((e("independence") == "unknown") & ~is_true(e("exempt")), F.lit("borderline")),
        (failed, F.lit("borderline")),
        (~is_true(e("bound")), F.lit("unassessable")),
        (none & is_true(e("deployed")), F.lit("borderline")),
    ]
    out = None
    for when, state in exits:
        out = F.when(when, state) if out is None else out.when(when, state)
    return out.otherwise("QUALIFYING")


def surfaced(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate that is shown: the most confident, then the smaller id (numbers before texts)."""
    order = F.struct((-F.coalesce("confidence", F.lit(-1.0))).alias("low"), F.coalesce(F.col("work").try_cast("long"), F.lit(2**62)).alias("number"), "work")
    return candidates.groupBy(key).agg(F.min_by("work", order).alias("work"), F.max("confidence").alias("confidence"))


def normalised(mappings: DataFrame, *keys: str) -> DataFrame:
    """(entity, state, exact) of a surface's valid, approved mappings (entity, exact): the only entity, or how many stand against it."""
    found = mappings.groupBy(*keys).agg(
        F.countDistinct("entity").alias("n"), F.count("entity").alias("any"), F.min("entity").alias("first"), F.max(F.coalesce(F.col("exact") & F.col("entity").isNotNull(), F.lit(False))).alias("exact")
    )
    state = first_match([(F.col("n") == 1, "resolved"), (F.col("any") > 0, "ambiguous")], "unresolved")
    return found.select(*keys, F.when(F.col("n") == 1, F.col("first")).alias("entity"), state.alias("state"), F.col("exact"))


def is_confident(how: Column, accepted: Column, registered: Column) -> Column:
    """Whether a mapping may decide: exact, an accepted synonym, or a registered crosswalk."""
    return (how == "exact") | ((how == "synonym") & is_true(accepted)) | ((how == "crosswalk") & is_true(registered))


# ---- journals by authority ----


def journal_keys(name: Column) -> Column:
    """Canonical name, and that without parentheses."""
    from citeloom.functions.titles import canonical_title

    return F.array_distinct(F.filter(F.array(canonical_title(name), canonical_title(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\([^)]*\)", ""))), lambda k: k != ""))


def journal_identity(pairs: DataFrame, authority: DataFrame) -> DataFrame:
    """``match, method, authoritative`` of journal pairs (id, a, b, a_issns, b_issns), strongest evidence first.

    ``authority``: key, journal_id, method. A shared ISSN; one shared id of the
    authority (two ids on a side are ambiguous, and null); the same name; an
    abbreviation. Where the authority knows both and they differ, they differ.
    """
    from citeloom.functions import names, titles

    sides = pairs.withColumns({"ka": journal_keys(F.col("a")), "kb": journal_keys(F.col("b"))})
    sides = sides.withColumns({"ca": titles.canonical_title(F.col("a")), "cb": titles.canonical_title(F.col("b"))})
    sides = sides.withColumn("near", names.same_journal_udf("ca", "cb"))
    known = []
    for side in "ab":
        keys = sides.select("id", F.explode(f"k{side}").alias("key"))
        of = keys.join(authority, "key").groupBy("id").agg(F.collect_set("journal_id").alias(f"ids_{side}"), F.max(F.col("method") == "manual_alias").alias(f"manual_{side}"))
        known.append(of)
    out = sides.join(known[0], "id", "left").join(known[1], "id", "left")
    low = lambda xs: F.filter(F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    both = F.col("ids_a").isNotNull() & F.col("ids_b").isNotNull()
    many = (F.size("ids_a") > 1) | (F.size("ids_b") > 1)
    manual = F.coalesce("manual_a", F.lit(False)) | F.coalesce("manual_b", F.lit(False))
    method = first_match(
        [
            ((F.col("ca") == "") | (F.col("cb") == ""), "unavailable"),
            (F.arrays_overlap(low(F.col("a_issns")), low(F.col("b_issns"))), "issn_intersection"),
            (both & many, "ambiguous_alias"),
            (both & manual, "manual_alias"),
            (both, "authority_alias"),
            (F.col("ca") == F.col("cb"), "exact_text"),
        ],
        "containment_heuristic",
    )
    match = F.when(method.isin("issn_intersection", "exact_text"), True).when(method.isin("manual_alias", "authority_alias"), F.arrays_overlap("ids_a", "ids_b"))
    match = match.when(method == "containment_heuristic", F.col("near"))
    out = out.withColumns({"method": method, "match": match})
    return out.withColumn("authoritative", F.col("method").isin("issn_intersection", "manual_alias", "authority_alias")).select("id", "match", "method", "authoritative")


# ---- whether a later work is asked for at all ----

# Sections, and cues of ownership and of empirical relations.
_METHODS = r"\b(?:methods?|materials|methodology|experimental|procedures?)\b"
_RESULTS = r"\b(?:results?|findings)\b"
_EXTERNAL = r"\b(?:introduction|background|discussion|related\s+work|previous|prior|earlier|literature\s+review)\b"
_OWN = r"\b(?:we|our|us)\b|\b(?:in|for|within)\s+(?:the|this|our)\s+(?:study|trial|cohort|analysis|experiment)\b|^(?:the\s+)?(?:participants?|patients?|subjects?)\s+(?:completed|performed|received|underwent)\b"
_ATTRIBUTED = r"\b(?:et\s+al|previous(?:ly)?|prior|earlier|other)\b.*\b(?:stud(?:y|ies)|reported|showed|found|shown|demonstrated)\b|\b(?:has|have)\s+been\s+(?:shown|reported)\b"
_EMPIRICAL = r"\b(?:increas|decreas|reduc|improv|associat|caus|predict|correlat|prevent|affect|lower|higher|risk)\w*\b"
_DEFINED = r"^.{1,100}?\s+(?:(?:is|are|was|were)\s+defined\s+as|(?:refers?|referred)\s+to)\b[^,;]*[.]?$"
_BOOKISH = r"^(?:the\s+)?(?:article|paper|study|report|review|book)\s+(?:was|is)\s+(?:published|written|authored)\b(?:\s+in\s+(?:19|20)\d{2})?[.]?$"


def activation(claim: Column, section: Column, external: Column, empirical: Column, own: Column) -> Column:
    """(applicability, reason): whether a claim is one that later work could contradict. Only a clear case is excluded; doubt asks.

    Told facts come first; the cues of the text are a narrower list than a
    full reading, so a text may be uncertain here that is told elsewhere.
    """
    text, part = F.lower(F.trim(claim)), F.lower(F.coalesce(section, F.lit("")))
    here = part.rlike(_METHODS) | part.rlike(_RESULTS)
    mine, theirs, relation = text.rlike(_OWN), text.rlike(_ATTRIBUTED), text.rlike(_EMPIRICAL)
    value = lambda a, r: F.struct(F.lit(a).alias("applicability"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    table = [
        (is_true(own) & is_true(external), "uncertain", "explicit_ownership_conflict"),
        (is_true(own), "not_applicable", "explicit_own_study_statement"),
        (is_false(external), "not_applicable", "explicit_not_externally_sourced"),
        (is_false(empirical), "not_applicable", "explicit_not_empirical"),
        (is_true(external) & is_true(empirical) & is_false(own), "eligible", "explicit_external_empirical_claim"),
        (text.rlike(_DEFINED), "not_applicable", "pure_definition"),
        (text.rlike(_BOOKISH), "not_applicable", "bibliographic_statement"),
        (here & mine & theirs, "uncertain", "methods_results_ownership_conflict"),
        (here & mine, "not_applicable", F.when(part.rlike(_METHODS), "clear_current_study_methods").otherwise("clear_current_study_results")),
        (theirs & relation, "eligible", "attributed_external_empirical_claim"),
        (here, "uncertain", "methods_results_ownership_uncertain"),
        (part == "", "uncertain", "source_section_unavailable"),
        (part.rlike(_EXTERNAL) & relation, "uncertain", "external_section_ownership_uncertain"),
    ]
    out = None
    for when, a, r in table:
        out = F.when(when, value(a, r)) if out is None else out.when(when, value(a, r))
    return out.otherwise(value("uncertain", "applicability_ambiguous"))
