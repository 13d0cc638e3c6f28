"""Notices, candidates, entities, journals and replies on authored rows; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import titles
from citeloom.operators import later_work, markers, replies
from citeloom.plans.bibliography import TEXT, _numbered
from citeloom.plans.catalog import example
from citeloom.streaming import barrier


@example(
    "title_furniture", TEXT,
    _numbered([
        "Chapter Nine - Soil bacteria under drought in Spain", "Section II: Short one", "American Heart Association guidelines. Prevention of early stroke in young adults",
        "Roe, J.; van Dam, B.; Lee, K. Soil bacteria under drought stress", "Van Dam, B.; Lee, K. Soil bacteria under drought stress", "Soil bacteria. Under drought", None,
    ]),
    "id int, clean string, excised string",
    _numbered([
        ("Soil bacteria under drought in Spain", "Chapter Nine - "),
        ("Section II: Short one", ""),
        ("Prevention of early stroke in young adults", "American Heart Association guidelines. "),
        ("Roe, J.; van Dam, B.; Lee, K. Soil bacteria under drought stress", ""),
        ("Soil bacteria under drought stress", "Van Dam, B.; Lee, K."),
        ("Soil bacteria. Under drought", ""),
        (None, ""),
    ]),
)
def title_furniture(df):
    return df.withColumn("x", titles.without_furniture(F.col("a"))).withColumns({"clean": F.col("x.title"), "excised": F.col("x.excised")})


@example(
    "linked_notices", "work string, kind string, lookup string, date_state string, linked_id string",
    [("a", "correction", "ok", "compared", "3"), ("a", "retraction", "ok", "absent", "5"), ("a", "retraction", "ok", "compared", "9"), ("b", "correction", "error", "absent", "1"), ("b", "expression_of_concern", "ok", "after_cutoff", "2"),
     ("c", "correction", "ok", "after_cutoff", "8"), ("c", "retraction", "ok", "after_cutoff", "9"), ("d", "correction", "ok", "compared", "7"), ("d", "correction", "ok", "compared", "6")],
    "work string, kind string, resolution string, linked_id string",
    [("a", "retraction", "flagged", "9"), ("b", "correction", "unresolved", "1"), ("c", "none", "resolved_clear", "9"), ("d", "correction", "flagged", "6")],
)
def linked_notices(df):
    return later_work.notice_of(df, "work")


_K = {"after_cited": True, "by_as_of": True, "notice": "clear", "source_gap": False, "span_verbatim": True, "relation": "opposes", "directional": True, "comparability": "comparable", "independence": "independent", "exempt": False, "confidence": 0.9, "verifier": [True, True], "bound": True, "complete": True, "deployed": True}


@example(
    "candidate_exits", later_work.CANDIDATE,
    [(i, *(_K | x).values()) for i, x in enumerate([
        {}, {"after_cited": False}, {"by_as_of": None}, {"notice": "unresolved"}, {"source_gap": True}, {"span_verbatim": False}, {"relation": "mixed"}, {"relation": "uncertain"},
        {"relation": "confirms", "comparability": "not_comparable"}, {"relation": "confirms", "comparability": "not_comparable", "complete": False}, {"relation": "confirms", "complete": False}, {"relation": "confirms"},
        {"directional": False}, {"relation": "other", "directional": False}, {"comparability": "not_comparable"}, {"independence": "not_independent"}, {"confidence": None}, {"confidence": 0.2}, {"confidence": 0.2, "deployed": False},
        {"comparability": "uncertain"}, {"independence": "unknown"}, {"independence": "unknown", "exempt": True}, {"verifier": [True, False]}, {"bound": False}, {"verifier": []}, {"verifier": None, "deployed": False},
    ])],
    "id int, state string",
    _numbered(["QUALIFYING", "no", "no", "unassessable", "unassessable", "unassessable", "mixed", "borderline", "no", "unassessable", "unassessable", "confirming", "borderline", "no", "no", "no", "borderline", "borderline", "no",
               "borderline", "borderline", "QUALIFYING", "borderline", "unassessable", "borderline", "QUALIFYING"]),
)
def candidate_exits(df):
    return df.withColumn("state", later_work.assess(F.col))


@example(
    "surfaced_candidates", "claim int, work string, confidence double", [(1, "20", 0.5), (1, "3", 0.5), (1, "9", 0.4), (2, "x", None), (2, "10", None)],
    "claim int, work string, confidence double", [(1, "3", 0.5), (2, "10", None)],
)
def surfaced_candidates(df):
    return later_work.surfaced(df, "claim")


@example(
    "normalised_entities", "surface string, entity string, exact boolean",
    [("a", "E1", False), ("a", "E1", True), ("b", "E1", False), ("b", "E2", False), ("c", None, None)],
    "surface string, entity string, state string, exact boolean", [("a", "E1", "resolved", True), ("b", None, "ambiguous", False), ("c", None, "unresolved", False)],
)
def normalised_entities(df):
    return later_work.normalised(df, "surface")


@example(
    "confident_mappings", "id int, how string, accepted boolean, registered boolean", _numbered([("exact", None, None), ("synonym", True, None), ("synonym", False, True), ("crosswalk", None, True), ("crosswalk", True, None), ("fuzzy", True, True)]),
    "id int, confident boolean", _numbered([True, True, False, True, False, False]),
)
def confident_mappings(df):
    return df.withColumn("confident", later_work.is_confident(F.col("how"), F.col("accepted"), F.col("registered")))


@example(
    "journal_identity", "id int, a string, b string, a_issns array<string>, b_issns array<string>",
    _numbered([("Life (Basel)", "Life", [], []), ("JAMA", "J Am Med Assoc", [], []), ("Nature", "Science", ["1-2"], ["1-2 ", "3"]), ("Blood", "Blood Adv", [], []), ("Soil Biol", "Soil Biology", [], []), ("Soil", "Soil", [], []), ("", "x", [], []), ("Cell", "Neuron", [], [])]),
    "id int, match boolean, method string, authoritative boolean",
    _numbered([(None, "ambiguous_alias", False), (True, "manual_alias", True), (True, "issn_intersection", True), (False, "authority_alias", True), (True, "containment_heuristic", False), (True, "exact_text", False), (None, "unavailable", False), (False, "containment_heuristic", False)]),
)
def journal_identity(df):
    known = [("life", "1", "x"), ("life", "2", "x"), ("jama", "3", "x"), ("j am med assoc", "3", "manual_alias"), ("blood", "4", "x"), ("blood adv", "5", "x")]
    return later_work.journal_identity(df, df.sparkSession.createDataFrame(known, "key string, journal_id string, method string"))


@example(
    "activations", "id int, claim string, section string, external boolean, empirical boolean, own boolean",
    _numbered([
        ("x", "Results", True, True, True), ("x", None, None, None, True), ("x", None, False, None, None), ("x", None, None, False, None), ("x", None, True, True, False),
        ("Sepsis was defined as organ failure.", None, None, None, None), ("The book was published in 1999.", "Discussion", None, None, None), ("We treated rats.", "2. Methods", None, None, None),
        ("We confirmed that previous studies found it.", "Results", None, None, None), ("Previous studies showed that smoking increases risk.", "Results", None, None, None), ("Smoking is bad.", "Results", None, None, None),
        ("Smoking is bad.", None, None, None, None), ("Smoking increases risk.", "Discussion", None, None, None), ("Smoking is bad.", "Other", None, None, None),
    ]),
    "id int, applicability string, reason string",
    _numbered([
        ("uncertain", "explicit_ownership_conflict"), ("not_applicable", "explicit_own_study_statement"), ("not_applicable", "explicit_not_externally_sourced"), ("not_applicable", "explicit_not_empirical"),
        ("eligible", "explicit_external_empirical_claim"), ("not_applicable", "pure_definition"), ("not_applicable", "bibliographic_statement"), ("not_applicable", "clear_current_study_methods"),
        ("uncertain", "methods_results_ownership_conflict"), ("eligible", "attributed_external_empirical_claim"), ("uncertain", "methods_results_ownership_uncertain"), ("uncertain", "source_section_unavailable"),
        ("uncertain", "external_section_ownership_uncertain"), ("uncertain", "applicability_ambiguous"),
    ]),
)
def activations(df):
    return df.withColumn("x", later_work.activation(*map(F.col, ("claim", "section", "external", "empirical", "own")))).select("id", "x.*")


@example(
    "inferred_members", "doc string, sentence int, at int, label string, rids array<string>, between string",
    [("d", 1, 0, "2", ["r2"], "–"), ("d", 1, 2, "5", ["r5"], "x"), ("d", 2, 0, "1", ["r1"], ", "), ("d", 2, 3, "4", ["r4"], None), ("d", 3, 0, "4", ["r4"], "-"), ("d", 3, 2, "7", ["r7"], None),
     ("e", 1, 0, "1", ["r1"], "-"), ("e", 1, 2, "3", ["r9"], None)],
    "doc string, sentence int, number int, rid string", [("d", 1, 3, "r3"), ("d", 1, 4, "r4")],
)
def inferred_members(df):
    """A range of d's third sentence has an end that the references lack; e's marks don't number its references."""
    refs = [("d", i, f"r{i}") for i in (1, 2, 3, 4, 5)] + [("e", i, f"r{i}") for i in (1, 2, 3)]
    refs = df.sparkSession.createDataFrame(refs, "doc string, ord int, rid string")
    return markers.inferred_members(df, markers.numbering(df.where("label <> '7'"), refs))


@example(
    "occurrence_ids", "source string, citation_id string, at int", [("PMC1", None, 5), ("PMC1", "PMC1:B2", 2), ("", None, 9), ("PMC2", "", 7)],
    "at int, occurrence_id string", [(2, "PMC1:B2"), (5, "PMC1:f2occ2"), (7, "PMC2:f2occ3"), (9, "doc:f2occ4")],
)
def occurrence_ids(df):
    return markers.occurrence_ids(df, "at")


@example(
    "rendered_prompts", "id int, claim string, body string", _numbered([("{body} rose", "text"), (None, "{claim}")]),
    "id int, prompt string", _numbered(["Claim: {body} rose\nText: text.", "Claim: \nText: {claim}."]),
)
def rendered_prompts(df):
    return df.withColumn("prompt", replies.rendered("Claim: {claim}\nText: {body}.", claim=F.col("claim"), body=F.col("body")))


@example(
    "recorded_replies", "id int, prompt string", _numbered(["a", "b", "a", "c"]),
    "id int, reply string, answered boolean", _numbered([("yes", True), ("", True), ("yes", True), (None, False)]),
)
def recorded_replies(df):
    known = df.sparkSession.createDataFrame([("s", "a", "yes"), ("s", "b", ""), ("t", "c", "no")], "seam string, p string, reply string")
    return replies.with_replies(df, known.select("seam", F.sha2("p", 256).alias("prompt_sha256"), "reply"), "s")


@example(
    "budgeted_attempts", "call string, attempt int, bucket string, tries int",
    [("a", 1, "empty", 3), ("a", 2, "empty", 3), ("a", 3, None, None), ("b", 1, "keys", 2), ("b", 2, "empty", 3), ("b", 3, None, None), ("c", 1, "schema", 1), ("c", 2, None, None), ("d", 1, None, None), ("e", 1, "keys", 2), ("e", 2, "keys", 2), ("e", 3, None, None)],
    "call string, attempt int, bucket string, spent boolean", [("a", 3, None, False), ("b", 3, None, False), ("c", 1, "schema", True), ("d", 1, None, False), ("e", 2, "keys", True)],
)
def budgeted_attempts(df):
    return replies.within_budget(df, "call")


@example(
    "merged_ledgers", "stage string, model string, calls long, tokens_in long, tokens_out long", [("x", "m", 1, 10, 2), ("y", "m", 1, 5, 1)],
    "stage string, model string, calls long, tokens_in long, tokens_out long", [("x", "m", 3, 30, 6), ("y", "m", 1, 5, 1)],
)
def merged_ledgers(df):
    return replies.merged_ledgers(df, df.where("stage = 'x'"), df.where("stage = 'x'"))


@example(
    "chain_states", "place int, sha256 string", [(0, "aa"), (1, "bb"), (2, "cc"), (4, "ee")],
    "place int, state string", [(0, "ok"), (1, "mismatch"), (2, "mismatch"), (3, "torn"), (4, "unchained")],
)
def chain_states(df):
    """The second link was written over; the third no longer follows from it; row 3 was lost and row 4 has no link."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    links = [(0, sha("aa")), (1, "forged"), (2, sha(sha(sha("aa") + "bb") + "cc")), (3, "x")]
    return barrier.chain_state(df.sparkSession.createDataFrame(links, "place int, link string"), df)
