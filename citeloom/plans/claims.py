"""Sentence, marker, rollup and judgment rules on authored rows; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import similarity, text
from citeloom.operators import judgment, markers, rollups
from citeloom.plans.bibliography import TEXT, _numbered
from citeloom.plans.catalog import example


@example(
    "sentence_cuts", TEXT,
    _numbered(["One ends. Two starts here! (Three) is next? Yes.", "See Fig. S1 and vol. 3 of it. Done.", "J. Smith et al. Showed it. E. coli grew.", "At 3.14 it fell. 5 rose.", 'He said "no." "Yes" she said.', "  ", "no end"]),
    "id int, n int, sentences string",
    _numbered([
        (4, "One ends.|Two starts here!|(Three) is next?|Yes."),
        (2, "See Fig. S1 and vol. 3 of it.|Done."),
        (2, "J. Smith et al. Showed it.|E. coli grew."),
        (1, "At 3.14 it fell. 5 rose."),
        (2, 'He said "no."|"Yes" she said.'),
        (0, ""),
        (1, "no end"),
    ]),
)
def sentence_cuts(df):
    return df.withColumn("x", text.sentences(F.col("a"))).withColumns({"n": F.size("x"), "sentences": F.array_join("x", "|")})


@example(
    "section_units", "id int, label string, body string",
    _numbered([("results", "One. Two.\n\n Three rose. Four fell."), ("table", "Gene | 3.1. X\nB | 2"), ("methods", None)]),
    "id int, at int, unit string",
    [(0, 0, "One."), (0, 1, "Two."), (0, 2, "Three rose."), (0, 3, "Four fell."), (1, 0, "Gene | 3.1. X"), (1, 1, "B | 2")],
)
def section_units(df):
    return df.select("id", F.posexplode(text.section_units(F.col("label"), F.col("body"))).alias("at", "unit"))


@example(
    "normal_offsets", "id int, a string, at int",
    _numbered([("  a  b", 2), ("  a  b", 3), ("  a  b", 5), ("  a  b", 0), ("a\n\tb c", 5), ("ab", 1)]),
    "id int, place int",
    _numbered([0, 1, 2, 0, 4, 1]),
)
def normal_offsets(df):
    return df.withColumn("place", text.normal_offset(F.col("a"), F.col("at")))


@example(
    "stems", TEXT,
    _numbered(["antibodies", "antibody", "characterisations", "necessary", "treatments", "rats", "localization", "being"]),
    "id int, stem string",
    # characterisations loses ions and then nothing; localization loses ization; rats and being would keep too little
    _numbered(["antibod", "antibod", "characterisat", "necessar", "treat", "rats", "local", "being"]),
)
def stems(df):
    return df.withColumn("stem", text.stem(F.col("a")))


@example(
    "content_words", TEXT,
    _numbered(["The pH of antibodies was high", "of it, and to", "Rats and mice"]),
    "id int, tokens string",
    _numbered(["antibod|antibodies|high", "", "mice|rats"]),
)
def content_words(df):
    return df.withColumn("tokens", F.array_join(F.array_sort(text.content_tokens(F.col("a"))), "|"))


@example(
    "claim_inputs", TEXT,
    _numbered(["32", "12, 13", "[12]", "(1).", "32 patients were seen", "13,17,18 All procedures", "5.2 %", "We saw 32 patients", " ", None, "–", "2019 was the first year", "[3] It rose"]),
    "id int, status string",
    _numbered(["marker_only", "marker_only", "marker_only", "marker_only", "leading_marker_bleed", "leading_marker_bleed", "numeric_fragment", "prose", "empty", "empty", "marker_only", "leading_marker_bleed", "leading_marker_bleed"]),
)
def claim_inputs(df):
    return df.withColumn("status", text.claim_input_status(F.col("a")))


@example(
    "usable_evidence", TEXT, _numbered(["An abstract", " N/A ", "(No abstract available)", "", None, "Nano"]),
    "id int, usable boolean", _numbered([True, False, False, False, False, True]),
)
def usable_evidence(df):
    return df.withColumn("usable", text.usable_evidence(F.col("a")))


@example(
    "clipped", TEXT, _numbered(["One two. Three four. Five", "One two three four five six", "Short. X"]),
    "id int, clip string, cut boolean", _numbered([("One two. Three four.", True), ("One two three four five", True), ("Short. X", False)]),
)
def clipped(df):
    return df.withColumn("x", text.clip(F.col("a"), 23, 5)).withColumns({"clip": F.col("x.text"), "cut": F.col("x.cut")})


@example(
    "citation_styles", "id int, marks array<string>",
    _numbered([(["1", "2, 3", "4–6", " "],), (["1", "Lang"],), (["1", "2019"],), ([],), (["1", "*"],), (["", " "],), (["[1]"],)]),
    "id int, style string",
    _numbered(["numeric", "author-year", "author-year", "unknown", "unknown", "unknown", "unknown"]),
)
def citation_styles(df):
    return df.withColumn("style", text.citation_style(F.col("marks")))


@example(
    "best_alignments", "id int, quoted string, units array<string>",
    _numbered([("the cat sat", ["a dog ran", "the cat sat down", "cat the sat"]), ("cat", ["cat a", "cat b"]), ("none", ["x", "y"]), ("", ["x"])]),
    "id int, at int, score double",
    _numbered([(2, 1.0), (0, 0.5), (None, None), (None, None)]),
)
def best_alignments(df):
    x = similarity.best_unit(F.col("quoted"), F.col("units"))
    return df.withColumn("x", x).withColumns({"at": F.col("x.at"), "score": F.round("x.score", 4)})


_S = "It was not necessary for translation of labelled antibodies [1], [2] and pH sensitive fluorescent micelles [3] in imaging."


@example(
    "marker_runs", f"id int, sentence string, marks {markers.MARKS}",
    [(0, _S, [(61, "[1]"), (66, "[2]"), (104, "[3]")]), (1, "Both 12, 13 and 14 agree.", [(5, "12"), (9, "13"), (16, "14")]), (2, "No marks.", [])],
    "id int, runs string, places string",
    [(0, "0,0,1", "61-69,104-107"), (1, "0,0,0", "5-18"), (2, "", "")],
)
def marker_runs(df):
    s, m = F.col("sentence"), F.col("marks")
    places = F.transform(markers.runs(s, m), lambda r: F.concat_ws("-", r["at"].cast("string"), r["end"].cast("string")))
    return df.withColumns({"runs": F.array_join(markers.run_numbers(s, m).cast("array<string>"), ","), "places": F.array_join(places, ",")})


@example(
    "claim_attribution", f"id int, sentence string, marks {markers.MARKS}, claims array<string>, own int, style string",
    [
        (0, _S, [(61, "[1]"), (66, "[2]"), (104, "[3]")], ["antibodies were labelled", "micelles were fluorescent"], 1, "numeric"),
        (1, _S, [(61, "[1]"), (66, "[2]"), (104, "[3]")], ["antibodies and micelles differ"], 0, "numeric"),
        (2, _S, [(61, "[1]"), (66, "[2]"), (104, "[3]")], ["antibodies were labelled"], 0, "numeric"),
        (3, _S, [(61, "[1]")], ["antibodies were labelled"], 0, "numeric"),
        (4, _S, [(61, "[1]"), (104, "[3]")], ["x"], 0, "author-year"),
        (5, _S, [(61, "[1]"), (104, "[3]")], [], 0, "numeric"),
    ],
    "id int, assigned string, status string, reason string",
    [
        (0, "0,1", "scoped", ""),
        (1, "?", "whole_sentence", "ambiguous"),
        (2, "0", "whole_sentence", "cluster_without_claims"),
        (3, "0", "whole_sentence", "single_marker_cluster"),
        (4, "?", "whole_sentence", "citation_style_not_numeric"),
        (5, "", "whole_sentence", "no_atomic_claims"),
    ],
)
def claim_attribution(df):
    out = df.withColumn("runs", markers.runs(F.col("sentence"), F.col("marks")))
    out = out.withColumn("own_text", markers.regions(F.col("sentence"), F.col("runs"))).withColumn("anchors", markers.anchors(F.col("own_text")))
    out = out.withColumn("told", markers.claim_runs(F.col("own_text"), F.col("anchors"), F.col("claims")))
    out = out.withColumn("x", markers.scope(F.col("style"), F.size("runs"), F.col("own"), F.size("claims"), F.col("told")))
    return out.withColumns({"assigned": F.array_join(F.col("told").cast("array<string>"), ",", "?"), "status": F.col("x.status"), "reason": F.col("x.reason")})


@example(
    "partition_keys", "id int, run string, sentence string, citation_id string",
    _numbered([("PMC1:c02", "PMC1:g01", "PMC1:B1"), ("", "PMC1:g01", "PMC1:B2"), (None, " ", "PMC1:B3")]),
    "id int, key string", _numbered(["PMC1:c02", "PMC1:g01", "~solo~PMC1:B3"]),
)
def partition_keys(df):
    return df.withColumn("key", markers.partition_key(F.col("run"), F.col("sentence"), F.col("citation_id")))


@example(
    "entity_rollup", "pair int, tuple_id string, outcome string, reason string",
    [(1, "b", "UNJUDGEABLE", "late"), (1, "a", "UNJUDGEABLE", "early"), (1, "0", "CONFIRMED_MISMATCH", "x"), (2, "b", "CONFIRMED_MISMATCH", "x"), (2, "a", "SAME_ENTITY", None), (3, "a", "SAME_ENTITY", None)],
    "pair int, state string, reason string, tuple_id string",
    [(1, "UNJUDGEABLE", "early", "a"), (2, "DIFFERENT_ENTITY_SUPPORTED", "different_entity_supported", "b"), (3, "SAME_ENTITY", "all_same_entity", None)],
)
def entity_rollup(df):
    return rollups.entity_of_claim(df, "pair")


_Q, _N, _U = "QUALIFYING_CONTRADICTION", "NO_QUALIFYING_CONTRADICTION", "UNJUDGEABLE"


@example(
    "temporal_rollup", "pair int, claim_index int, supported boolean, applies boolean, state string",
    [(1, 0, True, True, _U), (1, 2, True, True, _Q), (1, 1, True, True, _Q), (2, 0, False, True, _Q), (2, 1, True, True, _U), (3, 0, True, False, None), (3, 1, False, True, _Q), (4, 0, True, True, _N)],
    "pair int, state string, claim_index int, why string",
    [(1, _Q, 1, "qualifying"), (2, _U, None, "held"), (3, _N, None, "no applicable supported claim"), (4, _N, None, "none qualifies")],
)
def temporal_rollup(df):
    return rollups.temporal_of_pair(df, "pair")


@example(
    "provenance_rollup", "pair int, claim_index int, verdict string, span string, abstract string, confirmed boolean",
    [(1, 0, "unclear", None, "x", None), (1, 1, "restatement", "as shown", "it is as shown before", True), (2, 0, "originates", None, "x", None), (2, 1, "not_origin_sensitive", None, "x", None),
     (3, 1, "restatement", "", "x", None), (3, 0, "unclear", None, "x", None), (3, 2, "unclear", None, "x", None), (4, 0, "restatement", "not there", "x", True), (5, 0, "restatement", "x", "x y", False), (6, 0, "other", None, "x", None)],
    "pair int, state string, claim_index int, why string",
    [(1, "CONFIRMED", 1, None), (2, "PROPER_ORIGIN", None, None), (3, _U, None, "unclear claim held; restatement without an anchoring span"),
     (4, _U, None, "restatement span is not verbatim in the cited abstract"), (5, _U, None, "restatement not confirmed within hop budget"), (6, _U, None, "provenance unresolved")],
)
def provenance_rollup(df):
    return rollups.provenance_of_pair(df, "pair")


_L = {"label": "cleared", "decided_by": "metadata_match", "has_pmid": True, "fetch": "answered_record", "resolved": True, "hits": None, "same_work": None, "unscoreable": None, "override": False, "flagged": False}
LOGS = [tuple((_L | x).values()) for x in [
    {}, {"override": True}, {"label": "F2", "flagged": True, "hits": {"pubmed": 90.0, "crossref": None}, "decided_by": "confirm_found_f2"},
    {"label": "unscoreable", "unscoreable": "journal_as_title"}, {"label": "unscoreable", "unscoreable": ""}, {"label": "same_work", "same_work": "shared_doi_same_work", "flagged": True},
    {"label": "unverifiable", "has_pmid": False, "fetch": None, "resolved": None}, {"label": "human_review", "fetch": "resolver_error", "resolved": False, "decided_by": "pmid_fetch_no_answer"},
    {"label": "F1", "has_pmid": False, "fetch": None, "hits": {"pubmed": 0.0, "crossref": 1.0}, "flagged": True}, {"label": "human_review", "fetch": "", "decided_by": "no_llm", "flagged": True},
]]


@example(
    "measurement_report", rollups.LOG, LOGS,
    "total long, scoreable long, unverifiable long, unscoreable_total long, same_work_total long, pmid_bearing long, pmid_resolved long, flagged_total long, f1_count long, f2_count long, override_cleared long, attempted long, answered long, transport_failed long, transport_unrecorded long, confirm_complete long, confirm_incomplete long, confirm_skipped_benign long, confirm_skipped_prevented long, quarantine_exception long, base_rate double",
    [(10, 6, 1, 2, 1, 6, 5, 4, 1, 1, 1, 8, 6, 1, 1, 1, 1, 6, 1, 0, 0.166667)],
)
def measurement_report(df):
    return rollups.measurement(df)


@example("excluded_reasons", rollups.LOG, LOGS, "kind string, reason string, n long", [("unscoreable", "journal_as_title", 1), ("unscoreable", "unspecified", 1), ("same_work", "shared_doi_same_work", 1)])
def excluded_reasons(df):
    return rollups.reasons(df)


@example("source_completeness", "pmid string, text string", [("1", "x" * 600), ("1", "y" * 400), ("2", "x" * 999), ("3", None)], "pmid string, chars long, complete boolean", [("1", 1000, True), ("2", 999, False), ("3", 0, False)])
def source_completeness(df):
    return rollups.complete_source(df, "pmid")


_IDS = "array<struct<pmid: string, doi: string>>"


@example(
    "gold_scores", f"id int, gold {_IDS}, said {_IDS}, label string, supported array<boolean>",
    _numbered([([("1", "")], [("1", "10.1/a")], "F6", [True, False]), ([("", "10.1/A")], [("2", "10.1/a")], "F6", [True]), ([("1", "")], [], "F2", [False]), ([], [], "accurate", [True]), ([], [("1", "")], "F6", [None])]),
    "id int, repaired boolean, conflict string",
    _numbered([(True, None), (True, "F6 without an unsupported claim"), (False, "unsupported claim without F6"), (True, None), (False, "F6 without an unsupported claim")]),
)
def gold_scores(df):
    return df.withColumns({"repaired": rollups.same_references(F.col("gold"), F.col("said")), "conflict": rollups.gold_conflict(F.col("label"), F.col("supported"))})


_J = {"cleared": True, "before": ["SUPPORTED"], "support": ["SUPPORTED"], "excused": [False], "entities": ["SAME_ENTITY"], "provenance": "PROPER_ORIGIN", "temporal": _N, "temporal_claim": None}


@example(
    "pair_judgments", judgment.PAIR,
    [(i, *(_J | x).values()) for i, x in enumerate([
        {}, {"cleared": False}, {"entities": ["DIFFERENT_ENTITY_SUPPORTED"]}, {"before": ["UNESTABLISHED"], "support": ["UNESTABLISHED"], "provenance": None},
        {"before": ["UNESTABLISHED"], "support": ["UNESTABLISHED"], "excused": [True], "provenance": None}, {"support": ["WEAKER_STRENGTH"]}, {"provenance": "CONFIRMED"},
        {"temporal": _Q, "temporal_claim": 0}, {"provenance": "UNJUDGEABLE", "temporal": _U}, {"before": [], "support": [], "excused": [], "entities": [], "provenance": None},
        {"support": ["WEAKER_STRENGTH"], "temporal": _Q, "temporal_claim": 0}, {"entities": ["DIFFERENT_ENTITY_SUPPORTED", "UNJUDGEABLE"]},
    ])],
    "id int, status string, findings string, primary string, holds string",
    _numbered([
        ("TERMINAL", "", "accurate", ""), ("OUTSIDE_BAND", "", None, ""), ("TERMINAL", "F7", "F7", ""), ("TERMINAL", "F6", "F6", ""), ("HELD", "", None, "attributed_to_co_cited"),
        ("TERMINAL", "F4", "F4", ""), ("TERMINAL", "F3", "F3", ""), ("TERMINAL", "F5", "F5", ""), ("HELD", "", None, "provenance,temporal"), ("HELD", "", None, "no_claims"),
        ("CONTRACT_ERROR", "", None, ""), ("HELD", "F7", None, "entity"),
    ]),
)
def pair_judgments(df):
    out = df.withColumn("x", judgment.judge(F.col)).select("id", "x.*")
    return out.withColumns({c: F.array_join(c, ",") for c in ("findings", "holds")})


_P = {"retrievable": True, "n_claims": 1, "extraction_failed": False, "findings": [], "solo": "FULL_COVERAGE", "route": "solo", "excused": False, "unjudgeable_before": False, "unjudgeable": False, "provenance": None}


@example(
    "dispositions", judgment.DISPOSED,
    [(i, *(_P | x).values()) for i, x in enumerate([
        {"retrievable": False}, {"n_claims": 0, "extraction_failed": True}, {"n_claims": 0}, {"findings": ["F4", "F7"]}, {"findings": ["F6"], "solo": "F6_FLAGGED"},
        {"solo": "F6_FLAGGED", "route": "GROUP_COVERED", "excused": True}, {"findings": ["F3", "F4"]}, {"route": "UNSUPPORTED_MEMBER"}, {"unjudgeable": True, "unjudgeable_before": True},
        {"unjudgeable": True}, {"provenance": "PROPER_ORIGIN"}, {},
    ])],
    "id int, disposition string",
    _numbered(["held_insufficient_evidence", "held_claim_extraction_failure", "held_no_atomic_claims", "predicted_F7", "predicted_F6", "held_cocitation_covered", "predicted_F4", "held_unsupported_cocitation_member",
               "held_insufficient_evidence", "held_strength_unjudgeable", "held_pending_F5_F7", "held_provenance_unjudgeable"]),
)
def dispositions(df):
    return df.withColumn("disposition", judgment.disposition(F.col))


_O = {"citation_id": "PMC1:B1", "findings": [], "sentence": "x", "input": "prose", "cited_in_body": True, "retrievable": True, "disposition": "predicted", "failure": None, "failure_outcome": None, "n_claims": 1, "attested": False, "attempts": 1, "stage_failed": False, "holds": []}


@example(
    "record_outcomes", judgment.RECORD,
    [(i, *(_O | x).values()) for i, x in enumerate([
        {"citation_id": " "}, {"findings": ["F5", "F6"]}, {"input": "empty", "cited_in_body": False}, {"input": "empty"}, {"input": "marker_only"}, {"retrievable": False}, {"disposition": "excluded_preband"},
        {"failure": "invalid_schema_response", "failure_outcome": "UNJUDGEABLE"}, {"n_claims": 0, "attested": True, "attempts": 2}, {"n_claims": 0, "attempts": 2}, {"stage_failed": True},
        {"holds": ["entity"], "disposition": "pending"}, {},
    ])],
    "id int, outcome string, reason string",
    _numbered([
        ("HUMAN_REVIEW_REQUIRED", "corrupt_source_record"), ("F6", "taxonomy_finding"), ("UNJUDGEABLE", "uncited_reference"), ("HUMAN_REVIEW_REQUIRED", "empty_claim_input"), ("HUMAN_REVIEW_REQUIRED", "malformed_claim_input"),
        ("UNJUDGEABLE", "cited_text_unavailable"), ("UNJUDGEABLE", "preband_excluded_preband"), ("UNJUDGEABLE", "invalid_schema_response"), ("NONE", "prose_sentence_asserts_nothing_empirical"),
        ("HUMAN_REVIEW_REQUIRED", "claim_extraction_empty_after_retry"), ("UNJUDGEABLE", "stage_failure"), ("UNJUDGEABLE", "held_pending"), ("NONE", "all_wired_stages_ran_no_fault"),
    ]),
)
def record_outcomes(df):
    return df.withColumn("x", judgment.outcome(F.col)).select("id", "x.*")


@example("support_states", "id int, established boolean", _numbered([True, False, None]), "id int, state string", _numbered(["SUPPORTED", "UNESTABLISHED", "UNJUDGEABLE"]))
def support_states(df):
    return df.withColumn("state", judgment.support_state(F.col("established")))


_T = {"subject": "yes", "owned": False, "population": "equivalent", "dimension": "causality", "citing": [2, 0, 0, 0], "cited": [1, 0, 0, 0], "spans_verbatim": True, "citing_tokens": 3, "cited_tokens": 3, "verified": [True, True, True, True]}


@example(
    "claim_strength", judgment.STRENGTH,
    [(i, *(_T | x).values()) for i, x in enumerate([
        {}, {"subject": "no"}, {"owned": True}, {"population": "citing_narrower"}, {"dimension": "none", "citing": [1, 0, 0, 0]}, {"dimension": "none"}, {"dimension": "none", "citing": [1, 0, None, 0]},
        {"dimension": "unknown"}, {"citing": [1, 0, 0, 0]}, {"citing": [None, 0, 0, 0]}, {"dimension": "population", "citing": [0, 0, 0, 1]}, {"dimension": "population", "population": "citing_broader", "citing": [0, 0, 0, 1]},
        {"spans_verbatim": False}, {"citing_tokens": 1}, {"verified": [True, True, None, True]}, {"verified": []},
    ])],
    "id int, strength string",
    _numbered(["confirmed", "hold", "hold", "hold", "supported", "hold", "hold", "hold", "hold", "hold", "hold", "confirmed", "hold", "hold", "candidate", "candidate"]),
)
def claim_strength(df):
    return df.withColumn("strength", judgment.strength(F.col))


_M = {"notice": "clear", "cited_gap": False, "n_qualifying": 0, "searched": True, "adequate": True, "n_candidates": 3, "cited_complete": True, "n_open": 0, "eligible": True, "deployed": True, "capped": False, "surfaced": False}


@example(
    "claim_times", "id int, notice string, cited_gap boolean, n_qualifying int, searched boolean, adequate boolean, n_candidates int, cited_complete boolean, n_open int, eligible boolean, deployed boolean, capped boolean, surfaced boolean",
    [(i, *(_M | x).values()) for i, x in enumerate([{"notice": "unresolved"}, {"notice": "retracted", "surfaced": True}, {"cited_gap": True}, {"n_qualifying": 1}, {"n_qualifying": 1, "capped": True}, {}, {"n_open": 1}, {"n_candidates": 0}])],
    "id int, state string, path string",
    _numbered([(_U, "unknown"), (_U, "B"), (_U, "unknown"), (_Q, "A"), (_Q, "B"), (_N, "not_F5"), (_U, "unknown"), (_U, "unknown")]),
)
def claim_times(df):
    out = df.withColumn("state", judgment.claim_time(F.col))
    return out.withColumn("path", judgment.time_path(*map(F.col, ("state", "eligible", "deployed", "capped", "surfaced"))))


@example(
    "date_intervals", "id int, y string, m string, d string, free string",
    _numbered([("2020", "Feb", "", None), ("2020", "2", "29", None), ("2019", "", "5", None), ("2019", "2", "30", None), ("", "", "", "2018 Nov-Dec"), (None, None, None, "Winter 1999"), ("", "", "", "n.d."), ("2021", "12", "", None)]),
    "id int, earliest string, latest string, precision string",
    _numbered([
        ("2020-02-01", "2020-02-29", "month"), ("2020-02-29", "2020-02-29", "day"), ("2019-01-01", "2019-12-31", "year"), (None, None, None), ("2018-11-01", "2018-11-30", "month"),
        ("1999-01-01", "1999-12-31", "year"), (None, None, None), ("2021-12-01", "2021-12-31", "month"),
    ]),
)
def date_intervals(df):
    x = df.withColumn("x", judgment.date_interval(*map(F.col, ("y", "m", "d", "free"))))
    return x.withColumns({"earliest": F.col("x.earliest").cast("string"), "latest": F.col("x.latest").cast("string"), "precision": F.col("x.precision")})
