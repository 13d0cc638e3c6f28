"""Stages of a run on authored tables; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.operators import judgment, matching, run, stages
from citeloom.plans.bibliography import PAIRS, TEXT, _numbered, _pair
from citeloom.plans.catalog import example, query, table


@example(
    "provider_title_scores", "ref int, title string", [(1, "Soil bacteria"), (2, "Clay")],
    "ref int, pubmed double, crossref double, openalex double", [(1, 100.0, 0.0, None), (2, None, None, 0.0)],
)
def provider_title_scores(df):
    said = [(1, "pubmed", True, ["Other", "Bacteria, soil."]), (1, "crossref", True, []), (1, "openalex", False, ["Soil bacteria"]), (2, "openalex", True, ["!!"])]
    out = stages.provider_scores(df, df.sparkSession.createDataFrame(said, "ref int, provider string, ok boolean, titles array<string>"))
    return out.select("ref", *[F.col("hits")[p].alias(p) for p in ("pubmed", "crossref", "openalex")])


@example(
    "provider_candidates", "ref int, ord int, doi string, title string", [(1, 0, "10.1/a", "One"), (1, 1, None, "Two")],
    "ref int, doi string, title string", [(1, "10.1/a", "One"), (1, None, "Two"), (1, "10.3/c", "Three")],
)
def provider_candidates(df):
    other = df.sparkSession.createDataFrame([(1, 0, "10.1/A", "x"), (1, 1, "10.2/b", "TWO"), (1, 2, "10.3/c", "Three")], df.schema)
    return stages.merged_candidates(df, other)


@query("id_batches", "SELECT count(DISTINCT c_custkey) AS ids, count(DISTINCT c_custkey) AS placed, TRUE AS bounded, CAST(ceil(count(DISTINCT c_custkey) / 200) AS BIGINT) AS requests FROM customer")
def id_batches(spark, sf_dir):
    """Customers in requests of at most 200 ids."""
    placed = stages.batches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))
    per = placed.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))
    out = per.agg(F.sum("n").alias("placed"), (F.max("n") <= 200).alias("bounded"))
    return out.select(F.col("placed").alias("ids"), "placed", "bounded", stages.requests(F.col("placed")).alias("requests"))


@example(
    "screened_pairs", matching.PAIRS, [PAIRS[0], PAIRS[1], PAIRS[4]],
    "id int, flagged boolean, verdict string, same_title boolean",
    [(0, False, None, True), (1, True, "review_same_work_variant", True), (4, True, "review_wrong_paper", False)],
)
def screened_pairs(df):
    return stages.screened(df).withColumn("same_title", F.col("similarity") == 100)


@example(
    "reranked_candidates", "ref int, ord int, score double, logit double", [(1, 0, 0.9, 0.1), (1, 1, 0.5, 2.0), (2, 0, 0.5, 9.0), (2, 1, 0.9, None), (3, 1, 0.5, None), (3, 0, 0.5, None)],
    "ref int, ord int, place int", [(1, 1, 1), (1, 0, 2), (2, 1, 1), (2, 0, 2), (3, 0, 1), (3, 1, 2)],
)
def reranked_candidates(df):
    return stages.reranked(df, "ref")


@example(
    "slot_coverages", matching.PAIRS,
    _numbered([
        _pair({"title": "Soil bacteria under drought", "authors": ["Okafor A", "Roe B"], "journal": "Dune"}, {"title": "Soil bacteria under drought stress", "authors": ["Okafor A", "Lee C"], "journal": "Dune"}),
        _pair({"title": "drought stress", "authors": ["Soil bacteria under"], "journal": "Dune"}, {"title": "Soil bacteria under drought stress", "authors": ["Okafor A"], "journal": "Dune"}),
        _pair({"title": "", "authors": [], "journal": ""}, {"title": "Clay", "authors": [], "journal": ""}),
    ]),
    "id int, roster double, content double, shifted double, boundary double",
    _numbered([(1.0, 1.0, 0.8, 1.0), (0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 0.0, 0.0)]),
)
def slot_coverages(df):
    """A surname under four letters (Roe) is no part of a roster."""
    return stages.coverages(df)


@example(
    "assembled_evidence", "id int, pmid string", _numbered(["1", "2", None]),
    "id int, abstract string, n int, body string, complete boolean, usable boolean", _numbered([("It rose.", 2, None, None, True), ("N/A", None, "b", False, False), (None, None, None, None, False)]),
)
def assembled_evidence(df):
    make = df.sparkSession.createDataFrame
    out = stages.with_evidence(
        df, make([("1", "It rose."), ("2", "N/A")], "pmid string, abstract string"), make([("1", 1, "x"), ("1", 0, "y")], "pmid string, ord int, cited string"), make([("2", "b", False)], "pmid string, body string, complete boolean")
    )
    return out.withColumn("n", F.when(F.col("references").isNotNull(), F.size("references")))


@example(
    "fetched_records", "id int, pmid string", _numbered(["1", "2", "3", "4", None]),
    "id int, fetch string", _numbered(["answered_record", "answered_absent", "resolver_error", "not_attempted", None]),
)
def fetched_records(df):
    return stages.fetched(df, df.sparkSession.createDataFrame([("1", 200, "r"), ("2", 200, None), ("3", 503, None)], "pmid string, http int, record string"))


@example(
    "provenance_walks", "pair int, claim_index int, cited string, span string", [(1, 0, "C", "s"), (1, 1, "C", "s"), (2, 0, "C", "s"), (3, 0, "C", "s"), (4, 0, "X", "s")],
    "pair int, claim_index int, confirmed boolean, origin string", [(1, 0, True, "50"), (1, 1, False, None), (2, 0, False, None), (3, 0, False, None), (4, 0, False, None)],
)
def provenance_walks(df):
    make = df.sparkSession.createDataFrame
    lists = make([("C", 0, "50"), ("C", 1, "51")], "cited string, ord int, pmid string")
    chosen = make([(1, 0, 0), (2, 0, 0), (3, 0, 1), (4, 0, 0)], "pair int, claim_index int, ord int")
    closed = make([(1, 0, True, "first seen"), (2, 0, True, "not there"), (3, 0, True, "x"), (4, 0, True, "x")], "pair int, claim_index int, contains boolean, origin_span string")
    return stages.provenance(df, lists, chosen, make([("50", "It was first seen here."), ("51", "none")], "pmid string, abstract string"), closed)


@example(
    "refined_supports", "pair int, claim_index int, state string", [(1, 0, "SUPPORTED"), (1, 1, "SUPPORTED"), (1, 2, "UNESTABLISHED"), (2, 0, "SUPPORTED"), (2, 1, "SUPPORTED")],
    "pair int, claim_index int, state string", [(1, 0, "WEAKER_STRENGTH"), (1, 1, "SUPPORTED"), (1, 2, "UNESTABLISHED"), (2, 0, "UNJUDGEABLE"), (2, 1, "UNJUDGEABLE")],
)
def refined_supports(df):
    schema = judgment.STRENGTH.replace("id int", "pair int, claim_index int").rpartition(", verified")[0]
    rows = [(1, 0, "yes", False, "equivalent", "causality", [2, 0, 0, 0], [1, 0, 0, 0], True, 3, 3), (1, 1, "yes", False, "equivalent", "none", [1, 0, 0, 0], [1, 0, 0, 0], True, 3, 3), (2, 0, "yes", False, "equivalent", "causality", [2, 0, 0, 0], [1, 0, 0, 0], True, 3, 3)]
    checks = df.sparkSession.createDataFrame([(1, 0, [True] * 4), (2, 0, [True, True, True, False])], "pair int, claim_index int, verified array<boolean>")
    return stages.refined_support(df, df.sparkSession.createDataFrame(rows, schema), checks)


_A = {"admitted": ["major_guideline_revision", "review"], "kind": "review", "replacement": "7", "candidate": "7", "source": "9", "replaced_on": None, "published_on": "2015-01-01", "attested_on": "2016-01-01", "as_of": "2020-01-01", "span": "replaces it", "source_text": "This replaces it."}


@example(
    "attestations", "id int, admitted array<string>, kind string, replacement string, candidate string, source string, replaced_on string, published_on string, attested_on string, as_of string, span string, source_text string",
    [(i, *(_A | x).values()) for i, x in enumerate([{}, {"kind": "blog"}, {"replacement": "8"}, {"kind": "major_guideline_revision", "source": "7"}, {"attested_on": "2021-01-01"}, {"replaced_on": "2017-01-01"}, {"span": " "}, {"source_text": "Other."}, {"published_on": None}])],
    "id int, valid boolean", _numbered([True, False, False, False, False, False, False, False, False]),
)
def attestations(df):
    return df.withColumn("valid", stages.attestation_valid(F.col))


@example("reachable_types", TEXT, _numbered(['{"gene": {}, "drug": {}}', "{}", "no"]), "id int, types string, reachable boolean, reason string", _numbered([("drug,gene", True, None), ("", False, "no entity type is locked"), ("", False, "authorities do not parse")]))
def reachable_types(df):
    return df.withColumn("x", stages.reachable(F.col("a"))).select("id", "x.*").withColumn("types", F.array_join("types", ","))


_E = {"clause": True, "asserted": True, "evidence": True, "span_verbatim": True, "claimed_state": "resolved", "found_state": "resolved", "claimed_type": "gene", "found_type": "gene", "locked": True, "confident": True, "relation": "provably_distinct", "verified": True}


@example(
    "entity_assessments", stages.TUPLE,
    [(i, *(_E | x).values()) for i, x in enumerate([
        {}, {"clause": False}, {"asserted": False}, {"evidence": None}, {"span_verbatim": False}, {"locked": False}, {"claimed_state": "ambiguous"}, {"found_state": "unresolved"}, {"confident": False},
        {"relation": "equivalent"}, {"relation": "broader"}, {"found_type": "drug"}, {"verified": False}, {"verified": None},
    ])],
    "id int, outcome string, reason string",
    _numbered([
        ("CONFIRMED_MISMATCH", "provably_distinct"), ("UNJUDGEABLE", "clause_not_bound"), ("SAME_ENTITY", "not_asserted"), ("UNJUDGEABLE", "evidence_incomplete"), ("UNJUDGEABLE", "span_not_verbatim"),
        ("UNJUDGEABLE", "authority_not_locked"), ("UNJUDGEABLE", "claimed_entity_unresolved"), ("UNJUDGEABLE", "evidence_entity_unresolved"), ("UNJUDGEABLE", "mapping_not_confident"), ("SAME_ENTITY", "compatible"),
        ("UNJUDGEABLE", "relation_open"), ("UNJUDGEABLE", "cross_type"), ("UNJUDGEABLE", "verifier_disagrees"), ("UNJUDGEABLE", "not_verified"),
    ]),
)
def entity_assessments(df):
    return df.withColumn("x", stages.assess_entity(F.col)).select("id", "x.*")


_OK, _BAD = (True, None, "ok", "supported"), (True, None, "ok", "unsupported")


@example(
    "frozen_dispositions", stages.FROZEN,
    _numbered([(True, "ok", 1, [_OK]), (False, "indeterminate", 1, []), (False, "error", 1, []), (False, "ok", 0, []), (False, "ok", 1, [(False, "evidence_unavailable", None, None)]), (False, "ok", 2, [_OK, (True, None, "error", None)]),
               (False, "ok", 1, []), (False, "ok", 1, [(True, None, "ok", None)]), (False, "ok", 2, [_OK, _BAD]), (False, "ok", 2, [_OK, _OK])]),
    "id int, disposition string", _numbered(["excluded", "quarantined", "held", "held", "held", "quarantined", "unknown", "unknown", "flagged", "clear"]),
)
def frozen_dispositions(df):
    return df.withColumn("disposition", stages.frozen_disposition(F.col))


@query(
    "manifest_funnel",
    "WITH k AS (SELECT 'o_orderstatus' AS kind, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM orders) SELECT * FROM k",
)
def manifest_funnel(spark, sf_dir):
    """Two censuses of the orders and their total in one scan."""
    return stages.funnel(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority")


@query("accounted_funnel", "SELECT unnest(['o_orderstatus', 'o_orderpriority']) AS kind, TRUE AS sound")
def accounted_funnel(spark, sf_dir):
    return stages.is_accounted(stages.funnel(table(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority"))


@example(
    "section_texts", TEXT, _numbered(["Café  \r\nx \t\n\n y ", "\n\na\rb", "", None]),
    "id int, text string", _numbered(["Café\nx\n\n y", "a\nb", "", None]),
)
def section_texts(df):
    return df.withColumn("text", stages.section_text(F.col("a")))


@example("canonical_json", TEXT, _numbered(['{"b": [1, {"z": "é", "a": null}], "a": true}', "[]", "x", None]), "id int, json string", _numbered(['{"a":true,"b":[1,{"a":null,"z":"é"}]}', "[]", None, None]))
def canonical_json(df):
    return df.withColumn("json", stages.canonical_json_udf("a"))


@example(
    "merged_counts", "id int, x map<string,int>, y map<string,int>", _numbered([({"a": 1, "b": 2}, {"b": 3, "c": 4}), ({}, {"a": 1}), ({}, {})]),
    "id int, counts string", _numbered(["a=1,b=5,c=4", "a=1", ""]),
)
def merged_counts(df):
    out = F.map_entries(stages.merged_counts(F.col("x"), F.col("y")))
    return df.withColumn("counts", F.array_join(F.transform(out, lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


# ---- whole runs ----

_WORLD = _numbered([
    _pair({"title": "Early irrigation and yields of barley", "doi": None}, {"title": "Early irrigation and yields of barley", "doi": None}),
    _pair({"title": "Early irrigation and yields of barley", "doi": None}, {"title": "Galaxy rotation in dwarf clusters", "authors": ["Vera R"], "journal": "Stars", "volume": "9", "pages": "1", "doi": None}),
    (_pair({"title": "Terraces and soil loss in uplands", "doi": None})[0], None),
    (_pair({"title": "No such survey was ever made here", "doi": None})[0], None),
    (_pair({"title": "", "doi": None})[0], None),
])


@example(
    "references_run", matching.PAIRS, _WORLD,
    "id int, label string, confidence string, decided_by string",
    _numbered([
        ("cleared", "HIGH", "metadata_match"), ("human_review", "MED", "confirm_not_found_human_review"), ("cleared", "MED", "llm_formatting"),
        ("human_review", "MED", "confirm_not_found_human_review"), ("unscoreable", "HIGH", "unscoreable"),
    ]),
)
def references_run(df):
    """Five references: right, resolved to another work, dead id of a known title, dead id of an unknown one, and no title."""
    none, zero = {"pubmed": None, "crossref": None, "openalex": None}, {"pubmed": 0.0, "crossref": 10.0, "openalex": 0.0}
    rows = [(0, "answered_record", None, none), (1, "answered_record", "fabrication", zero), (2, "answered_absent", "formatting_discrepancy", none), (3, "answered_absent", "fabrication", zero), (4, "answered_absent", None, none)]
    told = df.sparkSession.createDataFrame([(i, True, f, v, h, None, None, None, False) for i, f, v, h in rows], "id int, has_pmid boolean, fetch string, verdict string, hits map<string,double>, retracted boolean, timing string, doi_status string, searched boolean")
    return run.references(df, told)


_CITES = [
    ("a1", "Watering raised yields.", "1", "pmid", "1", True), ("a2", "Watering halved weeds.", "2", "pmid", "2", True), ("a3", "Watering may help bees.", "3", "pmid", "3", True), ("a4", "We thank the growers.", "4", "pmid", "4", True),
    ("a5", "12, 13", "5", "pmid", "5", True), ("a6", None, "6", "pmid", "6", True), ("b1", "Clay holds water.", None, None, None, True), ("b2", "Clay holds water.", "8", "pmid", "8", True), ("b3", "Clay holds water.", "9", "pmid", "9", True),
    ("b4", "Sand is dry.", "10", "doi", None, True), ("b5", "Peat burns and smells.", "11", "pmid", "11", True), ("b6", "Never cited.", None, None, "12", True), ("b7", " ", None, None, "13", False),
]


@example(
    "pairs_run", "citation_id string, citance string, value string, kind string, claimed_pmid string, cited_in_body boolean", _CITES,
    "citation_id string, route string, disposition string, outcome string, reason string",
    [
        ("a1", "FULL_COVERAGE", "held_full_coverage_pending_F3_F5_F7", "UNJUDGEABLE", "held_held_full_coverage_pending_F3_F5_F7"),
        ("a2", "F6_FLAGGED", "predicted", "F6", "taxonomy_finding"),
        ("a3", "HELD_LOW_CONFIDENCE", "held_insufficient_evidence", "UNJUDGEABLE", "held_held_insufficient_evidence"),
        ("a4", "NO_CLAIMS", "held_no_atomic_claims", "NONE", "prose_sentence_asserts_nothing_empirical"),
        ("a5", "NO_CLAIMS", "held_no_atomic_claims", "HUMAN_REVIEW_REQUIRED", "malformed_claim_input"),
        ("a6", None, "excluded_no_citance", "HUMAN_REVIEW_REQUIRED", "empty_claim_input"),
        ("b1", None, "excluded_no_cited_pmid", "UNJUDGEABLE", "preband_excluded_no_cited_pmid"),
        ("b2", None, "excluded_preband_disposition_missing", "UNJUDGEABLE", "preband_excluded_preband_disposition_missing"),
        ("b3", None, "excluded_preband", "UNJUDGEABLE", "preband_excluded_preband"),
        ("b4", None, "excluded_preband", "UNJUDGEABLE", "preband_excluded_preband"),
        ("b5", "F6_FLAGGED", "predicted", "F6", "taxonomy_finding"),
        ("b6", "HELD_LOW_CONFIDENCE", "held_insufficient_evidence", "UNJUDGEABLE", "held_held_insufficient_evidence"),
        ("b7", None, "excluded_no_citance", "UNJUDGEABLE", "uncited_reference"),
    ],
)
def pairs_run(df):
    """Every way out of a run in which only coverage is judged, one pair each."""
    make = df.sparkSession.createDataFrame
    labels = make([*[(f"a{i}", "cleared") for i in range(1, 7)], ("b1", "accurate"), ("b3", "human_review"), ("b4", "F2"), ("b5", "same_work"), ("b6", "cleared"), ("b7", "cleared")], "citation_id string, label string")
    claims = [("Watering raised yields.", 1, None, ["yields rose"]), ("Watering halved weeds.", 1, None, ["weeds halved", "watering was done"]), ("Watering may help bees.", 1, None, ["bees helped"]),
              ("We thank the growers.", 2, True, []), ("12, 13", 2, True, []), ("Peat burns and smells.", 1, None, ["peat burns", "peat smells"]), ("Never cited.", 1, None, ["x"])]
    extracted = make(claims, "sentence string, attempts int, attested boolean, claims array<string>")
    answers = [("1", "yields rose", True), ("2", "weeds halved", False), ("2", "watering was done", True), ("3", "bees helped", None), ("11", "peat burns", None), ("11", "peat smells", False)]
    return run.pairs(df, labels, extracted, make(answers, "pmid string, claim string, established boolean"))
