"""Matching, scope and decision rules on authored references; the expected rows are stated by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import folding, names, similarity, text, titles
from citeloom.operators import decide, matching, scope
from citeloom.plans.catalog import example, query, table

TEXT = "id int, a string"
PAIR = "id int, a string, b string"


def _numbered(values) -> list[tuple]:
    return [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]


@example(
    "fold_text", TEXT,
    _numbered(["Caf&eacute; <i>β</i>-blockers", "one<br/>two", "λ-phage and Σ; final ς, µm", "1–3 − 5", "ﬁn ²", None]),
    "id int, folded string",
    _numbered(["Cafe  beta -blockers", "one two", "lambda-phage and sigma; final sigma, mum", "1-3 - 5", "fin 2", None]),
)
def fold_text(df):
    return df.withColumn("folded", folding.fold_udf("a"))


@query("folded_documents", "SELECT doc_id, md5(strip_accents(text)) AS folded FROM documents")
def folded_documents(spark, sf_dir):
    """The whole table; its texts have no tags, entities, Greek letters or dashes, so that the fold is that of accents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(folding.fold_udf("text")).alias("folded"))


@example(
    "fold_charges", TEXT,
    _numbered(["Mn(2+) and Mn2+ or Mn 2+.", "Na+ or Cl-, not Na", "Ca ( 2 + ) channel", "Zn + and A - B", "10-12 and pre-war"]),
    "id int, folded string",
    _numbered(["Mn2plus and Mn2plus or Mn2plus.", "Naplus or Clminus, not Na", "Ca2plus channel", "Znplus and A - B", "10-12 and pre-war"]),
)
def fold_charges(df):
    return df.withColumn("folded", folding.fold_charges(F.col("a")))


@example(
    "title_forms", TEXT,
    _numbered(["Étude de la Grippe", "[Results of a trial].", "Erratum: The t-RNA story", "Retraction - Old news", "Γρίπη и грипп", "Correction to  PD-L2 <b>in</b> Ca2+", "", None]),
    "id int, normal string, canonical string, lookup string",
    _numbered([
        ("etude de la grippe", "etude de la grippe", "etude de la grippe"),
        ("results of a trial", "results of a trial", "results of a trial"),
        ("the trna story", "erratum the trna story", "erratum the t rna story"),
        ("old news", "retraction old news", "retraction old news"),
        ("gammarhoιpieta и грипп", "gammarhoιpieta и грипп", "gammarhoιpieta и грипп"),
        ("to pdl2 in ca2plus", "correction to pdl2 in ca2plus", "correction to pd l2 in ca2"),
        ("", "", ""),
        ("", "", ""),
    ]),
)
def title_forms(df):
    return df.withColumns({"normal": titles.normal_title(F.col("a")), "canonical": titles.canonical_title(F.col("a")), "lookup": titles.lookup_title(F.col("a"))})


@example(
    "title_variants", TEXT,
    _numbered(["Biochemistry. Metamorphic proteins.", "Clinical practice. Celiac disease.", "No prefix here", "Gout: x y", ""]),
    "id int, variants string, distinctive boolean",
    _numbered([
        ("biochemistry metamorphic proteins|metamorphic proteins", True),
        ("clinical practice celiac disease|celiac disease", True),
        ("no prefix here", False),
        ("gout x y", False),
        ("", False),
    ]),
)
def title_variants(df):
    return df.withColumns({"variants": F.array_join(titles.title_variants(F.col("a")), "|"), "distinctive": titles.is_distinctive(titles.canonical_title(F.col("a")))})


@example(
    "page_ranges", TEXT,
    _numbered(["1199-8", "141–4", "S141-S144", "S141-4", "123-5, 130-2", "001-9", "212-8; quiz 276", "925-8.e4", "e0224455", "A12-B4", "55", None]),
    "id int, pages string, first string",
    _numbered([
        ("1199-1208", "1199"), ("141-144", "141"), ("s141-144", "141"), ("s141-144", "141"), ("123-125,130-132", "123"), ("001-009", "1"),
        ("212-218", "212"), ("925-928.e4", "925"), ("e0224455", "224455"), ("a12-b4", "12"), ("55", "55"), ("", None),
    ]),
)
def page_ranges(df):
    return df.withColumns({"pages": text.full_pages(F.col("a")), "first": text.first_page(F.col("a"))})


@example(
    "locators", TEXT,
    _numbered(["https://doi.org/10.1000/ABC.", "doi: 10.1/x,;", "http://dx.doi.org/10.2/Y)", " 10.3/z ", "vol. 12a", "7 Suppl 1", None]),
    "id int, doi string, digits string, leading string",
    _numbered([
        ("10.1000/abc", "101000", None), ("10.1/x", "101", None), ("10.2/y", "102", None), ("10.3/z", "103", "10"), ("vol. 12a", "12", None), ("7 suppl 1", "71", "7"), ("", "", None),
    ]),
)
def locators(df):
    return df.withColumns({"doi": text.normal_doi(F.col("a")), "digits": text.digits(F.col("a")), "leading": text.leading_number(F.col("a"))})


@example(
    "names_forms", "id int, name string, marked boolean",
    _numbered([("Smith JA", None), ("van der Berg AB", None), ("Smith, John", None), ("WHO", True), ("American Diabetes Association", None), ("Maria Del Carmen Garcia Lopez", None),
               ("ICH S7A", None), ("Practice Committee: 3", None), ("data from the big registry", None)]),
    "id int, surname string, corporate boolean, implausible boolean",
    _numbered([("Smith", False, False), ("van der Berg", False, False), ("Smith", False, False), ("WHO", True, False), ("American Diabetes Association", True, False),
               ("Maria Del Carmen Garcia Lopez", False, False), ("ICH S7A", False, True), ("Practice Committee: 3", True, False), ("data from the big registry", True, False)]),
)
def names_forms(df):
    n = F.col("name")
    return df.withColumns({"surname": names.medline_surname(n), "corporate": names.is_corporate(n, F.col("marked")), "implausible": names.is_implausible(n)})


@example(
    "surnames", "id int, first string, others array<string>",
    _numbered([("van der berg", ["a okafor", "berg"]), ("okafor", ["a okafor"]), ("smith", ["jones"]), ("smith", []), ("", ["smith"]), ("national committee", ["national committee on x"]), ("smithson", ["smith"])]),
    "id int, present boolean",
    _numbered([True, True, False, None, None, False, True]),
)
def surnames(df):
    return df.withColumn("present", names.surname_present(F.col("first"), F.col("others")))


@example(
    "first_author_aliases", TEXT,
    _numbered(["smith ja", "j smith", "maria de la cruz", "romeo casabona", "national institute of x", "smith jr"]),
    "id int, aliases string",
    _numbered(["smith", "smith", "cruz|de la cruz|maria|maria de la cruz", "casabona|romeo|romeo casabona", "national institute of x", "smith"]),
)
def first_author_aliases(df):
    return df.withColumn("aliases", F.array_join(F.array_sort(names.first_author_aliases(F.col("a"))), "|"))


@example(
    "restored_bodies", "id int, a string, roster array<string>",
    _numbered([("Association AD", ["American Diabetes Association"]), ("Smith JA", ["Smith JA"]), ("Committee NP", ["Nutrition Policy Committee", "x"]), ("Association AD", ["American Heart Association"])]),
    "id int, restored string",
    _numbered(["American Diabetes Association", None, "Nutrition Policy Committee", None]),
)
def restored_bodies(df):
    return df.withColumn("restored", names.restored_body(F.col("a"), F.col("roster")))


@example(
    "trigram_rules", PAIR,
    _numbered([("ab", "ab"), ("abcd", "abce"), ("abcdef", "abc"), ("", "abc")]),
    "id int, jaccard double, containment double",
    _numbered([(0.0, 0.0), (0.3333, 0.5), (0.25, 1.0), (0.0, 0.0)]),
)
def trigram_rules(df):
    x, y = (similarity.trigrams(F.col(c)) for c in "ab")
    return df.withColumns({"jaccard": F.round(similarity.jaccard(x, y), 4), "containment": F.round(similarity.containment(x, y), 4)})


@example(
    "ratio_rules", PAIR,
    _numbered([("new york", "york new"), ("abcd", "abxd"), ("a b c", "a b"), ("smith", "smyth"), ("x", "y")]),
    "id int, plain double, sorted double, sets double",
    _numbered([(50.0, 100.0, 100.0), (75.0, 75.0, 75.0), (75.0, 75.0, 100.0), (80.0, 80.0, 80.0), (0.0, 0.0, 0.0)]),
)
def ratio_rules(df):
    return df.withColumns({k: F.round(f("a", "b"), 4) for k, f in (("plain", similarity.ratio_udf), ("sorted", similarity.token_sort_udf), ("sets", similarity.token_set_udf))})


@example(
    "title_similarity", PAIR,
    _numbered([("Metamorphic proteins", "Biochemistry. Metamorphic proteins."), ("Same title here", "Same title here."), ("", "x"), ("abc", "xyz")]),
    "id int, similarity double",
    _numbered([1.0, 1.0, 0.0, 0.0]),
)
def title_similarity(df):
    forms = df.withColumns({"x": titles.title_variants(F.col("a")), "y": titles.title_variants(F.col("b"))})
    return forms.withColumn("similarity", similarity.variants_similarity(F.col("x"), F.col("y")))


@example(
    "title_extensions", PAIR,
    _numbered([
        ("Thermal interface materials in cooling", "Thermal interfaces materials in cooling of servers"),
        ("Thermal interface materials", "Thermal interface materials in cooling"),
        ("Metal fatigue in aircraft wings", "Metallurgy of fatigue in aircraft wings"),
        ("Post obturation pain in adults", "Postobturation pain in adults after surgery"),
        ("Pain in young adults after surgery", "Pain in old adults after surgery"),
        ("Editorial", "Editorial on interface materials"),
    ]),
    "id int, prefix boolean, extension boolean",
    _numbered([(False, True), (True, True), (False, False), (False, True), (False, False), (False, False)]),
)
def title_extensions(df):
    a, b = titles.normal_title(F.col("a")), titles.normal_title(F.col("b"))
    return df.withColumns({"x": a, "y": b}).withColumns({"prefix": titles.is_strict_prefix(F.col("x"), F.col("y")), "extension": titles.is_strict_extension(F.col("x"), F.col("y"))})


@example(
    "series_conflicts", PAIR,
    _numbered([
        ("Heart Statistics-2017 Update", "Heart Statistics-2019 Update"),
        ("Guideline, Second Edition", "Guideline, 3rd edition"),
        ("The scheme. Part II. Results", "The scheme. Part III. Results"),
        ("X-ray of Populus x canadensis", "An X-ray of the heart"),
        ("Drug given i.v. in 2010", "Drug given i.v. in 2010 and 2012"),
        ("First-line therapy", "Second-line therapy"),
    ]),
    "id int, conflict boolean",
    _numbered([True, True, True, False, False, False]),
)
def series_conflicts(df):
    return df.withColumn("conflict", titles.series_conflict(F.col("a"), F.col("b")))


@example(
    "language_triggers", PAIR,
    _numbered([
        ("Грипп у детей", "Influenza in children"),
        ("Les effets du tabac sur la santé des enfants", "The effects of tobacco on the health of children"),
        ("α-synuclein and β1 in disease", "Synuclein in disease"),
        ("Short le la", "The of and"),
        ("", "x"),
    ]),
    "id int, trigger string",
    _numbered(["script", "stopword", None, None, None]),
)
def language_triggers(df):
    return df.withColumn("trigger", titles.language_trigger(F.col("a"), F.col("b")))


@example(
    "ordered_containment", "id int, short array<string>, long array<string>",
    _numbered([(["a", "bc"], ["x", "a", "b", "c"]), (["a", "b", "zzz"], ["a", "ab"]), (["post", "pain"], ["postop", "pain"]), (["b", "a"], ["a", "b"]), (["ab", "cd"], ["ab", "x", "cd"])]),
    "id int, matched int",
    _numbered([2, 1, 1, 1, 2]),
)
def ordered_containment(df):
    return df.withColumn("matched", similarity.ordered_matches_udf("short", "long"))


@example(
    "journals_alike", PAIR,
    _numbered([("agric food chem", "j agric food chem"), ("antioxidants", "antioxidants basel"), ("angew chem int ed", "angew chem int ed engl"), ("blood", "blood adv"), ("lancet", "nature"), ("", "nature")]),
    "id int, alike boolean",
    _numbered([True, True, True, True, False, False]),
)
def journals_alike(df):
    return df.withColumn("alike", names.same_journal_udf("a", "b"))


# ---- pairs ----

_C = {"title": "Deep learning for protein structure prediction", "authors": ["Smith J", "Doe A"], "year": 2015, "journal": "Nature Methods", "volume": "12", "pages": "100-8", "doi": "10.1/a", "is_collab": None}
_R = {k: v for k, v in _C.items() if k != "is_collab"} | {"authors": ["Smith J", "Doe A"], "pages": "100-108", "year_from_dep": False, "publication_types": [], "alternate_titles": [], "language": "eng"}


def _pair(c: dict | None = None, r: dict | None = None) -> tuple:
    return tuple((_C | (c or {})).values()), tuple((_R | (r or {})).values())


PAIRS = _numbered([
    _pair(),
    _pair({"year": 2011}),
    _pair({"title": "Les effets du tabac sur la santé des enfants"}, {"title": "The effects of tobacco on the health of children", "authors": ["Roe B"], "doi": "10.1/b"}),
    _pair({"title": "Heart disease statistics 2017 update", "doi": None}, {"title": "Heart disease statistics 2019 update"}),
    _pair({"authors": ["Brown K"], "title": "Soil bacteria under drought in Spain", "journal": "Soil Biology", "year": 2009, "volume": "3", "pages": "5", "doi": None}),
    _pair({"doi": None}, {"journal": "bioRxiv", "doi": "10.1101/2020.02.08.939660"}),
    _pair({"authors": ["Association AD"], "title": "Standards of medical care in diabetes", "doi": None},
          {"authors": ["American Diabetes Association"], "title": "Standards of medical care in diabetes"}),
    _pair({"title": "Protein structure", "authors": [], "year": None, "volume": None, "pages": None, "doi": None}, {"title": "Deep learning"}),
    _pair({"title": "Deep learning for protein structure", "doi": None, "pages": None, "volume": None}),
    _pair({"journal": "arXiv", "year": 2012, "title": "Protein structures by learned potentials", "volume": None, "pages": None, "doi": "10.48550/x"}, {"doi": None}),
])


@example(
    "field_agreement", matching.PAIRS, PAIRS,
    "id int, author boolean, first_author boolean, year boolean, journal boolean, volume boolean, pages boolean, doi boolean",
    _numbered([
        (True, True, True, True, True, True, True),
        (True, True, False, True, True, True, True),
        (False, False, True, True, True, True, False),
        (True, True, True, True, True, True, None),
        (False, False, False, False, False, False, None),
        (True, True, True, False, True, True, None),
        (True, True, True, True, True, True, None),
        (None, None, None, True, None, None, None),
        (True, True, True, True, None, None, None),
        (True, True, False, False, None, None, None),
    ]),
)
def field_agreement(df):
    return matching.with_fields(matching.with_forms(df)).select("id", "fields.*")


@example(
    "match_scores", matching.PAIRS, [PAIRS[0], PAIRS[1], PAIRS[3]],
    "id int, score double, title double, override boolean, flagged boolean",
    [(0, 1.0, 1.0, False, False), (1, 1.0, 1.0, False, True), (3, 1.0, 0.9889, False, False)],
)
def match_scores(df):
    scored = matching.with_score(df)
    return scored.withColumns({"title": F.col("title_similarity"), "flagged": matching.is_flagged(scored)})


@example(
    "pair_verdicts", matching.PAIRS, PAIRS,
    "id int, verdict string, reason string",
    _numbered([
        ("match", None),
        ("review_same_work_variant", "shared_doi_same_work"),
        ("out_of_scope_cross_language", "stopword"),
        ("review_wrong_paper", "series_ordinal_conflict"),
        ("review_wrong_paper", "field_disagreement"),
        ("match", None),
        ("review_same_work_variant", "corporate_name_inverted"),
        ("review_formatting", None),
        ("match", None),
        ("review_same_work_variant", "preprint_published_version"),
    ]),
)
def pair_verdicts(df):
    return matching.with_verdict(df)


@example(
    "best_candidates", "ref int, ord int, score double",
    [(1, 0, 0.9), (1, 1, 0.97), (2, 0, 0.95), (2, 1, 0.93), (3, 0, 0.5), (4, 0, 0.9), (4, 1, 0.9), (5, 0, 0.9), (5, 1, 0.85)],
    "ref int, ord int, score double, ambiguous boolean, confident boolean",
    [(1, 1, 0.97, False, True), (2, 0, 0.95, True, False), (3, 0, 0.5, False, False), (4, 0, 0.9, True, False), (5, 0, 0.9, False, True)],
)
def best_candidates(df):
    return matching.best_of(df, "ref")


@example(
    "candidates_kept", "ref int, ord int, doi string, title string",
    [(1, 0, "10.1/A", "One title"), (1, 1, "10.1/a", "Other title"), (1, 2, None, "ONE title."), (1, 3, "10.2/b", "Other title"), (1, 4, None, None), (2, 0, "", "x"), (2, 1, "10.3/c", "X")],
    "ref int, ord int",
    [(1, 0), (1, 3), (2, 0)],
)
def candidates_kept(df):
    return matching.keep_first(df, "ref")


# ---- scope ----

_U = {"title": "A long study of something new", "authors": ["Smith J"], "journal": "Nature", "pmid": "1", "doi": None, "publication_type": "journal", "resolved": True, "r_title": "Another", "r_authors": ["Titelboim D"], "r_journal": "Royal Society Open Science", "is_container": False}


@example(
    "unscoreable_buckets", scope.UNSCOREABLE,
    [(i, *(_U | u).values()) for i, u in enumerate([
        {}, {"publication_type": "Book", "pmid": None, "title": ""}, {"is_container": True}, {"r_title": "[Not Available]"}, {"title": " "}, {"title": "et al."}, {"title": "NATURE"},
        {"title": "Proc. of the National Academy of Sciences of the United States of America (PNAS)"}, {"title": "Zhongguo Zhong yao za zhi = Zhongguo zhongyao zazhi"},
        {"title": "Royal Soc Open Science Titelboim"}, {"title": "Gastroenterology"}, {"title": "1999-2001"}, {"title": "45 CFR 46"}, {"title": "COVID-19"}, {"title": "TITLE 45: PUBLIC WELFARE"},
    ])],
    "id int, bucket string",
    _numbered([None, "non_article_reference", "resolved_book_container", "resolved_no_title", "no_claimed_title", "author_residue_as_title", "journal_as_title", "journal_as_title", "journal_as_title",
               "journal_author_residue_as_title", "single_word_title", "numeric_or_year_only_title", "regulatory_code", None, "regulatory_code"]),
)
def unscoreable_buckets(df):
    return df.withColumn("bucket", scope.unscoreable_bucket(F.col))


@example(
    "scoreable_titles", "id int, title string, journal string",
    _numbered([("A new trial", "Lancet"), ("", "x"), ("[Not Available]", ""), ("J Biol Chem", "J. Biol. Chem."), ("Untitled", None)]),
    "id int, scoreable boolean",
    _numbered([True, False, False, False, False]),
)
def scoreable_titles(df):
    forms = df.withColumns({"own": titles.normal_title(F.col("title")), "masthead": titles.normal_title(F.col("journal"))})
    return forms.withColumn("scoreable", scope.is_scoreable_title(F.col("own"), F.col("masthead")))


@example(
    "structural_exclusions", "id int, citance string, value string, kind string, pmid string, citation_id string",
    _numbered([(" ", "1", "pmid", "1", "PMC1:B1"), ("x", "10.1/a", "doi", None, "PMC12:ref-1"), ("x", None, None, "5", "PMC:B1"), ("x", "", "", " ", "12:B1"), ("x", "1", None, None, "PMC9: B")]),
    "id int, reason string, canonical boolean",
    _numbered([("excluded_no_citance", True), (None, True), (None, False), ("excluded_no_cited_pmid", False), ("excluded_no_cited_pmid", False)]),
)
def structural_exclusions(df):
    return df.withColumns({"reason": scope.structural_exclusion(*map(F.col, ("citance", "value", "kind", "pmid"))), "canonical": scope.is_citation_id(F.col("citation_id"))})


@example(
    "preprints", "id int, journal string, doi string",
    _numbered([("bioRxiv", None), ("Genome Res", "10.1101/gr.209601.116"), ("x", "10.1101/2020.02.08.939660"), (None, "10.48550/arXiv.1"), ("Nature", None)]),
    "id int, preprint boolean",
    _numbered([True, False, True, True, False]),
)
def preprints(df):
    return df.withColumn("preprint", matching.is_preprint(F.col("journal"), F.col("doi")))


@example(
    "evidence_tiers", "id int, hint string, types array<string>, headings array<string>",
    _numbered([("rct", [], []), ("gold", ["Journal Article", "Meta-Analysis"], []), (None, ["Clinical Trial, Phase II"], []), (None, ["Clinical Trial, Phase I"], []), (None, ["Letter"], ["Retrospective Studies"]), (None, None, None), (None, ["Review"], [])]),
    "id int, tier string, basis string, review boolean, retracted boolean",
    _numbered([
        ("rct", "tier_hint:rct", False, False),
        ("systematic_review_or_meta_analysis", "publication_type:meta-analysis", True, False),
        ("rct", "publication_type:clinical trial, phase ii", False, False),
        ("rct", "publication_type_contains:clinical trial", False, False),
        ("retrospective_cohort", "mesh:retrospective studies", False, False),
        ("preprint_unreviewed", "unclassified", None, None),
        ("preprint_unreviewed", "unclassified", True, False),
    ]),
)
def evidence_tiers(df):
    t = F.col("types")
    return df.withColumn("x", scope.evidence_tier(F.col("hint"), t, F.col("headings"))).withColumns({"tier": F.col("x.tier"), "basis": F.col("x.basis"), "review": scope.is_review(t), "retracted": scope.is_retracted(t)})


@example(
    "parse_failure_buckets", TEXT,
    _numbered(["empty model output", "Unterminated string starting at 4", "JSON keys mismatch: sibling_x", "a key is wrong", "span is not verbatim in its bound section", "content_sha256 does not match stored text", None]),
    "id int, bucket string, tries int, longer boolean, outcome string, reason string",
    _numbered([
        ("empty_model_response", 3, True, "HUMAN_REVIEW_REQUIRED", "empty_model_response_after_retry"),
        ("malformed_model_response", 3, True, "HUMAN_REVIEW_REQUIRED", "malformed_model_response_after_retry"),
        ("schema_key_mismatch", 2, False, "UNJUDGEABLE", "schema_key_mismatch_after_retry"),
        ("unclassified_parse_failure", 1, False, "HUMAN_REVIEW_REQUIRED", "schema_contract_failure_after_retry"),
        ("semantic_validation_failure", 1, False, "UNJUDGEABLE", "semantic_validation_failure"),
        ("content_sha256_mismatch", 1, False, "UNJUDGEABLE", "evidence_representation_defect"),
        ("unclassified_parse_failure", 1, False, "HUMAN_REVIEW_REQUIRED", "schema_contract_failure_after_retry"),
    ]),
)
def parse_failure_buckets(df):
    return df.withColumn("x", scope.parse_failure(F.col("a"))).select("id", "x.*")


_E = {"title": "Soil bacteria under drought in southern Spain", "authors": ["Smith J"], "year": "2015", "journal": "Soil Biology", "volume": "12", "pages": "100-8", "doi": "10.1/a"}
_ER = _E | {"is_container": False, "publication_types": []}


@example(
    "same_work_entries", scope.ENTRY,
    [(i, tuple((_E | w).values()), tuple((_ER | r).values())) for i, (w, r) in enumerate([
        ({}, {}),
        ({"title": "Bactéries du sol sous la sécheresse dans le sud de l'Espagne"}, {"title": "The bacteria of the soil under drought"}),
        ({"title": "Ewing Sarcoma. StatPearls. Treasure"}, {"title": "Ewing Sarcoma", "journal": "StatPearls"}),
        ({"title": "Clavicle fracture. Springer"}, {"title": "Clavicle fractures"}),
        ({"title": "Soil bacteria under drought in Spain"}, {"title": "Microbes of soils: soil bacteria under severe drought in Spain"}),
        ({"title": "Soil bacteria under drought in Spain", "volume": "1", "pages": "2", "doi": None}, {"title": "Microbes of soils: soil bacteria under severe drought in Spain"}),
        ({"title": "Soil bacteria under drought Spain"}, {"title": "Commentary on soil bacteria under drought in Spain"}),
        ({"title": "Practice guideline for soils", "authors": ["Practice Committee of the Soil Society"]}, {"title": "Practice guideline for soils", "authors": ["Soil Society Practice Committee"]}),
    ])],
    "id int, verdict string, entry string, address int",
    _numbered([("FLAG", None, 0), ("SAME_WORK", "language", 6), ("SAME_WORK", "container", 0), ("FLAG", "container", 0), ("SAME_WORK", "subset", 6), ("FLAG", "subset", 3), ("FLAG", None, 0), ("SAME_WORK", "corporate", 5)]),
)
def same_work_entries(df):
    return scope.with_entry(df)


# ---- decisions ----

_D = {"retracted": None, "unscoreable": None, "timing": None, "same_work": None, "identity": None, "has_pmid": True, "fetch": "answered_record", "doi": None, "doi_status": None, "flagged": True, "verdict": "fabrication", "hits": {"pubmed": 10.0, "crossref": 20.0, "openalex": 0.0}, "searched": False}
_SOME = {"pubmed": 90.0, "crossref": None, "openalex": None}
_PART = {"pubmed": 10.0, "crossref": None, "openalex": 0.0}
_NONE = {"pubmed": None, "crossref": None, "openalex": None}
DECISIONS = [
    ({"retracted": True, "timing": "qualified"}, ("F8", "HIGH", "f8_retracted_before_citation_timing_met")),
    ({"retracted": True, "unscoreable": "no_claimed_title"}, ("F8", "HIGH", "retracted_publication_pubtype")),
    ({"unscoreable": "journal_as_title"}, ("unscoreable", "HIGH", "unscoreable")),
    ({"timing": "timing_indeterminate"}, ("unscoreable", "HIGH", "f8_timing_indeterminate_excluded")),
    ({"timing": "unresolved"}, ("unscoreable", "HIGH", "f8_timing_boundary_unresolved")),
    ({"same_work": "mixed_identity_citation", "identity": "mixed_identity_conflict"}, ("human_review", "MED", "mixed_identity_conflict_quarantine")),
    ({"same_work": "near_identical_title"}, ("same_work", "HIGH", "same_work_variant_resolved")),
    ({"fetch": "resolver_error"}, ("human_review", "LOW", "pmid_fetch_no_answer")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "found"}, ("F2", "MED", "exact_doi_metadata_mismatch_f2")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "found_no_metadata"}, ("human_review", "MED", "exact_doi_found_metadata_unavailable_hold")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "conflict"}, ("human_review", "LOW", "exact_doi_incomplete_hold")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "answered_absent", "hits": None}, ("human_review", "LOW", "exact_doi_no_confirm")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "answered_absent", "hits": _SOME}, ("F2", "MED", "exact_doi_absent_title_found_f2")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "answered_absent", "hits": _PART}, ("human_review", "LOW", "exact_doi_confirm_incomplete")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "answered_absent"}, ("F1", "HIGH", "exact_doi_absent_confirm_not_found_f1")),
    ({"has_pmid": False}, ("unverifiable", "HIGH", "no_pmid_no_title")),
    ({"has_pmid": False, "searched": True, "flagged": False}, ("cleared", "HIGH", "noid_metadata_match")),
    ({"has_pmid": False, "doi": "10.1/a", "doi_status": "found", "flagged": False, "searched": True}, ("cleared", "HIGH", "noid_metadata_match")),
    ({"flagged": False}, ("cleared", "HIGH", "metadata_match")),
    ({"verdict": None}, ("human_review", "LOW", "no_llm")),
    ({"verdict": "formatting_discrepancy"}, ("cleared", "MED", "llm_formatting")),
    ({"verdict": "uncertain", "hits": {"pubmed": 96.0}}, ("cleared", "MED", "title_search_identity_settled")),
    ({"verdict": "uncertain", "hits": _SOME}, ("unscoreable", "HIGH", "identity_unresolved_after_title_search")),
    ({"hits": None}, ("human_review", "LOW", "no_confirm")),
    ({"hits": _NONE}, ("human_review", "LOW", "confirm_all_errored")),
    ({"has_pmid": False, "searched": True, "hits": _SOME}, ("human_review", "MED", "noid_confirm_found_human_review")),
    ({"hits": _SOME}, ("F2", "MED", "confirm_found_f2")),
    ({"has_pmid": False, "searched": True}, ("human_review", "MED", "noid_confirm_not_found_human_review")),
    ({"hits": _PART}, ("human_review", "LOW", "confirm_incomplete_evidence")),
    ({}, ("human_review", "MED", "confirm_not_found_human_review")),
]


@example("reference_decisions", decide.EVIDENCE, [(i, *(_D | d).values()) for i, (d, _) in enumerate(DECISIONS)], "id int, label string, confidence string, decided_by string", _numbered([w for _, w in DECISIONS]))
def reference_decisions(df):
    return df.withColumn("x", decide.decide(F.col)).select("id", "x.*")


@example(
    "title_search_scores", "id int, hits map<string,double>",
    _numbered([({"pubmed": 96.0, "crossref": None},), ({"pubmed": 0.0},), ({"pubmed": None},), (None,)]),
    "id int, best double, answered boolean, silent boolean, found boolean, missing string",
    _numbered([(96.0, False, False, True, "crossref"), (0.0, True, False, False, ""), (None, False, True, False, "pubmed"), (None, False, False, False, None)]),
)
def title_search_scores(df):
    h = F.col("hits")
    return df.withColumns({"best": decide.best_score(h), "answered": decide.answered(h), "silent": decide.silent(h), "found": decide.found(h), "missing": F.array_join(decide.unanswered(h), ",")})


@example(
    "lookups_needed", decide.EVIDENCE,
    [(i, *(_D | d).values()) for i, d in enumerate([{"retracted": True}, {}, {"flagged": False}, {"has_pmid": False, "doi": "10.1/a", "doi_status": "answered_absent"}, {"verdict": "formatting_discrepancy"}])],
    "id int, doi_check boolean, filter boolean, title_search boolean",
    _numbered([(False, False, False), (False, True, True), (False, False, False), (True, False, True), (False, True, False)]),
)
def lookups_needed(df):
    return df.withColumn("x", decide.needs(F.col)).select("id", "x.*")


@example(
    "finding_names", TEXT,
    _numbered(["F6", "F6_FLAGGED", "FULL_COVERAGE", "SHA256_F1A", "accurate", "cleared", "human_review"]),
    "id int, name string, annotated string, label string",
    _numbered([
        ("Insufficient Support", "F6  (Insufficient Support)", "F6"), ("F6_FLAGGED", "F6_FLAGGED  (Insufficient Support)", None), ("FULL_COVERAGE", "FULL_COVERAGE", None),
        ("SHA256_F1A", "SHA256_F1A", None), ("Accurate", "accurate", "accurate"), ("cleared", "cleared", "accurate"), ("human_review", "human_review", None),
    ]),
)
def finding_names(df):
    return df.withColumns({"name": decide.finding_name(F.col("a")), "annotated": decide.annotated(F.col("a")), "label": decide.data_set_label(F.col("a"))})
