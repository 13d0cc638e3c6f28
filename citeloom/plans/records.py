"""Provider replies, tagged records, strict replies and accounted joins on authored rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.functions.strict import reply_error, strict_error_udf
from citeloom.operators import joins, markers
from citeloom.plans.bibliography import TEXT, _numbered
from citeloom.plans.catalog import example, query, table
from citeloom.sources import articles, providers

_CROSSREF = [
    '{"title": ["Soil", "bacteria"], "author": [{"family": "Roe"}, null, {"name": "Soil Group"}, {"given": "x"}], "issued": {"date-parts": [[2015, 3]]}, "container-title": ["Soil Biology"], "page": "1-9", "DOI": "10.1/ABC", "volume": "7"}',
    '{"issued": {"date-parts": [[null]]}, "DOI": null}',
]
_OPENALEX = [
    '{"display_name": "Soil", "authorships": [{"author": {"display_name": "J. Roe"}}, null, {"author": null}], "host_venue": {"display_name": "Old"}, "biblio": {"first_page": "1", "last_page": "9", "volume": "7"}, "doi": "https://doi.org/10.1/ABC", "publication_year": 2015}',
    '{"title": "T", "primary_location": {"source": {"display_name": "New"}}, "host_venue": {"display_name": "Old"}, "biblio": {"first_page": "e5"}, "publication_year": "n.d."}',
]
_DATACITE = ['{"titles": [{"title": "A set"}, {"x": 1}], "creators": [{"familyName": "Roe", "name": "Roe, J"}, {"name": "Lab"}], "container": {"title": "Archive"}, "doi": "10.5/X", "publicationYear": 2020}', "{}"]
_SHOWN = "id int, title string, authors string, year int, journal string, volume string, pages string, doi string"


def _shown(df, f):
    return df.withColumn("x", f(F.col("a"))).select("id", "x.*").withColumn("authors", F.array_join("authors", "|"))


@example("crossref_records", TEXT, _numbered(_CROSSREF), _SHOWN, _numbered([("Soil bacteria", "Roe|Soil Group", 2015, "Soil Biology", "7", "1-9", "10.1/abc"), ("", "", None, "", "", "", "")]))
def crossref_records(df):
    return _shown(df, providers.crossref)


@example("openalex_records", TEXT, _numbered(_OPENALEX), _SHOWN, _numbered([("Soil", "J. Roe", 2015, "Old", "7", "1-9", "10.1/abc"), ("T", "", None, "New", "", "e5", "")]))
def openalex_records(df):
    return _shown(df, providers.openalex)


@example("datacite_records", TEXT, _numbered(_DATACITE), _SHOWN, _numbered([("A set", "Roe|Lab", 2020, "Archive", "", "", "10.5/x"), ("", "", None, "", "", "", "")]))
def datacite_records(df):
    return _shown(df, providers.datacite)


@example(
    "inverted_abstracts", TEXT,
    _numbered(['{"the": [0, 2], "cat": [1], "saw": [3]}', "{}", '{"a": [0], "b": ["x"]}', '{"a": 5}', "no json", '{"b": [1], "a": [0.5]}']),
    "id int, text string", _numbered(["the cat the saw", "", "", "", "", ""]),
)
def inverted_abstracts(df):
    return df.withColumn("text", providers.inverted_abstract(F.col("a")))


_TAGGED = [
    "\nPMID- 123\nTI  - A long title that\n      goes on\n      and ends.\nAU  - Roe JA\nAU  - van Dam B\nFAU - Roe, Jane A\nCN  - Soil Group\nDP  - 2015 Mar\nDEP - 20141201\nTA  - Soil Biol\nJT  - Soil biology\nVI  - 7\nPG  - 1-9\n"
    "AID - 10.1/abc [doi]\nAID - S1 [pii]\nLA  - eng\nPT  - Journal Article\nPT  - Review\nTT  - Ein Titel\nCIN - Soil. 2016. PMID: 77\nCIN - x PMID: 77\nRIN - PMID: 88\n",
    "PMID- 5\r\nBTI - The Book\r\nFAU - Doe, John\r\nDEP - 20101201\r\nJT  - Books\r\n\r\nLID - 10.2/x. [doi]\r\n",
    "junk without tags",
]


@example(
    "tagged_records", TEXT, _numbered(_TAGGED),
    "id int, resolved boolean, title string, authors string, year int, year_from_dep boolean, journal string, pmid string, doi string, volume string, pages string, is_container boolean, alternate_titles string, language string, publication_types string, related string",
    _numbered([
        (True, "A long title that goes on and ends.", "Roe|van Dam|Soil Group", 2015, False, "Soil Biol", "123", "10.1/abc", "7", "1-9", False, "Ein Titel", "eng", "Journal Article|Review", "CIN=77;RIN=88"),
        (True, "The Book", "Doe", 2010, True, "Books", "5", "10.2/x", "", "", True, "", "", "", ""),
        (False, "", "", None, False, "", "", "", "", "", False, "", "", "", ""),
    ]),
)
def tagged_records(df):
    out = df.withColumn("x", providers.tagged(F.col("a"))).select("id", "x.*")
    out = out.withColumns({c: F.array_join(c, "|") for c in ("authors", "alternate_titles", "publication_types")})
    return out.withColumn("related", F.array_join(F.transform(F.array_sort(F.map_entries("related")), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], ","))), ";"))


@example(
    "strict_json", TEXT,
    _numbered(['{"a": 1, "b": [true, null]}', '{"a": 1, "a": 2}', '{"x": {"a": 1, "a": 1}}', '{"a": 1.5}', '{"a": NaN}', '{"a": "\\ud800"}', "{", None, "[1]"]),
    "id int, error string", _numbered([None, "duplicate_key", "duplicate_key", "float", "constant", "surrogate", "parse", "parse", None]),
)
def strict_json(df):
    return df.withColumn("error", strict_error_udf("a"))


@example(
    "strict_replies", TEXT,
    _numbered(['{"engages": true, "spans": ["s1"], "note": null}', '{"engages": true, "spans": []}', '{"engages": "yes", "spans": [], "note": "x"}', "", '{"engages": true,', '{"engages": true, "engages": true, "spans": [], "note": null}', '[true]', '{"engages": false, "spans": [], "note": "x", "more": 1}']),
    "id int, error string",
    _numbered([None, "schema_key_mismatch", "invalid_schema", "empty_model_response", "malformed_model_response", "schema_key_mismatch", "malformed_model_response", "schema_key_mismatch"]),
)
def strict_replies(df):
    return df.withColumn("error", reply_error(F.col("a"), {"engages": ("boolean",), "spans": ("array",), "note": ("string", "null")}))


@example(
    "entity_relations", "id int, a string, b string",
    _numbered([("x", "x"), ("x", "y"), ("y", "x"), ("x", "z"), ("z", "x"), ("x", "q"), (None, "x")]),
    "id int, relation string", _numbered(["equivalent", "broader", "narrower", "distinct", "distinct", "unknown", "unknown"]),
)
def entity_relations(df):
    known = df.sparkSession.createDataFrame([("x", "y", "broader"), ("z", "x", "distinct")], "a string, b string, relation string")
    return joins.entity_relation(df, known)


@example(
    "clause_spans", "claim_index int, tuple_id string, span string", [(0, "t1", "rats"), (0, "t2", "mice"), (1, "t1", "cats"), (2, "t1", "x")],
    "claim_index int, tuple_id string, clause_id int", [(0, "t1", 1), (0, "t2", 2), (1, "t1", None), (2, "t1", None)],
)
def clause_spans(df):
    clauses = df.sparkSession.createDataFrame([(0, 1, "in rats"), (0, 2, "rats and mice"), (1, 1, "dogs")], "claim_index int, clause_id int, clause string")
    return joins.spans_of_clauses(df, clauses)


@example(
    "span_units", "pmid string, label string, sid string", [("1", "results", "s1"), ("1", "results", "s9"), ("2", "table", "s1")],
    "pmid string, label string, sid string, text string, missing boolean", [("1", "results", "s1", "It rose.", False), ("1", "results", "s9", None, True), ("2", "table", "s1", "a | b", False)],
)
def span_units(df):
    units = df.sparkSession.createDataFrame([("1", "results", "s1", "It rose."), ("2", "table", "s1", "a | b")], "pmid string, label string, sid string, text string")
    return joins.resolved_spans(df, units)


@example(
    "corpus_states", "name string, sha256 string", [("a.xml", "1"), ("b.xml", "2"), ("c.xml", "3")],
    "name string, state string", [("a.xml", "same"), ("b.xml", "changed"), ("c.xml", "absent"), ("d.xml", "extra")],
)
def corpus_states(df):
    return joins.corpus_state(df, df.sparkSession.createDataFrame([("a.xml", "1"), ("b.xml", "9"), ("d.xml", "4")], "name string, sha256 string"))


@example(
    "join_refusals", "id int, matched long, missing long", _numbered([(5, 0), (0, 3), (5, 2)]),
    "id int, ordinary string, whole string, absent string", _numbered([(None, None, "no_disposition"), ("zero_overlap", "zero_overlap", "no_disposition"), (None, "missing_ids", "no_disposition")]),
)
def join_refusals(df):
    return df.withColumns({"ordinary": joins.refusal(F.col), "whole": joins.refusal(F.col, whole=True), "absent": joins.refusal(F.col, supplied=False)})


@example(
    "heading_queries", "id int, headings array<string>", _numbered([(["Stroke", " stroke ", "Rats, Inbred", '"x" [y]'],), ([],), (None,)]),
    "id int, query string", _numbered(['("Stroke"[MeSH Terms] OR "Rats, Inbred"[MeSH Terms] OR "x y"[MeSH Terms])', "", ""]),
)
def heading_queries(df):
    return df.withColumn("query", joins.heading_query(F.col("headings")))


@example(
    "claim_queries", TEXT, _numbered(["Drug-X reduces the risk of stroke, Stroke in rats", "of it", None]),
    "id int, query string", _numbered(['("Drug-X"[Title/Abstract] OR "reduces"[Title/Abstract] OR "risk"[Title/Abstract] OR "stroke"[Title/Abstract] OR "rats"[Title/Abstract])', "", ""]),
)
def claim_queries(df):
    return df.withColumn("query", joins.claim_query(F.col("a")))


@query(
    "enforced_join",
    "SELECT o_orderstatus AS label, count(*) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
)
def enforced_join(spark, sf_dir):
    """Lines with their orders' labels; refused if no order matched, or (here) if a line has none."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("citation_id"))
    supplied = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("citation_id"), F.col("o_orderstatus").alias("label"))
    return joins.enforced(lines, supplied, whole=True).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "full_accounting",
    "WITH e AS (SELECT DISTINCT l_suppkey AS id FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT o_custkey AS id, min(CASE o_orderstatus WHEN 'F' THEN 'cleared' ELSE 'F2' END) AS label FROM orders GROUP BY 1), b AS (SELECT e.id AS e, s.id AS s, label FROM e FULL JOIN s ON e.id = s.id) SELECT count(e) AS expected, count(s) AS supplied, count_if(e IS NOT NULL AND s IS NOT NULL) AS matched, count_if(s IS NULL) AS missing, count_if(e IS NULL) AS extra, count_if(e IS NOT NULL AND label = 'cleared') AS cleared, count_if(e IS NOT NULL AND s IS NOT NULL) / count(e) AS coverage FROM b",
)
def full_accounting(spark, sf_dir):
    """Suppliers of returned lines against customers who ordered, as two id domains."""
    expected = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("citation_id"))
    status = F.when(F.col("o_orderstatus") == "F", "cleared").otherwise("F2")
    supplied = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("citation_id")).agg(F.min(status).alias("label"))
    return joins.accounting(expected, supplied).drop("missing_sample", "extra_sample")


# ---- articles ----

_REFS = (
    '<ref id="k1"><element-citation publication-type="journal"><person-group person-group-type="author"><collab>Dune Survey</collab><name><surname>Lind</surname></name></person-group><article-title>Wind</article-title>'
    "<source>Sand</source><year>1999</year><volume>4</volume><fpage>10</fpage><lpage>12</lpage><pub-id pub-id-type='pmid'>71</pub-id></element-citation></ref>"
    '<ref id="k2"><mixed-citation publication-type="book"><name><surname>Moor</surname></name><person-group person-group-type="editor"><name><surname>Edit</surname></name></person-group><chapter-title>Rain</chapter-title>'
    '<year>2001</year> or <year>2003</year><ext-link ext-link-type="doi" xmlns:xlink="x" xlink:href="10.2/r">r</ext-link></mixed-citation></ref>'
    '<ref id="k3"><element-citation><article-title>Snow</article-title><elocation-id>e9</elocation-id></element-citation></ref>'
)
_M = lambda rid, label: f'<xref ref-type="bibr" rid="{rid}">{label}</xref>'
_PARAGRAPH = f"Dunes move. Wind is strong\n  {_M('k1', '1')}, {_M('k3', '3')} and rain {_M('k2', '2')} weak. Snow again {_M('k3', '3')}."
_ARTICLE = f"<article><front><article-meta><title-group><article-title>Weather</article-title></title-group></article-meta></front><body><sec><title>Intro</title><p>{_PARAGRAPH}</p></sec></body><back><ref-list>{_REFS}</ref-list></back></article>"
ARTICLES = [("PMC5", _ARTICLE), ("PMC6", "<article>")]


def _read(df):
    return articles.references(df.select(F.encode("xml", "UTF-8").alias("content"), "source_id"))


@example(
    "article_references", "source_id string, xml string", ARTICLES,
    "citation_id string, title string, authors string, year int, pages string, claimed_pmid string, publication_type string, is_collab boolean, ext_link string, section string, group_id string, members string, mark int",
    [
        ("PMC5:k1", "Wind", "Dune Survey|Lind", 1999, "10-12", "71", "journal", True, None, "Intro", "PMC5:g01", "PMC5:k1|PMC5:k3|PMC5:k2", 0),
        ("PMC5:k2", "Rain", "Moor", None, None, None, "book", False, "10.2/r", "Intro", "PMC5:g01", "PMC5:k1|PMC5:k3|PMC5:k2", 2),
        ("PMC5:k3", "Snow", "", None, "e9", None, None, False, None, "Intro", "PMC5:g01", "PMC5:k1|PMC5:k3|PMC5:k2", 1),
        (None, None, None, None, None, None, None, None, None, None, None, None, None),
    ],
)
def article_references(df):
    return _read(df).withColumns({"authors": F.array_join("authors", "|"), "members": F.array_join("group_members", "|")})


@example(
    "article_clusters", "source_id string, xml string", ARTICLES,
    "citation_id string, citance string, places string, run int, style string",
    [(f"PMC5:{k}", "Wind is strong 1, 3 and rain 2 weak.", "15,18,29", r, "numeric") for k, r in (("k1", 0), ("k2", 1), ("k3", 0))],
)
def article_clusters(df):
    """Marks of the citing sentence with their places, the run that each reference is in, and the document's style."""
    rows = _read(df).where("citation_id is not null")
    styles = rows.groupBy("source_id").agg(F.flatten(F.collect_list(F.transform("marks", lambda m: m["text"]))).alias("all"))
    out = rows.join(styles.select("source_id", text.citation_style(F.col("all")).alias("style")), "source_id")
    runs = markers.run_numbers(F.col("citance"), F.col("marks"))
    return out.withColumns({"places": F.array_join(F.transform("marks", lambda m: m["at"].cast("string")), ","), "run": F.get(runs, F.col("mark"))})
