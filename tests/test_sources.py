"""Articles, records, sinks and accounted joins from files."""

import pytest
from pyspark.sql import functions as F

from citeloom.operators import joins
from citeloom.sources import articles, sinks
from citeloom.streaming.groups import running_routes, windowed_tally


def ref(rid, inner):
    return f'<ref id="{rid}"><element-citation publication-type="journal">{inner}</element-citation></ref>'


def mark(*rids):
    return f'<xref rid="{" ".join(rids)}" ref-type="bibr">{rids[0][1:]}</xref>'


#: A paragraph cites two works in its second sentence, a table row one, and a caption one that no paragraph has.
WORKS = {
    "r10": "<person-group><collab>Soil Group</collab></person-group><chapter-title>Clay</chapter-title><year>2004</year><elocation-id>e77</elocation-id>",
    "r11": "<name><surname>Okafor</surname></name><article-title>Sand <sub>2</sub></article-title><source>Dune J</source><volume>3</volume><year>1987</year><pub-id pub-id-type='doi'>10.9/s</pub-id>",
    "r12": "<article-title>Silt</article-title><year>2010</year><year>2011</year>",
    "r13": "<article-title>Loam</article-title>",
}
BODY = (
    f"<sec><title>Results</title><p>Plots were dry. Yields fell in vol. 3 of the survey {mark('r11')} and rose later {mark('r12', 'r10')}! Prices did not move.</p>"
    f"<table-wrap><table><tr><td>Farm</td><td>low {mark('r10')}</td></tr></table></table-wrap></sec>"
)


def article(body=BODY):
    refs = "".join(ref(k, v) for k, v in WORKS.items())
    return f"<article><front><article-meta><title-group><article-title>Fields</article-title></title-group></article-meta></front><body>{body}</body><back><ref-list>{refs}</ref-list></back></article>"


@pytest.fixture
def corpus(tmp_path):
    (tmp_path / "PMC70.xml").write_text(article())
    (tmp_path / "PMC71.xml").write_text("<article><body>")
    (tmp_path / "PMC72.xml").write_text(article(BODY + f"<fig><label>{mark('r13')}</label></fig>"))
    (tmp_path / "notes.txt").write_text("no article")
    return tmp_path


def test_references_of_chosen_articles(spark, corpus):
    rows = articles.read_articles(spark, str(corpus), ["PMC70", "PMC71"])
    assert "PMC72" not in str(rows.inputFiles())
    got = {r.citation_id: r for r in rows.collect()}
    assert set(got) == {None, *(f"PMC70:{k}" for k in WORKS)}
    sand, clay = got["PMC70:r11"], got["PMC70:r10"]
    assert sand.citance == "Yields fell in vol. 3 of the survey 11 and rose later 12!" and sand.section == "Results"
    assert (sand.authors, sand.year, sand.journal, sand.volume, sand.claimed_doi) == (["Okafor"], 1987, "Dune J", "3", "10.9/s")
    assert clay.title == "Clay" and clay.pages == "e77" and clay.citance == sand.citance
    assert sand.group_members == ["PMC70:r11", "PMC70:r12", "PMC70:r10"]
    assert got["PMC70:r12"].year is None and got["PMC70:r13"].cited_in_body is False
    assert articles.read_articles(spark, str(corpus), []).collect() == []


def test_marks_that_the_parse_does_not_reach(spark, corpus):
    (corpus / "PMC71.xml").unlink()
    cited = articles.cited_marks(spark, str(corpus))
    refs = articles.read_articles(spark, str(corpus))
    lost = articles.unreached_marks(cited, refs)
    assert cited.where("source_id = 'PMC70'").count() == 3
    assert [tuple(r) for r in lost.collect()] in ([], [("PMC72", "r13")])


def test_sentences_are_verbatim():
    text = "Trials ran (see Figs. 1 and 2). M. Okafor et al. Led them. At 3.5 it stopped? Yes."
    got = articles.sentences(text)
    assert got == ["Trials ran (see Figs. 1 and 2).", "M. Okafor et al. Led them.", "At 3.5 it stopped?", "Yes."]
    assert " ".join(got) == text


def test_sinks(spark, tmp_path, corpus):
    rows = spark.createDataFrame([("b", "F2", None), ("a", "cleared", 1), ("c", "unscoreable", 2), ("d", None, 3)], "citation_id string, label string, n int")
    log, said = sinks.split_log(rows)
    assert log.count() == 4 and {r.citation_id for r in said.collect()} == {"a", "b"}
    sinks.write_lines(log, str(tmp_path / "out"), "citation_id")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines[:2] == ['{"citation_id":"a","label":"cleared","n":1}', '{"citation_id":"b","label":"F2"}']
    found, manifest = sinks.dispositions(rows.where("label is not null"))
    again, other = sinks.dispositions(rows.where("label is not null").orderBy(F.desc("citation_id")))
    first = manifest.first()
    assert found.count() == 3 and first.labels == {"F2": 1, "cleared": 1, "unscoreable": 1} and first.rows_sha256 == other.first().rows_sha256
    assert sinks.dispositions(rows.withColumn("label", F.lit("F2")))[1].first().rows_sha256 != first.rows_sha256
    queue, review = sinks.blind_queue(rows.withColumn("outcome", F.when(F.col("n") == 2, "HUMAN_REVIEW_REQUIRED")), ["citation_id"])
    assert queue.columns == ["citation_id"] and [r[0] for r in review.collect()] == ["c"]
    held = spark.createDataFrame(sinks.corpus_manifest(spark, str(corpus)).collect())
    (corpus / "PMC70.xml").write_text("changed")
    (corpus / "PMC71.xml").unlink()
    states = joins.corpus_state(held, sinks.corpus_manifest(spark, str(corpus)))
    assert {r.name: r.state for r in states.collect()} == {"PMC70.xml": "changed", "PMC71.xml": "absent", "PMC72.xml": "same"}


def test_joins_that_are_refused(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "citation_id string")
    some = spark.createDataFrame([("a", "cleared"), ("x", "F2")], "citation_id string, label string")
    account = joins.accounting(ids, some).first()
    assert (account.matched, account.missing, account.extra, account.cleared, account.missing_sample, account.extra_sample) == (1, 1, 1, 1, ["b"], ["x"])
    assert {tuple(r) for r in joins.enforced(ids, some).collect()} == {("a", "cleared"), ("b", None)}
    for args, options in (((ids, None), {}), ((ids, some.where("label = 'F2'")), {}), ((ids, some), {"whole": True})):
        with pytest.raises(joins.ContractError):
            joins.enforced(*args, **options)
    with pytest.raises(joins.ContractError):
        joins.selected(ids, some)
    assert joins.selected(ids, some.where("label = 'cleared'")).count() == 1
    counts = spark.createDataFrame([("missing", 3), ("no_citance", 4)], "disposition string, n int")
    assert counts.agg(joins.all_missing(counts, "missing", ["no_citance"]).alias("x")).first().x is True


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, True), (1, None), (2, False), (3, True)], "pair long, established boolean").write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema("pair long, established boolean").parquet(str(tmp_path / "v"))
    q = running_routes(stream).writeStream.outputMode("complete").format("memory").queryName("routes").start()
    q.processAllAvailable()
    q.stop()
    assert dict(map(tuple, spark.table("routes").collect())) == {1: "HELD_LOW_CONFIDENCE", 2: "F6_FLAGGED", 3: "FULL_COVERAGE"}
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert windowed_tally(events).count() > 0
