"""PubMed XML and labelled sections on authored files."""

import datetime

from citeloom.sources import pubmed

ONE = """<PubmedArticle><MedlineCitation Status="MEDLINE"><PMID Version="1">901</PMID><Article PubModel="Print"><Journal><JournalIssue><PubDate><Year>2023</Year><Month>Jan</Month></PubDate></JournalIssue></Journal>
<ArticleTitle>Clay and <i>Bacillus</i>
 in fields.</ArticleTitle><Abstract><AbstractText Label="AIMS">To see.</AbstractText><AbstractText>It <sub>2</sub> rose.</AbstractText></Abstract>
<AuthorList><Author><LastName>Okafor</LastName><ForeName>Ada</ForeName></Author><Author><CollectiveName>Soil Group</CollectiveName></Author></AuthorList>
<DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>NCT1</AccessionNumber></AccessionNumberList></DataBank><DataBank><DataBankName>GEO</DataBankName><AccessionNumberList><AccessionNumber>GSE9</AccessionNumber><AccessionNumber>GSE8</AccessionNumber></AccessionNumberList></DataBank></DataBankList>
<PublicationTypeList><PublicationType UI="D1">Journal Article</PublicationType><PublicationType UI="D2">Review</PublicationType></PublicationTypeList>
<ArticleDate DateType="Electronic"><Year>2019</Year><Month>11</Month><Day>23</Day></ArticleDate></Article>
<CommentsCorrectionsList><CommentsCorrections RefType="RetractionIn"><RefSource>Soil. 2023</RefSource><PMID Version="1">77</PMID></CommentsCorrections><CommentsCorrections RefType="UpdateOf"><PMID Version="1">55</PMID></CommentsCorrections></CommentsCorrectionsList>
<MeshHeadingList><MeshHeading><DescriptorName MajorTopicYN="Y" UI="x">Soil</DescriptorName></MeshHeading><MeshHeading><DescriptorName MajorTopicYN="N" UI="y">Clay</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation>
<PubmedData><ArticleIdList><ArticleId IdType="pubmed">901</ArticleId><ArticleId IdType="doi">10.7/c</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
TWO = "<PubmedArticle><MedlineCitation><PMID>902</PMID><Article><Journal><JournalIssue><PubDate><MedlineDate>1998 Nov-Dec</MedlineDate></PubDate></JournalIssue></Journal><ArticleTitle>Plain</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
NO_DATE = "<PubmedArticle><MedlineCitation><PMID>903</PMID><Article><ArticleTitle>x</ArticleTitle></Article></MedlineCitation></PubmedArticle>"


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text(f'<?xml version="1.0"?>\n<PubmedArticleSet>\n{ONE}\n{TWO}{NO_DATE}</PubmedArticleSet>\n')
    got = {r.pmid: r for r in pubmed.articles(spark, str(tmp_path)).collect()}
    assert set(got) == {"901", "902"}
    one, two = got["901"], got["902"]
    assert one.title == "Clay and Bacillus in fields." and one.abstract == "AIMS: To see.\nIt 2 rose."
    day = datetime.date
    assert (one.earliest, one.latest, one.precision) == (day(2019, 11, 23), day(2019, 11, 23), "day")
    assert (one.issue_earliest, one.issue_latest) == (day(2023, 1, 1), day(2023, 1, 31))
    assert (one.authors, one.headings, one.major_headings) == (["Okafor", "Soil Group"], ["Soil", "Clay"], ["Soil"])
    assert (one.publication_types, one.doi) == (["Journal Article", "Review"], "10.7/c")
    assert (one.registry_ids, one.dataset_ids, one.version_ids) == (["clinicaltrialsgov:NCT1"], ["GSE8", "GSE9"], ["55"])
    assert [(c.kind, c.pmid, c.source) for c in one.corrections] == [("RetractionIn", "77", "Soil. 2023"), ("UpdateOf", "55", None)]
    assert (two.earliest, two.latest, two.precision, two.abstract, two.authors) == (day(1998, 11, 1), day(1998, 11, 30), "month", "", [])


BODY = """<article><body><p>Lead text.</p><sec sec-type="results"><title>What came out</title><p>It rose.</p><sec><title>Primary outcome</title><p>By two.</p></sec><sec><title>Discussion of it</title><p>Odd.</p></sec>
<table-wrap><label>Table 1</label><caption><p>Yields</p></caption><table><tr><th>Farm</th><th>t</th></tr><tr><td>A</td><td/></tr></table></table-wrap></sec><sec><title>Methods</title><fig><label>Fig 1</label><caption><p>A plot.</p></caption></fig><p>We dug.</p></sec>
<sec><title>Odds and ends</title><p>More.</p></sec></body><sub-article><body><p>A review of it.</p></body></sub-article></article>"""


def test_sections_and_completeness(spark):
    bodies = spark.createDataFrame([("1", BODY), ("2", "<article><front/></article>"), ("3", "no xml"), ("4", None), ("5", f"<body><p>{'x' * 1000}</p></body>")], "pmid string, xml string")
    found = pubmed.sections(bodies)
    rows = [(r.label, r.title, r.text) for r in found.where("pmid = '1'").orderBy("ord").collect()]
    assert rows == [
        ("other", "", "Lead text."),
        ("results", "What came out", "It rose."),
        ("results", "Primary outcome", "By two."),
        ("discussion", "Discussion of it", "Odd."),
        ("table", "Table 1", "Yields\n\nFarm | t\nA | "),
        ("methods", "Methods", "We dug."),
        ("figure", "Fig 1", "A plot."),
        ("other", "Odds and ends", "More."),
    ]
    state = {r.pmid: (r.complete, r.reason) for r in pubmed.completeness(bodies, found).collect()}
    assert state == {"1": (False, "body_too_small"), "2": (False, "body_too_small"), "3": (False, "body_too_small"), "4": (False, "not_resolved"), "5": (True, None)}
