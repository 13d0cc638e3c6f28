"""PubMed article XML and labelled sections of JATS bodies, with Spark's XML functions."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.operators.judgment import date_interval

_DATE = "struct<Year: string, Month: string, Day: string, MedlineDate: string>"
_ARTICLE = f"""struct<
 MedlineCitation: struct<
  PMID: struct<_VALUE: string>,
  Article: struct<
   ArticleTitle: string, ArticleDate: array<{_DATE}>, Journal: struct<JournalIssue: struct<PubDate: {_DATE}>>,
   Abstract: struct<AbstractText: array<struct<_VALUE: string, _Label: string>>>,
   AuthorList: struct<Author: array<struct<LastName: string, ForeName: string, CollectiveName: string>>>,
   PublicationTypeList: struct<PublicationType: array<struct<_VALUE: string>>>,
   DataBankList: struct<DataBank: array<struct<DataBankName: string, AccessionNumberList: struct<AccessionNumber: array<string>>>>>>,
  MeshHeadingList: struct<MeshHeading: array<struct<DescriptorName: struct<_VALUE: string, _MajorTopicYN: string>>>>,
  CommentsCorrectionsList: struct<CommentsCorrections: array<struct<_RefType: string, PMID: struct<_VALUE: string>, RefSource: string, Note: string>>>>,
 PubmedData: struct<ArticleIdList: struct<ArticleId: array<struct<_VALUE: string, _IdType: string>>>>>""".replace("\n", "")
#: Marks inside a text that carry none of it.
_INLINE = r"</?(?:i|b|u|sub|sup|sc|mml:[a-z]+|math)(?:\s[^>]*)?/?>"
# Names of trial registries, and relations of versions of one work.
REGISTRIES = ("clinicaltrials", "isrctn", "eudract", "chictr", "trial")
VERSIONS = "republishedin republishedfrom updatein updateof correctedandrepublishedin correctedandrepublishedfrom preprintof haspreprint".split()


def article(xml: Column) -> Column:
    """Metadata of one ``PubmedArticle`` element; null if it has no PMID of digits or no date.

    The date is the electronic article's, else the issue's; ``issue_earliest``
    and ``issue_latest`` are always the issue's, as a converted notice moves only
    that.
    """
    x = F.from_xml(F.regexp_replace(xml, _INLINE, ""), _ARTICLE, {"rowTag": "PubmedArticle"})
    cite = x["MedlineCitation"]
    a = cite["Article"]
    none = lambda t: F.array().cast(f"array<{t}>")
    texts = lambda xs, of: F.filter(F.coalesce(F.transform(xs, lambda y: F.trim(F.regexp_replace(of(y), r"\s+", " "))), none("string")), lambda t: t.isNotNull() & (t != ""))
    of_date = lambda d: date_interval(d["Year"], d["Month"], d["Day"], d["MedlineDate"])
    issue = of_date(a["Journal"]["JournalIssue"]["PubDate"])
    found = F.coalesce(of_date(F.get(a["ArticleDate"], 0)), issue)
    abstract = F.transform(
        F.filter(a["Abstract"]["AbstractText"], lambda t: F.trim(F.coalesce(t["_VALUE"], F.lit(""))) != ""),
        lambda t: F.concat(F.when(F.coalesce(t["_Label"], F.lit("")) != "", F.concat(t["_Label"], F.lit(": "))).otherwise(""), F.trim(F.regexp_replace(t["_VALUE"], r"\s+", " "))),
    )
    short = lambda p: F.coalesce(F.nullif(F.trim(p["CollectiveName"]), F.lit("")), F.trim(p["LastName"]))
    headings = cite["MeshHeadingList"]["MeshHeading"]["DescriptorName"]
    banks = F.coalesce(a["DataBankList"]["DataBank"], none("struct<DataBankName: string, AccessionNumberList: struct<AccessionNumber: array<string>>>"))
    is_registry = lambda b: F.greatest(*[F.lower(F.coalesce(b["DataBankName"], F.lit(""))).contains(r) for r in REGISTRIES])
    space = lambda b: F.regexp_replace(F.lower(b["DataBankName"]), "[^a-z0-9]", "")
    numbers = lambda b: F.coalesce(b["AccessionNumberList"]["AccessionNumber"], none("string"))
    registered = F.flatten(F.transform(F.filter(banks, is_registry), lambda b: F.transform(numbers(b), lambda n: F.concat(space(b), F.lit(":"), n))))
    sets = F.flatten(F.transform(F.filter(banks, lambda b: ~is_registry(b)), numbers))
    links = F.filter(cite["CommentsCorrectionsList"]["CommentsCorrections"], lambda r: F.coalesce(r["_RefType"], F.lit("")) != "")
    link = F.transform(links, lambda r: F.struct(r["_RefType"].alias("kind"), F.coalesce(r["PMID"]["_VALUE"], F.lit("")).alias("pmid"), r["RefSource"].alias("source"), r["Note"].alias("note")))
    version = F.filter(link, lambda r: F.regexp_replace(F.lower(r["kind"]), "[^a-z]", "").isin(VERSIONS))
    dois = F.filter(x["PubmedData"]["ArticleIdList"]["ArticleId"], lambda i: F.lower(i["_IdType"]) == "doi")
    parts = {
        "pmid": F.trim(cite["PMID"]["_VALUE"]),
        "title": F.trim(F.regexp_replace(F.coalesce(a["ArticleTitle"], F.lit("")), r"\s+", " ")),
        "abstract": F.array_join(F.coalesce(abstract, none("string")), "\n"),
        "earliest": found["earliest"],
        "latest": found["latest"],
        "precision": found["precision"],
        "issue_earliest": issue["earliest"],
        "issue_latest": issue["latest"],
        "authors": texts(a["AuthorList"]["Author"], short),
        "headings": texts(headings, lambda h: h["_VALUE"]),
        "major_headings": texts(F.filter(headings, lambda h: F.upper(h["_MajorTopicYN"]) == "Y"), lambda h: h["_VALUE"]),
        "publication_types": texts(a["PublicationTypeList"]["PublicationType"], lambda t: t["_VALUE"]),
        "corrections": link,
        "doi": F.coalesce(F.trim(F.get(dois, 0)["_VALUE"]), F.lit("")),
        "registry_ids": F.array_sort(F.array_distinct(registered)),
        "dataset_ids": F.array_sort(F.array_distinct(sets)),
        "version_ids": F.array_sort(F.array_distinct(F.coalesce(F.transform(version, lambda r: r["pmid"]), none("string")))),
    }
    sound = F.coalesce(parts["pmid"].rlike(r"^\d+$"), F.lit(False)) & found.isNotNull()
    return F.when(sound, F.struct(*[v.alias(k) for k, v in parts.items()]))


def articles(spark, path: str) -> DataFrame:
    """A row for every article of PubMed XML files; files are read in splits, an element at a time."""
    rows = spark.read.text(path, lineSep="</PubmedArticle>").where(F.col("value").contains("<PubmedArticle"))
    whole = F.concat(F.regexp_extract("value", r"(?s)(<PubmedArticle[\s>].*)$", 1), F.lit("</PubmedArticle>"))
    return rows.select(article(whole).alias("x")).where("x is not null").select("x.*")


# ---- sections of a body ----

#: Labels of sections, by type or heading (fixed values); the first that fits.
LABELS = (
    ("methods", r"\b(?:methods?|materials|methodology|procedures?)\b"),
    ("results", r"\b(?:results?|findings)\b"),
    ("discussion", r"\bdiscussion\b"),
    ("conclusion", r"\bconclusions?\b"),
    ("introduction", r"\b(?:intro|introduction|background)\b"),
)
SECTIONS = "pmid string, ord int, own string, outer string, title string, text string, kind string"


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _flat(node: ET.Element) -> str:
    return " ".join("".join(node.itertext()).split())


def _parts(node: ET.Element, path: tuple[str, ...]) -> Iterator[tuple[str, tuple[str, ...], str, str]]:
    """(kind, path of types and headings, title, text) of an element's own blocks, then of the parts in it."""
    inner = [c for c in node if _name(c) in ("sec", "table-wrap", "fig")]
    head = next((c for c in node if _name(c) in ("title", "label")), None)
    if _name(node) == "table-wrap":
        rows = [" | ".join(_flat(c) for c in r if _name(c) in ("th", "td")) for r in node.iter() if _name(r) == "tr"]
        other = [_flat(c) for c in node if c is not head and not any(_name(x) == "table" for x in c.iter())]
        yield "table", path, _flat(head) if head is not None else "", "\n\n".join(filter(None, [*other, "\n".join(filter(lambda r: r.strip(" |"), rows))]))
        return
    kind = "figure" if _name(node) == "fig" else "text"
    yield kind, path, _flat(head) if head is not None else "", "\n\n".join(filter(None, (_flat(c) for c in node if c is not head and c not in inner)))
    for c in inner:
        title = next((_flat(t) for t in c if _name(t) == "title"), "")
        yield from _parts(c, (*path, f"{c.get('sec-type') or ''}\t{title}") if _name(c) == "sec" else path)


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in SECTIONS.split(", ")]
    for batch in batches:
        out = []
        for pmid, xml in zip(batch["pmid"], batch["xml"], strict=True):
            try:
                root = ET.fromstring(xml or "")
            except ET.ParseError:
                continue
            # the article's own body, not that of a review or reply in it
            body = next((c for a in root.iter() if _name(a) == "article" for c in a if _name(c) == "body"), root if _name(root) == "body" else None)
            for i, (kind, path, title, text) in enumerate(_parts(body, ()) if body is not None else ()):
                if text.strip():
                    own, outer = (path[-1] if path else ""), "\n".join(reversed(path[:-1]))
                    out.append((pmid, i, own, outer, title, text, kind))
        yield pd.DataFrame(out, columns=columns).astype({"ord": "int32"})


def sections(bodies: DataFrame) -> DataFrame:
    """``pmid, ord, label, title, text, sha256`` of JATS bodies (pmid, xml) in order; what is no XML has none.

    A section's label is told by its type, else its heading, else by the nearest
    section around it that tells one; tables and figures are their own.
    """
    parts = bodies.select("pmid", "xml").mapInPandas(_sections, SECTIONS)
    of = lambda c: first_match([(F.lower(c).rlike(p), label) for label, p in LABELS])
    typed = lambda c: F.coalesce(of(F.substring_index(c, "\t", 1)), of(F.substring_index(c, "\t", -1)))
    outer = F.get(F.array_compact(F.transform(F.split("outer", "\n"), typed)), 0)
    label = F.when(F.col("kind") == "table", "table").when(F.col("kind") == "figure", "figure").otherwise(F.coalesce(typed(F.col("own")), outer, F.lit("other")))
    return parts.select("pmid", "ord", label.alias("label"), "title", "text", F.sha2("text", 256).alias("sha256"))


def completeness(bodies: DataFrame, found: DataFrame, least: int = 1000) -> DataFrame:
    """``pmid, complete, reason, present`` of every body: not resolved (no XML), too small, or whole."""
    per = found.groupBy("pmid").agg(F.sum(F.length("text")).alias("chars"), F.array_sort(F.collect_set("label")).alias("present"))
    reason = first_match([(F.col("xml").isNull(), "not_resolved"), (F.coalesce("chars", F.lit(0)) < least, "body_too_small")])
    out = bodies.join(per, "pmid", "left").withColumn("reason", reason)
    return out.select("pmid", F.col("reason").isNull().alias("complete"), "reason", F.coalesce("present", F.array().cast("array<string>")).alias("present"))


