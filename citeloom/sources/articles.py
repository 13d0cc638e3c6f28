"""Article XML to references with their citing sentences, and tagged bibliographic text to records."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions.text import ABBREVIATIONS
from citeloom.sources.providers import tagged

REFERENCES = (
    "citation_id string, source_id string, source_title string, ref_ord int, title string, authors array<string>, year int, journal string, "
    "volume string, pages string, claimed_pmid string, claimed_doi string, publication_type string, is_collab boolean, ext_link string, "
    "citance string, section string, group_id string, group_members array<string>, cited_in_body boolean, mark int, marks array<struct<at:int,text:string>>"
)

#: A citation mark in a block's text: the ids it cites and what it shows.
_MARK = "\ue000{}\ue004{}\ue001"
_MARKED = re.compile("\ue000(.*?)\ue004(.*?)\ue001", re.S)
#: Stands for a blank that ends no sentence, and for the end of one.
_GLUE, _CUT = "\ue002", "\ue003"
_SHORT = re.compile(rf"(?i)((?:^|(?<=\s))(?:{'|'.join(map(re.escape, ABBREVIATIONS))}|[a-z])\.)\s(?=\S)")
_END = re.compile(r"""([.!?][)\]"'”’]*(?:\ue000.*?\ue001)*)\s+(?=[A-Z“"'(\[\ue000])""")


def sentences(text: str) -> list[str]:
    """Verbatim sentences: cut where a mark is followed by a blank and an opening or citation mark, but not after abbreviations or initials."""
    cut = _END.sub(rf"\1{_CUT}", _SHORT.sub(rf"\1{_GLUE}", text))
    return [s for s in (x.replace(_GLUE, " ").strip() for x in cut.split(_CUT)) if s]


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _text(node: ET.Element | None) -> str | None:
    return None if node is None else " ".join("".join(node.itertext()).split()) or None


def _first(node: ET.Element, *names: str) -> ET.Element | None:
    return next((x for n in names for x in node.iter() if _name(x) == n), None)


def _marked(node: ET.Element) -> str:
    """Text of a block with its citation marks in private-use brackets."""
    out = [node.text or ""]
    for child in node:
        cites = _name(child) == "xref" and child.get("ref-type") == "bibr" and (child.get("rid") or "").strip()
        out.append(_MARK.format(child.get("rid"), "".join(child.itertext())) if cites else _marked(child))
        out.append(child.tail or "")
    return "".join(out)


def _shown(sentence: str) -> tuple[str, list[tuple[list[str], dict]]]:
    """A sentence as it is read, and its marks: the ids they cite, where they stand and what they show."""
    pieces, raw, marks = _MARKED.split(sentence), "", []
    for text, rids, label in zip(pieces[::3], [*pieces[1::3], ""], [*pieces[2::3], ""], strict=True):
        raw += text
        if rids:
            # the place of the label's first character once white space is folded
            at = len(" ".join((raw + (label.strip()[:1] or "x")).split())) - 1
            marks.append((rids.split(), {"at": at, "text": " ".join(label.split())}))
            raw += label
    return " ".join(raw.split()), marks


def _blocks(node: ET.Element, section: str = "") -> Iterator[tuple[str, str]]:
    """Innermost blocks that hold sentences, with the titles of the sections they are in; table rows are units."""
    for child in node:
        kind = _name(child)
        if kind == "sec":
            title = _text(next((x for x in child if _name(x) == "title"), None)) or ""
            yield from _blocks(child, f"{section}/{title}".strip("/"))
        elif kind == "tr":
            yield section, " | ".join(" ".join(_marked(c).split()) for c in child)
        elif kind == "p" and not any(_name(x) in ("p", "table", "list") for x in child.iter() if x is not child):
            yield section, " ".join(_marked(child).split())
        elif kind not in ("title", "ref-list"):
            yield from _blocks(child, section)


def _reference(ref: ET.Element) -> dict:
    cite = _first(ref, "element-citation", "mixed-citation")
    cite = ref if cite is None else cite
    ids = {x.get("pub-id-type"): _text(x) for x in cite.iter() if _name(x) == "pub-id"}
    editors = [g for g in cite.iter() if _name(g) == "person-group" and g.get("person-group-type") in ("editor", "translator")]
    hidden = {id(x) for g in editors for x in g.iter()}
    years = {y for x in cite.iter() if _name(x) == "year" for y in re.findall(r"\b(?:1[5-9]|20)\d\d\b", _text(x) or "")}
    first, last = _text(_first(cite, "fpage")), _text(_first(cite, "lpage"))
    persons = [x for x in cite.iter() if _name(x) in ("surname", "collab", "string-name") and id(x) not in hidden]
    link = _first(cite, "ext-link")
    return {
        "title": _text(_first(cite, "article-title", "chapter-title", "data-title")),
        "authors": [_text(x) for x in persons if _name(x) != "string-name" or not any(y in persons for y in x.iter() if y is not x)],
        "year": int(years.pop()) if len(years) == 1 else None,
        "journal": _text(_first(cite, "source")),
        "volume": _text(_first(cite, "volume")),
        "pages": f"{first}-{last}" if first and last else first or _text(_first(cite, "elocation-id")),
        "claimed_pmid": ids.get("pmid"),
        "claimed_doi": ids.get("doi"),
        "publication_type": cite.get("publication-type"),
        "is_collab": bool(persons) and _name(persons[0]) == "collab",
        "ext_link": None if link is None else next((v for k, v in link.attrib.items() if k.endswith("href")), None),
    }


def parse_article(content: bytes, source_id: str) -> list[dict]:
    """References of one article, each with the first sentence that cites it."""
    root = ET.fromstring(content)
    body = _first(root, "body")
    cited: dict[str, dict] = {}
    groups, reached = 0, set()
    for section, text in _blocks(body) if body is not None else ():
        for sentence in sentences(text):
            clean, marks = _shown(sentence)
            place = {rid: i for i, (rids, _) in reversed(list(enumerate(marks))) for rid in rids}
            new = [r for r in dict.fromkeys(rid for rids, _ in marks for rid in rids) if r not in cited]
            reached.update(place)
            if new:
                groups += 1
                told = {"citance": clean, "section": section, "group_id": f"{source_id}:g{groups:02d}", "group_members": [f"{source_id}:{r}" for r in new], "marks": [m for _, m in marks]}
                cited |= {rid: told | {"mark": place[rid]} for rid in new}
    title = _text(_first(root, "article-title"))
    out = []
    for n, ref in enumerate(x for x in root.iter() if _name(x) == "ref"):
        rid = ref.get("id") or str(n + 1)
        known = {"citation_id": f"{source_id}:{rid}", "source_id": source_id, "source_title": title, "ref_ord": n + 1, **_reference(ref)}
        out.append(known | {"group_members": [], "marks": []} | cited.get(rid, {}) | {"cited_in_body": rid in reached})
    return out


def read_articles(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """References of all articles under ``path``; with ``ids``, only files of these names are listed and read.

    An article that isn't well-formed gives one row with only its source id.
    """
    names = "*" if ids is None else "{" + ",".join(sorted(ids)) + "}" if ids else "-"
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{names}.xml").load(path)
    files = files.withColumn("source_id", F.regexp_extract("path", r"([^/]+)\.xml$", 1))
    return references(files)


def references(files: DataFrame) -> DataFrame:
    """``REFERENCES`` of articles (content, source_id); one that isn't well-formed gives a row with only its source id.

    ``marks`` are all citation marks of the sentence, ``mark`` the reference's own;
    ``operators.markers`` tells their runs and which claims belong to them.
    """
    columns = [c.split()[0] for c in REFERENCES.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for content, source_id in zip(batch["content"], batch["source_id"], strict=True):
                try:
                    rows += parse_article(content, source_id)
                except ET.ParseError:
                    rows.append({"source_id": source_id})
            out = pd.DataFrame(rows, columns=columns)
            numbers = ("ref_ord", "year", "mark")
            out = out.astype(dict.fromkeys(numbers, "Int32"))
            yield out.astype({c: object for c in columns if c not in numbers}).where(lambda d: d.notna(), None)

    return files.select("content", "source_id").mapInPandas(parse, REFERENCES)


def parse_tagged(records: DataFrame) -> DataFrame:
    """Records (``body``: MEDLINE-style text) with the columns of ``providers.tagged``."""
    return records.select(tagged(F.col("body")).alias("x")).select("x.*")


def cited_marks(spark: SparkSession, path: str) -> DataFrame:
    """``source_id, rid``: every reference id that a mark anywhere in an article cites, whatever the parser reaches."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    text = F.decode("content", "UTF-8")
    marks = F.regexp_extract_all(text, F.lit(r"<xref\b([^>]*)>"), F.lit(1))
    cited = F.filter(marks, lambda m: m.rlike(r"""ref-type\s*=\s*["']bibr["']"""))
    rids = F.flatten(F.transform(cited, lambda m: F.split(F.trim(F.regexp_extract(m, r"""\brid\s*=\s*["']([^"']*)["']""", 1)), r"\s+")))
    return files.select(F.regexp_extract("path", r"([^/]+)\.xml$", 1).alias("source_id"), F.explode(F.array_distinct(rids)).alias("rid")).where("rid <> ''")


def unreached_marks(cited: DataFrame, references: DataFrame) -> DataFrame:
    """Cited ids that no reference of the parse has a citing sentence for."""
    reached = references.where("cited_in_body").select("source_id", F.regexp_extract("citation_id", r":(.*)$", 1).alias("rid"))
    return cited.join(reached, ["source_id", "rid"], "left_anti")
