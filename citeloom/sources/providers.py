"""Recorded provider replies (JSON text) to bibliographic records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CROSSREF = (
    "title array<string>, author array<struct<family: string, name: string>>, issued struct<`date-parts`: array<array<string>>>, "
    "`container-title` array<string>, page string, DOI string, volume string"
)
_OPENALEX = (
    "title string, display_name string, authorships array<struct<author: struct<display_name: string>>>, "
    "primary_location struct<source: struct<display_name: string>>, host_venue struct<display_name: string>, "
    "biblio struct<first_page: string, last_page: string, volume: string>, doi string, publication_year string"
)
_DATACITE = (
    "titles array<struct<title: string>>, creators array<struct<familyName: string, name: string>>, container struct<title: string>, doi string, publicationYear string"
)
#: Most words of an abstract that is put together from an inverted index (fixed value).
INDEX_WORDS = 20_000


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _first(*cs: Column) -> Column:
    """The first that is not empty, else an empty text."""
    return _text(F.coalesce(*[F.nullif(c, F.lit("")) for c in cs]))


def _all(xs: Column, of) -> Column:
    """Values of an array's entries, without null or empty ones."""
    return F.filter(F.coalesce(F.transform(xs, of), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def _year(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^\d+$"), F.trim(c).cast("int"))


def _record(title: Column, authors: Column, year: Column, journal: Column, volume: Column, pages: Column, doi: Column) -> Column:
    parts = {"title": title, "authors": authors, "year": year, "journal": journal, "volume": volume, "pages": pages, "doi": doi}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def crossref(reply: Column) -> Column:
    x = F.from_json(reply, _CROSSREF)
    issued = F.get(F.get(x["issued"]["date-parts"], 0), 0)
    whole = lambda xs: F.array_join(_all(xs, lambda t: t), " ")
    authors = _all(x["author"], lambda a: _first(a["family"], a["name"]))
    return _record(whole(x["title"]), authors, _year(issued), whole(x["container-title"]), _text(x["volume"]), _text(x["page"]), F.lower(_text(x["DOI"])))


def openalex(reply: Column) -> Column:
    x = F.from_json(reply, _OPENALEX)
    first, last = _text(x["biblio"]["first_page"]), _text(x["biblio"]["last_page"])
    pages = F.when((first != "") & (last != ""), F.concat_ws("-", first, last)).otherwise(first)
    journal = _first(x["primary_location"]["source"]["display_name"], x["host_venue"]["display_name"])
    doi = F.replace(F.lower(_text(x["doi"])), F.lit("https://doi.org/"), F.lit(""))
    authors = _all(x["authorships"], lambda a: a["author"]["display_name"])
    return _record(_first(x["title"], x["display_name"]), authors, _year(x["publication_year"]), journal, _text(x["biblio"]["volume"]), pages, doi)


def datacite(reply: Column) -> Column:
    x = F.from_json(reply, _DATACITE)
    title = F.trim(F.array_join(_all(x["titles"], lambda t: t["title"]), " "))
    authors = _all(x["creators"], lambda a: _first(a["familyName"], a["name"]))
    return _record(title, authors, _year(x["publicationYear"]), _text(x["container"]["title"]), F.lit(""), F.lit(""), F.lower(_text(x["doi"])))


def inverted_abstract(index: Column) -> Column:
    """Text of an index (word to places) by place; empty if it has no or too many words, or a place that is no number."""
    places = F.from_json(index, "map<string,array<string>>")
    pairs = F.flatten(F.transform(F.map_entries(places), lambda e: F.transform(e["value"], lambda p: F.struct(p.try_cast("int").alias("at"), e["key"].alias("word")))))
    sound = F.forall(F.map_values(places), lambda ps: ps.isNotNull() & F.forall(ps, lambda p: p.rlike(r"^-?\d+$"))) & F.size(pairs).between(1, INDEX_WORDS)
    words = F.transform(F.array_sort(pairs), lambda p: p["word"])
    return F.when(F.coalesce(sound, F.lit(False)), F.trim(F.array_join(words, " "))).otherwise("")


# Relation tags of tagged records.
RELATIONS = "CIN CON CRI CRF EFR EIN RIN ROF RPF RPI SPIN UIN UOF".split()


def tagged(body: Column) -> Column:
    """Record of MEDLINE-style ``TAG - value`` text; a line without a tag continues the value before it.

    A record without PMID and title is not resolved. The year is that of print,
    else that of the electronic version (``year_from_dep``).
    """
    from citeloom.functions.names import medline_surname

    flat = F.regexp_replace(F.regexp_replace(_text(body), "\r\n?", "\n"), r"(?:\n(?![A-Z]{2,4}\s*-)[ \t]*)+", " ")
    values = lambda tag: F.filter(F.transform(F.regexp_extract_all(flat, F.lit(rf"(?m)^{tag}\s*-[ \t]*(.*)$"), F.lit(1)), lambda v: F.trim(v)), lambda v: v != "")
    one = lambda *tags: _first(*[F.get(values(t), 0) for t in tags])
    persons = F.transform(values("AU"), medline_surname)
    full = F.transform(values("FAU"), lambda x: F.trim(F.regexp_extract(x, "^[^,]*", 0)))
    authors = F.concat(F.when(F.size(persons) > 0, persons).otherwise(full), values("CN"))
    years = lambda tag: F.nullif(F.regexp_extract(F.array_join(F.filter(values(tag), lambda v: v.rlike(r"(?:19|20)\d{2}")), "\n"), r"(?:19|20)\d{2}", 0), F.lit(""))
    dois = F.filter(F.concat(values("AID"), values("LID")), lambda v: v.rlike(r"(?i)^10\.\S+\s*\[doi\]$"))
    doi = F.regexp_replace(F.regexp_replace(_text(F.get(dois, 0)), r"(?i)\s*\[doi\]$", ""), r"[. ]+$", "")
    title = one("TI", "BTI", "TT")
    linked = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(t).alias("tag"), F.array_distinct(F.flatten(F.transform(values(t), lambda v: F.regexp_extract_all(v, F.lit(r"(?i)PMID:\s*(\d+)"), F.lit(1))))).alias("ids")) for t in RELATIONS]),
            lambda x: F.size(x["ids"]) > 0,
        )
    )
    parts = {
        "resolved": (one("PMID") != "") | (title != ""),
        "title": title,
        "authors": F.filter(authors, lambda a: a != ""),
        "year": F.coalesce(years("DP"), years("DEP")).cast("int"),
        "year_from_dep": years("DP").isNull() & years("DEP").isNotNull(),
        "journal": one("TA", "JT"),
        "pmid": one("PMID"),
        "doi": doi,
        "volume": one("VI"),
        "pages": one("PG"),
        "is_container": (one("BTI") != "") & (one("TI") == ""),
        "alternate_titles": F.filter(values("TT"), lambda t: t != title),
        "language": one("LA"),
        "publication_types": values("PT"),
        "related": linked,
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])
