"""Sentences, tokens, locators and input classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.folding import DASHES
from citeloom.functions.titles import squeezed

# Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = (
    "fig figs eq eqs ref refs no nos ch sec vol pp al vs cf approx est min max dr prof mr mrs ms st jr sr inc ltd co dept univ i.e e.g etc "
    "spp sp subsp var cv syn"
).split()
_KNOWN = "|".join(x.replace(".", r"\.") for x in ABBREVIATIONS)
_BOUNDARY = rf"""(?<=[.!?][)\]"'”’]{{0,8}})(?<!(?:^|\s)(?i:{_KNOWN}|[a-z])\.)\s+(?=[A-Z“"'(\[])"""


def sentences(line: Column) -> Column:
    """Verbatim sentences of a line: cut where a mark is followed by a blank and an opening, but not after an abbreviation or initial."""
    return F.filter(F.transform(F.split(F.trim(line), _BOUNDARY), lambda s: F.trim(s)), lambda s: s != "")


def section_units(label: Column, text: Column) -> Column:
    """Units of a section in order: sentences of every line, but whole lines of a table."""
    rows = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(label == "table", rows).otherwise(F.flatten(F.transform(rows, sentences)))


def normal_offset(text: Column, at: Column) -> Column:
    """Where the character at ``at`` (from 0) stands once white space is folded and trimmed."""
    before = F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(1), at), r"(?U)\s+", " "), "^ ", "")
    here = F.substring(text, at + 1, F.lit(1))
    return F.length(F.when(here.rlike(r"(?U)\s"), F.regexp_replace(before, " $", "")).otherwise(before))


# Endings that a crude stem loses, and words that carry no content.
ENDINGS = (
    "ization isation ational iveness ously ation ition ities ically ingly ments ional ising izing ility ement ical ible able ness ment ions "
    "ives ists isms ing ies ied ive ily ers ent ant ate ous ful ish ism ist ity ion al ed es ly er ic s y"
).split()
STOPWORDS = (
    "a an and are as at be been being but by can could did do does for from had has have having how however if in into is it its itself may "
    "might more most must no nor not of off on once only or other our out over own same she should since so some such than that the their "
    "them then there these they this those through thus to too under until upon use used using was we were what when where which while who "
    "whom why will with within without would yet you your his her him he"
).split()


def stem(token: Column) -> Column:
    """A word without up to three endings, the longest first, four characters left at least."""
    for _ in range(3):
        token = F.regexp_replace(token, f"^(.{{4,}}?)(?:{'|'.join(ENDINGS)})$", "$1")
    return token


def content_tokens(text: Column) -> Column:
    """Distinct words of three characters that carry content, and their stems."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[^\W_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))
    return F.array_distinct(F.concat(words, F.transform(words, stem)))


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


_MARKS, _WRAPS = rf"0-9\-{DASHES}", r"()\[\]{}.,;:"


def claim_input_status(sentence: Column) -> Column:
    """empty, marker_only, numeric_fragment, leading_marker_bleed or prose."""
    x = F.trim(F.regexp_replace(F.coalesce(sentence, F.lit("")), r"(?U)\s", " "))
    run = rf"[{_WRAPS}]*[{_MARKS}](?:[,{_MARKS}]*[{_MARKS}])?[{_WRAPS}]*"
    return (
        F.when(x == "", "empty")
        .when(~x.rlike(r"\p{L}") & x.rlike(rf"^[{_MARKS}{_WRAPS}\s]+$"), "marker_only")
        .when(~x.rlike(r"\p{L}"), "numeric_fragment")
        .when(x.rlike(rf"^{run}(?:\s|$)"), "leading_marker_bleed")
        .otherwise("prose")
    )


#: Texts that stand where there is no abstract (fixed values).
NO_ABSTRACT = ("", "none", "null", "n/a", "na", "not available", "unavailable", "(no abstract available)")


def usable_evidence(abstract: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(abstract, F.lit("")))).isin(*NO_ABSTRACT)


def clip(text: Column, limit: int, least: int = 120) -> Column:
    """(text, cut) within ``limit``: back to the last sentence's end if that leaves ``least`` characters."""
    clean = squeezed(F.coalesce(text, F.lit("")))
    window = F.substring(clean, 1, limit)
    # up to the last mark that a blank follows in the window
    whole = F.regexp_extract(window, r"(?s)^(.*[.?!]) ", 1)
    cut = F.when(F.length(whole) > least, whole).otherwise(F.rtrim(window))
    return F.struct(F.when(F.length(clean) <= limit, clean).otherwise(cut).alias("text"), (F.length(clean) > limit).alias("cut"))


def citation_style(markers: Column) -> Column:
    """numeric, author-year or unknown, from all markers of a document; one that is wrong decides."""
    some = F.filter(F.transform(markers, lambda m: F.trim(m)), lambda m: m != "")
    number = r"^\d+(?:\s*[,\-‐‑‒–—―]\s*\d+)*$"
    return (
        F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, "unknown")
        .when(F.exists(some, lambda m: m.rlike(r"^(?:19|20)\d{2}$")), "author-year")
        .when(F.forall(some, lambda m: m.rlike(number)), "numeric")
        .when(F.exists(some, lambda m: m.rlike(r"\p{L}")), "author-year")
        .otherwise("unknown")
    )


# ---- locators ----

# What stands before a DOI, matter after an article's pages, and a range of pages.
DOI_PREFIX = r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)"
AFTER_PAGES = r"\s*;\s*(?:quiz|discussion|author reply|reply|erratum|comment)\b.*$"
PAGE_RANGE = r"^([a-z]*)(\d+)-([a-z]*)(\d+)(.*)$"


def normal_doi(doi: Column) -> Column:
    """Lower case, without resolver or ``doi:``, without closing marks."""
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(doi, F.lit("")))), DOI_PREFIX, "")
    return F.regexp_replace(bare, "[. ,;)]+$", "")


def same_doi(a: Column, b: Column) -> Column:
    return (normal_doi(a) != "") & (normal_doi(a) == normal_doi(b))


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def leading_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\s*(\d+)", 1), F.lit(""))


def first_page(pages: Column) -> Column:
    """Number of the first page, without letters and zeros before it."""
    return F.nullif(F.regexp_extract(F.coalesce(pages, F.lit("")), r"^\s*[A-Za-z]*0*(\d+)", 1), F.lit(""))


def _full_segment(segment: Column) -> Column:
    part = lambda i: F.regexp_extract(segment, PAGE_RANGE, i)
    low, high, start, end = part(1), part(3), part(2), part(4)
    unit = F.rpad(F.lit("1"), F.length(end) + 1, "0").cast("long")
    first, last = start.cast("long"), end.cast("long")
    grown = first - first % unit + last
    grown = F.when(grown < first, grown + unit).otherwise(grown).cast("string")
    # no leading zero of the start is lost
    padded = F.when(F.length(grown) < F.length(start), F.lpad(grown, F.length(start), "0")).otherwise(grown)
    other = (start == "") | ((low != "") & (high != "") & (low != high))
    shown = F.concat(F.when(low != "", low).otherwise(high), start, F.lit("-"), F.when(F.length(end) < F.length(start), padded).otherwise(end), part(5))
    return F.when(other, segment).otherwise(shown)


def full_pages(pages: Column, *, editorial: bool = True) -> Column:
    """Ranges with elided ends written out (1199-8 is 1199-1208); matter after the article is off; null is empty."""
    x = F.lower(F.trim(F.coalesce(pages, F.lit(""))))
    if editorial:
        x = F.regexp_replace(x, AFTER_PAGES, "")
    x = F.regexp_replace(F.regexp_replace(x, f"[{DASHES}]", "-"), r"\s+", "")
    return F.array_join(F.transform(F.split(x, ","), _full_segment), ",")
