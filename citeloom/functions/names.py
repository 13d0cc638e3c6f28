"""Names of authors and bodies, and of journals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.folding import fold_charges, fold_udf
from citeloom.functions.similarity import jaro_winkler
from citeloom.functions.titles import _worded

# Words of a body's name, particles and suffixes of a person's.
BODIES = "association society organization organisation committee council consortium collaboration group agency college".split()
INSTITUTIONS = "association society organization organisation college academy world national international committee council institute foundation board"
_INSTITUTION = rf"\b(?:{'|'.join(INSTITUTIONS.split())})\b"
CORPORATE = (
    r"(?i)\b(?:committee|association|society|college|academy|council|board|panel|agency|authority|federation|consortium|network|collaborat\w*|"
    r"task\s+force|working\s+group|study\s+group|trial\s+group|investigators?|institute|foundation|ministry|department|organi[sz]ation|group)\b"
)
PARTICLES = "al da de del della der di dos du la le van von".split()
_PARTICLE = "|".join(PARTICLES)
# A surname with initials, and a body's name written as if it were one.
PERSON = r"\b[A-Z][A-Za-z'\-]+\s*,?\s+(?:[A-Z]\.?\s*){1,5}\b"
INVERTED = r"^([A-Z][A-Za-z'\-]+)[ ,]+([A-Z]{1,5})\.?$"
# Words of a body's name in the same-work rules.
BODY_WORDS = (
    "group consortium society committee collaborative association panel institute department network investigators task force authority agency "
    "registry foundation working college academy council board organization organisation ministry centre center trial study initiative program programme"
).split()

_BREAK = "␞"


def folded_each(texts: Column) -> Column:
    """Every text of an array folded, in one call of the Arrow function."""
    whole = F.array_join(F.transform(texts, lambda x: F.coalesce(x, F.lit(""))), _BREAK)
    return F.when(F.size(texts) > 0, F.split(fold_udf(whole), _BREAK)).otherwise(F.array().cast("array<string>"))


def normal_names(folded: Column) -> Column:
    return F.transform(folded, lambda x: _worded(fold_charges(x)))


def before_comma(name: Column) -> Column:
    return F.regexp_extract(name, r"^([^,]*)", 1)


def medline_surname(name: Column) -> Column:
    """``Smith JA`` is Smith, ``Smith, J`` too."""
    bare = F.trim(name)
    return F.when(bare.contains(","), F.trim(before_comma(bare))).otherwise(F.regexp_replace(bare, r"(?<=\S)\s+[A-Z]{1,3}$", ""))


def surname_present(first: Column, others: Column) -> Column:
    """Whether the first author's normal surname is among normal names; null if either side has none.

    The last word of three letters must be a word of a name; a body's name must be the same.
    """
    tokens = F.split(first, " ")
    last = F.coalesce(F.element_at(F.filter(tokens, lambda t: F.length(t) >= 3), -1), first)
    body = F.arrays_overlap(tokens, F.array(*[F.lit(x) for x in BODIES]))
    inside = lambda c: (F.length(c) >= 4) & (F.length(first) >= 4) & (first.contains(c) | c.contains(first))
    same = lambda c: (c == first) | (~body & (F.array_contains(F.split(c, " "), last) | inside(c)))
    return F.when((first != "") & (F.size(others) > 0), F.exists(others, lambda c: (c != "") & same(c)))


def first_author_aliases(first: Column) -> Column:
    """Ways to write the surname of a normal first author: bare, first and last word, and with its particles."""
    bare = F.regexp_replace(first, rf"^(?:(?!(?:{_PARTICLE})\s)[a-z]{{1,3}}\s+(?=\S))+", "")
    bare = F.regexp_replace(bare, r"(?:\s+(?:[a-z]{1,3}|junior|senior|filho|neto))+$", "")
    long = F.regexp_extract(bare, rf"(?:^|\s)((?:(?:{_PARTICLE})\s+)+\S+)$", 1)
    ways = F.array(bare, F.regexp_extract(bare, r"^\S+", 0), F.regexp_extract(bare, r"\S+$", 0), long)
    return F.when(first.rlike(_INSTITUTION), F.array(first)).otherwise(F.array_distinct(F.filter(ways, lambda w: w != "")))


def same_first_author(first: Column, other: Column) -> Column:
    return F.arrays_overlap(F.filter(first_author_aliases(first), lambda x: x != ""), F.filter(first_author_aliases(other), lambda x: x != ""))


def is_implausible(name: Column) -> Column:
    """A name with a digit, other than a section number after a colon."""
    return F.regexp_replace(F.trim(name), r"\s*:\s*\d+\s*$", "").rlike(r"\d")


def restored_body(written: Column, resolved: Column) -> Column:
    """The resolved body's name that ``Association AD`` inverts: its last word, and the others' initials in order; else null."""
    last, initials = F.lower(F.regexp_extract(F.trim(written), INVERTED, 1)), F.lower(F.regexp_extract(F.trim(written), INVERTED, 2))
    parts = lambda r: F.regexp_extract_all(F.coalesce(r, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'\-]*"), F.lit(0))
    of = lambda ws: F.array_join(F.transform(F.slice(ws, 1, F.size(ws) - 1), lambda w: F.lower(F.substring(w, 1, 1))), "")
    fits = lambda r: (F.size(parts(r)) >= 2) & (F.lower(F.element_at(parts(r), -1)) == last) & (of(parts(r)) == initials)
    return F.when(initials != "", F.get(F.filter(resolved, lambda r: F.when(F.size(parts(r)) >= 2, fits(r)).otherwise(False)), 0))


def is_corporate(name: Column, marked: Column) -> Column:
    """A body: marked as one, with a body's word, or of four words that aren't all names."""
    bare = F.coalesce(name, F.lit(""))
    named = F.regexp_extract_all(bare, F.lit(r"[\p{L}][\p{L}'\-]*"), F.lit(0))
    person = bare.rlike(PERSON) | (
        (F.size(named) >= 2) & F.forall(named, lambda w: w.rlike(r"^\p{Lu}") | F.lower(w).isin(PARTICLES))
    )
    many = F.size(F.regexp_extract_all(bare, F.lit(r"(?U)\b[\w'\-]+\b"), F.lit(0))) >= 4
    return F.coalesce(marked, F.lit(False)) | ((bare != "") & (bare.rlike(CORPORATE) | (many & ~person)))


def roster(normal: Column, least: int = 4) -> Column:
    """Distinct words of ``least`` letters in normal names."""
    return F.array_distinct(F.filter(F.flatten(F.transform(normal, lambda x: F.split(x, " "))), lambda t: F.length(t) >= least))


def share_of(some: Column, of: Column) -> Column:
    """Share of the first array's values that the second has; 0 if either is empty."""
    return F.when((F.size(some) > 0) & (F.size(of) > 0), F.size(F.array_intersect(some, of)) / F.size(some)).otherwise(F.lit(0.0))


# ---- journals ----

#: Words that a journal's abbreviation leaves out (fixed values).
JOURNAL_FILL = ("j", "the", "of", "and", "suppl", "supplement")


def same_journal(a: str, b: str) -> bool:
    """Two canonical names, one perhaps abbreviated or spelt otherwise."""
    if not a or not b:
        return False
    x, y = a.split(), b.split()
    if a == b or (min(len(x), len(y)) >= 2 and min(len(a), len(b)) >= 6 and (a in b or b in a)):
        return True
    short, long = sorted(([w for w in z if w not in JOURNAL_FILL] for z in (x, y)), key=len)

    def alike(v: str, w: str) -> bool:
        least = min(len(v), len(w))
        return v == w or (least >= 4 and v[:least] == w[:least]) or (least >= 5 and jaro_winkler(v, w) >= 0.88)

    return bool(short) and all(any(alike(v, w) for w in long) for v in short)


@F.pandas_udf(T.BooleanType())
def same_journal_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    found = {p: same_journal(*p) for p in set(pairs)}
    return pd.Series([found[p] for p in pairs], dtype=bool)
