"""Titles: normal forms, variants and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions.folding import fold_charges, fold_udf, without_marks_udf

# Words that say nothing of a title, titles that many works have, and what stands where there is no title.
WEAK_WORDS = "a an and as at by for from in of on or the to with paper study analysis medical".split()
GENERIC_TITLES = ("introduction", "editorial", "preface", "foreword", "conclusion", "discussion", "letter")
NO_TITLE = ("not available", "no title available", "no title", "title not available", "untitled")

# Prefixes of notices, and of sections or societies that a title may be without.
NOTICE_PREFIX = r"(?i)^\s*(erratum|corrigendum|correction|retraction)\b[:\-\s]*"
LEADING_PREFIX = r"^[^.:]{1,80}?[.:]\s+(?=\S)"

# Function words of English and of other languages (same-work rules).
ENGLISH = (
    "a an the of in on for and or to with from by at as is are was were be been being this that these those its it their his her our your "
    "not no than then when where which who whom whose how why what"
).split()
OTHER_LANGUAGES = (
    "le la les des du de un une et ou dans sur pour avec chez par au aux ce cette ces el los las una y o en para con por del al lo su sus como "
    "es son as um uma e em com da do dos das no na nos nas ao aos que se der die das ein eine und oder in an auf fur mit von bei zur zum dem den "
    "als il gli di della dei delle alla nel nella het een of op voor met van bij aan door dat zijn wordt werd i w z od po za oraz jest sa dla nie "
    "tego tym ktory ktora och eller pa med av till fran som ar det ett ve ile bir bu icin olan ya nin dan"
).split()


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _worded(text: Column) -> Column:
    """Lower case, hyphens in words deleted, other marks to blanks."""
    joined = F.regexp_replace(F.lower(text), r"(?U)(?<=\w)-(?=\w)", "")
    return squeezed(F.regexp_replace(joined, r"(?U)[^\w\s]", " "))


def _text(title: Column) -> Column:
    return F.coalesce(title, F.lit(""))


def normal_title(title: Column) -> Column:
    """Brackets of a translated title and notice prefixes off, folded, charges as words, words only; null is empty."""
    bare = F.regexp_replace(F.trim(_text(title)), r"(?s)^\[(.*)\]\.?$", "$1")
    own = F.regexp_replace(bare, NOTICE_PREFIX, "")
    return _worded(fold_charges(fold_udf(own)))


def canonical_title(title: Column) -> Column:
    """As ``normal_title``, but prefixes stay."""
    bare = F.regexp_replace(F.trim(_text(title)), r"(?s)^\[(.*)\]\.*$", "$1")
    return _worded(fold_charges(fold_udf(bare)))


def lookup_title(title: Column) -> Column:
    """Folded, lower case, all marks (also hyphens in words) to blanks."""
    return squeezed(F.regexp_replace(F.lower(fold_udf(_text(title))), r"(?U)[^\w\s]", " "))


def is_distinctive(canonical: Column) -> Column:
    """A canonical title that can identify a work: 18 characters and two telling words."""
    telling = F.filter(F.split(canonical, " "), lambda w: (F.length(w) >= 3) & ~w.isin(WEAK_WORDS))
    return ~canonical.isin(*GENERIC_TITLES) & (F.length(canonical) >= 18) & (F.size(telling) >= 2)


def title_variants(title: Column) -> Column:
    """Normal title, and that without a leading section or society where two words and ten characters are left."""
    whole = normal_title(title)
    rest = normal_title(F.regexp_replace(_text(title), LEADING_PREFIX, ""))
    offered = _text(title).rlike(LEADING_PREFIX) & (rest != whole) & (F.length(rest) >= 10) & rest.contains(" ")
    return F.when(whole == "", F.array().cast("array<string>")).when(offered, F.array(whole, rest)).otherwise(F.array(whole))


def plain_words(text: Column) -> Column:
    """Words of a text without accents and marks, lower case."""
    plain = F.regexp_replace(F.lower(without_marks_udf(_text(text))), r"(?U)[^\w\s]", " ")
    return F.filter(F.split(squeezed(plain), " "), lambda w: w != "")


def content_words(text: Column) -> Column:
    return F.filter(plain_words(text), lambda w: ~w.isin(ENGLISH))


def has_other_script(text: Column) -> Column:
    """Letters that aren't Latin; a Greek letter that stands alone is notation."""
    return _text(text).rlike(r"[\p{IsAlphabetic}&&\P{IsLatin}&&\P{IsGreek}&&\p{L}]|\p{IsGreek}\p{IsGreek}")


def language_trigger(written: Column, resolved: Column) -> Column:
    """Why two titles are in different languages: ``script``, ``stopword`` or null."""
    words, others = plain_words(written), plain_words(resolved)
    count = lambda ws, some: F.size(F.filter(ws, lambda w: w.isin(some)))
    foreign = [w for w in OTHER_LANGUAGES if w not in ENGLISH]
    theirs = count(words, foreign)
    stop = (F.size(words) >= 5) & (theirs >= 2) & (theirs > count(words, ENGLISH)) & (count(others, ENGLISH) > count(others, foreign))
    there = (F.length(_text(written)) > 0) & (F.length(_text(resolved)) > 0)
    return F.when(there & (has_other_script(written) != has_other_script(resolved)), "script").when(there & stop, "stopword")


def is_strict_prefix(a: Column, b: Column) -> Column:
    """One normal title is the other's beginning, up to a word's end, and both are distinctive."""
    begins = lambda x, y: y.startswith(F.concat(x, F.lit(" ")))
    return (a != "") & (b != "") & (begins(a, b) | begins(b, a)) & is_distinctive(a) & is_distinctive(b)


def word_bag(title: Column, other: Column) -> Column:
    """Words of a normal title: final s folded, and two words as one where the other title writes them as one."""
    fold_s = lambda ws: F.transform(ws, lambda w: F.regexp_replace(w, r"^(.{4,}(?<![sui]))s$", "$1"))
    own, theirs = fold_s(F.split(title, " ")), fold_s(F.split(other, " "))
    nothing = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"))

    def step(state: Column, word: Column) -> Column:
        both = F.concat(state["held"], word)
        joined = F.struct(F.array_append(state["done"], both).alias("done"), F.lit(None).cast("string").alias("held"))
        kept = F.when(state["held"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["held"]))
        return F.when(state["held"].isNotNull() & F.array_contains(theirs, both), joined).otherwise(F.struct(kept.alias("done"), word.alias("held")))

    return F.aggregate(own, nothing, step, lambda s: F.when(s["held"].isNull(), s["done"]).otherwise(F.array_append(s["done"], s["held"])))


def less(bag: Column, other: Column) -> Column:
    """Multiset difference of two arrays."""
    of = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.filter(F.array_distinct(bag), lambda w: of(bag, w) > of(other, w))


def is_strict_extension(a: Column, b: Column) -> Column:
    """One normal title has all words of the other and more, and both are distinctive."""
    x, y = word_bag(a, b), word_bag(b, a)
    more, fewer = F.size(less(x, y)), F.size(less(y, x))
    return is_strict_prefix(a, b) | ((a != "") & (b != "") & is_distinctive(a) & is_distinctive(b) & ((more == 0) != (fewer == 0)))


# An edition's ordinal, a roman ordinal where series have one, and dotted i.v. (a route, not an ordinal).
_NUMBERS = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_EDITION = r"(?i)\b(%s)[\s-]+(?:revised[\s-]+)?(?:edition|update|revision|version|part|report)s?\b"
_ROMAN = "(i|ii|iii|iv|v|vi|vii|viii|ix|x)"
_SERIES = rf"(?i)\b(?:part|pt|no|number|vol|volume|chapter|chap|section|sect|series|book)\.?\s+{_ROMAN}\b"
_SEGMENT = rf"(?i)(?:^|[:;.–—-])\s*{_ROMAN}\s*[.:]\s"
_ROUTE = r"(?i)\b(?:i\s*\.\s*v|v\s*\.\s*i)\s*\."


def edition_ordinals(title: Column) -> Column:
    found = lambda of: F.transform(F.regexp_extract_all(_text(title), F.lit(_EDITION % of), F.lit(1)), lambda x: F.lower(x))
    numbers = F.create_map(*[F.lit(x) for i, w in enumerate(_NUMBERS, 1) for x in (w, i)])
    spelled = F.transform(found("|".join(_NUMBERS)), lambda w: numbers[w])
    digits = F.transform(found(r"\d{1,2}(?:st|nd|rd|th)"), lambda w: F.regexp_extract(w, r"^\d+", 0).cast("int"))
    return F.array_distinct(F.concat(spelled, digits))


def roman_ordinals(title: Column) -> Column:
    bare = F.regexp_replace(_text(title), _ROUTE, " ")
    found = F.concat(*[F.regexp_extract_all(bare, F.lit(p), F.lit(1)) for p in (_SERIES, _SEGMENT)])
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def title_years(title: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(_text(title), F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)))


def series_conflict(a: Column, b: Column) -> Column:
    """Two titles of one series: other roman ordinals, or years or editions of which none is shared."""
    some = lambda x: F.size(x) > 0
    romans = [F.array_sort(roman_ordinals(t)) for t in (a, b)]
    years, editions = [title_years(t) for t in (a, b)], [edition_ordinals(t) for t in (a, b)]
    apart = lambda x: some(x[0]) & some(x[1]) & ~F.arrays_overlap(*x)
    return (some(romans[0]) & some(romans[1]) & (romans[0] != romans[1])) | apart(years) | apart(editions)


# Labels that stand before a title, and words that carry none of it.
_CHAPTER = (
    r"(?i)^\s*(?:chapters?|sections?|parts?|appendix|unit)\s+(?:[ivxlcdm]+|\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|"
    r"sixteen|seventeen|eighteen|nineteen|twenty)\b\s*[-–—:.]\s+(?=[A-Za-z])"
)
_KIND = r"^\s*(?:[A-Z][\w'’&.\-]+(?:\s+[\w'’&.\-]+){0,5}?\s+(?i:report|statement|guidelines?|guidance|recommendations?|consensus(?:\s+statement)?))\.\s+(?=[A-Z][a-z])"
_RUN = r"^((?:(?!\.\s+[A-Z][a-z]).)*)\.\s+(?=[A-Z][a-z])"
_FILL = "a an and as at by for from in of on or the to with de la le".split()


def without_furniture(title: Column) -> Column:
    """(title, excised): a chapter label, a report's label or a run of authors before the title off, if four content words are left."""
    bare = F.trim(_text(title))
    content = lambda t: F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)[^\W\d_]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(_FILL)))
    run = F.regexp_extract(bare, _RUN, 1)
    names = F.filter(F.transform(F.split(run, ";"), lambda x: F.trim(x)), lambda x: x != "")
    authors = run.contains(";") & (F.size(names) >= 2) & F.forall(names, lambda x: x.rlike(r"^\p{Lu}") & (F.size(F.split(x, r"\s+")) <= 6))

    def cut(pattern: str) -> tuple[Column, Column]:
        rest = F.trim(F.regexp_replace(bare, pattern, ""))
        return rest, F.regexp_extract(bare, pattern, 0)

    value = lambda t, x: F.struct(t.alias("title"), x.alias("excised"))
    whole = value(title, F.lit(""))
    out = None
    for pattern, when in ((_CHAPTER, bare.rlike(_CHAPTER)), (_KIND, bare.rlike(_KIND))):
        rest, gone = cut(pattern)
        found = F.when(content(rest) >= 4, value(rest, gone)).otherwise(whole)
        out = F.when(when, found) if out is None else out.when(when, found)
    rest, _ = cut(_RUN)
    return out.when(authors & (content(rest) >= 4), value(rest, F.concat(run, F.lit(".")))).otherwise(whole)
