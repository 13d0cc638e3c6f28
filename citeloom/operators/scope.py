"""What can be judged at all: references out of scope, titles that are none, structural exclusions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions import names, similarity, titles
from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true

# Publication types that are no articles, titles that are none, and names of journals that stand for titles.
NON_ARTICLES = ("book", "webpage", "other", "confproc")
PLACEHOLDERS = ("", "in process", *titles.NO_TITLE)
MASTHEADS = (
    "proceedings of the national academy of sciences",
    "proceedings of the national academy of sciences of the united states of america",
    "proc of the national academy of sciences of the united states of america",
    "journal of the american medical association",
    "new england journal of medicine",
    "cochrane database of systematic reviews",
)
_REGULATION = r"(?i)^\s*title\s+\d+\s*[:.–—-]|\b\d+\s+cfr\b|\bu\.\s*s\.\s*c\.?\b"

UNSCOREABLE = "id int, title string, authors array<string>, journal string, pmid string, doi string, publication_type string, resolved boolean, r_title string, r_authors array<string>, r_journal string, is_container boolean"


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def is_non_article(publication_type: Column, pmid: Column, doi: Column, title: Column) -> Column:
    """No article by its type, and without anything to look it up by."""
    return F.lower(F.trim(F.coalesce(publication_type, F.lit("")))).isin(*NON_ARTICLES) & _blank(pmid) & _blank(doi) & _blank(title)


def is_scoreable_title(own: Column, masthead: Column) -> Column:
    """A normal title that can be compared: not empty, no placeholder, not the journal's normal name (columns, as they are used in lambdas)."""
    near = (F.least(F.length(own), F.length(masthead)) >= 8) & (similarity.containment(similarity.trigrams(own), similarity.trigrams(masthead)) >= 0.92)
    return (own != "") & ~own.isin(*titles.NO_TITLE) & ~((masthead != "") & ((own == masthead) | near))


def _twice(title: Column) -> Column:
    """A masthead in two spellings: two sides of an equals sign that are the same but for blanks."""
    sides = F.transform(F.split(F.lower(title), "="), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w\s]", " "), r"\s+", ""))
    long = F.filter(sides, lambda x: F.length(x) >= 6)
    return title.contains("=") & (F.size(long) > F.size(F.array_distinct(long)))


def _masthead_and_author(own: Column, author: Column, journal: Column) -> Column:
    """A normal title that is the resolved journal, perhaps abbreviated word by word, and the first author's surname."""
    fill = lambda t: F.filter(F.split(t, " "), lambda w: ~w.isin("the", "of", "and"))
    longer = fill(journal)

    def fits(alias: Column) -> Column:
        rest = fill(F.trim(F.regexp_replace(own, F.concat(F.lit(" "), alias, F.lit("$")), "")))
        each = F.zip_with(rest, longer, lambda a, b: F.coalesce(a.startswith(b) | b.startswith(a), F.lit(False)))
        return own.endswith(F.concat(F.lit(" "), alias)) & (F.size(rest) >= 3) & (F.size(rest) == F.size(longer)) & F.forall(each, lambda x: x)

    aliases = [author, F.regexp_extract(author, r"^\S+", 0), F.regexp_extract(author, r"\S+$", 0)]
    return (author != "") & (journal != "") & F.greatest(*[F.coalesce(fits(a), F.lit(False)) for a in aliases])


def unscoreable_bucket(e) -> Column:
    """Why a pair's titles can't be compared; null if they can. ``e`` gives ``UNSCOREABLE`` by name; the first rule that holds.

    Title-shaped text in another field is only told with a journal authority,
    which is not among the columns.
    """
    title = F.coalesce(e("title"), F.lit(""))
    own, masthead = titles.normal_title(title), titles.normal_title(e("journal"))
    bare = titles.normal_title(F.trim(F.regexp_replace(title, r"\s*\([^)]*\)\s*$", "")))
    author = titles.normal_title(F.get(e("r_authors"), 0))
    word = own.rlike(r"[a-z]{2,}")
    return first_match(
        [
            (is_non_article(e("publication_type"), e("pmid"), e("doi"), e("title")), "non_article_reference"),
            (is_true(e("resolved")) & is_true(e("is_container")), "resolved_book_container"),
            (is_true(e("resolved")) & titles.normal_title(e("r_title")).isin(*PLACEHOLDERS), "resolved_no_title"),
            (own == "", "no_claimed_title"),
            (title.rlike(r"(?i)^\s*(?:et\s+al\.?|and\s+colleagues)\s*$"), "author_residue_as_title"),
            ((masthead != "") & (own == masthead), "journal_as_title"),
            (own.isin(*MASTHEADS) | bare.isin(*MASTHEADS) | _twice(title), "journal_as_title"),
            (is_true(e("resolved")) & _masthead_and_author(own, author, titles.normal_title(e("r_journal"))), "journal_author_residue_as_title"),
            (~own.contains(" ") & (F.length(own) >= 8) & ~own.rlike(r"\d") & word, "single_word_title"),
            (~word & ~title.rlike(r"[\p{L}&&[^\x00-\x7F]]") & own.rlike(r"\d"), "numeric_or_year_only_title"),
            (title.rlike(_REGULATION), "regulatory_code"),
        ]
    )


def structural_exclusion(citance: Column, resolved_value: Column, resolved_kind: Column, claimed_pmid: Column) -> Column:
    """Why a reference can't be judged: no citing sentence, or no identifier that was resolved or claimed."""
    known = ~_blank(resolved_value) & ~_blank(resolved_kind)
    return first_match([(_blank(citance), "excluded_no_citance"), (~known & _blank(claimed_pmid), "excluded_no_cited_pmid")])


def is_citation_id(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^PMC\d+:\S+$"), F.lit(False))


# Tiers by publication type, most specific first, and by subject heading.
TYPE_TIERS = (
    ("meta-analysis", "systematic_review_or_meta_analysis"), ("systematic review", "systematic_review_or_meta_analysis"),
    ("randomized controlled trial", "rct"), ("controlled clinical trial", "rct"), ("clinical trial, phase iii", "rct"),
    ("clinical trial, phase ii", "rct"), ("clinical trial", "rct"), ("observational study", "prospective_cohort"),
    ("comparative study", "retrospective_cohort"), ("case reports", "case_series_or_report"), ("preprint", "preprint_unreviewed"),
)
HEADING_TIERS = (
    ("cohort studies", "prospective_cohort"), ("prospective studies", "prospective_cohort"), ("retrospective studies", "retrospective_cohort"),
    ("case-control studies", "case_control"), ("cross-sectional studies", "cross_sectional"),
)
TIERS = (
    "systematic_review_or_meta_analysis", "rct", "prospective_cohort", "retrospective_cohort", "case_control", "cross_sectional",
    "case_series_or_report", "preprint_unreviewed",
)


def evidence_tier(hint: Column, types: Column, headings: Column) -> Column:
    """(tier, basis): a known hint, an exact type, a type that holds a name, a heading; else the lowest tier, unclassified."""
    low = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    has = lambda xs, name: F.exists(low(xs), lambda x: x.contains(name))
    value = lambda tier, basis: F.struct(tier.alias("tier"), basis.alias("basis"))
    out = F.when(hint.isin(*TIERS), value(hint, F.concat(F.lit("tier_hint:"), hint)))
    for name, tier in TYPE_TIERS:
        out = out.when(F.array_contains(low(types), name), value(F.lit(tier), F.lit(f"publication_type:{name}")))
    for name, tier in TYPE_TIERS:
        out = out.when(has(types, name), value(F.lit(tier), F.lit(f"publication_type_contains:{name}")))
    for name, tier in HEADING_TIERS:
        out = out.when(has(headings, name), value(F.lit(tier), F.lit(f"mesh:{name}")))
    return out.otherwise(value(F.lit(TIERS[-1]), F.lit("unclassified")))


#: Types of reviews and of a retracted work (fixed values).
REVIEWS = ("review", "systematic review", "meta-analysis", "scoping review", "narrative review", "review literature as topic")


def is_review(types: Column) -> Column:
    """Null where the types are not known."""
    return F.exists(types, lambda t: F.lower(t).isin(*REVIEWS))


def is_retracted(types: Column) -> Column:
    """A retracted work, not a notice of one; null where the types are not known."""
    return F.exists(types, lambda t: F.lower(F.trim(t)) == "retracted publication")


# Messages of failed replies, by bucket; tries of each bucket, whether the last may be longer; and where it ends.
FAILURES = (
    ("content_sha256_mismatch", r"content_sha256 does not (match stored text|bind its source text)"),
    ("empty_model_response", r"empty model output"),
    ("malformed_model_response", r"not one bare JSON object|Unterminated string|Expecting value|Expecting ',' delimiter|Extra data"),
    ("schema_key_mismatch", r"JSON keys mismatch"),
    ("invalid_schema", r"dimensions must be an object with exactly the four ladder keys"),
    (
        "semantic_validation_failure",
        r"is not verbatim in its bound section|bound to an unknown section sha256|requires the same clear cited and candidate direction|"
        r"conflicts with different clear source directions|require scope_mismatch_axis|must be strictly before as_of_date",
    ),
)
TRIES = {"empty_model_response": (3, True), "malformed_model_response": (3, True), "schema_key_mismatch": (2, False)}
ENDS = {
    "empty_model_response": ("HUMAN_REVIEW_REQUIRED", "empty_model_response_after_retry"),
    "malformed_model_response": ("HUMAN_REVIEW_REQUIRED", "malformed_model_response_after_retry"),
    "schema_key_mismatch": ("UNJUDGEABLE", "schema_key_mismatch_after_retry"),
    "invalid_schema": ("UNJUDGEABLE", "invalid_schema_response"),
    "semantic_validation_failure": ("UNJUDGEABLE", "semantic_validation_failure"),
    "content_sha256_mismatch": ("UNJUDGEABLE", "evidence_representation_defect"),
}


def parse_failure(message: Column) -> Column:
    """(bucket, tries, longer, outcome, reason) of a failed reply's message."""
    text = F.coalesce(message, F.lit(""))
    bucket = first_match([(text.rlike(p), b) for b, p in FAILURES], "unclassified_parse_failure")
    of = lambda table, i, other: F.coalesce(*[F.when(bucket == b, F.lit(v[i])) for b, v in table.items()], F.lit(other))
    return F.struct(
        bucket.alias("bucket"),
        of(TRIES, 0, 1).alias("tries"),
        of(TRIES, 1, False).alias("longer"),
        of(ENDS, 0, "HUMAN_REVIEW_REQUIRED").alias("outcome"),
        of(ENDS, 1, "schema_contract_failure_after_retry").alias("reason"),
    )


# ---- same-work entries: why a title is not usable, and the address that proves the work ----

# Containers, and words that name a separate record.
CONTAINERS = "statpearls elsevier springer wiley mcgraw lippincott saunders churchill thieme humana blackwell karger bookshelf treasure island".split()
CONTAINER_PHRASES = ("treasure island", "university press", "academic press", "crc press", "wolters kluwer", "nova science")
CONTAINER_TYPES = ("book", "book chapter", "books", "chapter")
SEPARATE = (
    "commentary comment comments reply replies response rebuttal discussion erratum errata corrigendum correction corrections retraction retracted "
    "withdrawn editorial letter preface foreword addendum supplement supplementary expression concern part chapter volume update updated author "
    "authors abstract poster protocol preprint summary translation reprint republished"
).split()
ENTRY = "id int, written struct<title: string, authors: array<string>, year: string, journal: string, volume: string, pages: string, doi: string>, resolved struct<title: string, authors: array<string>, year: string, journal: string, volume: string, pages: string, doi: string, is_container: boolean, publication_types: array<string>>"


def _plain(words: Column) -> Column:
    return F.array_join(words, " ")


def _holds_phrase(plain: Column) -> Column:
    return plain.rlike(rf"\b(?:{'|'.join(CONTAINER_PHRASES)})\b")


def without_container(plain: Column) -> Column:
    rest = F.split(F.regexp_replace(plain, rf"\b(?:{'|'.join(CONTAINER_PHRASES)})\b", " "), r"\s+")
    return _plain(F.filter(rest, lambda t: (t != "") & ~t.isin(CONTAINERS)))


def is_subset(short: Column, long: Column, matched: Column) -> Column:
    """Content words of a title within a longer one in order; one may be missing from six on; what is more names no other record."""
    n = F.size(short)
    shared = F.filter(short, lambda w: F.array_contains(long, w))
    telling = F.exists(shared, lambda w: F.length(w) >= 7) | (F.size(shared) >= 6)
    extra = F.filter(long, lambda w: ~F.array_contains(short, w))
    other = F.exists(extra, lambda w: w.isin(SEPARATE))
    return (n >= 4) & (n != F.size(long)) & ((matched == n) | ((n >= 6) & (matched >= n - 1))) & telling & ~other


def author_evidence(a: Column, b: Column, near: Column) -> Column:
    """(agrees, why) of two rosters as word lists: null if one is missing or all its names are bodies; ``near``: names alike by letters."""
    body = lambda ws: F.exists(ws, lambda w: w.isin(names.BODY_WORDS)) | (F.size(ws) >= 4)
    shared = F.exists(a, lambda x: F.exists(b, lambda y: F.arrays_overlap(x, y)))
    value = lambda v, why: F.struct(F.lit(v).cast("boolean").alias("agrees"), F.lit(why).alias("why"))
    return (
        F.when((F.size(a) <= 0) | (F.size(b) <= 0), value(None, "missing"))
        .when(F.forall(a, body) | F.forall(b, body), value(None, "corporate"))
        .when(shared, value(True, "shared_token"))
        .when(near, value(True, "fuzz"))
        .otherwise(value(False, "disagree"))
    )


def with_entry(rows):
    """``verdict, entry, address`` of ``ENTRY`` rows: which entry explains the titles, and whether four of six fields agree."""
    from citeloom.functions import text

    w, r = F.col("written"), F.col("resolved")
    out = rows.withColumns({"w_words": titles.plain_words(w["title"]), "r_words": titles.plain_words(r["title"])})
    out = out.withColumns({"w_plain": _plain(F.col("w_words")), "r_plain": _plain(F.col("r_words"))})
    content = lambda ws: F.filter(ws, lambda x: ~x.isin(titles.ENGLISH))
    out = out.withColumns({"w_content": content(F.col("w_words")), "r_content": content(F.col("r_words"))})
    flip = F.size("w_content") <= F.size("r_content")
    out = out.withColumns({"short": F.when(flip, F.col("w_content")).otherwise(F.col("r_content")), "long": F.when(flip, F.col("r_content")).otherwise(F.col("w_content"))})
    out = out.withColumn("matched", similarity.ordered_matches_udf("short", "long"))
    lists = lambda a: F.filter(F.transform(F.split(_plain_names(a), names._BREAK), lambda x: F.filter(F.split(x, " "), lambda t: t != "")), lambda x: F.size(x) > 0)

    def _plain_names(a: Column) -> Column:
        joined = F.array_join(F.coalesce(a, F.array().cast("array<string>")), names._BREAK)
        # the break between names is not a word character, so it is kept apart from the marks
        parts = F.transform(F.split(titles.without_marks_udf(joined), names._BREAK), lambda x: titles.squeezed(F.regexp_replace(F.lower(x), r"(?U)[^\w\s]", " ")))
        return F.array_join(parts, names._BREAK)

    out = out.withColumns({"w_names": lists(w["authors"]), "r_names": lists(r["authors"])})
    whole = lambda ns, gap: F.array_join(F.transform(ns, lambda x: F.array_join(x, gap)), names._BREAK)
    near = F.greatest(*[_near_udf(whole(F.col("w_names"), g), whole(F.col("r_names"), g)) for g in (" ", "")]) >= 85
    out = out.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("author", author_evidence(F.col("w_names"), F.col("r_names"), F.col("near")))
    journals = [_plain(titles.plain_words(x["journal"])) for x in (w, r)]
    out = out.withColumn("journal_near", F.when((journals[0] != "") & (journals[1] != ""), similarity.token_set_udf(*journals)))
    agree = [
        text.same_doi(w["doi"], r["doi"]),
        text.leading_number(w["year"]) == text.leading_number(r["year"]),
        text.leading_number(w["volume"]) == text.leading_number(r["volume"]),
        text.first_page(w["pages"]) == text.first_page(r["pages"]),
        F.col("journal_near") >= 80,
        F.col("author.agrees"),
    ]
    count = sum((F.when(is_true(a), 1).otherwise(0) for a in agree), F.lit(0))
    types = F.exists(F.coalesce(r["publication_types"], F.array().cast("array<string>")), lambda p: F.lower(F.trim(p)).isin(*CONTAINER_TYPES))
    hit = lambda ws, plain: F.exists(ws, lambda x: x.isin(CONTAINERS)) | _holds_phrase(plain)
    container = is_true(r["is_container"]) | types | hit(F.col("w_words"), F.col("w_plain")) | hit(F.col("r_words"), F.col("r_plain"))
    equal = (F.col("w_plain") != "") & (F.col("r_plain") != "") & ((F.col("w_plain") == F.col("r_plain")) | (F.array_sort(F.array_distinct("w_content")) == F.array_sort(F.array_distinct("r_content"))))
    entry = first_match(
        [
            (titles.language_trigger(w["title"], r["title"]).isNotNull(), "language"),
            (container, "container"),
            (is_subset(F.col("short"), F.col("long"), F.col("matched")), "subset"),
            (equal & (F.col("author.why") == "corporate"), "corporate"),
        ]
    )
    out = out.withColumn("entry", entry)
    cleaned = [without_container(F.col(c)) for c in ("w_plain", "r_plain")]
    same = F.when(F.col("entry") == "container", ~is_false(F.col("author.agrees")) & (cleaned[0] != "") & (cleaned[0] == cleaned[1])).otherwise(F.col("address") >= 4)
    out = out.withColumn("address", F.when(F.col("entry").isNull() | (F.col("entry") == "container"), 0).otherwise(count))
    return out.withColumn("verdict", F.when(F.col("entry").isNotNull() & same, "SAME_WORK").otherwise("FLAG"))


def _best_pair(a: str, b: str) -> float:
    return max((similarity.ratio(x, y) for x in a.split(names._BREAK) for y in b.split(names._BREAK) if x and y), default=0.0)


_near_udf = F.pandas_udf(similarity._pairwise(_best_pair), T.DoubleType())
