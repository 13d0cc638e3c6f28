"""A printed reference against a database's record: fields, score, flag and verdict.

``pairs`` tables have two struct columns, ``claimed`` and ``cand``, with
``title, authors, year, journal, volume, pages, doi`` and, on the record's side,
``year_from_dep, publication_types, alternate_titles, language``. A field that
can't be judged is null and counts neither way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import names, similarity, text, titles
from citeloom.functions.rules import settled
from citeloom.functions.tri import is_false, is_true

CLAIMED = "title string, authors array<string>, year int, journal string, volume string, pages string, doi string, is_collab boolean"
RECORD = CLAIMED.replace("is_collab boolean", "year_from_dep boolean, publication_types array<string>, alternate_titles array<string>, language string")
PAIRS = f"id int, claimed struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in CLAIMED.split(', ')))}>, cand struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ') for x in RECORD.split(', ')))}>"

# Least score to accept, margin over the second best, title of the same work, and what fields add or take.
ACCEPT, MARGIN, SAME_TITLE = 0.85, 0.05, 0.92
ADDS = {"author": 0.05, "year": 0.05, "journal": 0.03, "place": 0.02}
TAKES = {"author": 0.15, "year": 0.10}
LIVING = ("statpearls", "ncbi bookshelf", "bookshelf")

# Venues, registrants and dates of preprints.
PREPRINT_VENUES = (
    "arxiv", "biorxiv", "biorvix", "medrxiv", "chemrxiv", "ssrn", "research square", "researchsquare", "preprints.org", "preprint", "osf", "psyarxiv", "techrxiv", "authorea",
)
PREPRINT_DOI = r"^10\.(?:48550|21203|26434|31234|31219)/|^10\.1101/\d{4}\.\d{2}\.\d{2}\."


def _both(f, *parts: Column) -> list[Column]:
    return [f(p) for p in parts]


def any_true(*flags: Column) -> Column:
    return F.greatest(*[F.coalesce(f, F.lit(False)) for f in flags])


def is_preprint(journal: Column, doi: Column) -> Column:
    venue = F.lower(F.coalesce(journal, F.lit("")))
    return any_true(*[venue.contains(v) for v in PREPRINT_VENUES], F.lower(F.coalesce(doi, F.lit(""))).rlike(PREPRINT_DOI))


def with_forms(pairs: DataFrame) -> DataFrame:
    """Normal and canonical forms of both sides, each computed once; ``own_authors`` are the claimed ones after repair."""
    c, r = F.col("claimed"), F.col("cand")
    plausible = F.filter(F.coalesce(c["authors"], F.array().cast("array<string>")), lambda a: ~names.is_implausible(a))
    restored = names.restored_body(F.get(F.col("plausible"), 0), r["authors"])
    repaired = F.when(F.col("restored").isNotNull(), F.concat(F.array("restored"), F.slice("plausible", 2, F.greatest(F.size("plausible"), F.lit(1))))).otherwise(F.col("plausible"))
    source = F.concat_ws(" ", c["title"], c["journal"], r["title"], r["journal"])
    out = pairs.withColumn("plausible", plausible).withColumn("restored", restored)
    out = out.withColumn("own_authors", repaired).withColumn(
        "repair",
        F.when(F.col("restored").isNotNull(), "corporate_name_inverted").when((F.size(c["authors"]) > 0) & (F.size("plausible") == 0), "implausible_author_field"),
    )
    first = lambda a: names.before_comma(F.coalesce(F.get(a, 0), F.lit("")))
    forms = (
        out.withColumns(
            {
                "c_title": titles.normal_title(c["title"]), "r_title": titles.normal_title(r["title"]),
                "c_canon": titles.canonical_title(c["title"]), "r_canon": titles.canonical_title(r["title"]),
                "c_variants": titles.title_variants(c["title"]), "r_variants": titles.title_variants(r["title"]),
                "c_journal": titles.canonical_title(c["journal"]), "r_journal": titles.canonical_title(r["journal"]),
                "c_names": names.folded_each(F.col("own_authors")), "r_names": names.folded_each(r["authors"]),
                "c_first": titles.normal_title(first(F.col("own_authors"))), "r_first": titles.normal_title(first(r["authors"])),
                "source": titles.canonical_title(source),
            }
        )
        .withColumns({"c_names": names.normal_names(F.col("c_names")), "r_names": names.normal_names(F.col("r_names"))})
        .withColumn("living", any_true(*[F.col("source").contains(x) for x in LIVING]))
        .drop("plausible", "restored", "source")
    )
    return settled(forms, *[c for c in forms.columns if c not in pairs.columns])


def with_fields(forms: DataFrame) -> DataFrame:
    """``fields``: author, first_author, year, journal, volume, pages, doi, each true, false or null."""
    c, r = F.col("claimed"), F.col("cand")
    there = lambda a, b, same: F.when((a != "") & (b != ""), same)
    volumes, pages = _both(text.digits, c["volume"], r["volume"]), _both(text.full_pages, c["pages"], r["pages"])
    dois = _both(lambda d: F.coalesce(d, F.lit("")), c["doi"], r["doi"])
    out = forms.withColumn("journal_ok", F.when((F.col("c_journal") != "") & (F.col("r_journal") != ""), names.same_journal_udf("c_journal", "r_journal")))
    out = settled(out.withColumn("author_ok", names.surname_present(F.col("c_first"), F.col("r_names"))), "author_ok", "journal_ok")
    first = F.when((F.col("c_first") != "") & (F.size("r_names") > 0), names.same_first_author(F.col("c_first"), F.col("r_first")))
    gap = F.abs(c["year"] - r["year"])
    early = (gap <= 2) & is_true(r["year_from_dep"]) & is_true(F.col("author_ok")) & is_true(F.col("journal_ok"))
    year = F.when(F.col("living") | gap.isNull(), F.lit(None).cast("boolean")).when(gap <= 1, True).when(early, None).otherwise(False)
    fields = {
        "author": F.col("author_ok"),
        "first_author": first,
        "year": year,
        "journal": F.col("journal_ok"),
        "volume": there(*volumes, volumes[0] == volumes[1]),
        "pages": there(*pages, pages[0] == pages[1]),
        "doi": there(*dois, text.same_doi(c["doi"], r["doi"])),
    }
    return settled(out.withColumn("fields", F.struct(*[v.alias(k) for k, v in fields.items()])).drop("journal_ok", "author_ok"), "fields")


FIVE = ("author", "year", "journal", "volume", "pages")


def first_author_stands(f: Column) -> Column:
    return is_true(f["first_author"]) | (f["first_author"].isNull() & is_true(f["author"]))


def composite(similarity_: Column, f: Column, accept: float = ACCEPT) -> tuple[Column, Column]:
    """(score, override): similarity, raised and lowered by fields; floored where first author and journal agree and nothing disagrees."""
    place = is_true(f["volume"]) | is_true(f["pages"])
    agree = {"author": is_true(f["author"]), "year": is_true(f["year"]), "journal": is_true(f["journal"]), "place": place}
    raw = similarity_
    for k, v in ADDS.items():
        raw = raw + F.when(agree[k], v).otherwise(0.0)
    for k, v in TAKES.items():
        raw = raw - F.when(is_false(f[k]), v).otherwise(0.0)
    override = first_author_stands(f) & is_true(f["journal"]) & ~any_true(*[is_false(f[k]) for k in FIVE]) & (raw < accept)
    score = F.when(override, F.lit(accept)).otherwise(raw)
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4), override


def with_score(pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """Adds ``title_similarity, score, override`` to ``fields`` and the forms."""
    out = with_fields(with_forms(pairs)).withColumn("raw_similarity", similarity.variants_similarity(F.col("c_variants"), F.col("r_variants")))
    out = settled(out, "raw_similarity")
    score, override = composite(F.col("raw_similarity"), F.col("fields"), accept)
    out = out.withColumns({"score": score, "override": override, "title_similarity": F.bround("raw_similarity", 4)})
    return settled(out, "score", "override", "title_similarity")


def is_flagged(scored: DataFrame, accept: float = ACCEPT, *, tripwire: bool = True) -> Column:
    """Whether a pair needs a look: score or title too low, years apart, or (``tripwire``) another first author."""
    f = scored["fields"]
    strong = first_author_stands(f) & is_true(f["journal"]) & ~any_true(*[is_false(f[k]) for k in FIVE])
    other_first = is_false(f["first_author"]) if tripwire else F.lit(False)
    return (scored["score"] < accept) | is_false(f["year"]) | other_first | ((scored["title_similarity"] < accept) & ~strong)


def disagrees(f: Column, title: Column) -> Column:
    place = (is_false(f["volume"]) | is_false(f["pages"])) & (title < SAME_TITLE)
    return is_false(f["first_author"]) | is_false(f["author"]) | is_false(f["year"]) | place


# ---- the same work? ----

# Notices, derived works, documents of bodies, reprints, and locators of abstracts.
_NOTICE = r"(?i)^\s*(corrigendum|erratum|correction)\b"
_DERIVED = (
    r"(?i)(?:^|[.:;]\s+)\s*(?:(?:a|an|the|editorial|invited)\s+){0,2}(?:(?:systematic|scoping|narrative|updated|umbrella|rapid|integrative|critical|literature)\s+){0,2}"
    r"(?:commentary|comment|reply|review|perspective|editorial|retraction|protocol|meta[ -]?analysis)\b(?:\s*[:.\-–—]|\s+(?:on|to|of|for)\b)"
)
_DOCUMENT = r"(?i)\b(declaration|position\s+paper|guidelines?|guidance|consensus(?:\s+statement)?|recommendations?|standard)\b"
_REPRINT = r"(?i)^\s*(?:pillars?|classic(?:al)?|landmark|seminal)\s+(?:article|paper)\b|^\s*reprint(?:ed)?\b|\breprinted\s+from\b|\brepublished\b"
_REPRINT_TYPES = ("republished article", "reprint", "classical article")
ABSTRACT_PAGE = r"(?i)^\s*(?:[SP]\d|E\d+[A-Za-z]?\s*$|\d{1,4}[A-Za-z]?\s*$)"
_SUPPLEMENT_PAGE = r"(?i)^\s*[SP]\d"
# Least title similarity, roster share, content share and telling words of one study's abstract and article.
ABSTRACT_MIN, LINEAGE_MIN = (0.87, 0.75, 0.77, 6), (0.80, 0.60, 0.77, 6)


def telling_words(canonical: Column) -> Column:
    return F.array_distinct(F.filter(F.split(canonical, " "), lambda t: (F.length(t) >= 4) & ~t.isin(titles.WEAK_WORDS)))


def same_volume(c: Column, r: Column) -> Column:
    a, b = text.digits(c["volume"]), text.digits(r["volume"])
    return (a != "") & (a == b)


def same_first_page(c: Column, r: Column) -> Column:
    """Numbers of the first pages are the same, and both or neither are in a supplement."""
    page = lambda x: text.digits(F.regexp_extract(F.trim(F.coalesce(x["pages"], F.lit(""))), r"^([^-‐-―]*)", 1))
    extra = lambda x: F.coalesce(x["pages"], F.lit("")).rlike(_SUPPLEMENT_PAGE)
    return (extra(c) == extra(r)) & (page(c) != "") & (page(c) == page(r))


def is_lineage(scored: DataFrame) -> Column:
    """An abstract or preprint and the article of the same study: title, most of the roster, and a shared DOI or most of the content."""
    c, r = scored["claimed"], scored["cand"]
    title, people, content, least = LINEAGE_MIN
    early = F.coalesce(c["pages"], F.lit("")).rlike(ABSTRACT_PAGE) | is_preprint(c["journal"], c["doi"])
    own = telling_words(scored["c_canon"])
    same = is_true(scored["fields"]["doi"]) | ((F.size(own) >= least) & (names.share_of(own, F.split(scored["r_canon"], " ")) >= content))
    team = names.share_of(names.roster(scored["c_names"], 2), names.roster(scored["r_names"], 2)) >= people
    return early & (scored["title_similarity"] >= title) & team & same


def same_work(scored: DataFrame) -> Column:
    """(same, reason, blocked): why two records are one work, or what speaks against it; first rule that holds.

    The rules that need evidence outside the pair (a journal authority, the raw
    citation) are not among them.
    """
    c, r, f = scored["claimed"], scored["cand"], scored["fields"]
    ct, rt, ts = scored["c_canon"], scored["r_canon"], scored["title_similarity"]
    first, journal, doi = is_true(f["first_author"]), is_true(f["journal"]), is_true(f["doi"])
    year = F.coalesce(c["year"] == r["year"], F.lit(False))
    volume, page = same_volume(c, r), same_first_page(c, r)
    series = titles.series_conflict(c["title"], r["title"])
    derived = (ct != rt) & (F.coalesce(r["title"], F.lit("")).rlike(_DERIVED) | F.coalesce(c["title"], F.lit("")).rlike(_DERIVED))
    bodies = lambda x: F.coalesce(F.get(x["authors"], 0), F.lit("")).rlike("(?i)" + names._INSTITUTION)
    other_body = bodies(c) & bodies(r) & (scored["c_first"] != scored["r_first"])
    inside = rt.contains(ct)
    shared = F.size(F.array_intersect(telling_words(ct), telling_words(rt)))
    bracketed = F.trim(F.coalesce(r["title"], F.lit(""))).rlike(r"(?s)^\[.*\]\.*$")
    types = F.transform(F.coalesce(r["publication_types"], F.array().cast("array<string>")), lambda p: F.lower(p))
    reprint = F.coalesce(r["title"], F.lit("")).rlike(_REPRINT) | F.arrays_overlap(types, F.array(*[F.lit(x) for x in _REPRINT_TYPES]))
    recited = F.coalesce(r["title"].contains(c["year"].cast("string")), F.lit(False)) & (
        ((text.digits(c["volume"]) != "") & F.rlike(r["title"], F.concat(F.lit(r"\b"), text.digits(c["volume"]), F.lit(r"\b"))))
    )
    title, people, content, least = ABSTRACT_MIN
    own = telling_words(ct)
    abstract = (
        F.coalesce(c["pages"], F.lit("")).rlike(ABSTRACT_PAGE) & (F.size(own) >= least) & (ts >= title)
        & (names.share_of(names.roster(scored["c_names"]), names.roster(scored["r_names"])) >= people) & (names.share_of(own, F.split(rt, " ")) >= content)
    )
    overlap = first | F.arrays_overlap(scored["c_names"], scored["r_names"])
    gap = F.coalesce(F.abs(c["year"] - r["year"]) >= 2, F.lit(False))
    missing = F.size(F.array_except(names.roster(scored["c_names"]), names.roster(scored["r_names"])))
    distinctive = titles.is_distinctive(ct) & titles.is_distinctive(rt)
    mixed = doi & journal & volume & page & gap & distinctive & (ts >= 0.55) & (ts < 0.85) & (missing >= 2)
    document = F.coalesce(c["title"], F.lit("")).rlike(_DOCUMENT) & F.coalesce(r["title"], F.lit("")).rlike(_DOCUMENT)
    other_language = ~F.lower(F.coalesce(c["title"], F.lit(""))).rlike(r"^\p{ASCII}*$")
    none = F.lit(None).cast("string")
    rules = [
        ((ct == "") | (rt == ""), False, none),
        (doi & first & (ts >= SAME_TITLE) & ~series, True, "shared_doi_same_work"),
        (~derived & series, False, "series_ordinal_conflict"),
        (~derived & other_body, False, "corporate_author_conflict"),
        (scored["living"] & ((first & ct.contains(" ") & (inside | ct.contains(rt))) | (ct == rt)), True, "living_chapter_revision"),
        (mixed, True, "mixed_identity_citation"),
        (doi & year & journal & volume & page & (ts >= 0.85) & distinctive, True, "overwhelming_bibliographic_anchor"),
        (F.array_contains(F.coalesce(scored["alternates"], F.array().cast("array<string>")), ct), True, "authoritative_title_alias"),
        (derived, False, "derivative_publication"),
        ((ct == rt) & ~ct.isin(*titles.GENERIC_TITLES) & (first | doi | (page & (volume | f["volume"].isNull())) | (year & journal)), True, "canonical_title_exact"),
        (bracketed & (ts >= 0.80) & year & (journal | first), True, "translated_title_metadata"),
        (other_language & year & journal & (ts >= 0.82) & (shared >= 3), True, "translated_title_shared_anchors"),
        (reprint & (F.length(ct) >= 18) & inside & (F.length(rt) - F.length(ct) >= 5) & first & recited, True, "historical_republication"),
        (abstract, True, "conference_abstract_publication"),
        (F.coalesce(r["title"], F.lit("")).rlike(_NOTICE) & (ts >= 0.80) & overlap, True, "correction_notice"),
        ((F.length(ct) >= 24) & inside & first & journal & year, True, "title_stem_same_issue"),
        (document & journal & (ts >= 0.70) & (shared >= 3) & (doi | page | overlap | year), True, "institutional_document_revision"),
    ]
    out = None
    for when, same, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        value = F.struct(F.lit(same).alias("same"), F.when(F.lit(same), reason).alias("reason"), F.when(~F.lit(same), reason).alias("blocked"))
        out = F.when(when, value) if out is None else out.when(when, value)
    return out.otherwise(F.struct(F.lit(False).alias("same"), none.alias("reason"), none.alias("blocked")))


def with_verdict(pairs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``verdict`` and ``reason`` of every pair; the first gate that holds."""
    c, r = F.col("claimed"), F.col("cand")
    out = with_score(pairs, accept).withColumn("alternates", names.folded_each(F.coalesce(r["alternate_titles"], F.array().cast("array<string>"))))
    out = out.withColumn("alternates", names.normal_names(F.col("alternates")))
    out = settled(out, "alternates")
    out = settled(out.withColumn("work", same_work(out)).withColumn("trigger", titles.language_trigger(c["title"], r["title"])), "work", "trigger")
    f, ts, score, work = F.col("fields"), F.col("title_similarity"), F.col("score"), F.col("work")
    apart, same = disagrees(f, ts), work["same"]
    place = is_true(f["pages"]) & is_true(f["volume"]) & is_true(f["journal"]) & ~is_false(f["doi"])
    theirs = F.transform(F.coalesce(r["publication_types"], F.array().cast("array<string>")), lambda p: F.lower(p))
    own_preprint = is_preprint(c["journal"], c["doi"])
    to_preprint = (is_preprint(r["journal"], r["doi"]) | F.array_contains(theirs, "preprint")) & ~own_preprint
    revised = F.col("living") & F.coalesce(F.abs(c["year"] - r["year"]) > 1, F.lit(False))
    not_false = lambda *ks: ~any_true(*[is_false(f[k]) for k in ks])
    every = lambda *ks: F.least(*[is_true(f[k]) for k in ks])
    guards = (
        (not_false("volume", "first_author", "year", "doi") & any_true(f["volume"], f["first_author"], f["year"]))
        | (is_false(f["volume"]) & every("first_author", "year", "journal", "pages", "doi"))
        | (is_false(f["first_author"]) & is_false(f["author"]) & every("year", "journal", "volume", "pages", "doi"))
    )
    near = (ts >= SAME_TITLE) & apart & titles.is_distinctive(F.col("c_canon")) & titles.is_distinctive(F.col("r_canon")) & work["blocked"].isNull()
    early = own_preprint & first_author_stands(f) & apart
    reason = work["reason"]
    gates = [
        (F.col("trigger").isNotNull() & same, "review_same_work_variant", reason),
        (F.col("trigger").isNotNull(), "out_of_scope_cross_language", F.col("trigger")),
        (work["blocked"] == "series_ordinal_conflict", "review_wrong_paper", F.lit("series_ordinal_conflict")),
        (work["blocked"] == "corporate_author_conflict", "review_wrong_paper", F.lit("corporate_author_conflict")),
        (to_preprint & ~same, "review_wrong_paper", F.lit("resolved_preprint_target")),
        (F.col("repair").isNotNull() & ~apart & (score >= accept), "review_same_work_variant", F.col("repair")),
        (revised & same, "review_same_work_variant", reason),
        (revised & ~same & ~apart & (score >= accept), "review_formatting", F.lit("title_revision_unproven")),
        (~apart & (score >= accept) & ~(place & (ts < accept)), "match", F.lit(None).cast("string")),
        (same, "review_same_work_variant", reason),
        (near, "review_same_work_variant", F.lit("near_identical_title")),
        (is_lineage(out), "review_same_work_variant", F.lit("version_chain_same_work")),
        (early & ~is_false(f["doi"]), "review_same_work_variant", F.lit("preprint_published_version")),
        (early, "review_wrong_paper", F.lit("preprint_shape_unconfirmed")),
        (place & ~apart, "review_same_work_variant", F.lit("physical_location_same_work")),
        (titles.is_strict_extension(F.col("c_title"), F.col("r_title")) & guards, "review_same_work_variant", F.lit("strict_prefix_title")),
        (apart, "review_wrong_paper", F.lit("field_disagreement")),
        (score >= accept, "match", F.lit(None).cast("string")),
        (~any_true(f["author"], f["year"], f["journal"]), "review_wrong_paper", F.lit("nothing_agrees")),
    ]
    found = None
    for gate, verdict, why in gates:
        value = F.struct(F.lit(verdict).alias("verdict"), why.alias("reason"))
        found = F.when(gate, value) if found is None else found.when(gate, value)
    other = F.struct(F.lit("review_formatting").alias("verdict"), F.lit(None).cast("string").alias("reason"))
    out = settled(out.withColumn("found", found.otherwise(other)), "found")
    return out.select("*", "found.*").drop("found")


# ---- candidates ----


def best_of(scored: DataFrame, key: str, *, accept: float = ACCEPT, margin: float = MARGIN) -> DataFrame:
    """The best candidate of each reference, with ``ambiguous`` (a near tie) and ``confident``; ``ord`` breaks ties."""
    ranked = scored.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("score", (-F.col("ord")).alias("minus"))), asc=False), 1, 2).alias("top"))
    top, second = F.get("top", 0), F.get("top", 1)
    tie = F.coalesce(F.round(top["score"] - second["score"], 10) < margin, F.lit(False))
    return ranked.select(key, (-top["minus"]).alias("ord"), top["score"].alias("score"), tie.alias("ambiguous"), ((top["score"] >= accept) & ~tie).alias("confident"))


def keep_first(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates of each reference in order (``ord``), without those whose DOI or normal title a kept one has.

    ``candidates``: ``key, ord, doi, title``; a row without both is dropped. A
    reference has a few candidates, which are folded as one array.
    """
    forms = candidates.withColumns({"own_title": titles.normal_title(F.col("title")), "own_doi": F.lower(F.coalesce("doi", F.lit("")))})
    forms = forms.where("own_doi <> '' or coalesce(title, '') <> ''")
    row = F.struct("ord", F.col("own_doi").alias("doi"), F.col("own_title").alias("title"))
    none = F.array().cast("array<struct<ord:int,doi:string,title:string>>")
    seen = lambda kept, x: F.exists(kept, lambda k: ((x["doi"] != "") & (k["doi"] == x["doi"])) | ((x["title"] != "") & (k["title"] == x["title"])))
    fold = F.aggregate(F.array_sort(F.collect_list(row)), none, lambda kept, x: F.when(seen(kept, x), kept).otherwise(F.array_append(kept, x)))
    kept = forms.groupBy(key).agg(fold.alias("kept")).select(key, F.explode("kept").alias("k")).select(key, F.col("k.ord").alias("ord"))
    return candidates.join(kept, [key, "ord"], "left_semi")
