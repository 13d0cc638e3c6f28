"""Evidence about pairs as tables: cached records, repairs, profiles, queues, packets, tallies and whether a run may be reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_true
from citeloom.operators.joins import ContractError

# ---- cached records on occurrences ----


def cache_conflicts(cache: DataFrame, *keys: str) -> DataFrame:
    """Keys that have different records (struct ``rec``), as a digest of its JSON."""
    return cache.groupBy(*keys).agg(F.countDistinct(F.sha2(F.to_json("rec"), 256)).alias("n")).where("n > 1").select(*keys)


def occurrences_of_cache(occurrences: DataFrame, cache: DataFrame) -> DataFrame:
    """Each occurrence (source, citation_id, pmid) of a cached record (source, pmid, rec), once.

    A cached row with a source joins on source and PMID, one without on the PMID
    alone. Repeated occurrences stay, equal rows of the cache are one, and records
    that differ for one key or one occurrence raise ``ContractError``.
    """
    known = cache.where("coalesce(pmid, '') <> ''").withColumn("source", F.coalesce("source", F.lit(""))).select("source", "pmid", "rec")
    if cache_conflicts(known, "source", "pmid").limit(1).count():
        raise ContractError("conflicting cache rows")
    known = known.dropDuplicates(["source", "pmid"])
    exact = occurrences.join(known.where("source <> ''"), ["source", "pmid"])
    loose = occurrences.join(known.where("source = ''").drop("source"), "pmid")
    found = exact.select("source", "citation_id", "pmid", "rec").unionByName(loose.select("source", "citation_id", "pmid", "rec"))
    keys = ["source", "citation_id", "pmid"]
    if cache_conflicts(found, *keys).limit(1).count():
        raise ContractError("an occurrence has two works")
    return found.dropDuplicates(keys)


# ---- a proposed repair ----

REPAIR = "id int, published_is_b boolean, steps array<struct<step: string, doi: string, title_similarity: double, doi_match: boolean>>, clusters int, errors int"
#: Least title similarity of one record (fixed value).
SAME_RECORD = 0.90


def repair_outcome(e) -> Column:
    """(outcome, source, doi): what the printed reference resolves to, in the order of the steps, against the resolved record.

    ``steps`` are the resolutions found, in the order of the cascade. More than
    one candidate cluster proposes nothing, and an error leaves it open.
    """
    first = F.get(e("steps"), 0)
    same = F.when(first["doi_match"].isNotNull(), first["doi_match"]).otherwise(first["title_similarity"] >= SAME_RECORD)
    table = [
        (is_true(e("published_is_b")), "not_f2", F.lit("biorxiv_relation"), F.lit(None).cast("string")),
        (first.isNotNull() & same, "not_f2", first["step"], F.lit(None).cast("string")),
        (first.isNotNull(), "f2_with_repair", first["step"], first["doi"]),
        (e("clusters") > 1, "ambiguous_multiple", F.lit(""), F.lit(None).cast("string")),
        (e("errors") > 0, "undetermined", F.lit(""), F.lit(None).cast("string")),
    ]
    out = None
    for when, outcome, source, doi in table:
        v = F.struct(F.lit(outcome).alias("outcome"), source.alias("source"), doi.alias("doi"))
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(F.struct(F.lit("unscoreable").alias("outcome"), F.lit("").alias("source"), F.lit(None).cast("string").alias("doi")))


# ---- evidence for and against a claim ----


def candidate_category(notice: Column, state: Column, independence: Column) -> Column:
    """What an assessed candidate is to a claim; one study's other reports are context."""
    return first_match(
        [
            (F.coalesce(notice, F.lit("")) != "clear", "flagged_or_corrected"),
            (state == "QUALIFYING", "qualifying"),
            (state == "confirming", "confirmation"),
            (state == "mixed", "mixed"),
            (independence == "not_independent", "same_study"),
            (state == "borderline", "plausible"),
        ],
        "excluded",
    )


def evidence_profile(candidates: DataFrame, key: str) -> DataFrame:
    """Counts, independent clusters, tiers and pattern of a claim's candidates (category, cluster, independent, tier, confidence, open)."""
    c = lambda name: F.col("category") == name
    clusters = lambda name: F.countDistinct(F.when(c(name) & (F.col("independence") == "independent"), F.col("cluster")))
    out = candidates.groupBy(key).agg(
        F.count_if(c("qualifying")).alias("opposing"),
        F.count_if(c("confirmation")).alias("confirming"),
        F.count_if(c("mixed")).alias("mixed"),
        F.count_if(c("plausible") | c("flagged_or_corrected")).alias("uncertain"),
        clusters("qualifying").alias("opposing_clusters"),
        clusters("confirmation").alias("confirming_clusters"),
        F.array_sort(F.collect_set(F.when(c("qualifying"), F.col("tier")))).alias("opposing_tiers"),
        F.max(F.when(F.col("category").isin("qualifying", "confirmation", "mixed", "plausible"), F.col("confidence"))).alias("best"),
        F.max(F.coalesce("open", F.lit(False))).alias("open"),
    )
    pattern = first_match(
        [
            ((F.col("mixed") > 0) | ((F.col("opposing") > 0) & (F.col("confirming") > 0)), "mixed_evidence"),
            (F.col("opposing_clusters") > 1, "multiple_opposition"),
            (F.col("opposing") > 0, "single_opposition"),
            (F.col("confirming") > 0, "confirmation_only_found"),
            (F.col("open") | (F.col("uncertain") > 0), "unassessable"),
        ],
        "no_controversy_found",
    )
    return out.withColumn("pattern", pattern)


def review_queue(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """A row for each surfaced candidate, and one for a claim whose bundle has something to see though none surfaced.

    ``candidates``: claim, work, disposition; ``claims``: claim, bundle,
    search_complete, applicability.
    """
    surfaced = candidates.where("disposition = 'surface'").select("claim", "work", F.lit("candidate_review").alias("kind"))
    per = candidates.groupBy("claim").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("disposition") == "surface").alias("shown"))
    rest = claims.join(per, "claim", "left").where("coalesce(shown, 0) = 0 and coalesce(bundle, '') <> ''")
    rest = rest.where("coalesce(n, 0) > 0 or (search_complete = false and applicability in ('eligible', 'uncertain'))")
    return surfaced.unionByName(rest.select("claim", F.lit(None).cast("string").alias("work"), F.lit("controversy_bundle_reference").alias("kind")))


def negative_reason(status: Column) -> Column:
    """An empty search is an absence only if it was carried out."""
    return F.when(F.coalesce(status, F.lit("")) != "ok", "retrieval_failed").otherwise("no_evidence_found")


# Words of a decision that a blind queue must not show.
TELLING = ("verdict", "label", "confidence", "disposition", "finding", "prediction")


def leaks(row: Column) -> Column:
    """Keys of a row's JSON, at any depth, that tell a decision."""
    keys = F.regexp_extract_all(F.lower(F.to_json(row)), F.lit(r'"([^"]+)"\s*:'), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(keys, lambda k: F.greatest(*[k.contains(t) for t in TELLING]))))


# Named sources and registrations in a text, and how it says that data are not shared.
_NAMED = r"\b(?:[Cc]ohort|[Ss]tudy|[Tt]rial|[Dd]ataset)\s+([A-Z][A-Za-z0-9_-]{2,})\b"
_REGISTERED = r"(?i)\b(?:NCT[0-9]{8}|ISRCTN[0-9]{8}|DRKS[0-9]{8}|IRCT[0-9]{14,24}N[0-9]+|PACTR[0-9]{12,18})\b"
_APART = (
    r"\bno\s+(?:participants?|patients?|subjects?|records?|data)\b\s+(?:came\s+from|were\s+(?:drawn|recruited)\s+from|originated\s+from|overlapped(?:\s+with)?|were\s+(?:shared|reused))\b"
    r"|\b(?:participants?|patients?|subjects?|records?|data)\b\s+(?:did\s+not|were\s+not|was\s+not)\s+(?:overlap|share|reuse|come\s+from|originate\s+from|(?:be\s+)?drawn\s+from|(?:be\s+)?recruited\s+from)\b"
)


def source_names(text: Column) -> Column:
    """Named cohorts, studies and registrations of a text, lower case."""
    own = F.coalesce(text, F.lit(""))
    found = F.concat(F.regexp_extract_all(own, F.lit(_NAMED), F.lit(1)), F.regexp_extract_all(own, F.lit(_REGISTERED), F.lit(0)))
    return F.array_distinct(F.transform(found, lambda x: F.lower(x)))


def distinct_data(cited: Column, candidate: Column) -> Column:
    """Sentence of the candidate that says that none of a named source of the cited work's data is its own; null if none does.

    The candidate must name a source of its own, and not be a part of the cited one.
    """
    ours, theirs = source_names(cited), source_names(candidate)
    low = F.lower(F.coalesce(candidate, F.lit("")))
    part = F.exists(ours, lambda t: F.rlike(low, F.concat(F.lit(r"\b(?:(?:subgroup|subset)\s+of|nested\s+(?:within|in))\s+(?:cohort\s+)?"), t, F.lit(r"\b"))))
    said = F.filter(
        F.split(F.coalesce(candidate, F.lit("")), r"(?<=[.!?])\s+|[\r\n]+"),
        lambda s: F.lower(s).rlike(_APART) & F.exists(ours, lambda t: F.lower(s).contains(t)),
    )
    return F.when((F.size(ours) > 0) & (F.size(F.array_except(theirs, ours)) > 0) & ~part, F.trim(F.get(said, 0)))


def source_packet(sections: DataFrame, key: str = "pmid") -> DataFrame:
    """Methods, results and other text of a work's sections (ord, label, title, text, sha256), each with its heading.

    A digest that is not the text's raises no row away: ``mismatched`` counts it.
    """
    label = F.lower(F.trim("label"))
    kind = F.when(label.isin("methods", "results"), label).otherwise("other")
    heading = F.concat(F.lit("["), label, F.lit("]"), F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit(" "), F.col("title"))).otherwise(""))
    block = F.struct("ord", F.concat(heading, F.lit("\n"), F.col("text")).alias("text"))
    join = lambda k: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(kind == k, block))), lambda b: b["text"]), "\n\n"), F.lit(""))
    return sections.groupBy(key).agg(
        join("methods").alias("methods"), join("results").alias("results"), join("other").alias("other"), F.count_if(F.col("sha256") != F.sha2("text", 256)).alias("mismatched")
    )


def fact_gaps(packet) -> Column:
    """Facts that a packet's text does not give: methods, results."""
    return F.array_compact(F.array(*[F.when(packet(c).isNull(), F.lit(c)) for c in ("methods", "results")]))


# ---- rates and tallies ----


def high_band(records: DataFrame) -> DataFrame:
    """One row: the wrong-paper verdicts among those that can be scored; four kinds of verdict are on neither side."""
    v = F.col("verdict")
    out = records.agg(
        F.count_if(v == "review_wrong_paper").alias("high"),
        F.count_if(v.isin("match", "review_wrong_paper", "review_formatting")).alias("scoreable"),
        F.count_if(v == "review_same_work_variant").alias("same_work"),
        F.count_if(v == "unscoreable").alias("unscoreable"),
        F.count_if(v == "unresolved").alias("unresolved"),
        F.count_if(v == "out_of_scope_cross_language").alias("cross_language"),
    )
    return out.withColumn("rate", F.when(F.col("scoreable") > 0, F.round(F.col("high") / F.col("scoreable"), 6)))


def marker_tallies(references: DataFrame) -> DataFrame:
    """One row: sentences with marks, those with several references and with several runs, of all and of numeric documents.

    ``references``: group_id, style, runs (of the sentence).
    """
    per = references.where("coalesce(group_id, '') <> ''").groupBy("group_id").agg(F.count(F.lit(1)).alias("members"), F.max(F.greatest("runs", F.lit(1))).alias("runs"), F.max("style").alias("style"))
    many, split, numeric = F.col("members") >= 2, F.col("runs") >= 2, F.col("style") == "numeric"
    return per.agg(
        F.count(F.lit(1)).alias("sentences"),
        F.count_if(many).alias("multi_reference"),
        F.count_if(many & split).alias("multi_run"),
        F.count_if(many & numeric).alias("numeric_multi_reference"),
        F.count_if(many & split & numeric).alias("numeric_multi_run"),
    )


def scope_tallies(pairs: DataFrame) -> DataFrame:
    """``document, status, reason, pairs, asked, not_asked`` of scoped pairs (n_claims, n_asked); claims that weren't asked are not failures."""
    return pairs.groupBy("document", "status", "reason").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("n_asked").alias("asked"), F.sum(F.col("n_claims") - F.col("n_asked")).alias("not_asked")
    )


# ---- may a run be reported? ----

MANIFEST = (
    "id int, status string, canonical boolean, attested array<string>, missing int, disposition_corpus string, run_corpus string, code_commit string, model string, temperature string, "
    "judged int, accounted boolean, parse_failures int, stable boolean, segment boolean, total int, chained int, written int, duplicates int, domain_matches boolean, "
    "queue_matches boolean, review_matches boolean, disjoint boolean, findings array<string>, provenance array<string>"
)


def clauses(e) -> Column:
    """Names of the clauses that a run's manifest fails, in order; a run with none may be reported."""
    some = lambda c: F.coalesce(F.trim(e(c)), F.lit("")) != ""
    named = [
        ("status_complete", e("status") == "complete"),
        ("canonical_disposition", is_true(e("canonical"))),
        *[(f"{x}_attested", F.array_contains(e("attested"), x)) for x in ("F1", "F2", "F8")],
        ("full_coverage", e("missing") == 0),
        ("corpus_cross_bound", some("disposition_corpus") & (e("disposition_corpus") == e("run_corpus"))),
        ("code_commit_recorded", some("code_commit")),
        ("model_recorded", some("model")),
        ("temperature_recorded", e("temperature").isNotNull()),
        ("temperature_legal", (e("temperature") == "unsupported") | e("temperature").rlike(r"^\d+(?:\.\d+)?$")),
        ("pairs_judged", e("judged") > 0),
        ("terminal_outcomes_accounted", F.coalesce(e("accounted"), F.lit(True))),
        ("no_parse_failures", F.coalesce(e("parse_failures"), F.lit(0)) == 0),
        ("modules_stable", is_true(e("stable"))),
        ("single_segment", ~is_true(e("segment"))),
        ("counters_match_file", (e("total") == e("written")) & (e("chained") == e("written"))),
        ("unique_citation_ids", F.coalesce(e("duplicates"), F.lit(0)) == 0),
        ("executed_domain_matches_preflight", is_true(e("domain_matches"))),
        ("queue_matches_findings", is_true(e("queue_matches"))),
        ("human_review_queue_matches", F.coalesce(e("review_matches"), F.lit(True))),
        ("queues_disjoint", F.coalesce(e("disjoint"), F.lit(True))),
        *[(f"{x}_provenance", ~F.array_contains(e("findings"), x) | F.array_contains(e("provenance"), x)) for x in ("F3", "F4", "F5", "F7")],
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in named]))
