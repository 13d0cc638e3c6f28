"""Stages of a run as joins of recorded tables: searches, evidence, provenance, strength, screens, funnel."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom.functions import names, similarity, text, titles
from citeloom.functions.rules import first_match
from citeloom.functions.tri import is_false, is_true
from citeloom.operators import judgment, matching

# ---- searches ----


def provider_scores(refs: DataFrame, replies: DataFrame, providers: tuple[str, ...] = ("pubmed", "crossref", "openalex")) -> DataFrame:
    """``ref, hits``: best title score (0 to 100) by provider; 0 where it answered without a hit, null where it did not answer.

    ``refs``: ref, title; ``replies``: ref, provider, ok, titles (a reply's
    candidates). A provider without a reply row did not answer.
    """
    every = F.array(*[F.lit(p) for p in providers])
    asked = refs.select("ref", titles.lookup_title(F.col("title")).alias("own"), F.explode(every).alias("provider"))
    found = replies.where("ok").select("ref", "provider", F.explode_outer("titles").alias("found")).withColumn("other", titles.lookup_title(F.col("found")))
    pairs = asked.join(found, ["ref", "provider"]).withColumn("score", F.when((F.col("own") != "") & (F.col("other") != ""), similarity.token_sort_udf("own", "other")).otherwise(0.0))
    best = pairs.groupBy("ref", "provider").agg(F.max("score").alias("score"))
    out = asked.join(best, ["ref", "provider"], "left").groupBy("ref")
    return out.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("provider", "score")))).alias("hits"))


def merged_candidates(*lists: DataFrame) -> DataFrame:
    """Candidates (ref, ord, doi, title) of several providers, in the providers' order, kept first on DOI or title."""
    numbered = [x.withColumn("ord", F.lit(i * 1_000_000) + F.col("ord")) for i, x in enumerate(lists)]
    both = numbered[0]
    for x in numbered[1:]:
        both = both.unionByName(x)
    return matching.keep_first(both, "ref")


def batches(ids: DataFrame, size: int = 200) -> DataFrame:
    """``id, batch``: distinct ids in requests of at most ``size``, dealt by hash so that no task orders them all."""
    distinct = ids.select("id").distinct()
    parts = F.pmod(F.xxhash64("id"), F.lit(64))
    nth = F.row_number().over(Window.partitionBy(parts).orderBy("id")) - 1
    return distinct.withColumns({"part": parts, "nth": nth}).select("id", F.concat_ws("-", "part", F.floor(F.col("nth") / size)).alias("batch"))


def requests(n: Column, size: int = 200) -> Column:
    """Requests that ``n`` ids take."""
    return F.ceil(n / size).cast("long")


def screened(pairs: DataFrame) -> DataFrame:
    """Pairs with score, title similarity (0 to 100, one place), flag and, where flagged, the verdict."""
    out = matching.with_verdict(pairs)
    return out.withColumn("flagged", matching.is_flagged(out)).select(
        "id", "score", F.bround(F.col("title_similarity") * 100, 1).alias("similarity"), "flagged", F.when(F.col("flagged"), F.col("verdict")).alias("verdict"), "reason"
    )


def reranked(candidates: DataFrame, key: str) -> DataFrame:
    """Candidates (ord, score, logit) in the second stage's order where all of a reference's have a logit, else in the first's."""
    whole = F.count("logit").over(Window.partitionBy(key)) == F.count(F.lit(1)).over(Window.partitionBy(key))
    used = candidates.withColumn("used", F.when(whole, F.col("logit")).otherwise(F.col("score")))
    return used.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("used"), "ord")))


# ---- coverage of titles and rosters ----


def coverages(pairs: DataFrame) -> DataFrame:
    """``id, roster, content, shifted, boundary``: shares of the claimed roster and title that the record has, whatever slot they are in."""
    out = matching.with_forms(pairs)
    words = matching.telling_words
    first = F.coalesce(F.get("c_names", 0), F.lit(""))
    split = lambda *cs: F.array_distinct(F.filter(F.flatten(F.array(*[F.split(c, " ") for c in cs])), lambda w: w != ""))
    whole = lambda p: F.array_distinct(F.concat(split(F.col(f"{p}_canon"), F.col(f"{p}_journal")), names.roster(F.col(f"{p}_names"), 1)))
    return out.select(
        "id",
        names.share_of(names.roster(F.col("c_names")), names.roster(F.col("r_names"))).alias("roster"),
        names.share_of(words(F.col("c_canon")), split(F.col("r_canon"))).alias("content"),
        names.share_of(words(F.col("r_canon")), split(first, F.col("c_canon"))).alias("shifted"),
        F.greatest(names.share_of(words(F.col("r_canon")), whole("c")), names.share_of(words(F.col("c_canon")), whole("r"))).alias("boundary"),
    )


# ---- evidence of an item ----


def with_evidence(items: DataFrame, abstracts: DataFrame, lists: DataFrame, bodies: DataFrame) -> DataFrame:
    """Items (pmid) with abstract, reference list and body, each left as null where there is none, and whether the evidence is usable."""
    out = items.join(abstracts.select("pmid", "abstract"), "pmid", "left")
    refs = lists.groupBy("pmid").agg(F.array_sort(F.collect_list(F.struct("ord", "cited"))).alias("references"))
    out = out.join(refs, "pmid", "left").join(bodies.select("pmid", "body", "complete"), "pmid", "left")
    return out.withColumn("usable", text.usable_evidence(F.col("abstract")))


def fetched(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References with the record of their claimed PMID, and how the fetch ended."""
    from citeloom.operators.decisions import fetch_status

    out = refs.join(records.select("pmid", "http", "record"), "pmid", "left")
    status = fetch_status(F.col("http"), F.col("record").isNotNull())
    return out.withColumn("fetch", F.when(F.coalesce("pmid", F.lit("")) == "", F.lit(None).cast("string")).otherwise(status))


def provenance(claims: DataFrame, lists: DataFrame, chosen: DataFrame, abstracts: DataFrame, closed: DataFrame) -> DataFrame:
    """One hop from a restatement to its origin: ``pair, claim_index, confirmed, origin``.

    ``claims``: pair, claim_index, cited, span; ``lists``: cited, ord, pmid (the
    cited work's references); ``chosen``: pair, claim_index, ord (the selection's
    reply); ``abstracts``: pmid, abstract; ``closed``: pair, claim_index,
    contains, origin_span. What lacks a step is not confirmed.
    """
    keys = ["pair", "claim_index"]
    out = claims.join(chosen, keys, "left").join(lists, ["cited", "ord"], "left").join(abstracts, "pmid", "left").join(closed, keys, "left")
    span = F.coalesce("origin_span", F.lit(""))
    sure = F.col("pmid").isNotNull() & text.usable_evidence(F.col("abstract")) & is_true(F.col("contains")) & (span != "") & F.coalesce(F.col("abstract").contains(span), F.lit(False))
    return out.select(*keys, sure.alias("confirmed"), F.when(sure, F.col("pmid")).alias("origin"))


def refined_support(claims: DataFrame, readings: DataFrame, checks: DataFrame) -> DataFrame:
    """Support of each claim after strength: only a candidate whose four checks are all true is weaker.

    ``readings``: pair, claim_index and ``judgment.STRENGTH`` but for
    ``verified``; ``checks``: pair, claim_index, verified. A supported claim
    without a reading or with a hold can't be judged.
    """
    keys = ["pair", "claim_index"]
    out = claims.join(readings.drop("verified"), keys, "left").join(checks, keys, "left")
    out = out.withColumn("verified", F.coalesce("verified", F.array().cast("array<boolean>")))
    read = judgment.strength(F.col)
    after = first_match([(F.col("state") != "SUPPORTED", "as_is"), (F.col("dimension").isNull(), "UNJUDGEABLE"), (read == "confirmed", "WEAKER_STRENGTH"), (read == "supported", "SUPPORTED")], "UNJUDGEABLE")
    return out.select(*keys, F.when(after == "as_is", F.col("state")).otherwise(after).alias("state"))


def attestation_valid(e) -> Column:
    """Whether an attestation that one work replaces another is bound, of an admitted kind, in time and verbatim."""
    some = lambda c: F.coalesce(F.trim(e(c)), F.lit("")) != ""
    kinds = F.array_contains(e("admitted"), e("kind"))
    own = (e("source") == e("candidate")) & (e("kind") == "major_guideline_revision")
    replaced = F.coalesce(e("replaced_on"), e("published_on"))
    in_time = (replaced <= e("attested_on")) & (e("attested_on") <= e("as_of"))
    said = some("span") & some("source_text") & e("source_text").contains(e("span"))
    return F.coalesce(kinds & (e("replacement") == e("candidate")) & ~own & in_time & said, F.lit(False))


def reachable(authorities: Column) -> Column:
    """(types, reachable, reason): which entity types a policy's authorities (JSON object) lock, so that a mismatch could be found at all."""
    keys = F.array_sort(F.json_object_keys(authorities))
    reason = F.when(keys.isNull(), "authorities do not parse").when(F.size(keys) == 0, "no entity type is locked")
    return F.struct(F.coalesce(keys, F.array().cast("array<string>")).alias("types"), reason.isNull().alias("reachable"), reason.alias("reason"))


#: What the assessment of an entity in a claim reads.
TUPLE = "id int, clause boolean, asserted boolean, evidence boolean, span_verbatim boolean, claimed_state string, found_state string, claimed_type string, found_type string, locked boolean, confident boolean, relation string, verified boolean"


def assess_entity(e) -> Column:
    """(outcome, reason) of a claimed entity against the one that the paper supports; a mismatch needs every step to be sure."""
    table = [
        (~is_true(e("clause")), "UNJUDGEABLE", "clause_not_bound"),
        (~is_true(e("asserted")), "SAME_ENTITY", "not_asserted"),
        (~is_true(e("evidence")), "UNJUDGEABLE", "evidence_incomplete"),
        (~is_true(e("span_verbatim")), "UNJUDGEABLE", "span_not_verbatim"),
        (~is_true(e("locked")), "UNJUDGEABLE", "authority_not_locked"),
        (e("claimed_state") != "resolved", "UNJUDGEABLE", "claimed_entity_unresolved"),
        (e("found_state") != "resolved", "UNJUDGEABLE", "evidence_entity_unresolved"),
        (~is_true(e("confident")), "UNJUDGEABLE", "mapping_not_confident"),
        (e("relation").isin("equivalent", "narrower"), "SAME_ENTITY", "compatible"),
        (e("relation").isin("broader", "unknown") | e("relation").isNull(), "UNJUDGEABLE", "relation_open"),
        (e("claimed_type") != e("found_type"), "UNJUDGEABLE", "cross_type"),
        (is_true(e("verified")), "CONFIRMED_MISMATCH", "provably_distinct"),
        (is_false(e("verified")), "UNJUDGEABLE", "verifier_disagrees"),
    ]
    out = None
    for when, outcome, why in table:
        v = F.struct(F.lit(outcome).alias("outcome"), F.lit(why).alias("reason"))
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(F.struct(F.lit("UNJUDGEABLE").alias("outcome"), F.lit("not_verified").alias("reason")))


# ---- a run's records ----

FROZEN = "id int, excluded boolean, extract string, n_claims int, calls array<struct<made: boolean, reason: string, status: string, verdict: string>>"
#: Statuses of a call that ended in an error (fixed values).
ERRORS = ("error", "refused", "malformed", "indeterminate")


def frozen_disposition(e) -> Column:
    """Disposition of a frozen record from its facts: excluded, quarantined, held, flagged or clear; null if verdicts are missing."""
    calls = F.coalesce(e("calls"), F.array().cast("array<struct<made: boolean, reason: string, status: string, verdict: string>>"))
    ok = F.filter(calls, lambda c: c["status"] == "ok")
    unavailable = (F.size(calls) > 0) & F.forall(calls, lambda c: is_false(c["made"]) & F.coalesce(c["reason"] == "evidence_unavailable", F.lit(False)))
    return first_match(
        [
            (is_true(e("excluded")), "excluded"),
            (e("extract") == "indeterminate", "quarantined"),
            (F.coalesce(e("extract"), F.lit("")) != "ok", "held"),
            (e("n_claims") == 0, "held"),
            (unavailable, "held"),
            (F.exists(calls, lambda c: is_true(c["made"]) & F.coalesce(c["status"].isin(*ERRORS), F.lit(False))), "quarantined"),
            ((F.size(calls) == 0) | F.exists(ok, lambda c: c["verdict"].isNull()), "unknown"),
            (F.exists(ok, lambda c: c["verdict"] == "unsupported"), "flagged"),
        ],
        "clear",
    )


def funnel(records: DataFrame, *columns: str) -> DataFrame:
    """``kind, value, n``: counts of every value of each column in one scan, and the total, so that each kind adds up to it."""
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.col(c).cast("string"), F.lit("none")).alias("value")) for c in columns], F.struct(F.lit("total").alias("kind"), F.lit("all").alias("value")))
    return records.select(F.explode(pairs).alias("x")).groupBy("x.kind", "x.value").agg(F.count(F.lit(1)).alias("n"))


def is_accounted(counts: DataFrame) -> DataFrame:
    """``kind, sound``: whether a kind's counts add up to the total."""
    total = counts.where("kind = 'total'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return counts.where("kind <> 'total'").groupBy("kind").agg(F.sum("n").alias("n")).join(total, how="left").select("kind", (F.col("n") == F.col("total")).alias("sound"))


# ---- canonical text and JSON ----


@F.pandas_udf(T.StringType())
def composed_udf(value: pd.Series) -> pd.Series:
    return value.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def section_text(value: Column) -> Column:
    """The one form of a section's text: composed accents, line feeds, no blanks at the ends of lines or of the whole."""
    lines = F.regexp_replace(F.regexp_replace(composed_udf(value), "\r\n?", "\n"), r"(?U)\s*?[^\S\n]+(?=\n|$)", "")
    return F.regexp_replace(lines, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def canonical_json_udf(value: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            return None

    return value.map(one).astype(object).where(value.notna(), None)


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added key by key."""
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.map_from_entries(F.array_sort(F.transform(keys, lambda k: F.struct(k, (F.coalesce(F.try_element_at(a, k), F.lit(0)) + F.coalesce(F.try_element_at(b, k), F.lit(0))).alias("n")))))
