"""Works that one sentence cites together: claims of the group, routes of its members, gaps that others cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match

#: Members of groups: place in the group, its claims, and a bucket for each claim (null: not judged).
MEMBERS = "grp string, ord int, member string, claims array<string>, buckets array<string>"


def contributions(members: DataFrame) -> DataFrame:
    """``members`` with ``group_claims`` and ``excluded``: why a member's buckets don't count, null if they do.

    The group's claims are those of its first member with buckets; a member
    with other claims would join answers about different claims on one index.
    """
    some = F.size(F.coalesce("buckets", F.array().cast("array<string>"))) > 0
    first = members.where(some).groupBy("grp").agg(F.min_by("claims", "ord").alias("group_claims"))
    out = members.join(first, "grp", "left")
    reason = first_match([(~some, "no_coverage_verdicts"), (F.col("claims") != F.col("group_claims"), "atomic_claims_differ_from_group")])
    return out.withColumn("excluded", reason)


def group_claims(contributed: DataFrame) -> DataFrame:
    """``grp, claim_index, claim, status, covered_by, contradicted_by, judged_by``: members' ids in their order."""
    judged = contributed.where("excluded is null").select("grp", "ord", "member", F.posexplode("group_claims").alias("claim_index", "claim"), "buckets")
    judged = judged.withColumn("bucket", F.get("buckets", F.col("claim_index")))
    of = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("ord", "member")))), lambda x: x["member"])
    out = judged.groupBy("grp", "claim_index", "claim").agg(
        of(F.col("bucket") == "established").alias("covered_by"), of(F.col("bucket") == "contradicted").alias("contradicted_by"), of(F.col("bucket").isNotNull()).alias("judged_by")
    )
    return out.withColumn("status", first_match([(F.size("covered_by") > 0, "covered"), (F.size("judged_by") > 0, "uncovered")], "unknown"))


def group_records(contributed: DataFrame, claims: DataFrame) -> DataFrame:
    """``grp, size, contributing, excluded, covered, uncovered, unknown`` of every group."""
    size = contributed.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("excluded").isNull()).alias("contributing"), F.count("excluded").alias("excluded"))
    per = claims.groupBy("grp").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("covered", "uncovered", "unknown")])
    return size.join(per, "grp", "left").na.fill(0)


def with_routes(contributed: DataFrame, claims: DataFrame) -> DataFrame:
    """``grp, member, route, flags``: a member's route within its group, and which of its gaps a co-cited work covers.

    The first rule that holds; what is not wholly judged goes alone. ``flags``
    are empty unless the member counts and some claim of the group is covered; a
    claim that the member contradicts is never excused.
    """
    per = claims.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_index", "status"))), lambda x: x["status"]).alias("statuses"))
    size = contributed.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    out = contributed.join(per, "grp", "left").join(size, "grp")
    buckets, statuses = F.coalesce("buckets", F.array().cast("array<string>")), F.coalesce("statuses", F.array().cast("array<string>"))
    has = lambda xs, v: F.exists(xs, lambda x: x == v)
    every = lambda v: F.forall(buckets, lambda x: x == v)
    whole = F.size(buckets) == F.size(statuses)
    alone = (
        (F.col("size") <= 1) | F.col("excluded").isNotNull() | ~F.exists(buckets, lambda b: b.isNotNull()) | F.exists(buckets, lambda b: b.isNull()) | ~whole | every("established") | has(buckets, "contradicted")
    )
    route = first_match([(alone, "solo"), (every("off_topic"), "UNSUPPORTED_MEMBER"), (has(statuses, "uncovered"), "GROUP_COVERAGE_GAP"), (has(statuses, "unknown"), "solo")], "GROUP_COVERED")
    covered = F.zip_with(statuses, buckets, lambda s, b: (s == "covered") & ~F.coalesce(b == "contradicted", F.lit(False)))
    flags = F.when(F.col("excluded").isNull() & whole & has(statuses, "covered"), covered).otherwise(F.array().cast("array<boolean>"))
    return out.select("grp", "member", route.alias("route"), flags.alias("flags"))


# ---- retraction before citation ----

#: Least days from a retraction to a citation (fixed value).
LEAST_DAYS = 31
TIMING = "id int, cited string, citing string, cited_fetch string, citing_fetch string, citing_day date, notice string, resolution string, retracted_type boolean, notice_day date"


def retraction_time(e) -> Column:
    """(status, gap, reason): whether a work was retracted long enough before it was cited; what isn't known is unresolved."""
    digits = lambda c: F.coalesce(F.trim(e(c)), F.lit("")).rlike(r"^\d+$")
    gap = F.datediff(e("citing_day"), e("notice_day"))
    table = [
        (~digits("cited"), "not_applicable", "no_resolved_cited_pubmed_work"),
        (~digits("citing"), "unresolved", "work_identity_unavailable"),
        (e("cited_fetch") == "error", "unresolved", "cited_metadata_failure"),
        (e("cited_fetch") == "absent", "not_applicable", "cited_pubmed_record_absent"),
        (e("cited_fetch") == "conflict", "unresolved", "cited_metadata_conflict"),
        (e("citing_fetch") == "error", "unresolved", "citing_metadata_failure"),
        (e("citing_fetch") != "ok", "unresolved", "citing_metadata_unavailable"),
        (e("citing_day").isNull(), "unresolved", "citing_date_unavailable"),
        (e("resolution") == "resolved_clear", "clear", "no_retraction_in_force_at_citation"),
        ((e("resolution") == "flagged") & (e("notice") != "retraction") & ~F.coalesce(e("retracted_type"), F.lit(False)), "clear", "only_non_retraction_notice_in_force"),
        ((e("notice") != "retraction") | (e("resolution") != "flagged") | e("notice_day").isNull(), "unresolved", "retraction_notice_or_date_unresolved"),
        (gap >= LEAST_DAYS, "qualified", "retracted_before_citation_31_day_floor_met"),
    ]
    out = None
    for when, status, why in table:
        v = F.struct(F.lit(status).alias("status"), F.when(F.lit(status == "qualified"), gap).alias("gap"), F.lit(why).alias("reason"))
        out = F.when(when, v) if out is None else out.when(when, v)
    return out.otherwise(F.struct(F.lit("timing_indeterminate").alias("status"), gap.alias("gap"), F.lit("retraction_to_citation_gap_below_31_days").alias("reason")))


def after_retries(attempts: DataFrame, key: str, most: int = 2) -> DataFrame:
    """The first attempt (attempt, status, retryable) that needs no retry, else the last of at most ``most``."""
    some = attempts.where(F.col("attempt") <= most)
    order = F.when(~F.col("retryable"), F.col("attempt")).otherwise(F.lit(1000) - F.col("attempt"))
    return some.groupBy(key).agg(F.min_by(F.struct("attempt", "status"), order).alias("x")).select(key, "x.*")


# ---- candidates within a cap ----


def capped(candidates: DataFrame, key: str, *order: Column, cap: int = 50) -> DataFrame:
    """The first ``cap`` candidates of each key, with ``pool`` (at most min(1000, 4 cap) count) and ``truncated`` (the feature is the cap)."""
    from pyspark.sql.window import Window

    most = min(1000, 4 * cap)
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    pools = candidates.groupBy(key).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("pool"))
    out = candidates.withColumn("nth", nth).where(F.col("nth") <= cap).join(pools, key)
    return out.withColumn("truncated", F.col("pool") > cap)


# ---- log, predictions and gold ----


def scored(log: DataFrame, predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """``citation_id, band, gold, predicted, label_correct, secondary_correct, exact`` of what all three have."""
    out = log.select("citation_id", "band").join(predictions.select("citation_id", F.col("label").alias("predicted"), F.col("secondary").alias("second")), "citation_id")
    out = out.join(gold.select("citation_id", F.col("label").alias("gold"), F.col("secondary").alias("other")), "citation_id")
    right, also = F.col("gold").eqNullSafe(F.col("predicted")), F.col("other").eqNullSafe(F.col("second"))
    return out.select("citation_id", "band", "gold", "predicted", right.alias("label_correct"), also.alias("secondary_correct"), (right & also).alias("exact"))


# ---- an authority's snapshot ----

_DATED = "valid_from: string, valid_through: string"
SNAPSHOT = (
    f"entity_type string, release_date string, records array<struct<id: string, canonical_label: string, status: string, {_DATED}, "
    f"aliases: array<struct<surface: string, source_db: string, mapping_method: string, approved: boolean, {_DATED}>>>>, relations array<struct<a: string, b: string, relation: string>>"
)


def surface_key(surface: Column) -> Column:
    """Key under which a surface is looked up: lower case, white space folded."""
    return F.trim(F.regexp_replace(F.lower(surface), r"(?U)\s+", " "))


def snapshot_mappings(snapshot: DataFrame) -> DataFrame:
    """``entity_type, key, entity, how, approved, valid_from, valid_through`` of a snapshot's records: ids and labels exact, aliases as synonyms.

    An alias is valid only while its record is.
    """
    r = snapshot.select("entity_type", F.explode("records").alias("r"))
    own = r.select("entity_type", F.col("r.id").alias("entity"), F.explode(F.array_distinct(F.array("r.id", "r.canonical_label"))).alias("surface"), F.lit("exact").alias("how"),
                   (F.col("r.status") == "active").alias("approved"), "r.valid_from", "r.valid_through")
    a = r.select("entity_type", "r", F.explode("r.aliases").alias("a"))
    low = F.greatest("a.valid_from", "r.valid_from")
    alias = a.select("entity_type", F.col("r.id").alias("entity"), F.col("a.surface").alias("surface"), F.lit("synonym").alias("how"), (F.col("a.approved") & (F.col("r.status") == "active")).alias("approved"),
                     low.alias("valid_from"), F.least("a.valid_through", "r.valid_through").alias("valid_through"))
    return own.unionByName(alias).withColumn("key", surface_key(F.col("surface"))).drop("surface")


def valid_at(mappings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Surfaces (surface, day) with the approved mappings that are valid on the day; one row with nulls where there are none."""
    asked = surfaces.withColumn("key", surface_key(F.col("surface")))
    day = F.col("day")
    known = mappings.where("approved")
    inside = (known["valid_from"] <= day) & (known["valid_through"].isNull() | (known["valid_through"] >= day))
    return asked.join(known, (asked["key"] == known["key"]) & inside, "left").select("surface", "day", "entity", (F.col("how") == "exact").alias("exact"))


# ---- packets for people ----


def packet(pairs: DataFrame) -> DataFrame:
    """``citation_id, markdown``: a citation's claims (claim_index, claim, span) under its sentence, as a person reads them."""
    line = F.concat(F.lit("- "), F.col("claim"), F.when(F.coalesce("span", F.lit("")) != "", F.concat(F.lit('\n  > "'), F.col("span"), F.lit('"'))).otherwise(""))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("claim_index", line.alias("line")))), lambda x: x["line"])
    out = pairs.groupBy("citation_id").agg(F.first("sentence").alias("sentence"), lines.alias("lines"))
    return out.select("citation_id", F.concat(F.lit("## "), F.col("citation_id"), F.lit("\n\n"), F.col("sentence"), F.lit("\n\n"), F.array_join("lines", "\n"), F.lit("\n")).alias("markdown"))


# ---- before a run ----

PREFLIGHT = "id int, canonical boolean, missing int, parse_failures int, code_commit string, model string, declared string, corpus string, out_files int, genesis string, resumed boolean, max_docs int"


def preflight(e) -> Column:
    """Why a production run may not start, in order; empty if it may."""
    blank = lambda c: F.coalesce(F.trim(e(c)), F.lit("")) == ""
    problems = [
        (~F.coalesce(e("canonical"), F.lit(False)), "disposition_not_canonical"),
        (F.coalesce(e("missing"), F.lit(0)) > 0, "ids_missing"),
        (F.coalesce(e("parse_failures"), F.lit(0)) > 0, "documents_not_parsed"),
        (blank("code_commit"), "no_code_commit"),
        (blank("model"), "no_model"),
        (blank("corpus"), "no_corpus_manifest"),
        (~blank("corpus") & blank("declared"), "corpus_not_declared"),
        (~blank("corpus") & ~blank("declared") & (e("declared") != e("corpus")), "corpus_mismatch"),
        (F.coalesce(e("out_files"), F.lit(0)) > 0, "out_dir_not_empty"),
        (~blank("genesis"), "extends_a_segment"),
        (F.coalesce(e("resumed"), F.lit(False)), "resumed"),
        (e("max_docs").isNotNull(), "limited"),
    ]
    return F.array_compact(F.array(*[F.when(when, F.lit(name)) for when, name in problems]))
