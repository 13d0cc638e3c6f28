"""Semantic rules of frozen artifacts as tables of violations: ``rule, place, why``; no rows, no violations.

Hashes are recomputed from canonical JSON, and what an artifact says of itself
is derived again, not trusted. Rules that need a repository or a bootstrap
environment are not among them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.scope import is_citation_id
from citeloom.operators.stages import FROZEN, canonical_json_udf, frozen_disposition

#: What this module's rules are called where they are reported (fixed values).
RULES = {
    "SV-001": "E_SELF_HASH", "SV-010": "E_FUNNEL", "SV-011": "E_DISPOSITION", "SV-022": "E_SEND_BOUNDARY", "SV-023": "E_IDEMPOTENCY", "SV-031": "E_MANIFEST_UNIQ", "SV-032": "E_ELIGIBLE", "SV-060": "E_CITATION_ID",
    "SV-071": "E_STIMULUS", "SV-090": "E_HEADER", "SV-101": "E_RETRY_POLICY",
}
RECORDS = FROZEN + ", stored string"


def _violations(rows: DataFrame, rule: str, place: Column, *found: tuple[Column, str]) -> DataFrame:
    """A row for every condition of a row that holds."""
    why = F.array_compact(F.array(*[F.when(when, F.lit(text)) for when, text in found]))
    return rows.select(F.lit(rule).alias("rule"), place.cast("string").alias("place"), F.explode(why).alias("why"))


def self_hashes(artifacts: DataFrame) -> DataFrame:
    """``path, preimage, declared``: a declared hash is that of the canonical JSON of its preimage."""
    hashed = artifacts.withColumn("canon", canonical_json_udf("preimage"))
    missing = F.col("canon").isNull() | F.col("declared").isNull()
    return _violations(hashed, "SV-001", F.col("path"), (missing, "no hash or preimage"), (~missing & (F.sha2("canon", 256) != F.col("declared")), "hash differs"))


def funnel(batches: DataFrame) -> DataFrame:
    """``batch, input_total, excluded, runner_accepted, flagged, clear, held, quarantined``: each level adds up to the one above."""
    parts = ("input_total", "excluded", "runner_accepted", "flagged", "clear", "held", "quarantined")
    missing = F.greatest(*[F.col(c).isNull() for c in parts])
    taken = F.col("flagged") + F.col("clear") + F.col("held") + F.col("quarantined")
    return _violations(
        batches, "SV-010", F.col("batch"), (missing, "field missing"), (~missing & (F.col("input_total") != F.col("excluded") + F.col("runner_accepted")), "input"), (~missing & (F.col("runner_accepted") != taken), "accepted")
    )


def dispositions(records: DataFrame) -> DataFrame:
    """``RECORDS``: the stored disposition is the derived one; where verdicts are missing, one of the last two."""
    derived = frozen_disposition(F.col)
    open_ = derived == "unknown"
    return _violations(
        records.withColumn("derived", derived), "SV-011", F.col("id"), (~open_ & (F.coalesce("stored", F.lit("")) != F.col("derived")), "differs"), (open_ & ~F.col("stored").isin("flagged", "clear"), "not of the last tier")
    )


def send_boundary(events: DataFrame, calls: DataFrame) -> DataFrame:
    """``call, attempt, seq, event, crossed`` and ``call, status``: what may have been sent is not sent again, and not called settled."""
    per = events.groupBy("call", "attempt").agg(F.max(F.coalesce("crossed", F.lit(False))).alias("crossed"), F.max_by("event", "seq").alias("last"))
    after = per.select("call", (F.col("attempt") - 1).alias("attempt"), F.lit(True).alias("again")).distinct()
    out = per.join(after, ["call", "attempt"], "left").join(calls, "call", "left")
    again = F.coalesce("again", F.lit(False))
    open_ = F.col("last").isin("sent", "indeterminate", "transport_failed")
    return _violations(
        out, "SV-022", F.concat_ws("#", "call", "attempt"), (again & F.col("crossed") & (F.col("last") != "response_persisted"), "retried after sending"),
        (~again & F.col("crossed") & open_ & (F.col("status") != "indeterminate"), "not indeterminate"),
    )


def idempotency(events: DataFrame) -> DataFrame:
    """``attempt_id, event, preimage, idempotency_key``: each attempt was prepared, with the key of its preimage."""
    none = events.groupBy("attempt_id").agg(F.max(F.col("event") == "prepared").alias("prepared"))
    lost = _violations(none, "SV-023", F.col("attempt_id"), (~F.col("prepared"), "never prepared"))
    own = events.where("event = 'prepared'").withColumn("canon", canonical_json_udf("preimage"))
    missing = F.col("canon").isNull()
    return lost.unionByName(_violations(own, "SV-023", F.col("attempt_id"), (missing, "no preimage"), (~missing & (F.sha2("canon", 256) != F.coalesce("idempotency_key", F.lit(""))), "key differs")))


def inventory(rows: DataFrame) -> DataFrame:
    """``ord, citation_id, occurrence``: in order and unique. Order is a comparison with the row before, by a self-join on the place."""
    before = rows.select((F.col("ord") + 1).alias("ord"), F.col("citation_id").alias("before"))
    unsorted = _violations(rows.join(before, "ord"), "SV-031", F.col("citation_id"), (F.col("before") > F.col("citation_id"), "not sorted"))
    for c, why in (("citation_id", "id repeats"), ("occurrence", "occurrence repeats")):
        twice = rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        unsorted = unsorted.unionByName(_violations(twice, "SV-031", F.col(c), (F.lit(True), why)))
    return unsorted


def eligible(rows: DataFrame, records: DataFrame) -> DataFrame:
    """``citation_id, record`` against ``record, purpose, disposition``: a release has only flagged rows that are no calibration."""
    return _violations(rows.join(records, "record"), "SV-032", F.col("citation_id"), (F.col("purpose") == "calibration", "calibration"), (F.coalesce("disposition", F.lit("")) != "flagged", "not flagged"))


def citation_ids(rows: DataFrame) -> DataFrame:
    """``citation_id, pmcid, ref_id`` (either may be null): canonical, and made of the two."""
    sound = is_citation_id(F.col("citation_id"))
    return _violations(
        rows, "SV-060", F.col("citation_id"), (~sound, "not canonical"), (sound & (F.substring_index("citation_id", ":", 1) != F.col("pmcid")), "other article"),
        (sound & (F.regexp_extract("citation_id", "^[^:]*:(.*)$", 1) != F.col("ref_id")), "other reference"),
    )


def stimuli(rows: DataFrame) -> DataFrame:
    """``citation_id, codebook, codebook_sha256, claim_indexes, labels``: the codebook's hash, claims from 0 without gaps, labels once."""
    n = F.size("claim_indexes")
    whole = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return _violations(
        rows, "SV-071", F.col("citation_id"), (F.sha2(F.coalesce("codebook", F.lit("")), 256) != F.coalesce("codebook_sha256", F.lit("")), "codebook differs"), (F.col("claim_indexes") != whole, "claims not contiguous"),
        (F.size(F.array_distinct("labels")) < F.size("labels"), "label repeats"),
    )


#: Headers that carry credentials (fixed values).
CREDENTIALS = ("authorization", "cookie", "set-cookie", "x-api-key", "proxy-authorization")


def headers(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """``path, headers`` (names): no credentials are kept, and nothing that isn't allowed, in any case."""
    each = rows.select("path", F.explode("headers").alias("name")).withColumn("low", F.lower("name"))
    secret = F.col("low").isin(*CREDENTIALS)
    return _violations(each, "SV-090", F.concat_ws(".", "path", "name"), (secret, "credential"), (~secret & ~F.col("low").isin(allowed), "not allowed"))


def retry_policies(stages: DataFrame) -> DataFrame:
    """``stage, connect, read, total, base, cap`` (decimal texts): the whole time covers its parts, the cap its base."""
    number = lambda c: F.col(c).try_cast("decimal(18,6)")
    parts = ("connect", "read", "total", "base", "cap")
    unread = F.greatest(*[number(c).isNull() for c in parts])
    return _violations(
        stages, "SV-101", F.col("stage"), (unread, "unreadable"), (~unread & (number("total") < F.greatest(number("connect"), number("read"))), "total too short"), (~unread & (number("cap") < number("base")), "cap under base")
    )


def named(violations: DataFrame) -> DataFrame:
    """``violations`` with the rules' codes, in a stable order of content."""
    codes = F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair])
    return violations.withColumn("code", codes[F.col("rule")]).orderBy("rule", "place", "why")
