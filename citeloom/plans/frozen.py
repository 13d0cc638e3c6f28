"""Rules of frozen artifacts on authored tables; the expected violations are stated by hand."""

from __future__ import annotations

import hashlib

from citeloom.operators import frozen
from citeloom.plans.catalog import example

_OUT = "rule string, place string, why string"
_sha = lambda x: hashlib.sha256(x.encode()).hexdigest()


@example(
    "frozen_hashes", "path string, preimage string, declared string", [("a", '{"b": 1, "a": 2}', _sha('{"a":2,"b":1}')), ("b", '{"a": 1}', _sha('{"a": 1}')), ("c", None, "x"), ("d", "{}", None)],
    "rule string, code string, place string, why string", [("SV-001", "E_SELF_HASH", "b", "hash differs"), ("SV-001", "E_SELF_HASH", "c", "no hash or preimage"), ("SV-001", "E_SELF_HASH", "d", "no hash or preimage")],
)
def frozen_hashes(df):
    return frozen.named(frozen.self_hashes(df))


@example(
    "frozen_funnels", "batch string, input_total int, excluded int, runner_accepted int, flagged int, clear int, held int, quarantined int",
    [("a", 10, 2, 8, 1, 4, 2, 1), ("b", 10, 1, 8, 1, 4, 2, 1), ("c", 10, 2, 8, 1, 4, 2, 0), ("d", 10, 2, 8, 1, None, 2, 1)],
    _OUT, [("SV-010", "b", "input"), ("SV-010", "c", "accepted"), ("SV-010", "d", "field missing")],
)
def frozen_funnels(df):
    return frozen.funnel(df)


_OK = (True, None, "ok", "supported")


@example(
    "frozen_stored", frozen.RECORDS,
    [(0, True, "ok", 1, [_OK], "excluded"), (1, False, "ok", 1, [_OK], "flagged"), (2, False, "ok", 1, [(True, None, "ok", None)], "clear"), (3, False, "ok", 1, [(True, None, "ok", None)], "held"), (4, False, "error", 1, [], None)],
    _OUT, [("SV-011", "1", "differs"), ("SV-011", "3", "not of the last tier"), ("SV-011", "4", "differs")],
)
def frozen_stored(df):
    return frozen.dispositions(df)


@example(
    "frozen_sends", "call string, attempt int, seq int, event string, crossed boolean",
    [("a", 0, 0, "prepared", False), ("a", 1, 1, "prepared", False), ("a", 1, 2, "sent", True), ("a", 1, 3, "response_persisted", True), ("b", 0, 0, "sent", True), ("b", 1, 1, "response_persisted", True), ("c", 0, 0, "sent", True), ("d", 0, 0, "sent", True)],
    _OUT, [("SV-022", "b#0", "retried after sending"), ("SV-022", "c#0", "not indeterminate")],
)
def frozen_sends(df):
    return frozen.send_boundary(df, df.sparkSession.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "indeterminate")], "call string, status string"))


@example(
    "frozen_keys", "attempt_id string, event string, preimage string, idempotency_key string",
    [("a", "prepared", '{"x": 1}', _sha('{"x":1}')), ("a", "sent", None, None), ("b", "sent", None, None), ("c", "prepared", None, "k"), ("d", "prepared", '{"x": 1}', "k")],
    _OUT, [("SV-023", "b", "never prepared"), ("SV-023", "c", "no preimage"), ("SV-023", "d", "key differs")],
)
def frozen_keys(df):
    return frozen.idempotency(df)


@example(
    "frozen_inventories", "ord int, citation_id string, occurrence string", [(0, "PMC1:a", "1"), (1, "PMC1:c", "2"), (2, "PMC1:b", "3"), (3, "PMC1:c", "3")],
    _OUT, [("SV-031", "PMC1:b", "not sorted"), ("SV-031", "PMC1:c", "id repeats"), ("SV-031", "3", "occurrence repeats")],
)
def frozen_inventories(df):
    return frozen.inventory(df)


@example(
    "frozen_eligible", "citation_id string, record string", [("a", "1"), ("b", "2"), ("c", "3"), ("d", "9")],
    _OUT, [("SV-032", "b", "calibration"), ("SV-032", "c", "not flagged")],
)
def frozen_eligible(df):
    return frozen.eligible(df, df.sparkSession.createDataFrame([("1", "formal", "flagged"), ("2", "calibration", "flagged"), ("3", "formal", "clear")], "record string, purpose string, disposition string"))


@example(
    "frozen_ids", "citation_id string, pmcid string, ref_id string", [("PMC1:a:b", "PMC1", "a:b"), ("PMC1:a", "PMC2", None), ("PMC1:a", None, "b"), ("1:a", "1", "a"), (None, None, None)],
    _OUT, [("SV-060", "PMC1:a", "other article"), ("SV-060", "PMC1:a", "other reference"), ("SV-060", "1:a", "not canonical"), ("SV-060", None, "not canonical")],
)
def frozen_ids(df):
    return frozen.citation_ids(df)


@example(
    "frozen_stimuli", "citation_id string, codebook string, codebook_sha256 string, claim_indexes array<int>, labels array<string>",
    [("a", "x", _sha("x"), [0, 1], ["F6", "F7"]), ("b", "x", "0", [], ["F6"]), ("c", "x", _sha("x"), [0, 2], ["F6", "F6"])],
    _OUT, [("SV-071", "b", "codebook differs"), ("SV-071", "c", "claims not contiguous"), ("SV-071", "c", "label repeats")],
)
def frozen_stimuli(df):
    return frozen.stimuli(df)


@example(
    "frozen_headers", "path string, headers array<string>", [("r0", ["Date", "Authorization"]), ("r1", ["date", "X-Odd"]), ("r2", [])],
    _OUT, [("SV-090", "r0.Authorization", "credential"), ("SV-090", "r1.X-Odd", "not allowed")],
)
def frozen_headers(df):
    return frozen.headers(df, ["date"])


@example(
    "frozen_policies", "stage string, connect string, read string, total string, base string, cap string",
    [("a", "5", "30", "60", "0.5", "8"), ("b", "5", "30", "20", "0.5", "8"), ("c", "5", "30", "60", "9", "8"), ("d", "x", "30", "60", "1", "8")],
    _OUT, [("SV-101", "b", "total too short"), ("SV-101", "c", "cap under base"), ("SV-101", "d", "unreadable")],
)
def frozen_policies(df):
    return frozen.retry_policies(df)
