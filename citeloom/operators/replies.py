"""Recorded replies in place of live models: prompts, lookups, budgets and ledgers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rendered(template: str, **values: Column) -> Column:
    """A template with its ``{names}`` filled in one pass: what a value holds is never filled again. Null values are empty."""
    parts = re.split(r"\{(\w+)\}", template)
    missing = set(parts[1::2]) - set(values)
    if missing:
        raise KeyError(f"no value for {sorted(missing)}")
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def with_replies(asked: DataFrame, replies: DataFrame, seam: str) -> DataFrame:
    """``asked`` (prompt) with ``reply`` and ``answered``; each prompt is looked up once, however often it is asked.

    ``replies``: seam, prompt_sha256, reply. A prompt without a recorded reply has
    not been answered, which is not an empty reply.
    """
    keyed = asked.withColumn("prompt_sha256", F.sha2("prompt", 256))
    known = replies.where(F.col("seam") == seam).select("prompt_sha256", "reply").dropDuplicates(["prompt_sha256"])
    once = keyed.select("prompt_sha256").distinct().join(known, "prompt_sha256").withColumn("answered", F.lit(True))
    return keyed.join(once, "prompt_sha256", "left").withColumn("answered", F.coalesce("answered", F.lit(False)))


def within_budget(attempts: DataFrame, key: str) -> DataFrame:
    """First good attempt of each call that its budget reaches, else the last attempt that counts and ``spent``.

    ``attempts``: key, attempt (from 1), bucket (null: good), tries (of the bucket).
    An attempt is made while every failure before it allows that many tries.
    """
    row = F.struct("attempt", "bucket", "tries")
    held = attempts.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("all"))
    start = F.struct(F.lit(True).alias("open"), F.lit(None).cast("int").alias("attempt"), F.lit(None).cast("string").alias("bucket"))

    def step(state: Column, x: Column) -> Column:
        made = F.struct((x["bucket"].isNotNull() & (x["attempt"] < x["tries"])).alias("open"), x["attempt"].alias("attempt"), x["bucket"].alias("bucket"))
        return F.when(state["open"], made).otherwise(state)

    end = held.withColumn("x", F.aggregate("all", start, step))
    return end.select(key, "x.attempt", "x.bucket", F.col("x.bucket").isNotNull().alias("spent"))


def merged_ledgers(*ledgers: DataFrame) -> DataFrame:
    """Token ledgers (stage, model, calls, tokens_in, tokens_out) as one, by stage and model."""
    out = ledgers[0]
    for other in ledgers[1:]:
        out = out.unionByName(other)
    return out.groupBy("stage", "model").agg(*[F.sum(c).alias(c) for c in ("calls", "tokens_in", "tokens_out")])


def missing_and_stale(expected: DataFrame, replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prompts without a reply, replies that nothing asks for), by hash."""
    wanted = expected.select(F.sha2("prompt", 256).alias("prompt_sha256")).distinct()
    known = replies.select("prompt_sha256").distinct()
    return wanted.join(known, "prompt_sha256", "left_anti"), known.join(wanted, "prompt_sha256", "left_anti")
