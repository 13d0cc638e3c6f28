"""Strict JSON: what a lenient reader would repair is refused, with the reason."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class _Refused(Exception):
    pass


def _no(why: str):
    def refuse(*_):
        raise _Refused(why)

    return refuse


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise _Refused("duplicate_key")
    return out


def strict_error(text: str, floats: bool = False) -> str | None:
    """Why a text is no strict JSON: parse, duplicate_key, float, constant or surrogate."""
    try:
        found = json.loads(text, object_pairs_hook=_unique, parse_float=float if floats else _no("float"), parse_constant=_no("constant"))
        json.dumps(found, ensure_ascii=False).encode("utf-8")
    except _Refused as e:
        return str(e)
    except UnicodeEncodeError:
        return "surrogate"
    except ValueError:
        return "parse"
    return None


@F.pandas_udf(T.StringType())
def strict_error_udf(text: pd.Series) -> pd.Series:
    return pd.Series(["parse" if t is None else strict_error(t) for t in text], dtype=object)


def reply_error(reply: Column, schema: dict[str, tuple[str, ...]]) -> Column:
    """Bucket of a reply that is not one bare JSON object with exactly these keys, each of one of its kinds; null if it is.

    ``schema``: kinds (boolean, string, array, object, null, number) by key.
    """
    bare = F.trim(F.coalesce(reply, F.lit("")))
    error = strict_error_udf(F.when(bare == "", F.lit("{}")).otherwise(bare))
    keys = F.array_sort(F.json_object_keys(bare))
    wanted = F.array(*[F.lit(k) for k in sorted(schema)])
    variant = F.try_parse_json(bare)
    kind = lambda k: F.schema_of_variant(F.try_variant_get(variant, f'$["{k}"]', "variant"))

    def fits(k: str, kinds: tuple[str, ...]) -> Column:
        shape = F.lower(F.coalesce(kind(k), F.lit("void")))
        names = {"boolean": "^boolean", "string": "^string", "array": "^array", "object": "^object", "null": "^void", "number": r"^(bigint|decimal|double)"}
        return shape.rlike("|".join(names[x] for x in kinds))

    shapes = F.lit(True)
    for k, kinds in schema.items():
        shapes = shapes & fits(k, kinds)
    return (
        F.when(bare == "", "empty_model_response")
        .when(error == "duplicate_key", "schema_key_mismatch")
        .when(error.isNotNull() | ~bare.startswith("{"), "malformed_model_response")
        .when(keys != wanted, "schema_key_mismatch")
        .when(~shapes, "invalid_schema")
    )
