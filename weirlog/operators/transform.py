"""The user's transformer: annotate, replace or drop messages.

A transformer is a function from the message DataFrame to a column of JSON
replies: native expressions, or a Python function through
:func:`python_transformer`. A NULL reply means that it failed on the message. A
failure never loses a message: the original goes on, with ``transform_error``.
"""

from __future__ import annotations

import json as json_lib
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.functions.text import compact_json, is_json, trim_space
from weirlog.operators.render import message_to_json, metadata_from_json

Transformer = Callable[[DataFrame], Column]

_TEXT_FIELDS = (
    "schema",
    "subschema",
    "collector_type",
    "collector_identifier",
    "message_sha256",
    "message_text",
)
_COUNT_FIELDS = ("sequence", "timestamp_unix")
_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+\-]\d\d:\d\d)$"


def python_transformer(function: Callable[[dict], Any]) -> Transformer:
    """Wrap a Python function of one message (a dict); raising means failure.

    Messages go to Python in Arrow batches as JSON text, in no particular order.
    """

    @F.pandas_udf("string")
    def reply(messages: pd.Series) -> pd.Series:
        def one(text: str) -> str | None:
            try:
                return json_lib.dumps(function(json_lib.loads(text)), allow_nan=False)
            except Exception:
                return None

        return messages.map(one)

    return lambda df: reply(message_to_json())


def _with_reply(df: DataFrame, fn: Transformer) -> DataFrame:
    df = df.withColumn("_reply", fn(df).cast("string"))
    return df.withColumn("_valid", is_json(F.col("_reply")))


def _format_error() -> Column:
    return F.when(F.col("_reply").isNull(), F.lit("failed")).when(~F.col("_valid"), F.lit("invalid-json"))


def enrich(df: DataFrame, fn: Transformer) -> DataFrame:
    """The reply, any JSON value, becomes ``message_extra``; nothing else changes."""
    df = _with_reply(df, fn)
    return df.withColumns(
        {
            "message_extra": F.when(F.col("_valid"), compact_json(trim_space(F.col("_reply")))).otherwise(
                F.col("message_extra")
            ),
            "transform_error": _format_error(),
        }
    ).drop("_reply", "_valid")


def replace(df: DataFrame, fn: Transformer) -> DataFrame:
    """The reply, a JSON object, becomes the message.

    Members it leaves out are empty. A member that is no message column, or has
    the wrong type, is an error. A JSON ``null`` marks the message ``dropped``;
    :func:`drop_null_replacements` takes it out.
    """
    df = _with_reply(df, fn)
    df = df.withColumn("_value", F.when(F.col("_valid"), F.try_parse_json("_reply")))
    # A reply nested more deeply than VARIANT allows cannot become a message.
    df = df.withColumn("_valid", F.col("_value").isNotNull())
    member = lambda name: F.variant_get(F.col("_value"), f"$.{name}", "variant")
    kind = lambda name: F.coalesce(F.schema_of_variant(member(name)), F.lit("VOID"))
    text = lambda name: F.try_variant_get(F.col("_value"), f"$.{name}", "string")
    count = lambda name: F.try_variant_get(F.col("_value"), f"$.{name}", "bigint")

    known = F.array(*[F.lit(name) for name in schemas.MESSAGE_COLUMNS])
    unknown = F.size(F.array_except(F.json_object_keys("_reply"), known)) > 0
    instant = text("timestamp").try_cast("timestamp")
    raw = F.try_to_binary(text("message_raw"), F.lit("base64"))
    mistyped = F.lit(False)
    for name in _TEXT_FIELDS:
        mistyped = mistyped | ~kind(name).isin("STRING", "VOID")
    for name in _COUNT_FIELDS:
        mistyped = mistyped | ~kind(name).isin("BIGINT", "VOID") | F.coalesce(count(name) < 0, F.lit(False))
    for name, decoded in (("timestamp", instant), ("message_raw", raw)):
        good = (kind(name) == "VOID") | ((kind(name) == "STRING") & decoded.isNotNull())
        mistyped = mistyped | ~good
    mistyped = mistyped | ~F.coalesce(text("timestamp").rlike(_RFC3339), F.lit(True))

    is_null = F.col("_valid") & F.is_variant_null("_value")
    is_object = F.startswith(trim_space(F.col("_reply")), F.lit("{"))
    df = df.withColumns(
        {
            "dropped": F.coalesce(is_null, F.lit(False)),
            "transform_error": F.coalesce(
                _format_error(),
                F.when(is_null, F.lit(None))
                .when(~is_object, F.lit("not-an-object"))
                .when(unknown, F.lit("unknown-field"))
                .when(mistyped, F.lit("wrong-type")),
            ),
        }
    )
    replaced = F.col("transform_error").isNull() & ~F.col("dropped")
    made: dict[str, Column] = {name: F.nullif(text(name), F.lit("")) for name in _TEXT_FIELDS}
    made.update({name: count(name) for name in _COUNT_FIELDS})
    made["timestamp"] = instant
    made["message_raw"] = F.when(F.octet_length(raw) > 0, raw)
    made["message_json"] = F.to_json(member("message_json"))
    made["message_extra"] = F.to_json(member("message_extra"))
    metadata = F.when(~F.is_variant_null(member("message_metadata")), F.to_json(member("message_metadata")))
    made["message_metadata"] = metadata_from_json(metadata)
    others = [c for c in df.columns if c not in schemas.MESSAGE_COLUMNS and not c.startswith("_")]
    return df.select(
        *[
            F.when(replaced, made[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
            for f in schemas.MESSAGE
        ],
        *others,
    )


def drop_null_replacements(df: DataFrame) -> DataFrame:
    """Leave out the messages a transformer replaced by ``null``."""
    return df.where(~F.col("dropped")).drop("dropped")
