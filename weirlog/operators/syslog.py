"""Syslog decoding: frames to parts, parts to records, and what was rejected.

Every operator is a projection or a filter; none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog import schemas
from weirlog.functions.text import is_json, looks_like_object, trim_space

FORMATS = ("rfc3164", "rfc5424")

# Severity names by code, 0 to 7.
LEVELS = ("emergency", "alert", "critical", "error", "warning", "notice", "informative", "debug")
UNDEFINED_LEVEL = "<undefined>"

# Parts taken out of a frame; the rest are residual fields.
TEXT_PARTS = ("message", "content")
SERVICE_PARTS = ("app_name", "tag")
CONSUMED_PARTS = (*TEXT_PARTS, "timestamp", "hostname", *SERVICE_PARTS, "msg_id")

PARTS = T.StructType(
    [
        T.StructField("priority", T.IntegerType()),
        T.StructField("facility", T.IntegerType()),
        T.StructField("severity", T.IntegerType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("app_name", T.StringType()),
        T.StructField("tag", T.StringType()),
        T.StructField("proc_id", T.StringType()),
        T.StructField("msg_id", T.StringType()),
        T.StructField("structured_data", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("content", T.StringType()),
    ]
)

_MAX_PRIORITY = 191
# RFC 5424 header tokens and structured data, RFC 3164 layout.
_PRI_VERSION = r"^<(?:0|[1-9]\d{0,2})>[1-9]\d{0,2}$"
_RFC3339 = r"^\d{4}-\d\d-\d\d[Tt]\d\d:\d\d:\d\d(?:\.\d{1,6})?(?:[Zz]|[+\-]\d\d:\d\d)$"
_STRUCTURED = r'^(?:\[[^\s="\]]+(?: +[^\s="\]]+="(?:[^"\\]|\\.)*+")*+ ?\])++(?= |$)'
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_FRAME_3164 = (
    r"(?s)^<(\d{1,3})>([A-Z][a-z]{2}) ([ \d]\d) (\d\d):(\d\d):(\d\d) ([^\s\x1f]+) "
    r"([^\s:\[\x1f]+)(?:\[[^\]]*\])?:? ?(.*)$"
)
_UNIT = "\x1f"


def check_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"syslog format must be one of {FORMATS}, not {name!r}")
    return name


def with_digest(df: DataFrame, raw: str = "message_raw", out: str = "message_sha256") -> DataFrame:
    """SHA-256 of the raw frame in lower-case hex; a missing frame hashes as empty."""
    return df.withColumn(out, F.sha2(F.coalesce(F.col(raw), F.lit(b"")), 256))


def decode_syslog(
    df: DataFrame,
    format: str = "rfc3164",
    raw: str = "message_raw",
    received_at: str = "received_at",
) -> DataFrame:
    """Add ``parts``, a typed struct of the frame; NULL where the grammar refuses it."""
    check_format(format)
    line = F.col(raw).cast("string")
    if format == "rfc5424":
        return _decode_5424(df, line)
    return _decode_3164(df, line, F.col(received_at))


def _struct(**columns: Column) -> Column:
    members = [
        columns.get(field.name, F.lit(None)).cast(field.dataType).alias(field.name) for field in PARTS
    ]
    return F.struct(*members)


def _decode_5424(df: DataFrame, line: Column) -> DataFrame:
    df = df.withColumn("_tokens", F.split(line, " ", 7))
    token = lambda i: F.get(F.col("_tokens"), F.lit(i))
    df = df.withColumn(
        "_structured",
        F.when((token(6) == "-") | F.startswith(token(6), F.lit("- ")), F.lit("-"))
        .when(F.startswith(token(6), F.lit("[")), F.regexp_extract(token(6), _STRUCTURED, 0)),
    )
    head_end = F.instr(token(0), F.lit(">"))
    df = df.withColumn("_pri", F.substring(token(0), F.lit(2), head_end - 2).try_cast("int"))
    priority = F.col("_pri")
    version = F.substring(token(0), head_end + 1, F.length(token(0))).try_cast("int")
    well_formed = (
        (F.size("_tokens") == 7)
        & token(0).rlike(_PRI_VERSION)
        & (token(1).rlike(_RFC3339) | (token(1) == "-"))
        & (priority <= _MAX_PRIORITY)
        & (F.length("_structured") > 0)
    )
    parts = _struct(
        priority=priority,
        facility=F.shiftright(priority, 3),
        severity=priority % 8,
        version=version,
        timestamp=F.when(token(1) != "-", token(1).try_cast("timestamp")),
        hostname=token(2),
        app_name=token(3),
        proc_id=token(4),
        msg_id=token(5),
        structured_data=F.col("_structured"),
        message=F.substring(token(6), F.length("_structured") + 2, F.length(token(6))),
    )
    return _computed_once(df, F.when(well_formed, parts)).drop("_tokens", "_structured", "_pri")


def _decode_3164(df: DataFrame, line: Column, received_at: Column) -> DataFrame:
    # One pass of the pattern; the groups come back joined by a separator, with one
    # in front that tells a match from a frame that came through unchanged.
    groups = "".join(f"{_UNIT}${n}" for n in range(1, 10))
    replaced = F.regexp_replace(line, _FRAME_3164, groups)
    matched = F.startswith(line, F.lit("<")) & F.startswith(replaced, F.lit(_UNIT))
    df = df.withColumn("_g", F.when(matched, F.split(F.substr(replaced, F.lit(2)), _UNIT, 9)))
    group = lambda i: F.get(F.col("_g"), F.lit(i))
    month = (F.instr(F.lit(_MONTHS), group(1)) + 2) / 3
    number = lambda i: F.trim(group(i)).try_cast("int")
    instant = lambda year: F.try_make_timestamp(
        year, month.cast("int"), number(2), number(3), number(4), number(5)
    )
    # The frame names no year: the year of receipt, or the one before where that
    # lies more than a day ahead.
    this_year = instant(F.year(received_at))
    latest = received_at + F.expr("INTERVAL 1 DAY")
    timestamp = F.when(this_year <= latest, this_year).otherwise(instant(F.year(received_at) - 1))
    df = df.withColumn("_pri", group(0).try_cast("int"))
    priority = F.col("_pri")
    well_formed = (
        (F.size("_g") == 9)
        & (priority <= _MAX_PRIORITY)
        & (F.instr(F.lit(_MONTHS), group(1)) % 3 == 1)
    )
    parts = _struct(
        priority=priority,
        facility=F.shiftright(priority, 3),
        severity=priority % 8,
        timestamp=timestamp,
        hostname=group(6),
        tag=group(7),
        content=group(8),
    )
    return _computed_once(df, F.when(well_formed, parts)).drop("_g", "_pri")


def _computed_once(df: DataFrame, parts: Column) -> DataFrame:
    """Add ``parts`` so that filters on it are not rewritten over the frame.

    A filter moves below a projection by repeating its expressions, here the whole
    decoding. It does not move below a generator.
    """
    return df.select("*", F.explode(F.array(parts)).alias("parts"))


# -- operators on a map of parts -------------------------------------------------


def drop_nil_parts(parts: Column) -> Column:
    """Leave out entries that are NULL, empty or ``-``."""
    return F.map_filter(parts, lambda _, v: v.isNotNull() & ~v.isin("", "-"))


class Taken(NamedTuple):
    value: Column
    parts: Column
    error: Column


_CASTS = {"string": "string", "bytes": "binary", "int": "int", "time": "timestamp"}


def take_part(
    parts: Column,
    keys: Sequence[str],
    type: str = "string",
    remove: bool = True,
    optional: bool = False,
) -> Taken:
    """The first present key of a map of parts.

    ``parts`` comes back without that key if ``remove`` is set, and ``error`` is
    ``missing``, ``invalid`` (wrong type) or NULL.
    """
    found = F.coalesce(*[F.when(F.map_contains_key(parts, k), F.lit(k)) for k in keys])
    text = F.coalesce(*[F.when(F.map_contains_key(parts, k), F.try_element_at(parts, F.lit(k))) for k in keys])
    value = text.cast("binary") if type == "bytes" else text.try_cast(_CASTS[type])
    rest = F.map_filter(parts, lambda k, _: ~F.coalesce(k == found, F.lit(False))) if remove else parts
    error = F.when(text.isNotNull() & value.isNull(), F.lit("invalid"))
    if not optional:
        error = F.when(found.isNull(), F.lit("missing")).otherwise(error)
    return Taken(value, rest, error)


def residual_fields(parts: Column) -> Column:
    """What is left of a map of parts once the consumed ones are taken out.

    Only the first present of two alternatives is consumed.
    """
    taken_text = F.coalesce(*[F.when(F.map_contains_key(parts, k), F.lit(k)) for k in TEXT_PARTS])
    taken_service = F.coalesce(*[F.when(F.map_contains_key(parts, k), F.lit(k)) for k in SERVICE_PARTS])
    return F.map_filter(
        parts,
        lambda k, _: ~(
            k.isin("timestamp", "hostname", "msg_id")
            | F.coalesce(k == taken_text, F.lit(False))
            | F.coalesce(k == taken_service, F.lit(False))
        ),
    )


# -- single columns --------------------------------------------------------------


def promote_json_text(df: DataFrame, text: str = "message_text", json: str = "message_json") -> DataFrame:
    """Move a text that is one JSON object to ``json``; any other text stays untrimmed."""
    trimmed = trim_space(F.col(text))
    df = df.withColumn("_trimmed", F.when(looks_like_object(trimmed), trimmed))
    df = df.withColumn("_object", F.col("_trimmed").isNotNull() & is_json(F.col("_trimmed")))
    return (
        df.withColumn(json, F.when(F.col("_object"), F.col("_trimmed")))
        .withColumn(text, F.when(~F.col("_object"), F.col(text)))
        .drop("_trimmed", "_object")
    )


def severity_to_level(severity: Column) -> tuple[Column, Column]:
    """(``level``, ``level_unix``) of a severity; a missing one reads as emergency."""
    code = F.coalesce(severity.cast("int"), F.lit(0))
    # Reading beyond a list gives NULL.
    level = F.get(F.array(*[F.lit(name) for name in LEVELS]), code)
    level_unix = F.get(F.array(*[F.lit(n).cast("tinyint") for n in range(1, len(LEVELS) + 1)]), code)
    return F.coalesce(level, F.lit(UNDEFINED_LEVEL)), F.coalesce(level_unix, F.lit(-1).cast("tinyint"))


# -- whole records ---------------------------------------------------------------


def _nil(column: Column) -> Column:
    return F.when(~column.isin("", "-"), column)


def _fields(part) -> Column:
    """Residual fields of a decoded frame."""
    names = ("facility", "priority", "severity", "version", "proc_id", "structured_data")
    return drop_nil_parts(F.create_map(*[c for n in names for c in (F.lit(n), part(n).cast("string"))]))


def _with_reason(df: DataFrame, format: str, raw: str, received_at: str) -> DataFrame:
    df = decode_syslog(df, format, raw, received_at)
    part = lambda name: F.col("parts")[name]
    df = df.withColumns(
        {
            "_text": _nil(F.coalesce(part("message"), part("content"))),
            "_node": _nil(part("hostname")),
            "_service": _nil(F.coalesce(part("app_name"), part("tag"))),
        }
    )
    reason = (
        F.when(F.col(raw).isNull() | (F.octet_length(raw) == 0), F.lit("empty"))
        .when(F.col("parts").isNull(), F.lit("unparseable"))
        .when(F.col("_text").isNull(), F.lit("text"))
        .when(part("timestamp").isNull(), F.lit("timestamp"))
        .when(F.col("_node").isNull(), F.lit("hostname"))
        .when(F.col("_service").isNull(), F.lit("service"))
    )
    return df.withColumn("reject_reason", reason)


def syslog_records(
    df: DataFrame,
    format: str = "rfc3164",
    identifier: str | None = None,
    parse_json: bool = True,
    raw: str = "message_raw",
    received_at: str = "received_at",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Frames to collector messages; what :func:`syslog_rejects` lists is left out.

    ``keep`` names input columns to carry along, such as a record id.
    """
    df = _with_reason(df, format, raw, received_at).where(F.col("reject_reason").isNull())
    part = lambda name: F.col("parts")[name]
    df = df.withColumns({"message_text": F.col("_text"), "message_json": F.lit(None).cast("string")})
    if parse_json:
        df = promote_json_text(df)
    level, level_unix = severity_to_level(part("severity"))
    syslog = F.struct(
        F.lit(schemas.SYSLOG_SCHEMA).alias("schema"),
        F.lit(format).alias("protocol"),
        part("timestamp").alias("timestamp"),
        F.unix_millis(part("timestamp")).alias("timestamp_unix"),
        F.col("_node").alias("node"),
        F.col("_service").alias("service"),
        _nil(part("msg_id")).alias("type"),
        level.alias("level"),
        level_unix.alias("level_unix"),
        _fields(part).alias("fields"),
    )
    label = F.col("collector_identifier") if "collector_identifier" in df.columns else F.lit(None)
    if identifier is not None:
        label = F.lit(identifier)
    return df.select(
        *keep,
        F.lit(schemas.SYSLOG).alias("collector_type"),
        F.nullif(label.cast("string"), F.lit("")).alias("collector_identifier"),
        F.col(received_at).alias("received_at"),
        F.col(raw).alias("message_raw"),
        F.sha2(F.col(raw), 256).alias("message_sha256"),
        "message_text",
        "message_json",
        F.struct(
            syslog.alias("syslog"),
            F.lit(None).cast(schemas.HTTP_META).alias("http"),
            F.lit(None).cast("string").alias("other"),
        ).alias("message_metadata"),
    )


def syslog_rejects(
    df: DataFrame,
    format: str = "rfc3164",
    raw: str = "message_raw",
    received_at: str = "received_at",
    keep: Sequence[str] = (),
) -> DataFrame:
    """The frames that make no record, each with the reason."""
    return (
        _with_reason(df, format, raw, received_at)
        .where(F.col("reject_reason").isNotNull())
        .select(*keep, F.col(received_at).alias("received_at"), F.col(raw).alias("message_raw"), "reject_reason")
    )
