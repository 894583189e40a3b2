"""HTTP request decoding. A body that cannot be parsed is kept raw, never lost.

Every operator is a projection or a filter; none of them shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.functions import maps
from weirlog.functions.mime import split_content_type
from weirlog.functions.text import blank_to_null, is_json, trim_space
from weirlog.functions.url import split_url
from weirlog.functions.xml import xml_to_json

# Fixed values.
HEARTBEAT = "/__/heartbeat"
TEXT_TYPES = ("text/plain", "application/json", "application/xml")
STRUCTURED_TYPES = ("application/json", "application/xml")
KNOWN_ENCODINGS = ("gzip", "x-gzip", "deflate", "compress", "x-compress", "br")

# Outcomes in the order the gates are tried.
OUTCOMES = (
    "transfer-encoding",
    "content-encoding",
    "content-encoding-unknown",
    "content-type-invalid",
    "content-type-missing",
    "content-type-unsupported",
    "utf8",
    "empty",
    "json",
    "xml",
    "parsed",
)


def drop_heartbeats(df: DataFrame) -> DataFrame:
    """Leave out requests for exactly the heartbeat target."""
    return df.where(~F.equal_null("request_uri", F.lit(HEARTBEAT)))


def normalise_body(df: DataFrame, body: str = "body") -> DataFrame:
    """``message_raw`` (NULL where empty) and ``message_sha256`` (of nothing where empty)."""
    raw = F.when(F.octet_length(body) > 0, F.col(body))
    return df.withColumns(
        {
            "message_raw": raw,
            "message_sha256": F.sha2(F.coalesce(F.col(body), F.lit(b"")), 256),
        }
    )


def gate_transfer_encoding(transfer_encoding: Column) -> Column:
    """Failure reason, or NULL: any transfer encoding stops parsing."""
    return F.when(F.size(transfer_encoding) > 0, F.lit("transfer-encoding"))


def gate_content_encoding(encoding: Column) -> tuple[Column, Column]:
    """(encoding to keep, failure reason). Compared as written, case included."""
    plain = encoding.isNull() | encoding.isin("", "identity")
    kept = F.when(~plain, encoding)
    reason = F.when(~plain & encoding.isin(*KNOWN_ENCODINGS), F.lit("content-encoding")).when(
        ~plain, F.lit("content-encoding-unknown")
    )
    return kept, reason


def gate_content_type(header: Column, parsed: Column) -> Column:
    """Failure reason of a content type header, given its :func:`split_content_type`."""
    return F.when(blank_to_null(header).isNull(), F.lit("content-type-missing")).when(
        parsed.isNull(), F.lit("content-type-invalid")
    )


def decode_text(raw: Column, media_type: Column) -> tuple[Column, Column]:
    """(text, failure reason): text of the three known types, if valid UTF-8."""
    known = F.coalesce(media_type.isin(*TEXT_TYPES), F.lit(False))
    # The digest and the raw body are binary; text is validated before the cast.
    valid = F.coalesce(F.is_valid_utf8(raw.cast("string")), F.lit(True))
    reason = F.when(~known, F.lit("content-type-unsupported")).when(~valid, F.lit("utf8"))
    text = F.when(known & valid, F.coalesce(raw.cast("string"), F.lit("")))
    return text, reason


def trim_structured(text: Column, media_type: Column) -> tuple[Column, Column]:
    """(text, failure reason): JSON and XML are trimmed and must not be blank."""
    structured = media_type.isin(*STRUCTURED_TYPES)
    trimmed = F.when(structured, trim_space(text)).otherwise(text)
    return trimmed, F.when(structured & (trimmed == ""), F.lit("empty"))


def split_target(df: DataFrame, target: str = "request_uri") -> DataFrame:
    """Add ``target``: url, url_raw, path, query_raw and the query map."""
    method = F.col("method") if "method" in df.columns else None
    return df.withColumn("target", split_url(F.col(target), method))


def fold_case(df: DataFrame) -> DataFrame:
    """Protocol, host and method in lower case."""
    return df.withColumns({name: F.lower(name) for name in ("proto", "host", "method")})


def normalise_header_maps(df: DataFrame) -> DataFrame:
    """Names of headers and trailers in lower case, empty values as NULL."""
    return df.withColumns(
        {
            "headers": maps.normalise_headers(F.col("headers")),
            "trailers": maps.normalise_headers(F.col("trailers")),
            "transfer_encoding": F.when(F.size("transfer_encoding") > 0, F.col("transfer_encoding")),
        }
    )


def _parse(df: DataFrame, parse_json: bool, parse_xml: bool) -> DataFrame:
    """All gates in order. The first failing one is the ``outcome``."""
    df = normalise_header_maps(normalise_body(df))
    df = df.withColumns(
        {
            "_type_header": maps.first_value(F.col("headers"), "content-type"),
            "_encoding_header": maps.first_value(F.col("headers"), "content-encoding"),
        }
    )
    kept_encoding, encoding_reason = gate_content_encoding(F.col("_encoding_header"))
    df = df.withColumns(
        {
            "_type": F.when(F.col("_type_header").isNotNull(), split_content_type(F.col("_type_header"))),
            "content_encoding": kept_encoding,
            "_encoding_reason": encoding_reason,
        }
    )
    df = df.withColumn(
        "_reason",
        F.coalesce(
            gate_transfer_encoding(F.col("transfer_encoding")),
            F.col("_encoding_reason"),
            gate_content_type(F.col("_type_header"), F.col("_type")),
        ),
    )
    media_type = F.col("_type")["media_type"]
    text, reason = decode_text(F.col("message_raw"), media_type)
    df = df.withColumns(
        {
            "_text": F.when(F.col("_reason").isNull(), text),
            "_reason": F.coalesce(F.col("_reason"), reason),
        }
    )
    trimmed, reason = trim_structured(F.col("_text"), media_type)
    df = df.withColumns(
        {
            "_text": trimmed,
            "_reason": F.coalesce(F.col("_reason"), reason),
        }
    )
    open_ = F.col("_reason").isNull()
    is_json_body = open_ & (media_type == "application/json") & F.lit(parse_json)
    is_xml_body = open_ & (media_type == "application/xml") & F.lit(parse_xml)
    payload = F.when(is_json_body & is_json(F.col("_text")), F.col("_text"))
    if parse_xml:
        payload = F.coalesce(payload, F.when(is_xml_body, xml_to_json(F.col("_text"))))
    df = df.withColumn("message_json", payload)
    failed = F.col("message_json").isNull()
    return df.withColumns(
        {
            "message_text": F.when(failed, blank_to_null(F.col("_text"))),
            "outcome": F.coalesce(
                F.col("_reason"),
                F.when(is_json_body & failed, F.lit("json")).when(is_xml_body & failed, F.lit("xml")),
                F.lit("parsed"),
            ),
        }
    )


def http_records(
    df: DataFrame,
    identifier: str | None = None,
    parse_json: bool = True,
    parse_xml: bool = True,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Requests to collector messages; heartbeats are left out.

    ``keep`` names input columns to carry along, such as a record id. The column
    ``outcome`` may be kept too.
    """
    # Methods are told apart by case, so the target is read before that is folded.
    df = fold_case(split_target(_parse(drop_heartbeats(df), parse_json, parse_xml)))
    http = F.struct(
        F.lit(schemas.HTTP_SCHEMA).alias("schema"),
        blank_to_null(F.col("proto")).alias("protocol"),
        F.col("target")["url"].alias("url"),
        F.col("target")["url_raw"].alias("url_raw"),
        blank_to_null(F.col("host")).alias("host"),
        blank_to_null(F.col("method")).alias("method"),
        F.col("target")["path"].alias("path"),
        F.col("target")["query"].alias("query"),
        F.col("target")["query_raw"].alias("query_raw"),
        F.col("headers").alias("headers"),
        F.col("trailers").alias("trailers"),
        blank_to_null(F.col("remote_addr")).alias("remote"),
        F.col("_type")["media_type"].alias("content_type"),
        F.col("_type")["parameters"].alias("content_type_parameters"),
        F.col("content_encoding").alias("content_encoding"),
        F.nullif(F.col("content_length"), F.lit(0)).alias("content_length"),
        F.col("transfer_encoding").alias("transfer_encoding"),
    )
    label = F.col("collector_identifier") if "collector_identifier" in df.columns else F.lit(None)
    if identifier is not None:
        label = F.lit(identifier)
    return df.select(
        *keep,
        F.lit(schemas.HTTP).alias("collector_type"),
        F.nullif(label.cast("string"), F.lit("")).alias("collector_identifier"),
        F.col("received_at"),
        "message_raw",
        "message_sha256",
        "message_text",
        "message_json",
        F.struct(
            F.lit(None).cast(schemas.SYSLOG_META).alias("syslog"),
            http.alias("http"),
            F.lit(None).cast("string").alias("other"),
        ).alias("message_metadata"),
    )


def http_parse_outcome(
    df: DataFrame, parse_json: bool = True, parse_xml: bool = True, keep: Sequence[str] = ()
) -> DataFrame:
    """``keep`` columns and the ``outcome``: the first failing gate, or ``parsed``."""
    return _parse(drop_heartbeats(df), parse_json, parse_xml).select(*keep, "outcome")
