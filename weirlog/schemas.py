"""Record schemas and the constants that identify them."""

from __future__ import annotations

from pyspark.sql import types as T

# Schema identifiers and collector names written into every record.
MESSAGE_SCHEMA = "20181020b"
SYSLOG_SCHEMA = "syslog:20181020a"
HTTP_SCHEMA = "http:20181020a"
SYSLOG = "syslog"
HTTP = "http"

# Defaults of the options.
DEFAULT_SEGMENT_MESSAGES = 16384
DEFAULT_SEGMENT_TIMEOUT = "1 hour"
DEFAULT_TOKEN_LAYOUT = "yyyy-MM-dd"
DEFAULT_ARCHIVE_LAYOUT = "yyyy-MM-dd-HH-mm-ss"
DEFAULT_MONTH_LAYOUT = "yyyy-MM"
DEFAULT_SUFFIX = ".json-stream"
DEFAULT_REPORT_MESSAGES = 1000
DEFAULT_REPORT_INTERVAL = "60 seconds"
DEFAULT_COMPRESSION_LEVEL = 9

SYSLOG_META = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestamp_unix", T.LongType()),
        T.StructField("node", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("level_unix", T.ByteType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    ]
)

_LISTS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

HTTP_META = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("url_raw", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("query", _LISTS),
        T.StructField("query_raw", T.StringType()),
        T.StructField("headers", _LISTS),
        T.StructField("trailers", _LISTS),
        T.StructField("remote", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("content_type_parameters", T.MapType(T.StringType(), T.StringType())),
        T.StructField("content_encoding", T.StringType()),
        T.StructField("content_length", T.LongType()),
        T.StructField("transfer_encoding", T.ArrayType(T.StringType())),
    ]
)

# Exactly one member is set. `other` holds the JSON text of metadata that a
# replacing transformer returned and that is neither of the two known shapes.
METADATA = T.StructType(
    [
        T.StructField(SYSLOG, SYSLOG_META),
        T.StructField(HTTP, HTTP_META),
        T.StructField("other", T.StringType()),
    ]
)

HTTP_REQUEST = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("request_uri", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("proto", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("remote_addr", T.StringType()),
        T.StructField("headers", _LISTS),
        T.StructField("trailers", _LISTS),
        T.StructField("transfer_encoding", T.ArrayType(T.StringType())),
        T.StructField("content_length", T.LongType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("received_at", T.TimestampType()),
    ]
)

MESSAGE = T.StructType(
    [
        T.StructField("schema", T.StringType()),
        T.StructField("subschema", T.StringType()),
        T.StructField("sequence", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestamp_unix", T.LongType()),
        T.StructField("collector_type", T.StringType()),
        T.StructField("collector_identifier", T.StringType()),
        T.StructField("message_raw", T.BinaryType()),
        T.StructField("message_sha256", T.StringType()),
        T.StructField("message_text", T.StringType()),
        T.StructField("message_json", T.StringType()),
        T.StructField("message_extra", T.StringType()),
        T.StructField("message_metadata", METADATA),
    ]
)
MESSAGE_COLUMNS = tuple(MESSAGE.fieldNames())
