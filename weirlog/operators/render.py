"""Messages as JSON text and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirlog import schemas
from weirlog.functions import maps
from weirlog.functions.text import compact_json, escape_markup, has_markup, is_json, trim_space

RECORD_SEPARATOR = "\x1e"

# Residual syslog fields that are numbers.
NUMERIC_FIELDS = ("facility", "priority", "severity", "version")

_NUMERIC_MEMBER = rf'"(?<!\\")({"|".join(NUMERIC_FIELDS)})"(\s*:\s*)"(-?(?:0|[1-9][0-9]*))"'

_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
_ZERO_TIME = "0001-01-01T00:00:00Z"

_BODY = ("message_raw", "message_sha256", "message_text")


def _filled(name: str) -> Column:
    column = F.col(name)
    if name == "message_raw":
        return F.when(F.octet_length(column) > 0, column).alias(name)
    return F.nullif(column, F.lit("")).alias(name)


def _time(column: Column) -> Column:
    return F.coalesce(F.date_format(column, _TIME), F.lit(_ZERO_TIME))


def _members(json_object: Column) -> Column:
    """The text between the braces of a JSON object whose last member is a scalar."""
    return F.btrim(json_object, F.lit("{}"))


def _syslog_json(meta: Column, options: dict) -> Column:
    none = F.create_map().cast("map<string,string>")
    text = F.to_json(
        F.struct(
            meta["schema"].alias("schema"),
            meta["protocol"].alias("protocol"),
            _time(meta["timestamp"]).alias("timestamp"),
            F.coalesce(meta["timestamp_unix"], F.lit(0)).alias("timestamp_unix"),
            *[meta[n].alias(n) for n in ("node", "service", "type", "level", "level_unix")],
            maps.sorted_map(F.coalesce(meta["fields"], none)).alias("fields"),
        ),
        options,
    )
    # Numbers lose their quotes. Quotes inside a string are escaped, so only whole
    # members match.
    return F.regexp_replace(text, _NUMERIC_MEMBER, r'"$1"$2$3')


def _http_json(meta: Column, options: dict) -> Column:
    made = {
        "query": maps.sorted_map(meta["query"]),
        "headers": F.transform_values(maps.sorted_map(meta["headers"]), lambda _, v: maps.collapse_values(v)),
        "trailers": F.transform_values(maps.sorted_map(meta["trailers"]), lambda _, v: maps.collapse_values(v)),
        "content_type_parameters": maps.sorted_map(meta["content_type_parameters"]),
        "transfer_encoding": maps.collapse_values(meta["transfer_encoding"]),
    }
    return F.to_json(
        F.struct(*[made.get(n, meta[n]).alias(n) for n in schemas.HTTP_META.fieldNames()]), options
    )


def metadata_to_json(meta: Column, pretty: bool = False) -> Column:
    """The one member of the metadata that is set, as a JSON object; NULL without any."""
    options = {"pretty": "true"} if pretty else {}
    return (
        F.when(meta["syslog"].isNotNull(), _syslog_json(meta["syslog"], options))
        .when(meta["http"].isNotNull(), _http_json(meta["http"], options))
        .otherwise(meta["other"])
    )


def metadata_from_json(text: Column) -> Column:
    """METADATA of a JSON object: typed if it has one of the two known shapes."""
    schema_id = F.get_json_object(text, "$.schema")

    def known(struct: T.StructType) -> Column:
        names = F.array(*[F.lit(n) for n in struct.fieldNames()])
        return F.size(F.array_except(F.json_object_keys(text), names)) == 0

    loose = T.StructType(
        [
            T.StructField(f.name, T.MapType(T.StringType(), T.VariantType()))
            if f.name in ("headers", "trailers")
            else T.StructField(f.name, T.VariantType())
            if f.name == "transfer_encoding"
            else f
            for f in schemas.HTTP_META
        ]
    )
    raw = F.from_json(text, loose)
    made = {
        "headers": F.transform_values(raw["headers"], lambda _, v: maps.expand_values(v)),
        "trailers": F.transform_values(raw["trailers"], lambda _, v: maps.expand_values(v)),
        "transfer_encoding": maps.expand_values(raw["transfer_encoding"]),
    }
    http = F.struct(*[made.get(n, raw[n]).alias(n) for n in schemas.HTTP_META.fieldNames()])
    is_syslog = F.coalesce((schema_id == schemas.SYSLOG_SCHEMA) & known(schemas.SYSLOG_META), F.lit(False))
    is_http = F.coalesce((schema_id == schemas.HTTP_SCHEMA) & known(schemas.HTTP_META), F.lit(False))
    return F.when(
        text.isNotNull(),
        F.struct(
            F.when(is_syslog, F.from_json(text, schemas.SYSLOG_META)).alias("syslog"),
            F.when(is_http, http.cast(schemas.HTTP_META)).alias("http"),
            F.when(~is_syslog & ~is_http, text).alias("other"),
        ),
    )


def message_to_json(pretty: bool = False) -> Column:
    """One JSON object per message, over the message columns.

    Members come in a fixed order and empty ones are left out. The payloads are
    embedded as they are, only without blanks, and not re-read as values, so
    number formats and member order survive. :func:`with_json` adds the escapes.
    """
    options = {"pretty": "true"} if pretty else {}
    head = F.to_json(
        F.struct(
            F.coalesce("schema", F.lit("")).alias("schema"),
            _filled("subschema"),
            F.coalesce("sequence", F.lit(0)).alias("sequence"),
            _time(F.col("timestamp")).alias("timestamp"),
            F.coalesce("timestamp_unix", F.lit(0)).alias("timestamp_unix"),
            _filled("collector_type"),
            _filled("collector_identifier"),
            *[_filled(name) for name in _BODY],
        ),
        options,
    )
    meta = metadata_to_json(F.col("message_metadata"), pretty)
    payloads = [(name, compact_json(F.col(name))) for name in ("message_json", "message_extra")]
    if not pretty:
        members = [_members(head)]
        members += [F.concat(F.lit(f'"{name}":'), value) for name, value in payloads]
        members.append(F.concat(F.lit('"message_metadata":'), meta))
        return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))
    # Two blanks per level become tabs, and ` : ` becomes `: `. A line break can
    # only be layout: in a string it is escaped.
    inner = F.replace(meta, F.lit("\n"), F.lit("\n  "))
    members = [F.regexp_replace(_members(head), r"\s+$", "")]
    members += [F.concat(F.lit(f'\n  "{name}" : '), value) for name, value in payloads]
    members.append(F.concat(F.lit('\n  "message_metadata" : '), inner))
    text = F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("\n}"))
    text = F.regexp_replace(text, r"(?m)(?:^|\G)  ", "\t")
    return F.regexp_replace(text, r'(?m)^(\t*"(?:[^"\\]|\\.)*+") : ', "$1: ")


def with_json(df: DataFrame, pretty: bool = False, out: str = "json") -> DataFrame:
    """Add the JSON text of each message, with markup characters escaped."""
    # The text is a column of its own first, so that it is made once.
    df = df.withColumn(out, message_to_json(pretty))
    text = F.col(out)
    return df.withColumn(out, F.when(has_markup(text), escape_markup(text)).otherwise(text))


def render_message(df: DataFrame, pretty: bool = False, out: str = "json", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the JSON text of each message."""
    return with_json(df, pretty, out).select(*keep, out)


def frame_sequence(json: Column) -> Column:
    """JSON text sequence framing: record separator, text; the sink adds the line feed."""
    return F.concat(F.lit(RECORD_SEPARATOR), json)


def frame_blank_lines(json: Column) -> Column:
    """Two line feeds before and after; the sink adds the last one."""
    return F.concat(F.lit("\n\n"), json, F.lit("\n"))


def frame(json: Column, framing: str) -> Column:
    if framing == "sequence":
        return frame_sequence(json)
    if framing == "blank-lines":
        return frame_blank_lines(json)
    raise ValueError(f"framing must be 'sequence' or 'blank-lines', not {framing!r}")


# What a JSON reader should take each message member for; texts that are not
# plain strings come back exactly as written.
READ_SCHEMA = T.StructType(
    [
        T.StructField(f.name, T.StringType())
        if f.name in ("timestamp", "message_metadata")
        else f
        for f in schemas.MESSAGE
    ]
)


def messages_from_read(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Messages from columns read with :data:`READ_SCHEMA`.

    The reader hands a JSON string over without its quotes and ``null`` as NULL.
    Such a payload is the whole body of a JSON request, so it is taken from the raw
    bytes. Without raw bytes, quotes are put back where the text is not JSON by
    itself, and ``null`` stays NULL.
    """
    df = df.withColumn("_meta", metadata_from_json(F.col("message_metadata")))
    http = F.col("_meta")["http"]
    body = trim_space(F.col("message_raw").cast("string"))
    whole_body = (
        (http["content_type"] == "application/json")
        & http["content_encoding"].isNull()
        & http["transfer_encoding"].isNull()
        & F.col("message_text").isNull()
        & ((body == "null") | F.startswith(body, F.lit('"')))
    )

    def payload(name: str) -> Column:
        text = F.col(name)
        return F.when(is_json(text), text).otherwise(F.to_json(text.cast("variant")))

    made = {
        "timestamp": F.nullif("timestamp", F.lit(_ZERO_TIME)).try_cast("timestamp"),
        "message_json": F.when(whole_body, body).otherwise(payload("message_json")),
        "message_extra": payload("message_extra"),
        "message_metadata": F.col("_meta"),
    }
    return df.select(
        *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.MESSAGE], *keep
    )
