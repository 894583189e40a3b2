"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirlog.functions.mime import split_content_type
from weirlog.functions.text import is_json
from weirlog.functions.url import split_url
from weirlog.functions.xml import xml_to_json
from weirlog.operators import audit, envelope as env, http, render, reports, segments, syslog, transform
from weirlog.operators.numbering import with_sequence
from weirlog.plans import fixtures as fx
from weirlog.session import Scratch, configure, new_folder
from weirlog.sinks.files import archive, console_text, fan_out, write_segments
from weirlog.sources.archive import scan_archive
from weirlog.sources.frames import scan_http, scan_syslog, throttle
from weirlog.streaming import run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ORDER = ("received_at", "collector_type", "record_id")
CUTS = (datetime(2024, 1, 3, 5), datetime(2024, 1, 3, 6), datetime(2024, 1, 10))


def query(function: Query) -> Query:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(configure(spark), sf_dir)

    QUERIES[function.__name__.rstrip("_")] = call
    return function


def micros(name: str) -> Column:
    return F.unix_micros(name)


def pairs(column: Column) -> Column:
    """A map of lists as text, sorted by name."""
    return F.array_join(
        F.sort_array(
            F.transform(
                F.map_entries(column),
                lambda e: F.concat(e["key"], F.lit("="), F.coalesce(F.array_join(e["value"], "|"), F.lit(""))),
            )
        ),
        ";",
    )


def scalars(column: Column) -> Column:
    """A map of texts as text, sorted by name."""
    return F.array_join(
        F.sort_array(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";"
    )


# -- sources and syslog ------------------------------------------------------------


@query
def scan_syslog_(spark, sf_dir):
    folder = new_folder(spark, "frames")
    fx.syslog_lines(spark, sf_dir, "rfc5424").select("line").write.text(folder)
    frames = syslog.with_digest(scan_syslog(spark, folder, identifier="gate", format="rfc5424"))
    return frames.select(
        F.col("message_raw").cast("string").alias("line"), "collector_identifier", "message_sha256"
    )


@query
def scan_http_(spark, sf_dir):
    folder = new_folder(spark, "requests")
    fx.http_requests(spark, sf_dir).write.parquet(folder)
    return scan_http(spark, folder, identifier="gate").select(
        "record_id",
        "request_uri",
        "method",
        "collector_identifier",
        F.sha2("body", 256).alias("body_sha256"),
        F.size("headers").cast("bigint").alias("header_count"),
        micros("received_at").alias("received_us"),
    )


@query
def syslog_digest(spark, sf_dir):
    return syslog.with_digest(fx.syslog_frames(spark, sf_dir)).select("record_id", "message_sha256")


@query
def syslog_decode_5424(spark, sf_dir):
    part = lambda name: F.col("parts")[name]
    return syslog.decode_syslog(fx.syslog_frames(spark, sf_dir), "rfc5424").select(
        "record_id",
        *[part(n).cast("bigint").alias(n) for n in ("priority", "facility", "severity", "version")],
        F.unix_micros(part("timestamp")).alias("timestamp_us"),
        *[part(n).alias(n) for n in ("hostname", "app_name", "proc_id", "msg_id", "structured_data", "message")],
    )


@query
def syslog_decode_3164(spark, sf_dir):
    part = lambda name: F.col("parts")[name]
    return syslog.decode_syslog(fx.syslog_frames(spark, sf_dir, "rfc3164"), "rfc3164").select(
        "record_id",
        *[part(n).cast("bigint").alias(n) for n in ("priority", "facility", "severity")],
        F.unix_micros(part("timestamp")).alias("timestamp_us"),
        *[part(n).alias(n) for n in ("hostname", "tag", "content")],
    )


@query
def syslog_nil_parts(spark, sf_dir):
    rows = fx.syslog_parts(spark, sf_dir)
    return rows.select("record_id", F.explode(syslog.drop_nil_parts(F.col("parts"))).alias("part", "value"))


@query
def syslog_take_part(spark, sf_dir):
    rows = fx.syslog_parts(spark, sf_dir).withColumn("parts", syslog.drop_nil_parts(F.col("parts")))
    service = syslog.take_part(F.col("parts"), ["app_name", "tag"])
    severity = syslog.take_part(service.parts, ["severity"], "int", remove=False)
    kind = syslog.take_part(service.parts, ["msg_id"], optional=True)
    number = syslog.take_part(kind.parts, ["message"], "int")
    return rows.select(
        "record_id",
        service.value.alias("service"),
        severity.value.cast("bigint").alias("severity"),
        severity.error.alias("severity_error"),
        kind.value.alias("kind"),
        kind.error.alias("kind_error"),
        number.error.alias("number_error"),
        F.array_join(F.sort_array(F.map_keys(number.parts)), ",").alias("left_over"),
    )


@query
def syslog_promote_json(spark, sf_dir):
    rows = fx.syslog_parts(spark, sf_dir).withColumnRenamed("message", "message_text")
    return syslog.promote_json_text(rows).select("record_id", "message_text", "message_json")


@query
def syslog_levels(spark, sf_dir):
    level, level_unix = syslog.severity_to_level(F.col("severity"))
    return fx.syslog_parts(spark, sf_dir).select(
        "record_id", level.alias("level"), level_unix.cast("bigint").alias("level_unix")
    )


@query
def syslog_residual(spark, sf_dir):
    rows = fx.syslog_parts(spark, sf_dir)
    fields = syslog.residual_fields(syslog.drop_nil_parts(F.col("parts")))
    return rows.select("record_id", F.explode(fields).alias("part", "value"))


def _records(spark, sf_dir, format="rfc5424"):
    return syslog.syslog_records(fx.syslog_frames(spark, sf_dir, format), format, keep=("record_id",))


def _flat_syslog(records):
    meta = lambda name: F.col("message_metadata")["syslog"][name]
    return records.select(
        "record_id",
        "collector_type",
        "collector_identifier",
        "message_sha256",
        "message_text",
        "message_json",
        *[meta(n).alias(n) for n in ("schema", "protocol", "timestamp_unix", "node", "service", "type", "level")],
        meta("level_unix").cast("bigint").alias("level_unix"),
        scalars(meta("fields")).alias("fields"),
    )


@query
def syslog_records(spark, sf_dir):
    return _flat_syslog(_records(spark, sf_dir))


@query
def syslog_records_3164(spark, sf_dir):
    return _flat_syslog(_records(spark, sf_dir, "rfc3164"))


@query
def syslog_rejects(spark, sf_dir):
    rejects = syslog.syslog_rejects(fx.syslog_frames(spark, sf_dir), "rfc5424")
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("frames"))


@query
def syslog_reject_reasons(spark, sf_dir):
    """Each frame that is refused, over frames with every kind of fault."""
    rejects = syslog.syslog_rejects(fx.syslog_frames(spark, sf_dir, "odd"), "rfc5424", keep=("record_id",))
    return rejects.select("record_id", "reject_reason")


@query
def syslog_structured(spark, sf_dir):
    """Structured data and text of the frames that the grammar takes."""
    part = lambda name: F.col("parts")[name]
    decoded = syslog.decode_syslog(fx.syslog_frames(spark, sf_dir, "odd"), "rfc5424")
    return decoded.where("parts is not null").select(
        "record_id",
        part("priority").cast("bigint").alias("priority"),
        F.unix_micros(part("timestamp")).alias("timestamp_us"),
        *[part(n).alias(n) for n in ("structured_data", "message")],
    )


@query
def service_levels(spark, sf_dir):
    """The flagship: enveloped records by service and level."""
    meta = lambda name: F.col("message_metadata")["syslog"][name]
    return (
        env.envelope(_records(spark, sf_dir))
        .groupBy(meta("service").alias("service"), meta("level").alias("level"))
        .agg(
            F.count("*").alias("records"),
            F.count_if(F.col("message_json").isNotNull()).alias("json_records"),
            F.min("timestamp_unix").alias("first_ms"),
            F.max("timestamp_unix").alias("last_ms"),
        )
    )


# -- http --------------------------------------------------------------------------


@query
def http_heartbeat(spark, sf_dir):
    return http.drop_heartbeats(fx.http_requests(spark, sf_dir)).select("record_id", "request_uri")


@query
def http_body_digest(spark, sf_dir):
    return http.normalise_body(fx.http_requests(spark, sf_dir)).select(
        "record_id", "message_sha256", F.octet_length("message_raw").cast("bigint").alias("raw_bytes")
    )


@query
def http_transfer_gate(spark, sf_dir):
    return fx.http_requests(spark, sf_dir).select(
        "record_id", http.gate_transfer_encoding(F.col("transfer_encoding")).alias("reason")
    )


@query
def http_encoding_gate(spark, sf_dir):
    rows = http.normalise_header_maps(fx.http_requests(spark, sf_dir))
    kept, reason = http.gate_content_encoding(F.get(F.try_element_at("headers", F.lit("content-encoding")), F.lit(0)))
    return rows.select("record_id", kept.alias("content_encoding"), reason.alias("reason"))


# Content type headers, well formed and not, told apart by the page number.
CONTENT_TYPE = """
case page_id % 7 when 1 then 'text/plain; charset' when 2 then ';;'
 when 3 then 'a/b; x=' || cast(page_id as {str}) || '; X=' || cast(page_id % 2 as {str})
 when 4 then ' TEXT/Html ; q="a;b' || cast(page_id as {str}) || '" ; z=2;'
 when 5 then 'text; k="say \\\\"' || cast(page_id as {str}) || '\\\\""' when 6 then ''
 else 'Application/JSON; Charset="utf-8"; V=' || cast(page_id as {str}) end
"""


@query
def http_content_type(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("record_id"), F.expr(CONTENT_TYPE.format(str="string")).alias("header")
    )
    rows = rows.withColumn("parsed", split_content_type(F.col("header")))
    return rows.select(
        "record_id",
        F.col("parsed")["media_type"].alias("media_type"),
        scalars(F.col("parsed")["parameters"]).alias("parameters"),
        http.gate_content_type(F.col("header"), F.col("parsed")).alias("reason"),
    )


def _text_rows(spark, sf_dir):
    rows = http.normalise_header_maps(http.normalise_body(fx.http_requests(spark, sf_dir)))
    header = F.get(F.try_element_at("headers", F.lit("content-type")), F.lit(0))
    rows = rows.withColumn("media_type", split_content_type(header)["media_type"])
    text, reason = http.decode_text(F.col("message_raw"), F.col("media_type"))
    return rows.withColumns({"text": text, "reason": reason})


@query
def http_text(spark, sf_dir):
    return _text_rows(spark, sf_dir).select("record_id", F.sha2("text", 256).alias("text_sha256"), "reason")


@query
def http_trim(spark, sf_dir):
    trimmed, reason = http.trim_structured(F.col("text"), F.col("media_type"))
    return _text_rows(spark, sf_dir).select(
        "record_id", F.sha2(trimmed, 256).alias("text_sha256"), reason.alias("reason")
    )


@query
def http_json(spark, sf_dir):
    trimmed, _ = http.trim_structured(F.col("text"), F.col("media_type"))
    rows = _text_rows(spark, sf_dir).withColumn("text", trimmed)
    return rows.where(F.col("media_type") == "application/json").select(
        "record_id", is_json(F.col("text")).cast("bigint").alias("is_json")
    )


@query
def http_xml(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", xml_to_json(F.expr(fx.XML_DOCUMENT.format(str="string"))).alias("json")
    )


@query
def http_url(spark, sf_dir):
    rows = fx.http_requests(spark, sf_dir).withColumn("target", split_url(F.col("request_uri")))
    return rows.select(
        "record_id",
        *[F.col("target")[n].alias(n) for n in ("url", "url_raw", "path", "query_raw")],
        pairs(F.col("target")["query"]).alias("query"),
    )


@query
def http_fold_case(spark, sf_dir):
    return http.fold_case(fx.http_requests(spark, sf_dir)).select("record_id", "proto", "host", "method")


@query
def http_headers(spark, sf_dir):
    rows = http.normalise_header_maps(fx.http_requests(spark, sf_dir))
    return rows.select(
        "record_id",
        pairs(F.col("headers")).alias("headers"),
        pairs(F.col("trailers")).alias("trailers"),
        F.array_join("transfer_encoding", "|").alias("transfer_encoding"),
    )


@query
def http_records(spark, sf_dir):
    records = http.http_records(fx.http_requests(spark, sf_dir), "gate", keep=("record_id", "outcome"))
    meta = lambda name: F.col("message_metadata")["http"][name]
    return records.select(
        "record_id",
        "outcome",
        "collector_type",
        "collector_identifier",
        "message_sha256",
        F.octet_length("message_raw").cast("bigint").alias("raw_bytes"),
        F.sha2("message_text", 256).alias("text_sha256"),
        "message_json",
        *[
            meta(n).alias(n)
            for n in ("schema", "protocol", "url", "url_raw", "host", "method", "path", "query_raw", "remote")
        ],
        pairs(meta("query")).alias("query"),
        pairs(meta("headers")).alias("headers"),
        meta("content_type").alias("content_type"),
        scalars(meta("content_type_parameters")).alias("parameters"),
        meta("content_encoding").alias("content_encoding"),
        meta("content_length").alias("content_length"),
        F.array_join(meta("transfer_encoding"), "|").alias("transfer_encoding"),
    )


@query
def http_outcomes(spark, sf_dir):
    outcomes = http.http_parse_outcome(fx.http_requests(spark, sf_dir))
    return outcomes.groupBy("outcome").agg(F.count("*").alias("requests"))


# -- envelope and numbering ----------------------------------------------------------


def _collected(spark, sf_dir):
    requests = http.http_records(fx.http_requests(spark, sf_dir), "gate", keep=("record_id",))
    return env.merge_collectors(_records(spark, sf_dir), requests)


@query
def merge_collectors(spark, sf_dir):
    return _collected(spark, sf_dir).select(
        "collector_type",
        "record_id",
        micros("received_at").alias("received_us"),
        "message_sha256",
        F.sha2("message_text", 256).alias("text_sha256"),
        "message_json",
    )


@query
def envelope(spark, sf_dir):
    return env.envelope(_collected(spark, sf_dir), keep=("record_id",)).select(
        "record_id",
        "schema",
        "subschema",
        "collector_type",
        "collector_identifier",
        micros("timestamp").alias("timestamp_us"),
        "timestamp_unix",
        "message_sha256",
    )


@query
def sequence(spark, sf_dir):
    rows = with_sequence(_collected(spark, sf_dir).select(*ORDER), ORDER)
    return rows.select("collector_type", "record_id", "sequence")


@query
def prune_raw(spark, sf_dir):
    rows = env.prune_raw(env.envelope(_collected(spark, sf_dir), keep=("record_id",)), keep_raw=False)
    return rows.select(
        "collector_type", "record_id", F.octet_length("message_raw").cast("bigint").alias("raw_bytes"), "message_sha256"
    )


@query
def prune_digest(spark, sf_dir):
    rows = env.prune_digest(env.envelope(_collected(spark, sf_dir), keep=("record_id",)), keep_sha256=False)
    return rows.select(
        "collector_type", "record_id", F.octet_length("message_raw").cast("bigint").alias("raw_bytes"), "message_sha256"
    )


# -- transformer -----------------------------------------------------------------------


def _messages(spark, sf_dir, keep=("record_id",)):
    return env.envelope(_collected(spark, sf_dir), keep=keep)


def _annotate(df):
    """A native transformer: fails on every 7th record, replies junk on every 11th."""
    return (
        F.when(F.col("record_id") % 7 == 0, F.lit(None))
        .when(F.col("record_id") % 11 == 0, F.lit('{"a": 1} x'))
        .otherwise(F.concat(F.lit('{"n": '), F.col("record_id").cast("string"), F.lit("}")))
    )


@query
def enrich(spark, sf_dir):
    rows = transform.enrich(_messages(spark, sf_dir), _annotate)
    return rows.where(F.col("transform_error").isNull()).select("collector_type", "record_id", "message_extra")


@query
def enrich_fail_open(spark, sf_dir):
    rows = transform.enrich(_messages(spark, sf_dir), _annotate)
    return rows.select(
        "collector_type", "record_id", "message_sha256", "message_json", "message_extra", "transform_error"
    )


@query
def enrich_python(spark, sf_dir):
    """A Python transformer that fails on text messages of some services."""

    def describe(message):
        meta = message.get("message_metadata", {})
        if meta.get("service") == "error":
            raise ValueError("refused")
        return {"level": meta.get("level"), "size": len(message.get("message_sha256", ""))}

    rows = transform.enrich(_messages(spark, sf_dir), transform.python_transformer(describe))
    return rows.select("collector_type", "record_id", "message_extra", "transform_error")


def _rewrite(df):
    """A native replacing transformer with every outcome, told apart by record id."""
    number = F.col("record_id").cast("string")
    return (
        F.when(F.col("record_id") % 8 == 0, F.lit(" null "))
        .when(F.col("record_id") % 8 == 1, F.lit(None))
        .when(F.col("record_id") % 8 == 2, F.concat(F.lit('{"schema":"s","colour":"red","sequence":'), number, F.lit("}")))
        .when(F.col("record_id") % 8 == 3, F.concat(F.lit('{"schema":"s","sequence":"'), number, F.lit('"}')))
        .when(F.col("record_id") % 8 == 4, F.concat(F.lit("["), number, F.lit("]")))
        .when(F.col("record_id") % 8 == 5, F.lit('{"schema":'))
        .otherwise(
            F.concat(
                F.lit('{"schema": "mine", "sequence": '),
                number,
                F.lit(', "message_text": "t'),
                number,
                F.lit('", "message_json": {"k": ['),
                number,
                F.lit(']}, "message_metadata": {"who": "'),
                F.col("collector_type"),
                F.lit('"}}'),
            )
        )
    )


@query
def replace(spark, sf_dir):
    rows = transform.drop_null_replacements(transform.replace(_messages(spark, sf_dir), _rewrite))
    # Replaced messages have no columns but those of the reply.
    return rows.select(
        "record_id",
        "schema",
        "sequence",
        "timestamp_unix",
        "collector_type",
        "message_sha256",
        F.sha2("message_text", 256).alias("text_sha256"),
        "message_json",
        F.col("message_metadata")["other"].alias("other_metadata"),
        F.col("message_metadata")["syslog"]["service"].alias("service"),
        "transform_error",
    )


@query
def replace_drops(spark, sf_dir):
    return reports.totals(transform.replace(_messages(spark, sf_dir), _rewrite))


# -- reports ---------------------------------------------------------------------------


def _numbered(spark, sf_dir):
    rows = with_sequence(_collected(spark, sf_dir).select(*ORDER), ORDER)
    return rows.withColumn("dropped", F.col("record_id") % 8 == 0)


@query
def totals(spark, sf_dir):
    return reports.totals(_numbered(spark, sf_dir))


@query
def throughput_by_count(spark, sf_dir):
    return reports.throughput_by_count(_numbered(spark, sf_dir), 1000)


@query
def throughput_by_time(spark, sf_dir):
    rows = _collected(spark, sf_dir).withColumn("dropped", F.col("record_id") % 8 == 0)
    reports_ = reports.throughput_by_time(rows, "60 seconds")
    return reports_.select(micros("start").alias("start_us"), "messages", "dropped", "rate")


# -- segments --------------------------------------------------------------------------


def _events(spark, sf_dir):
    return fx.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"), "event_type", F.col("ts").cast("timestamp").alias("received_at")
    )


@query
def segment_token(spark, sf_dir):
    rows = segments.with_token(_events(spark, sf_dir), segments.layout_from_reference_time("2006-01-02 15"))
    return rows.select("record_id", "token")


@query
def segment_by_count(spark, sf_dir):
    return segments.segment_by_count(_events(spark, sf_dir), 100).select("record_id", "token", "segment")


@query
def segment(spark, sf_dir):
    return segments.segment(_events(spark, sf_dir)).select("record_id", "token", "segment")


@query
def segment_small(spark, sf_dir):
    return segments.segment(_events(spark, sf_dir), 10, "1 hour").select("record_id", "token", "segment")


@query
def segment_series(spark, sf_dir):
    rows = segments.segment(_events(spark, sf_dir), 5, "2 hours", keys=("event_type",))
    return rows.select("record_id", "event_type", "token", "segment")


@query
def segment_flush(spark, sf_dir):
    rows = segments.segment(_events(spark, sf_dir), 10, "1 hour", cut_at=CUTS)
    return rows.select("record_id", "token", "segment")


@query
def segment_hot_token(spark, sf_dir):
    """One token holds all rows and more messages may come than do: the chain is ranked by all tasks."""
    rows = segments.segment(_events(spark, sf_dir), 1000, "1 hour", layout="yyyy", scanned=1000)
    return rows.select("record_id", "token", "segment")


@query
def segment_hourly(spark, sf_dir):
    """Tokens that come back every day: the hour alone."""
    rows = segments.segment(_events(spark, sf_dir), 10, "40 minutes", layout="HH")
    return rows.select("record_id", "token", "segment")


@query
def segment_manifest(spark, sf_dir):
    rows = segments.segment(_events(spark, sf_dir), 10, "1 hour", cut_at=CUTS)
    manifest = segments.segment_manifest(rows, 10, "1 hour", cut_at=CUTS)
    return manifest.select(
        "token",
        "segment",
        micros("started_at").alias("started_us"),
        micros("last_at").alias("last_us"),
        "count",
        "cut_reason",
        "current_name",
        "month",
        "archived_name",
    )


# -- rendering, sinks, reading back ------------------------------------------------------


def _sequenced_messages(spark, sf_dir, scratch=None):
    return env.envelope(with_sequence(_collected(spark, sf_dir), ORDER, scratch=scratch), keep=("record_id",))


def _read_members(text: Column) -> dict[str, Column]:
    member = lambda path: F.get_json_object(text, path)
    return {
        "schema": member("$.schema"),
        "sequence": member("$.sequence").cast("bigint"),
        "timestamp_us": F.unix_micros(member("$.timestamp").cast("timestamp")),
        "timestamp_unix": member("$.timestamp_unix").cast("bigint"),
        "collector_type": member("$.collector_type"),
        "raw_sha256": F.sha2(F.unbase64(member("$.message_raw")), 256),
        "message_sha256": member("$.message_sha256"),
        "text_sha256": F.sha2(member("$.message_text"), 256),
        "message_json": member("$.message_json"),
        "service": member("$.message_metadata.service"),
        "facility": member("$.message_metadata.fields.facility").cast("bigint"),
        "request_id": member("$.message_metadata.headers.x-request-id"),
        "multi": member("$.message_metadata.headers.x-multi"),
    }


@query
def render_message(spark, sf_dir):
    rows = render.render_message(_sequenced_messages(spark, sf_dir), keep=("record_id",))
    return rows.select("record_id", *[c.alias(n) for n, c in _read_members(F.col("json")).items()])


@query
def render_pretty(spark, sf_dir):
    rows = render.render_message(_sequenced_messages(spark, sf_dir), pretty=True, keep=("record_id",))
    return rows.select("record_id", *[c.alias(n) for n, c in _read_members(F.col("json")).items()])


def _framing(spark, sf_dir, name):
    rows = render.render_message(_sequenced_messages(spark, sf_dir), keep=("record_id", "collector_type"))
    framed = F.concat(render.frame(F.col("json"), name), F.lit("\n"))
    body = F.trim(F.regexp_replace(framed, "[\\x1e\\n]", ""))
    return rows.select(
        "record_id",
        "collector_type",
        (F.length(framed) - F.length("json")).cast("bigint").alias("frame_characters"),
        F.hex(F.substring(framed, 1, 2)).alias("first_two"),
        F.hex(F.substring(framed, -2, 2)).alias("last_two"),
        F.get_json_object(body, "$.sequence").cast("bigint").alias("sequence"),
    )


@query
def frame_sequence(spark, sf_dir):
    return _framing(spark, sf_dir, "sequence")


@query
def frame_blank_lines(spark, sf_dir):
    return _framing(spark, sf_dir, "blank-lines")


@query
def write_console_(spark, sf_dir):
    """What the console prints, message by message: its text read as JSON, and its frame."""
    rows = console_text(_sequenced_messages(spark, sf_dir).drop("record_id"))
    member = lambda path: F.get_json_object("value", path)
    return rows.select(
        "sequence",
        member("$.sequence").cast("bigint").alias("printed_sequence"),
        member("$.message_sha256").alias("message_sha256"),
        F.sha2(member("$.message_text"), 256).alias("text_sha256"),
        F.endswith("value", F.lit("}\n")).alias("framed"),
    )


def _write_segmented(spark, sf_dir, store, **options):
    """The messages as segment files; the work tables behind them go once these are written."""
    # The message table is written before it is cut up, as a deployment would.
    with Scratch(spark) as scratch:
        with Scratch(spark) as numbered:
            messages = scratch.table(_sequenced_messages(spark, sf_dir, numbered), "messages")
        cut = segments.segment(messages, 1000, "12 hours", at="timestamp", position="sequence")
        write_segments(cut, store, **options)


def _flat_message(rows):
    meta = F.col("message_metadata")
    return rows.select(
        "sequence",
        "collector_type",
        micros("timestamp").alias("timestamp_us"),
        "message_sha256",
        F.sha2("message_raw", 256).alias("raw_sha256"),
        F.sha2("message_text", 256).alias("text_sha256"),
        "message_json",
        F.coalesce(meta["syslog"]["service"], meta["http"]["method"]).alias("what"),
        scalars(meta["syslog"]["fields"]).alias("fields"),
        pairs(meta["http"]["headers"]).alias("headers"),
    )


@query
def scan_archive_(spark, sf_dir):
    store = new_folder(spark, "segments")
    _write_segmented(spark, sf_dir, store, codec="gz")
    return _flat_message(scan_archive(spark, store))


@query
def write_segments_(spark, sf_dir):
    """Counts per segment file as read back."""
    store = new_folder(spark, "segments")
    _write_segmented(spark, sf_dir, store)
    rows = scan_archive(spark, store).withColumn("file", F.input_file_name())
    return rows.groupBy("month", "segment_name").agg(
        F.count("*").alias("messages"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.count_distinct("file").alias("files"),
    )


def _archived(codec):
    def run_(spark, sf_dir):
        """Every message of the archive with its place in its segment, as the files have it."""
        current, archived = new_folder(spark, "current"), new_folder(spark, "archive")
        _write_segmented(spark, sf_dir, current)
        archive(spark, current, archived, codec=codec)
        rows = scan_archive(spark, archived).withColumn("place", F.monotonically_increasing_id())
        in_segment = Window.partitionBy("month", "segment_name").orderBy("place")
        return rows.select(
            "month",
            "segment_name",
            F.row_number().over(in_segment).cast("bigint").alias("position"),
            "sequence",
            "message_sha256",
        )

    run_.__name__ = f"archive_{codec}"
    return query(run_)


for _codec in ("none", "gz", "bz2", "lz4"):
    _archived(_codec)


@query
def fan_out_(spark, sf_dir):
    first, second = new_folder(spark, "sink"), new_folder(spark, "sink")
    fan_out(
        _messages(spark, sf_dir),
        lambda df: df.write.parquet(first),
        lambda df: df.select(render.message_to_json().alias("value")).write.text(second),
    )
    one = spark.read.parquet(first).select(F.lit("table").alias("sink"), "collector_type", "message_sha256")
    two = spark.read.text(second).select(
        F.lit("text").alias("sink"),
        F.get_json_object("value", "$.collector_type").alias("collector_type"),
        F.get_json_object("value", "$.message_sha256").alias("message_sha256"),
    )
    return one.unionAll(two)


@query
def audit_digests(spark, sf_dir):
    rows = _messages(spark, sf_dir)
    damaged = F.when(F.col("record_id") % 50 == 0, F.lit(b"damaged")).otherwise(F.col("message_raw"))
    return audit.audit_digests(rows.withColumn("message_raw", damaged))


# -- streams -----------------------------------------------------------------------------


def _landed(spark, frames, as_text=False):
    """Four files, written one after another, each a stretch of time in order."""
    folder, table_ = new_folder(spark, "landed"), new_folder(spark, "frames")
    frames.write.parquet(table_)
    frames = spark.read.parquet(table_)
    bounds = frames.agg(F.percentile_approx(F.unix_micros("received_at"), [0.25, 0.5, 0.75])).first()[0]
    at = F.unix_micros("received_at")
    for low, high in zip([None, *bounds], [*bounds, None]):
        part = frames.where((at > low) if low is not None else F.lit(True))
        part = part.where((at <= high) if high is not None else F.lit(True)).coalesce(1)
        part = part.sortWithinPartitions("received_at", "record_id")
        part = part.select("line") if as_text else part
        getattr(part.write.mode("append"), "text" if as_text else "parquet")(folder)
    return folder


def _streamed(spark, sf_dir, sinks, state, max_files=2, **options):
    """Land the frames as several files and run them through as several batches."""
    frames = fx.syslog_frames(spark, sf_dir)
    folder = _landed(spark, frames)
    stream = spark.readStream.schema(frames.schema).options(**throttle(max_files=max_files)).parquet(folder)
    if "decode" not in options:
        stream = syslog.syslog_records(stream, "rfc5424", keep=("record_id",))
    writer = run.stream_messages(stream, state, sinks, **options)
    run.run_to_end(writer, new_folder(spark, "checkpoint"))


_DECODING = {
    "decode": lambda df: syslog.syslog_records(df, "rfc5424", keep=("record_id",)),
    "rejects": lambda df: syslog.syslog_rejects(df, "rfc5424", keep=("record_id",)),
}


@query
def stream_sequence(spark, sf_dir):
    """Numbers given over several micro-batches."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    _streamed(spark, sf_dir, [run.table_sink(out)], state)
    return spark.read.parquet(out).select("sequence", "message_sha256", micros("timestamp").alias("timestamp_us"))


@query
def stream_syslog(spark, sf_dir):
    """From landed text files to numbered messages: rows without an id, one instant per batch."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    folder = _landed(spark, fx.syslog_lines(spark, sf_dir, "rfc5424"), as_text=True)
    frames = scan_syslog(
        spark, folder, streaming=True, identifier="gate", format="rfc5424", options=throttle(max_files=1)
    )
    writer = run.stream_messages(frames, state, [run.table_sink(out)], **_DECODING)
    run.run_to_end(writer, new_folder(spark, "checkpoint"))
    return spark.read.parquet(out).select("sequence", "message_sha256", "collector_identifier")


@query
def stream_segments(spark, sf_dir):
    """Messages cut into segments over several micro-batches and archived as those close."""
    state, store, archived = (new_folder(spark, n) for n in ("state", "segments", "archive"))
    sink = run.segment_sink(store, state, 1000, "12 hours", archive_store=archived, archive_codec="gz")
    _streamed(spark, sf_dir, [sink], state)
    files = lambda path: scan_archive(spark, path).select("segment_name", "sequence", "message_sha256")
    # What is open keeps its current name: the token in place of the time.
    key = F.regexp_extract("segment_name", "-([0-9a-f]{20})\\.json-stream$", 1)
    rows = files(archived).unionByName(files(store))
    return rows.select(key.alias("segment_key"), "sequence", "message_sha256")


def _drop_each_eighth(df):
    return F.when(F.col("sequence") % 8 == 0, F.lit("null"))


@query
def stream_totals(spark, sf_dir):
    """Processed, dropped and rejected messages of a stream."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    _streamed(
        spark, sf_dir, [run.table_sink(out)], state, transformer=_drop_each_eighth, replacing=True, **_DECODING
    )
    totals = run.stream_totals(spark, state)
    return totals.crossJoin(F.broadcast(spark.read.parquet(out).agg(F.count("*").alias("kept"))))


@query
def stream_reports(spark, sf_dir):
    """The reports of 700 messages that several uneven batches close, with what a transformer drops."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    _streamed(
        spark, sf_dir, [], state, transformer=_drop_each_eighth, replacing=True, max_files=3,
        report=run.table_sink(out), report_every=700, **_DECODING
    )
    return spark.read.parquet(out).drop("batch")


@query
def stream_rejects(spark, sf_dir):
    """The frames a stream refuses, kept aside with their reasons."""
    state, aside = new_folder(spark, "state"), new_folder(spark, "rejects")
    _streamed(spark, sf_dir, [], state, quarantine=run.table_sink(aside), **_DECODING)
    return spark.read.parquet(aside).select(
        "record_id", "reject_reason", F.sha2("message_raw", 256).alias("message_sha256")
    )


@query
def stream_throttle(spark, sf_dir):
    """One landed file per micro-batch: the batch of each message."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    _streamed(spark, sf_dir, [run.table_sink(out)], state, max_files=1)
    rows = spark.read.parquet(out)
    return rows.agg(F.count_distinct("batch").alias("batches"), F.count("*").alias("messages"))


@query
def stream_merged(spark, sf_dir):
    """Syslog records and HTTP requests in one numbered stream, decoded in the batches."""
    state, out = new_folder(spark, "state"), new_folder(spark, "out")
    folder = new_folder(spark, "landed")
    collected = _collected(spark, sf_dir)
    collected.write.parquet(folder)
    stream = spark.readStream.schema(collected.schema).parquet(folder)
    run.run_to_end(run.stream_messages(stream, state, [run.table_sink(out)]), new_folder(spark, "checkpoint"))
    return spark.read.parquet(out).select("sequence", "collector_type", "message_sha256")
