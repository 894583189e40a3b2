from datetime import datetime

import pytest
from pyspark.sql import functions as F

from weirlog import schemas
from weirlog.operators import http, syslog


def frames(spark, rows):
    return spark.createDataFrame(rows, "id int, frame string, received_at timestamp").withColumn(
        "message_raw", F.col("frame").cast("binary")
    )


NOW = datetime(2024, 3, 5, 12)
GOOD = "<34>1 2024-03-01T10:00:00.123456Z host app 1 ID - text"


@pytest.mark.parametrize(
    "frame, reason",
    [
        (GOOD, None),
        ("", "empty"),
        ("hello", "unparseable"),
        (GOOD.replace("<34>", "<192>"), "unparseable"),
        (GOOD.replace("2024-03-01T", "2024-03-01 T"), "unparseable"),
        (GOOD.replace(" - text", " -x"), "unparseable"),
        (GOOD.replace(" text", ""), "text"),
        (GOOD.replace(" text", " -"), "text"),
        (GOOD.replace("2024-03-01T10:00:00.123456Z", "-"), "timestamp"),
        (GOOD.replace("2024-03-01", "2024-02-31"), "timestamp"),
        (GOOD.replace("host", "-"), "hostname"),
        (GOOD.replace("app", "-"), "service"),
        (GOOD.replace(" ID ", " - "), None),
    ],
)
def test_rfc5424_reasons(spark, frame, reason):
    df = frames(spark, [(1, frame, NOW)])
    rejects = syslog.syslog_rejects(df, "rfc5424", keep=("id",)).collect()
    assert [r.reject_reason for r in rejects] == ([reason] if reason else [])
    assert syslog.syslog_records(df, "rfc5424").count() == (0 if reason else 1)


def test_rfc5424_structured_data(spark):
    sd = '[a@1 k="v w" q="x\\"]y"][b]'
    df = frames(spark, [(1, f"<165>1 2024-03-01T10:00:00+02:00 h a - - {sd} {{\"k\": 1}} ", NOW)])
    row = syslog.syslog_records(df, "rfc5424", identifier="me").first()
    meta = row.message_metadata.syslog
    assert row.collector_identifier == "me" and row.message_json == '{"k": 1}' and row.message_text is None
    assert meta.fields == {
        "facility": "20", "priority": "165", "severity": "5", "version": "1", "structured_data": sd,
    }
    assert (meta.level, meta.level_unix, meta.type) == ("notice", 6, None)
    assert meta.timestamp_unix == 1709280000000
    assert syslog.syslog_records(df, "rfc5424", parse_json=False).first().message_text == '{"k": 1} '


@pytest.mark.parametrize(
    "stamp, received, expected",
    [
        ("Mar  5 01:02:03", NOW, datetime(2024, 3, 5, 1, 2, 3)),
        ("Mar 05 01:02:03", NOW, datetime(2024, 3, 5, 1, 2, 3)),
        ("Mar  6 11:00:00", NOW, datetime(2024, 3, 6, 11)),
        ("Mar  7 13:00:00", NOW, datetime(2023, 3, 7, 13)),
        ("Dec 31 23:59:59", datetime(2024, 1, 1), datetime(2023, 12, 31, 23, 59, 59)),
        ("Feb 29 00:00:00", datetime(2025, 1, 1), datetime(2024, 2, 29)),
    ],
)
def test_rfc3164_year(spark, stamp, received, expected):
    df = frames(spark, [(1, f"<13>{stamp} host app[12]: hello: x", received)])
    row = syslog.decode_syslog(df, "rfc3164").first().parts
    assert row.timestamp == expected
    assert (row.hostname, row.tag, row.content) == ("host", "app", "hello: x")


def test_rfc3164_rejects(spark):
    rows = [(1, "<13>Foo  5 01:02:03 h a: x", NOW), (2, "<13>Mar 5 01:02:03 h a: x", NOW), (3, "x", NOW)]
    got = syslog.syslog_rejects(frames(spark, rows), keep=("id",)).collect()
    assert {r.id: r.reject_reason for r in got} == {1: "unparseable", 2: "unparseable", 3: "unparseable"}


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError):
        syslog.decode_syslog(frames(spark, []), "rfc1234")


def test_map_operators_agree_with_records(spark):
    """The operators on a map of parts give what the typed records hold."""
    df = frames(spark, [(i, GOOD.replace("<34>", f"<{i}>").replace(" ID ", " - " if i % 2 else " ID "), NOW) for i in range(40)])
    parts = syslog.decode_syslog(df, "rfc5424")
    names = [f.name for f in syslog.PARTS]
    as_map = F.create_map(*[x for n in names for x in (F.lit(n), F.col("parts")[n].cast("string"))])
    parts = parts.select("id", syslog.drop_nil_parts(as_map).alias("m"))
    service = syslog.take_part(F.col("m"), syslog.SERVICE_PARTS)
    got = parts.select("id", service.value.alias("service"), syslog.residual_fields(F.col("m")).alias("fields"))
    records = syslog.syslog_records(df, "rfc5424", keep=("id",))
    expected = records.select("id", "message_metadata.syslog.service", "message_metadata.syslog.fields")
    key = lambda r: r.id
    assert sorted(got.collect(), key=key) == sorted(expected.collect(), key=key)


def test_severity_table(spark):
    df = spark.createDataFrame([(s,) for s in (-1, *range(9), None)], "s int")
    level, code = syslog.severity_to_level(F.col("s"))
    rows = df.select(level, code).collect()
    assert [tuple(r) for r in rows] == [
        ("<undefined>", -1),
        *[(name, i + 1) for i, name in enumerate(syslog.LEVELS)],
        ("<undefined>", -1),
        ("emergency", 1),
    ]


def request(**change):
    row = {
        "record_id": 1, "request_uri": "/p", "method": "POST", "proto": "HTTP/1.1", "host": "H", "remote_addr": "r",
        "headers": {"Content-Type": ["application/json"]}, "trailers": None, "transfer_encoding": None,
        "content_length": 0, "body": b'{"a": 1}', "received_at": NOW,
    }
    return {**row, **change}


def typed(kind, *more):
    return {"Content-Type": [kind], **dict(more)}


HTTP_CASES = [
    ({}, "parsed", None, '{"a": 1}'),
    ({"transfer_encoding": ["chunked"]}, "transfer-encoding", None, None),
    ({"transfer_encoding": []}, "parsed", None, '{"a": 1}'),
    ({"headers": typed("text/plain", ("Content-Encoding", ["gzip"]))}, "content-encoding", None, None),
    ({"headers": typed("text/plain", ("Content-Encoding", ["GZIP"]))}, "content-encoding-unknown", None, None),
    ({"headers": typed("text/plain", ("content-encoding", ["identity"]))}, "parsed", '{"a": 1}', None),
    ({"headers": typed("a/b; c")}, "content-type-invalid", None, None),
    ({"headers": {}}, "content-type-missing", None, None),
    ({"headers": typed("text/html")}, "content-type-unsupported", None, None),
    ({"headers": typed("text/plain"), "body": b"\xffA"}, "utf8", None, None),
    ({"headers": typed("text/plain; charset=latin-1"), "body": b" a "}, "parsed", " a ", None),
    ({"headers": typed("text/plain"), "body": b""}, "parsed", None, None),
    ({"body": b" \n"}, "empty", None, None),
    ({"body": b" {x "}, "json", "{x", None),
    ({"body": b" null "}, "parsed", None, "null"),
    ({"headers": typed("application/xml"), "body": b"<r><a>1</a></r>"}, "parsed", None, '{"r":{"a":1}}'),
    ({"headers": typed("application/xml"), "body": b"<r"}, "xml", "<r", None),
]


def test_http_gates(spark):
    rows = [request(record_id=i, **change) for i, (change, *_) in enumerate(HTTP_CASES)]
    df = spark.createDataFrame(rows, schemas.HTTP_REQUEST)
    got = http.http_records(df, keep=("record_id", "outcome")).orderBy("record_id").collect()
    for row, (_, *expected), sent in zip(got, HTTP_CASES, rows):
        assert [row.outcome, row.message_text, row.message_json] == expected
        assert row.message_raw == (sent["body"] or None)
        assert row.message_metadata.syslog is None and row.message_metadata.http.content_length is None


def test_http_parsing_can_be_turned_off(spark):
    df = spark.createDataFrame(
        [request(), request(record_id=2, headers=typed("application/xml"), body=b" <r/> ")], schemas.HTTP_REQUEST
    )
    rows = http.http_records(df, parse_json=False, parse_xml=False, keep=("record_id",)).orderBy("record_id").collect()
    assert [(r.message_text, r.message_json) for r in rows] == [('{"a": 1}', None), ("<r/>", None)]


def test_heartbeats(spark):
    targets = ["/__/heartbeat", "/__/heartbeat?x=1", "/p", None]
    df = spark.createDataFrame([(t,) for t in targets], "request_uri string")
    assert [r[0] for r in http.drop_heartbeats(df).collect()] == targets[1:]


def test_separators_inside_frames(spark):
    rows = [
        ("a\x1fb\x1fc",),
        ("\x1f13\x1fMar\x1f 5\x1f01\x1f02\x1f03\x1fhost\x1fapp\x1fnot syslog",),
        ("<13>Mar  5 01:02:03 ho\x1fst app: x",),
        ("<13>Mar  5 01:02:03 host app: x\x1fy",),
    ]
    df = spark.createDataFrame(rows, "line string").select(
        F.col("line").cast("binary").alias("message_raw"), F.lit("2024-03-05 10:00:00").cast("timestamp").alias("received_at")
    )
    parts = [r.parts for r in syslog.decode_syslog(df, "rfc3164").collect()]
    assert parts[:3] == [None, None, None]
    assert (parts[3].hostname, parts[3].tag, parts[3].content) == ("host", "app", "x\x1fy")


def test_lines_end_with_a_line_feed(spark, folder):
    import os

    from weirlog.sources.frames import scan_syslog

    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.log", "wb") as f:
        f.write(b"one\rstill one\r\ntwo\nthree\r\r\n")
    rows = scan_syslog(spark, f"{folder}/in").collect()
    assert [bytes(r.message_raw) for r in rows] == [b"one\rstill one", b"two", b"three\r"]


def test_requests_without_a_receive_time(spark, folder):
    from weirlog import schemas
    from weirlog.sources.frames import scan_http

    row = {name: None for name in schemas.HTTP_REQUEST.names}
    spark.createDataFrame([row, row], schemas.HTTP_REQUEST).write.parquet(f"{folder}/in")
    scan = scan_http(spark, f"{folder}/in")
    instants = {r.received_at for r in scan.collect()} | {r.received_at for r in scan.collect()}
    assert len(instants) == 1 and None not in instants
