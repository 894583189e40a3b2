"""Collector input derived from the benchmark tables.

Each formula gives the same rows in Spark and in DuckDB. Where the dialects
differ, ``{str}`` and the timestamp renderings are filled in per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirlog import schemas

PRIORITY = "8 * (event_id % 24) + event_id % 8"

LINE_5424 = """
'<' || cast({priority} as {{str}}) || '>1 ' || {{ts}} || ' '
 || case when event_id % 23 = 0 then '-' else 'node' || cast(user_id % 7 as {{str}}) end
 || ' ' || event_type || ' ' || cast(user_id as {{str}}) || ' '
 || case when event_id % 3 = 0 then '-' else 'ID' || cast(event_id % 5 as {{str}}) end
 || ' - '
 || case when event_id % 4 = 0 then 'value is ' || cast(cast(round(value * 100) as bigint) as {{str}})
         else props end
""".format(priority=PRIORITY)

LINE_3164 = """
'<' || cast({priority} as {{str}}) || '>' || {{ts}}
 || ' node' || cast(user_id % 7 as {{str}}) || ' ' || event_type
 || '[' || cast(user_id as {{str}}) || ']: ' || props
""".format(priority=PRIORITY)

# Frames with every part well formed, nil, odd or broken, by different moduli of the id.
LINE_ODD = """
case when event_id % 17 = 0 then '' else
 '<' || case event_id % 11 when 0 then '192' when 1 then '007' else cast({priority} as {{str}}) end || '>'
 || case event_id % 13 when 0 then '0' when 1 then '' else '1' end || ' '
 || case event_id % 7 when 0 then '-' when 1 then '2024-13-01T00:00:00Z' else {{ts}} end
 || case event_id % 5 when 0 then ' -' else ' node' end || case event_id % 6 when 0 then ' -' else ' app' end
 || ' 7 - ' || case event_id % 8 when 0 then '-' when 1 then '[a@1 k="v"]' when 2 then '[a@1 k="x \\\\] y" l=""][b]'
    when 3 then '[broken' when 4 then '[a@1 k=v]' else '-' end
 || case event_id % 3 when 0 then '' when 1 then ' text ' || cast(event_id as {{str}}) else ' -' end
end
""".format(priority=PRIORITY)

PARTS = {
    "hostname": "case when event_id % 23 = 0 then '-' else 'node' || cast(user_id % 7 as {str}) end",
    "app_name": "case when event_id % 2 = 0 then event_type end",
    "tag": "case when event_id % 2 = 1 then event_type end",
    "msg_id": "case when event_id % 3 = 0 then '-' else 'ID' || cast(event_id % 5 as {str}) end",
    "severity": "case when event_id % 17 = 0 then null else event_id % 9 end",
    "message": """case event_id % 6 when 0 then props when 1 then '  ' || props || ' '
        when 2 then '{{broken' || props || '}}' when 3 then 'value ' || cast(user_id as {str})
        when 4 then '-' else '[' || props || ']' end""",
}

REQUEST = {
    "request_uri": """case page_id % 13 when 5 then '/__/heartbeat' when 6 then '/__/heartbeat?x=1'
        else url || case when page_id % 4 = 0 then
        (case when url like '%?%' then '&' else '?' end) || 'x=1&y=2&x=3&z&w=a%20b+c&e=a=b' else '' end end""",
    "method": "case page_id % 3 when 0 then 'POST' when 1 then 'Put' else 'get' end",
    "content_type": """case page_id % 8 when 0 then 'text/plain' when 1 then 'Application/JSON; Charset="utf-8"'
        when 2 then 'application/xml' when 3 then 'text/html' when 4 then null
        when 5 then 'application/json' when 6 then 'application/json'
        else 'text/plain; charset=utf-8' end""",
    "content_encoding": """case page_id % 11 when 0 then 'gzip' when 1 then 'identity'
        when 2 then 'zip9' else '' end""",
    "transfer": "case page_id % 9 when 4 then 'chunked' when 5 then '' end",
    "body_text": """case page_id % 8 when 1 then ' {{"page": ' || cast(page_id as {str}) || '}} '
        when 5 then '{{"page": ' when 6 then '   '
        when 2 then '<r><page>' || cast(page_id as {str}) || '</page></r>'
        when 7 then '' else html end""",
    "broken_text": "page_id % 32 = 24",
}

XML_DOCUMENT = """
'<doc id="' || cast(doc_id as {str}) || '"><lang>' || lang || '</lang><size>' || cast(n_chars as {str})
 || '</size><mark>' || source || '</mark><mark>x</mark></doc>'
"""

SPARK = {"str": "string"}


def named(formulas: dict[str, str], dialect: dict[str, str]) -> list[str]:
    """Select-list items of the formulas in one dialect."""
    return [f"{formula.format(**dialect)} as {name}" for name, formula in formulas.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def syslog_lines(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    """``record_id``, ``line``, ``received_at`` from the events table."""
    if format in ("rfc5424", "odd"):
        formula = LINE_5424 if format == "rfc5424" else LINE_ODD
        line = formula.format(ts="""date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")""", **SPARK)
    else:
        line = LINE_3164.format(ts="date_format(ts, 'MMM dd HH:mm:ss')", **SPARK)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("record_id"),
        F.expr(line).alias("line"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )


def syslog_frames(spark: SparkSession, sf_dir: str, format: str = "rfc5424") -> DataFrame:
    """Frames as :func:`scan_syslog` returns them, with a record id."""
    return syslog_lines(spark, sf_dir, format).select(
        "record_id",
        F.col("line").cast("binary").alias("message_raw"),
        "received_at",
        F.lit("gate").alias("collector_identifier"),
    )


def syslog_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``record_id``, ``ts`` and a map of parts."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "ts", *named(PARTS, SPARK))
    names = ("hostname", "app_name", "tag", "msg_id", "severity", "message")
    parts = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])
    return rows.select(F.col("event_id").alias("record_id"), "ts", "message", "severity", parts.alias("parts"))


def http_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed requests with the columns of ``HTTP_REQUEST``, from the pages table."""
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", *named(REQUEST, SPARK))
    header = lambda name, values, present: F.when(
        present, F.struct(F.lit(name).alias("name"), values.alias("values"))
    )
    empty = F.array().cast("array<string>")
    headers = F.array_compact(
        F.array(
            header("Content-Type", F.array("content_type"), F.col("content_type").isNotNull()),
            header("Content-Encoding", F.array("content_encoding"), F.col("content_encoding") != ""),
            header("X-Request-ID", F.array(F.col("page_id").cast("string")), F.lit(True)),
            header("X-Multi", F.array(F.lit("a"), F.lit("b")), F.col("page_id") % 2 == 0),
            header("X-Empty", empty, F.col("page_id") % 5 == 0),
        )
    )
    body = F.when(F.col("broken_text"), F.unhex(F.lit("FF41"))).otherwise(F.col("body_text").cast("binary"))
    made = {
        "record_id": F.col("page_id"),
        "proto": F.lit("HTTP/1.1"),
        "host": F.lit("Collector.Example"),
        "remote_addr": F.lit("192.0.2.1:50000"),
        "headers": F.map_from_entries(headers),
        "trailers": F.when(
            F.col("page_id") % 6 == 2,
            F.create_map(F.lit("X-Sum"), F.array(F.col("page_id").cast("string"), F.lit("x")), F.lit("X-None"), empty),
        ),
        "transfer_encoding": F.when(F.col("transfer") == "", empty).when(
            F.col("transfer").isNotNull(), F.array("transfer")
        ),
        "content_length": F.octet_length(body),
        "body": body,
        "received_at": F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, cast(page_id as int))"),
    }
    return rows.select(
        *[made.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in schemas.HTTP_REQUEST]
    )
