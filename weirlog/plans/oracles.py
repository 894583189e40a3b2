"""The registered queries again, as SQL for DuckDB over the same tables."""

from __future__ import annotations

from weirlog.plans import fixtures as fx
from weirlog.plans.catalog import CONTENT_TYPE, CUTS

DUCK = {"str": "varchar"}

ORACLES: dict[str, str] = {}


def _with(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


# -- shared tables ---------------------------------------------------------------------

_L5424 = "lines as (select event_id as record_id, ts, {} as line from events)".format(
    fx.LINE_5424.format(ts="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')", **DUCK)
)
_L3164 = "lines as (select event_id as record_id, ts, {} as line from events)".format(
    fx.LINE_3164.format(ts="strftime(ts, '%b %d %H:%M:%S')", **DUCK)
)
_D5424 = r"""decoded as (
  select record_id, ts, line, cast(g.pri as bigint) as priority, cast(g.pri as bigint) // 8 as facility,
    cast(g.pri as bigint) % 8 as severity, cast(g.ver as bigint) as version,
    epoch_us(cast(replace(g.at, 'Z', '') as timestamp)) as timestamp_us,
    g.hostname, g.app_name, g.proc_id, g.msg_id, g.structured_data, g.message
  from (select *, regexp_extract(line, '^<(\d+)>(\d+) (\S+) (\S+) (\S+) (\S+) (\S+) (-) (.*)$',
    ['pri', 'ver', 'at', 'hostname', 'app_name', 'proc_id', 'msg_id', 'structured_data', 'message']) as g
    from lines))"""
_D3164 = r"""decoded as (
  select record_id, ts, line, cast(g.pri as bigint) as priority, cast(g.pri as bigint) // 8 as facility,
    cast(g.pri as bigint) % 8 as severity,
    epoch_us(strptime(cast(year(ts) as varchar) || ' ' || g.at, '%Y %b %d %H:%M:%S')) as timestamp_us,
    g.hostname, g.tag, g.content
  from (select *, regexp_extract(line, '^<(\d+)>(\w+ \d+ \d+:\d+:\d+) (\S+) (\w+)\[\d+\]: (.*)$',
    ['pri', 'at', 'hostname', 'tag', 'content']) as g from lines))"""

_LEVEL = """case coalesce({0}, 0) when 0 then 'emergency' when 1 then 'alert' when 2 then 'critical'
 when 3 then 'error' when 4 then 'warning' when 5 then 'notice' when 6 then 'informative'
 when 7 then 'debug' else '<undefined>' end"""
_LEVEL_UNIX = "cast(case when coalesce({0}, 0) between 0 and 7 then coalesce({0}, 0) + 1 else -1 end as bigint)"

_IS_OBJECT = "(trim({0}) like '{{%' and trim({0}) like '%}}' and json_valid(trim({0})))"


def _nil(column: str) -> str:
    return f"nullif(nullif({column}, ''), '-')"


_S5424 = f"""syslog as (
  select record_id, 'syslog' as collector_type, 'gate' as collector_identifier, ts as received_at, line,
    encode(line) as raw, sha256(line) as message_sha256,
    case when not {_IS_OBJECT.format('message')} then message end as message_text,
    case when {_IS_OBJECT.format('message')} then trim(message) end as message_json,
    'syslog:20181020a' as schema, 'rfc5424' as protocol, timestamp_us // 1000 as timestamp_unix,
    hostname as node, app_name as service, {_nil('msg_id')} as type,
    {_LEVEL.format('severity')} as level, {_LEVEL_UNIX.format('severity')} as level_unix, facility,
    'facility=' || facility || ';priority=' || priority || ';proc_id=' || proc_id
      || ';severity=' || severity || ';version=' || version as fields
  from decoded
  where {_nil('message')} is not null and {_nil('hostname')} is not null and {_nil('app_name')} is not null)"""
_S3164 = f"""syslog as (
  select record_id, 'syslog' as collector_type, 'gate' as collector_identifier,
    sha256(line) as message_sha256,
    case when not {_IS_OBJECT.format('content')} then content end as message_text,
    case when {_IS_OBJECT.format('content')} then trim(content) end as message_json,
    'syslog:20181020a' as schema, 'rfc3164' as protocol, timestamp_us // 1000 as timestamp_unix,
    hostname as node, tag as service, cast(null as varchar) as type,
    {_LEVEL.format('severity')} as level, {_LEVEL_UNIX.format('severity')} as level_unix,
    'facility=' || facility || ';priority=' || priority || ';severity=' || severity as fields
  from decoded)"""
_SYSLOG_COLUMNS = """record_id, collector_type, collector_identifier, message_sha256, message_text, message_json,
 schema, protocol, timestamp_unix, node, service, type, level, level_unix, fields"""

_PARTS = "parts as (select event_id as record_id, ts, {} from events)".format(
    ", ".join(fx.named(fx.PARTS, DUCK))
)
_PAIRS = """pairs as (
  select record_id, 'hostname' as part, hostname as value from parts union all
  select record_id, 'app_name', app_name from parts union all
  select record_id, 'tag', tag from parts union all
  select record_id, 'msg_id', msg_id from parts union all
  select record_id, 'severity', cast(severity as varchar) from parts union all
  select record_id, 'message', message from parts)"""

_REQUESTS = "requests as (select page_id as record_id, {} from pages)".format(
    ", ".join(fx.named(fx.REQUEST, DUCK))
)
_BODIES = r"""bodies as (
  select *, case when broken_text then '\xFF\x41'::blob else encode(body_text) end as body,
    timestamp '2024-01-01' + to_minutes(record_id) as received_at,
    nullif(content_encoding, '') as encoding_header
  from requests)"""
_GATES = """gated as (
  select *,
    case when transfer = 'chunked' then 'transfer-encoding' end as transfer_reason,
    case when encoding_header in ('gzip', 'x-gzip', 'deflate', 'compress', 'x-compress', 'br') then 'content-encoding'
      when encoding_header is not null and encoding_header <> 'identity' then 'content-encoding-unknown' end
      as encoding_reason,
    case when encoding_header <> 'identity' then encoding_header end as kept_encoding,
    lower(trim(split_part(content_type, ';', 1))) as media_type,
    case when record_id % 8 = 1 or record_id % 8 = 7 then 'charset=utf-8' end as parameters
  from bodies)"""
_TYPED = """typed as (
  select *,
    case when media_type in ('text/plain', 'application/json', 'application/xml') and not broken_text
      then body_text end as text,
    case when coalesce(media_type, '') not in ('text/plain', 'application/json', 'application/xml')
      then 'content-type-unsupported' when broken_text then 'utf8' end as text_reason,
    media_type in ('application/json', 'application/xml') as structured
  from gated)"""
_HTTP = """http as (
  select *,
    case when outcome = 'parsed' and media_type = 'application/json' then trimmed
      when outcome = 'parsed' and media_type = 'application/xml'
        then '{"r":{"page":' || record_id || '}}' end as message_json,
    case when opened and outcome in ('parsed', 'json') and not (outcome = 'parsed' and structured)
      then nullif(trimmed, '') end as message_text
  from (select *,
      coalesce(stopped, text_reason, case when structured and trimmed = '' then 'empty' end,
        case when media_type = 'application/json' and not json_valid(trimmed) then 'json' end, 'parsed') as outcome,
      stopped is null and text_reason is null as opened
    from (select *, case when structured then trim(text) else text end as trimmed,
        coalesce(transfer_reason, encoding_reason,
          case when content_type is null then 'content-type-missing' end) as stopped
      from typed where request_uri <> '/__/heartbeat')))"""
_URL = """urls as (
  select *, split_part(request_uri, '?', 1) as before,
    case when request_uri like '%?%' then substr(request_uri, instr(request_uri, '?') + 1) end as query_text
  from requests)"""
_TARGET = r"""targets as (
  select *, regexp_extract(before, '^(?:[a-z]+:)?(?://[^/]*)?', 0) as origin,
    regexp_replace(before, '^(?:[a-z]+:)?(?://[^/]*)?', '') as path
  from urls)"""
_QUERY = """queries as (
  select record_id, string_agg(name || '=' || vals, ';' order by name) as query from (
    select record_id, name, string_agg(value, '|' order by place) as vals from (
      select record_id, place, url_decode(split_part(pair, '=', 1)) as name,
        url_decode(replace(case when pair like '%=%' then substr(pair, instr(pair, '=') + 1) else '' end, '+', ' '))
          as value
      from (select record_id, unnest(string_split(query_text, '&')) as pair,
          generate_subscripts(string_split(query_text, '&'), 1) as place from urls where query_text <> ''))
    group by record_id, name)
  group by record_id)"""
_URL_COLUMNS = """origin || replace(path, '#', '%23') || coalesce('?' || query_text, '') as url,
 request_uri as url_raw, path, query_text as query_raw, query"""
_HEADERS = """concat_ws(';', case when encoding_header is not null then 'content-encoding=' || encoding_header end,
 'content-type=' || content_type, case when record_id % 5 = 0 then 'x-empty=' end,
 case when record_id % 2 = 0 then 'x-multi=a|b' end, 'x-request-id=' || record_id)"""

_HTTP_CHAIN = (_REQUESTS, _BODIES, _GATES, _TYPED, _HTTP)
_MERGED = """merged as (
  select collector_type, record_id, received_at, raw, message_sha256, message_text, message_json,
    collector_identifier, service, facility, cast(null as varchar) as method, fields, cast(null as varchar) as headers
  from syslog union all
  select 'http', record_id, received_at, case when octet_length(body) > 0 then body end, sha256(body), message_text,
    message_json, 'gate', null, null, lower(method), null, {headers} from http)""".format(headers=_HEADERS)
_ALL = (_L5424, _D5424, _S5424, *_HTTP_CHAIN, _MERGED)
_NUMBERED = """numbered as (
  select *, row_number() over (order by received_at, collector_type, record_id) as sequence from merged)"""

# -- syslog ----------------------------------------------------------------------------

ORACLES["scan_syslog"] = (
    _with(_L5424) + "select line, 'gate' as collector_identifier, sha256(line) as message_sha256 from lines"
)
ORACLES["syslog_digest"] = _with(_L5424) + "select record_id, sha256(line) as message_sha256 from lines"
ORACLES["syslog_decode_5424"] = (
    _with(_L5424, _D5424)
    + """select record_id, priority, facility, severity, version, timestamp_us, hostname, app_name, proc_id,
 msg_id, structured_data, message from decoded"""
)
ORACLES["syslog_decode_3164"] = (
    _with(_L3164, _D3164)
    + "select record_id, priority, facility, severity, timestamp_us, hostname, tag, content from decoded"
)
ORACLES["syslog_nil_parts"] = (
    _with(_PARTS, _PAIRS) + "select * from pairs where value is not null and value not in ('', '-')"
)
ORACLES["syslog_take_part"] = (
    _with(_PARTS)
    + """select record_id, coalesce(app_name, tag) as service, cast(severity as bigint) as severity,
 case when severity is null then 'missing' end as severity_error, nullif(msg_id, '-') as kind,
 cast(null as varchar) as kind_error, case when message = '-' then 'missing' else 'invalid' end as number_error,
 concat_ws(',', case when hostname <> '-' then 'hostname' end, case when severity is not null then 'severity' end)
 as left_over from parts"""
)
ORACLES["syslog_promote_json"] = (
    _with(_PARTS)
    + f"""select record_id, case when not {_IS_OBJECT.format('message')} then message end as message_text,
 case when {_IS_OBJECT.format('message')} then trim(message) end as message_json from parts"""
)
ORACLES["syslog_levels"] = (
    _with(_PARTS)
    + f"select record_id, {_LEVEL.format('severity')} as level, {_LEVEL_UNIX.format('severity')} as level_unix from parts"
)
ORACLES["syslog_residual"] = (
    _with(_PARTS, _PAIRS)
    + "select * from pairs where part = 'severity' and value is not null"
)
ORACLES["syslog_records"] = _with(_L5424, _D5424, _S5424) + f"select {_SYSLOG_COLUMNS} from syslog"
ORACLES["syslog_records_3164"] = _with(_L3164, _D3164, _S3164) + f"select {_SYSLOG_COLUMNS} from syslog"
ORACLES["syslog_rejects"] = (
    _with(_L5424, _D5424)
    + f"""select * from (select case when {_nil('message')} is null then 'text'
 when {_nil('hostname')} is null then 'hostname' when {_nil('app_name')} is null then 'service' end as reject_reason,
 count(*) as frames from decoded group by 1) where reject_reason is not null"""
)
_ODD = "lines as (select event_id as record_id, ts, {} as line from events)".format(
    fx.LINE_ODD.format(ts="strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')", **DUCK).replace("\\\\", "\\")
)
_ODD_PARTS = r"""parts as (
  select record_id, line, g.*, try_cast(replace(g.at, 'Z', '') as timestamp) as instant,
    coalesce(try_cast(g.pri as bigint) <= 191, false) as good
  from (select *, regexp_extract(line,
    '^<(0|[1-9]\d{0,2})>([1-9]\d{0,2}) (-|\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z) (\S+) (\S+) (\S+) (\S+) (-|(?:\[[^\s="\]]+(?: +[^\s="\]]+="(?:[^"\\]|\\.)*")* ?\])+)(?: (.*))?$',
    ['pri', 'ver', 'at', 'hostname', 'app_name', 'proc_id', 'msg_id', 'structured_data', 'message']) as g from lines))"""
ORACLES["syslog_reject_reasons"] = (
    _with(_ODD, _ODD_PARTS)
    + f"""select * from (select record_id, case when line = '' then 'empty' when not good then 'unparseable'
 when {_nil('message')} is null then 'text' when instant is null then 'timestamp'
 when {_nil('hostname')} is null then 'hostname' when {_nil('app_name')} is null then 'service' end as reject_reason
 from parts) where reject_reason is not null"""
)
ORACLES["syslog_structured"] = (
    _with(_ODD, _ODD_PARTS)
    + """select record_id, cast(pri as bigint) as priority, epoch_us(instant) as timestamp_us, structured_data,
 message from parts where good"""
)
ORACLES["service_levels"] = (
    _with(_L5424, _D5424, _S5424)
    + """select service, level, count(*) as records, count(message_json) as json_records,
 min(epoch_us(received_at) // 1000) as first_ms, max(epoch_us(received_at) // 1000) as last_ms
 from syslog group by service, level"""
)

# -- http ------------------------------------------------------------------------------

ORACLES["scan_http"] = (
    _with(_REQUESTS, _BODIES)
    + """select record_id, request_uri, method, 'gate' as collector_identifier, sha256(body) as body_sha256,
 cast(1 + (case when content_type is not null then 1 else 0 end)
   + (case when encoding_header is not null then 1 else 0 end) + (case when record_id % 2 = 0 then 1 else 0 end)
   + (case when record_id % 5 = 0 then 1 else 0 end) as bigint) as header_count,
 epoch_us(received_at) as received_us from bodies"""
)
ORACLES["http_heartbeat"] = (
    _with(_REQUESTS) + "select record_id, request_uri from requests where request_uri <> '/__/heartbeat'"
)
ORACLES["http_body_digest"] = (
    _with(_REQUESTS, _BODIES)
    + "select record_id, sha256(body) as message_sha256, nullif(octet_length(body), 0) as raw_bytes from bodies"
)
ORACLES["http_transfer_gate"] = (
    _with(_REQUESTS, _BODIES, _GATES) + "select record_id, transfer_reason as reason from gated"
)
ORACLES["http_encoding_gate"] = (
    _with(_REQUESTS, _BODIES, _GATES)
    + "select record_id, kept_encoding as content_encoding, encoding_reason as reason from gated"
)
ORACLES["http_content_type"] = (
    _with("headers as (select page_id as record_id, {} as header from pages)".format(CONTENT_TYPE.format(**DUCK).replace("\\\\", "\\")))
    + """select record_id,
 case record_id % 7 when 3 then case when record_id = record_id % 2 then 'a/b' end when 4 then 'text/html'
   when 5 then 'text' when 0 then 'application/json' end as media_type,
 case record_id % 7 when 3 then case when record_id = record_id % 2 then 'x=' || record_id end
   when 4 then 'q=a;b' || record_id || ';z=2' when 5 then 'k=say "' || record_id || '"'
   when 0 then 'charset=utf-8;v=' || record_id end as parameters,
 case when header = '' then 'content-type-missing' when record_id % 7 in (1, 2) then 'content-type-invalid'
   when record_id % 7 = 3 and record_id <> record_id % 2 then 'content-type-invalid' end as reason
 from headers"""
)
ORACLES["http_text"] = (
    _with(_REQUESTS, _BODIES, _GATES, _TYPED)
    + "select record_id, sha256(text) as text_sha256, text_reason as reason from typed"
)
ORACLES["http_trim"] = (
    _with(_REQUESTS, _BODIES, _GATES, _TYPED)
    + """select record_id, sha256(case when structured then trim(text) else text end) as text_sha256,
 case when structured and trim(text) = '' then 'empty' end as reason from typed"""
)
ORACLES["http_json"] = (
    _with(_REQUESTS, _BODIES, _GATES, _TYPED)
    + """select record_id, cast(json_valid(trim(text)) as bigint) as is_json from typed
 where media_type = 'application/json'"""
)
ORACLES["http_xml"] = """select doc_id, '{"doc":{"-id":' || doc_id || ',"lang":"' || lang || '","mark":["' || source
 || '","x"],"size":' || n_chars || '}}' as json from documents"""
ORACLES["http_url"] = (
    _with(_REQUESTS, _URL, _TARGET, _QUERY)
    + f"select record_id, {_URL_COLUMNS} from targets left join queries using (record_id)"
)
ORACLES["http_fold_case"] = (
    _with(_REQUESTS)
    + """select record_id, 'http/1.1' as proto, 'collector.example' as host, lower(method) as method from requests"""
)
ORACLES["http_headers"] = (
    _with(_REQUESTS, _BODIES)
    + f"""select record_id, {_HEADERS} as headers,
 case when record_id % 6 = 2 then 'x-none=;x-sum=' || record_id || '|x' end as trailers,
 nullif(transfer, '') as transfer_encoding from bodies"""
)
ORACLES["http_records"] = (
    _with(*_HTTP_CHAIN, _URL, _TARGET, _QUERY)
    + f"""select http.record_id, outcome, 'http' as collector_type, 'gate' as collector_identifier,
 sha256(body) as message_sha256, nullif(octet_length(body), 0) as raw_bytes, sha256(message_text) as text_sha256,
 message_json, 'http:20181020a' as schema, 'http/1.1' as protocol, t.url, t.url_raw, 'collector.example' as host,
 lower(method) as method, t.path, t.query_raw, '192.0.2.1:50000' as remote, t.query,
 {_HEADERS.replace('record_id', 'http.record_id')} as headers, media_type as content_type, parameters,
 kept_encoding as content_encoding, nullif(octet_length(body), 0) as content_length,
 nullif(transfer, '') as transfer_encoding
 from http join (select record_id, {_URL_COLUMNS} from targets left join queries using (record_id)) t
 on t.record_id = http.record_id"""
)
ORACLES["http_outcomes"] = (
    _with(*_HTTP_CHAIN) + "select outcome, count(*) as requests from http group by outcome"
)

# -- envelope and transformer ------------------------------------------------------------

ORACLES["merge_collectors"] = (
    _with(*_ALL)
    + """select collector_type, record_id, epoch_us(received_at) as received_us, message_sha256,
 sha256(message_text) as text_sha256, message_json from merged"""
)
ORACLES["envelope"] = (
    _with(*_ALL)
    + """select record_id, '20181020b' as schema, cast(null as varchar) as subschema, collector_type,
 collector_identifier, epoch_us(received_at) as timestamp_us, epoch_us(received_at) // 1000 as timestamp_unix,
 message_sha256 from merged"""
)
ORACLES["sequence"] = (
    _with(*_ALL, _NUMBERED) + "select collector_type, record_id, sequence from numbered"
)
ORACLES["prune_raw"] = (
    _with(*_ALL)
    + """select collector_type, record_id,
 case when message_text is null and message_json is null then octet_length(raw) end as raw_bytes, message_sha256
 from merged"""
)
ORACLES["prune_digest"] = (
    _with(*_ALL)
    + """select collector_type, record_id, octet_length(raw) as raw_bytes, cast(null as varchar) as message_sha256
 from merged"""
)
_EXTRA = """case when record_id % 7 <> 0 and record_id % 11 <> 0 then '{"n":' || record_id || '}' end"""
ORACLES["enrich"] = (
    _with(*_ALL)
    + f"""select collector_type, record_id, {_EXTRA} as message_extra from merged
 where record_id % 7 <> 0 and record_id % 11 <> 0"""
)
ORACLES["enrich_fail_open"] = (
    _with(*_ALL)
    + f"""select collector_type, record_id, message_sha256, message_json, {_EXTRA} as message_extra,
 case when record_id % 7 = 0 then 'failed' when record_id % 11 = 0 then 'invalid-json' end as transform_error
 from merged"""
)
ORACLES["enrich_python"] = (
    _with(*_ALL, "levels as (select record_id, level from syslog)")
    + """select collector_type, merged.record_id,
 case when collector_type = 'http' then '{"level":null,"size":64}' when service <> 'error'
   then '{"level":"' || level || '","size":64}' end as message_extra,
 case when service = 'error' then 'failed' end as transform_error
 from merged left join levels on levels.record_id = merged.record_id and collector_type = 'syslog'"""
)
_REPLACED = "record_id % 8 in (6, 7)"
ORACLES["replace"] = (
    _with(*_ALL)
    + f"""select record_id, case when {_REPLACED} then 'mine' else '20181020b' end as schema,
 case when {_REPLACED} then record_id end as sequence,
 case when not {_REPLACED} then epoch_us(received_at) // 1000 end as timestamp_unix,
 case when not {_REPLACED} then collector_type end as collector_type,
 case when not {_REPLACED} then message_sha256 end as message_sha256,
 sha256(case when {_REPLACED} then 't' || record_id else message_text end) as text_sha256,
 case when {_REPLACED} then '{{"k":[' || record_id || ']}}' else message_json end as message_json,
 case when {_REPLACED} then '{{"who":"' || collector_type || '"}}' end as other_metadata,
 case when not {_REPLACED} then service end as service,
 case record_id % 8 when 1 then 'failed' when 2 then 'unknown-field' when 3 then 'wrong-type'
   when 4 then 'not-an-object' when 5 then 'invalid-json' end as transform_error
 from merged where record_id % 8 <> 0"""
)
ORACLES["replace_drops"] = (
    _with(*_ALL)
    + "select count(*) as processed, count(*) filter (record_id % 8 = 0) as dropped from merged"
)

# -- reports -----------------------------------------------------------------------------

ORACLES["totals"] = ORACLES["replace_drops"]
ORACLES["throughput_by_count"] = (
    _with(*_ALL, _NUMBERED)
    + """, reports as (
  select (sequence - 1) // 1000 as report, count(*) as messages, epoch_us(max(received_at)) as last_us,
    epoch_us(min(received_at)) as first_us, count(*) filter (record_id % 8 = 0) as dropped
  from numbered group by 1)
select report, messages, seconds, messages / (seconds + 1e-10) as rate, processed, dropped_sum as dropped from (
  select *, (last_us - coalesce(lag(last_us) over (order by report), first_us)) / 1e6 as seconds,
    cast(sum(messages) over (order by report) as bigint) as processed,
    cast(sum(dropped) over (order by report) as bigint) as dropped_sum from reports)"""
).replace(")\n, reports", "),\nreports")
ORACLES["throughput_by_time"] = (
    _with(*_ALL)
    + """select epoch_us(received_at) // 60000000 * 60000000 as start_us, count(*) as messages,
 count(*) filter (record_id % 8 = 0) as dropped, count(*) / (60.0::double + 1e-10) as rate from merged group by 1"""
)

# -- segments ----------------------------------------------------------------------------

_DAY = "cast(cast(ts as date) as varchar)"
_ROWS = """rows_ as (select event_id as record_id, ts, {series} as series, {token} as token, {cuts} as cuts from {table})"""
_PLACED = """placed as (
  select *, row_number() over (partition by series, token, cuts order by ts, record_id) as rn,
    row_number() over (partition by series, token, cuts order by ts, record_id)
      - rank() over (partition by series, token, cuts order by ts) as same from rows_)"""
_NEXT = """nexts as (
  select *, least(rn + {messages}, rn - same + count(*) over (partition by series, token, cuts order by ts
    range between current row and interval '{micros} microseconds' following)) as nxt from placed)"""
_STARTS = """starts as (
  select distinct series, token, cuts, 1::bigint as s from rows_
  union all
  select n.series, n.token, n.cuts, n.nxt from starts join nexts n on n.series = starts.series
    and n.token = starts.token and n.cuts = starts.cuts and n.rn = starts.s
  where exists (select 1 from placed p where p.series = n.series and p.token = n.token and p.cuts = n.cuts
    and p.rn = n.nxt))"""
_CUT = """segmented as (
  select p.*, dense_rank() over (partition by p.series, p.token order by p.cuts, o.s) - 1 as segment
  from placed p asof join starts o
    on o.series = p.series and o.token = p.token and o.cuts = p.cuts and p.rn >= o.s)"""
_CUT_COUNT = " + ".join(f"(case when ts >= timestamp '{c}' then 1 else 0 end)" for c in CUTS)


def _segmented(
    messages: int, seconds: int, series: str = "''", cuts: str = "0", token: str = _DAY, table: str = "events"
) -> str:
    return _with(
        _ROWS.format(series=series, cuts=cuts, token=token, table=table),
        _PLACED,
        _NEXT.format(messages=messages, micros=seconds * 1_000_000 - 1),
        _STARTS,
        _CUT,
    )


ORACLES["segment_token"] = "select event_id as record_id, strftime(ts, '%Y-%m-%d %H') as token from events"
ORACLES["segment_by_count"] = """select event_id as record_id, cast(cast(ts as date) as varchar) as token,
 (row_number() over (partition by cast(ts as date) order by ts, event_id) - 1) // 100 as segment from events"""
_SEGMENT = "select record_id, token, segment from segmented"
ORACLES["segment"] = _segmented(16384, 3600) + _SEGMENT
ORACLES["segment_small"] = _segmented(10, 3600) + _SEGMENT
ORACLES["segment_series"] = (
    _segmented(5, 7200, "event_type") + "select record_id, series as event_type, token, segment from segmented"
)
ORACLES["segment_flush"] = _segmented(10, 3600, cuts=_CUT_COUNT) + _SEGMENT
ORACLES["segment_hot_token"] = _segmented(1000, 3600, token="strftime(ts, '%Y')") + _SEGMENT
# A day's hours are strips of their own, so the hours before are the stretch's number.
ORACLES["segment_hourly"] = (
    _segmented(10, 2400, cuts="epoch_us(ts) // 3600000000", token="strftime(ts, '%H')") + _SEGMENT
)
ORACLES["segment_manifest"] = (
    _segmented(10, 3600, cuts=_CUT_COUNT)
    + """, grouped as (
  select token, segment, min(ts) as started, max(ts) as last, count(*) as n, min(cuts) as cuts
  from segmented group by token, segment),
chained as (select *, lead(started) over w as next_at, lead(token) over w as next_token, lead(cuts) over w as next_cuts
  from grouped window w as (order by token, segment)),
keyed as (select *, substr(sha256('/' || token || '/' || segment), 1, 20) as unique_part from chained)
select token, segment, epoch_us(started) as started_us, epoch_us(last) as last_us, n as count,
 case when next_at is null then null when next_cuts > cuts then 'flush' when n >= 10 then 'messages'
   when epoch_us(next_at) - epoch_us(started) >= 3600000000 then 'timeout'
   when next_token <> token then 'token' end as cut_reason,
 token || '-' || unique_part || '.json-stream' as current_name, strftime(started, '%Y-%m') as month,
 strftime(started, '%Y-%m-%d-%H-%M-%S') || '-' || unique_part || '.json-stream' as archived_name from keyed"""
).replace(")\n, grouped", "),\ngrouped")

# -- rendering, sinks, streams -------------------------------------------------------------

ORACLES["render_message"] = (
    _with(*_ALL, _NUMBERED)
    + """select record_id, '20181020b' as schema, sequence, epoch_us(received_at) as timestamp_us,
 epoch_us(received_at) // 1000 as timestamp_unix, collector_type, sha256(raw) as raw_sha256, message_sha256,
 sha256(message_text) as text_sha256, replace(message_json, ' ', '') as message_json, service, facility,
 case when collector_type = 'http' then cast(record_id as varchar) end as request_id,
 case when collector_type = 'http' and record_id % 2 = 0 then '["a","b"]' end as multi from numbered"""
)
ORACLES["render_pretty"] = ORACLES["render_message"]
ORACLES["frame_sequence"] = (
    _with(*_ALL, _NUMBERED)
    + """select record_id, collector_type, 2::bigint as frame_characters, '1E7B' as first_two, '7D0A' as last_two,
 sequence from numbered"""
)
ORACLES["frame_blank_lines"] = (
    _with(*_ALL, _NUMBERED)
    + """select record_id, collector_type, 4::bigint as frame_characters, '0A0A' as first_two, '0A0A' as last_two,
 sequence from numbered"""
)
ORACLES["scan_archive"] = (
    _with(*_ALL, _NUMBERED)
    + """select sequence, collector_type, epoch_us(received_at) as timestamp_us, message_sha256,
 sha256(raw) as raw_sha256, sha256(message_text) as text_sha256, replace(message_json, ' ', '') as message_json,
 coalesce(service, method) as what, fields, headers from numbered"""
)
ORACLES["write_console"] = (
    _with(*_ALL, _NUMBERED)
    + """select sequence, sequence as printed_sequence, message_sha256, sha256(message_text) as text_sha256,
 true as framed from numbered"""
)
_STORED = (
    "rows_ as (select sequence as record_id, received_at as ts, message_sha256, '' as series,"
    " cast(cast(received_at as date) as varchar) as token, 0 as cuts from numbered)",
    _PLACED,
    _NEXT.format(messages=1000, micros=43_200_000_000 - 1),
    _STARTS,
    _CUT,
    """files as (select token, segment, strftime(min(ts), '%Y-%m') as month,
  strftime(min(ts), '%Y-%m-%d-%H-%M-%S') || '-' || substr(sha256('/' || token || '/' || segment), 1, 20)
    || '.json-stream' as segment_name, count(*) as messages, min(record_id) as first_sequence,
  max(record_id) as last_sequence from segmented group by token, segment)""",
)
ORACLES["write_segments"] = (
    _with(*_ALL, _NUMBERED, *_STORED)
    + "select month, segment_name, messages, first_sequence, last_sequence, 1::bigint as files from files"
)
for _codec in ("none", "gz", "bz2", "lz4"):
    ORACLES[f"archive_{_codec}"] = (
        _with(*_ALL, _NUMBERED, *_STORED)
        + """select f.month, f.segment_name, s.record_id as sequence, s.message_sha256,
 row_number() over (partition by s.token, s.segment order by s.record_id) as position
 from segmented s join files f on f.token = s.token and f.segment = s.segment"""
    )
ORACLES["fan_out"] = (
    _with(*_ALL)
    + """select sink, collector_type, message_sha256 from merged, (values ('table'), ('text')) as sinks(sink)"""
)
ORACLES["audit_digests"] = (
    _with(*_ALL)
    + """select collector_type, count(*) as messages,
 count(*) filter (raw is null and record_id % 50 <> 0) as without_raw,
 count(*) filter (record_id % 50 = 0) as mismatches from merged group by collector_type"""
)
_STREAMED = (
    _L5424,
    _D5424,
    _S5424,
    "numbered as (select *, row_number() over (order by received_at, record_id) as sequence from syslog)",
)
ORACLES["stream_sequence"] = (
    _with(*_STREAMED) + "select sequence, message_sha256, epoch_us(received_at) as timestamp_us from numbered"
)
ORACLES["stream_syslog"] = _with(*_STREAMED) + "select sequence, message_sha256, collector_identifier from numbered"
ORACLES["stream_segments"] = (
    _with(*_STREAMED, *_STORED)
    + """select substr(sha256('/' || token || '/' || segment), 1, 20) as segment_key, record_id as sequence,
 message_sha256 from segmented"""
)
ORACLES["stream_totals"] = (
    _with(*_STREAMED)
    + """select count(*) as processed, count(*) filter (sequence % 8 = 0) as dropped,
 count(*) filter (sequence % 8 <> 0) as kept, (select count(*) from events) - count(*) as rejected from numbered"""
)
ORACLES["stream_reports"] = (
    _with(*_STREAMED)
    + """, reports as (
  select (sequence - 1) // 700 as report, count(*) as messages, epoch_us(max(received_at)) as last_us,
    epoch_us(min(received_at)) as first_us, count(*) filter (sequence % 8 = 0) as dropped
  from numbered group by 1)
select report, messages, seconds, messages / (seconds + 1e-10) as rate, processed, dropped_sum as dropped from (
  select *, (last_us - coalesce(lag(last_us) over (order by report), first_us)) / 1e6 as seconds,
    cast(sum(messages) over (order by report) as bigint) as processed,
    cast(sum(dropped) over (order by report) as bigint) as dropped_sum from reports) where messages = 700"""
).replace(")\n, reports", "),\nreports")
ORACLES["stream_rejects"] = (
    _with(_L5424, _D5424)
    + f"""select * from (select record_id, case when {_nil('message')} is null then 'text'
 when {_nil('hostname')} is null then 'hostname' when {_nil('app_name')} is null then 'service' end as reject_reason,
 sha256(line) as message_sha256 from decoded) where reject_reason is not null"""
)
ORACLES["stream_throttle"] = (
    _with(_L5424, _D5424, _S5424) + "select 4::bigint as batches, count(*) as messages from syslog"
)
ORACLES["stream_merged"] = (
    _with(*_ALL, _NUMBERED) + "select sequence, collector_type, message_sha256 from numbered"
)
