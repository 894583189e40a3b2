"""Transformer, rendering, sinks, reading back, streams."""

import glob
import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_decoding import NOW, request, typed
from test_ordering import START, frame, make, replay
from weirlog import schemas
from weirlog.operators import http, numbering, render, reports, segments, syslog, transform
from weirlog.operators.audit import audit_digests
from weirlog.operators.envelope import envelope, merge_collectors, prune_digest, prune_raw
from weirlog.operators.numbering import with_sequence
from weirlog.plans.catalog import QUERIES
from weirlog.sinks import files as sinks_files
from weirlog.sinks.files import archive, fan_out, write_console, write_segments, writer_options
from weirlog.sources.archive import scan_archive, scan_unreadable
from weirlog.sources.frames import scan_syslog, throttle
from weirlog.streaming import run
from weirlog.streaming.state import BatchState

TEXTS = ['quote " and \\', "tab\tand <&>  ", "naïve 雪", "two\nlines", "plain"]


def messages(spark):
    """Five syslog and a few HTTP messages with awkward content."""
    lines = [f"<{8 * i + i}>1 2024-03-01T10:00:00.5Z h app 7 ID - {t}" for i, t in enumerate(TEXTS)]
    lines += ['<1>1 2024-03-01T10:00:01Z h app - - - {"b" : 1.50, "a": [1, "x y"], "e": 1e400}']
    frames = spark.createDataFrame(
        [(i, line.encode(), NOW + timedelta(microseconds=i)) for i, line in enumerate(lines)],
        "record_id int, message_raw binary, received_at timestamp",
    )
    requests = spark.createDataFrame(
        [
            request(record_id=100, headers=typed("application/json; a=b", ("X-M", ["1", "2"]), ("X-E", []))),
            request(record_id=101, body=b' "text" ', request_uri="/p?x=1&x=2"),
            request(record_id=102, body=b"null", transfer_encoding=[]),
            request(record_id=103, headers=typed("text/plain"), body=b"\xff", transfer_encoding=["a", "b"]),
        ],
        schemas.HTTP_REQUEST,
    )
    records = merge_collectors(
        syslog.syslog_records(frames, "rfc5424", "gate", keep=("record_id",)),
        http.http_records(requests, keep=("record_id",)),
    )
    return envelope(with_sequence(records, ("received_at", "record_id")), keep=("record_id",))


def test_rendered_text(spark):
    rows = render.render_message(messages(spark), keep=("record_id",)).collect()
    text = {r.record_id: r.json for r in rows}
    assert text[5].startswith('{"schema":"20181020b","sequence":')
    assert '"message_json":{"b":1.50,"a":[1,"x y"],"e":1e400},"message_metadata":{"schema":"syslog:20181020a"' in text[5]
    assert '"fields":{"facility":0,"priority":1,"severity":1,"version":1}}' in text[5]
    assert "\\u003c\\u0026\\u003e \\u2028" in text[1] and "message_extra" not in text[1]
    assert '"message_json":null' in text[102]
    assert '"headers":{"content-type":"application/json; a=b","x-e":null,"x-m":["1","2"]}' in text[100]
    assert '"transfer_encoding":["a","b"]' in text[103] and '"message_raw":"/w=="' in text[103]
    for line in text.values():
        json.loads(line)


def test_pretty_differs_in_layout_only(spark):
    plain = {r.record_id: r.json for r in render.render_message(messages(spark), keep=("record_id",)).collect()}
    rows = render.render_message(messages(spark), pretty=True, keep=("record_id",)).collect()
    for row in rows:
        assert json.loads(row.json) == json.loads(plain[row.record_id])
        assert '\n\t"sequence": ' in row.json and '\n\t\t"schema": ' in row.json and "\n\n" not in row.json


def comparable(df):
    rows = [r.asDict(recursive=True) for r in df.select(*schemas.MESSAGE_COLUMNS).collect()]
    for row in rows:
        row["message_raw"] = row["message_raw"] and bytes(row["message_raw"])
        # Blanks between JSON tokens are not kept.
        row["message_json"] = row["message_json"] and row["message_json"].replace(' : ', ":").replace(": ", ":").replace(', ', ",")
    return sorted(rows, key=lambda r: r["sequence"])


@pytest.mark.parametrize("framing, pretty", [("sequence", False), ("blank-lines", False), ("sequence", True), ("blank-lines", True)])
def test_archive_reads_back(spark, folder, framing, pretty):
    df = messages(spark).withColumn("message_extra", F.lit('{"k":[1,2.50]}'))
    cut = segments.segment(df, 3, "1 hour", at="timestamp", tie=("sequence",))
    write_segments(cut, f"{folder}/s", framing=framing, pretty=pretty)
    back = scan_archive(spark, f"{folder}/s", framing)
    assert comparable(back) == comparable(df)
    assert {r.month for r in back.select("month").collect()} == {"2024-03"}


def test_files_hold_whole_segments_in_order(spark, folder):
    df = messages(spark)
    cut = segments.segment(df, 4, "1 hour", at="timestamp", position="sequence")
    write_segments(cut, f"{folder}/s", prefix="p-")
    files = glob.glob(f"{folder}/s/month=2024-03/segment_name=p-2024-03-05-12-00-00-*.json-stream/part-*")
    texts = [open(f).read() for f in files]
    assert len(files) == len({os.path.dirname(f) for f in files}) == 3
    numbers = []
    for text in texts:
        assert text.startswith("\x1e{") and text.endswith("}\n")
        numbers.append([json.loads(part)["sequence"] for part in text.split("\x1e")[1:]])
    assert sorted(numbers) == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10]]


@pytest.mark.parametrize("codec, ending", [("none", ".txt"), ("gz", ".txt.gz"), ("bz2", ".txt.bz2"), ("lz4", ".txt.lz4")])
def test_archive_codecs(spark, folder, codec, ending):
    df = messages(spark)
    cut = segments.segment(df, 4, "1 hour", at="timestamp", position="sequence")
    write_segments(cut, f"{folder}/current", framing="blank-lines", pretty=True)
    assert archive(spark, f"{folder}/current", f"{folder}/archived", codec) == 3
    assert not glob.glob(f"{folder}/current/month=*/segment_name=*")
    files = glob.glob(f"{folder}/archived/month=*/segment_name=*/part-*")
    assert len(files) == 3 and all(f.endswith(ending) for f in files)
    assert comparable(scan_archive(spark, f"{folder}/archived", "blank-lines")) == comparable(df)


def test_archive_only_closed_segments(spark, folder):
    cut = segments.segment(messages(spark), 4, "1 hour", at="timestamp", position="sequence")
    write_segments(cut, f"{folder}/current")
    manifest = segments.segment_manifest(cut, 4, "1 hour", at="timestamp")
    closed = manifest.where("cut_reason is not null").select(F.col("archived_name").alias("segment_name"))
    assert archive(spark, f"{folder}/current", f"{folder}/archived", "gz", closed=closed) == 2
    assert scan_archive(spark, f"{folder}/archived").count() == 8
    assert scan_archive(spark, f"{folder}/current").count() == 2


def test_archive_moves_segments_in_turns(spark, folder, monkeypatch):
    """Originals go turn by turn, so that a part of the store at most is there twice; nothing is lost."""
    monkeypatch.setattr(sinks_files, "_TURN_BYTES", 1, raising=False)
    monkeypatch.setattr(sinks_files, "_TURNS", 5, raising=False)
    remove, there = sinks_files.remove_listed, []

    def spy(spark, path):
        there.append(len(glob.glob(f"{folder}/*/month=*/segment_name=*/part-*")))
        remove(spark, path)

    monkeypatch.setattr(sinks_files, "remove_listed", spy)
    df = messages(spark)
    write_segments(segments.segment(df, 1, "1 hour", at="timestamp", position="sequence"), f"{folder}/current")
    assert archive(spark, f"{folder}/current", f"{folder}/archived") == 10
    assert len(there) == 10 and max(there) < 18
    assert not glob.glob(f"{folder}/current/month=*/segment_name=*")
    assert comparable(scan_archive(spark, f"{folder}/archived")) == comparable(df)


def test_archive_in_turns_keeps_what_gets_one_name(spark, folder, monkeypatch):
    monkeypatch.setattr(sinks_files, "_TURN_BYTES", 1, raising=False)
    write_segments(segments.segment(messages(spark), 1, "1 hour", at="timestamp", position="sequence"), f"{folder}/current")
    names = scan_archive(spark, f"{folder}/current").select("segment_name").distinct()
    closed = names.withColumn("archived_name", F.lit("all"))
    assert archive(spark, f"{folder}/current", f"{folder}/archived", closed=closed) == 10
    assert sorted(r.sequence for r in scan_archive(spark, f"{folder}/archived").collect()) == list(range(1, 11))


def test_archive_query_leaves_no_work_tables(spark, folder):
    """What is numbered and cut up goes once the segments are written: only the archive takes room."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    rows = [(i, START + timedelta(minutes=i), i, "view", 1.5 * i, '{"k": %d}' % i) for i in range(50)]
    events = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame([(i, t.replace(tzinfo=None), *r) for i, t, *r in rows], events).write.parquet(f"{folder}/events.parquet")
    spark.createDataFrame([(1, "/a?b=c", "<p>x</p>")], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    assert QUERIES["archive_none"](spark, folder).count() > 40
    left = [f for name in set(os.listdir(shared)) - before for f in glob.glob(f"{shared}/{name}/**/part-*", recursive=True)]
    assert left and not [f for f in left if "/weirlog-" in f and "/weirlog-archive-" not in f]


def test_codec_options():
    assert writer_options("gz", 1)["zlib.compress.level"] == "BEST_SPEED"
    for codec, level in (("xz", 9), ("zip", 9), ("gz", 0)):
        with pytest.raises(ValueError):
            writer_options(codec, level)


def test_console(spark, capfd):
    write_console(messages(spark).limit(2))
    assert "20181020b" in capfd.readouterr().out


def test_pruning(spark):
    df = prune_digest(prune_raw(messages(spark), keep_raw=False), keep_sha256=False)
    kept = {r.record_id for r in df.where("message_raw is not null").collect()}
    assert kept == {103} and df.where("message_sha256 is not null").count() == 0


def test_digests_are_clean(spark):
    assert all(r.mismatches == 0 for r in audit_digests(messages(spark)).collect())


REPLIES = {
    "null": (None, True),
    '{"schema":"x","sequence":5,"message_text":"t"}': (None, False),
    '{"schema":"x","colour":1}': ("unknown-field", False),
    '{"Schema":"x"}': ("unknown-field", False),
    '{"sequence":-1}': ("wrong-type", False),
    '{"sequence":1.5}': ("wrong-type", False),
    '{"message_text":5}': ("wrong-type", False),
    '{"timestamp":"yesterday"}': ("wrong-type", False),
    '{"message_raw":"***"}': ("wrong-type", False),
    '{"timestamp":"2024-01-01T00:00:00+01:00","message_raw":"aGk=","message_json":null}': (None, False),
    "[1]": ("not-an-object", False),
    "5": ("not-an-object", False),
    '{"a"': ("invalid-json", False),
    None: ("failed", False),
}


def test_replacement_outcomes(spark):
    base = messages(spark).limit(1).drop("record_id")
    replies = spark.createDataFrame([(i, r) for i, r in enumerate(REPLIES)], "id int, answer string")
    df = base.join(replies, F.lit(True)).cache()
    rows = transform.replace(df, lambda d: F.col("answer")).orderBy("id").collect()
    original = base.first()
    for row, (reply, (error, dropped)) in zip(rows, REPLIES.items()):
        assert (row.transform_error, row.dropped) == (error, dropped), reply
        if error:
            assert (row.schema, row.sequence, row.message_text) == (original.schema, original.sequence, original.message_text)
    assert (rows[1].schema, rows[1].sequence, rows[1].message_text, rows[1].message_sha256) == ("x", 5, "t", None)
    assert rows[9].timestamp == datetime(2023, 12, 31, 23) and bytes(rows[9].message_raw) == b"hi"
    assert rows[9].message_json == "null" and rows[9].schema is None
    assert transform.drop_null_replacements(transform.replace(df, lambda d: F.col("answer"))).count() == len(REPLIES) - 1


def test_replacing_with_itself_changes_nothing(spark):
    df = messages(spark).where("record_id not in (5)")  # number formats are normalised
    same = transform.replace(df, transform.python_transformer(lambda message: message))
    assert same.where("transform_error is not null").count() == 0
    assert comparable(same) == comparable(df)


def test_python_enrichment_fails_open(spark):
    def answer(message):
        if message["collector_type"] == "http":
            raise ValueError
        return [message["sequence"], None]

    rows = transform.enrich(messages(spark), transform.python_transformer(answer)).collect()
    for r in rows:
        if r.collector_type == "http":
            assert (r.message_extra, r.transform_error) == (None, "failed")
        else:
            assert (r.message_extra, r.transform_error) == (f"[{r.sequence},null]", None)


def test_fan_out(spark, folder):
    seen = []
    fan_out(messages(spark), lambda df: df.write.parquet(f"{folder}/a"), lambda df: seen.append(df.count()))
    assert seen == [10] and spark.read.parquet(f"{folder}/a").count() == 10


# -- streams -------------------------------------------------------------------------


def land(spark, rows, path, name):
    df = spark.createDataFrame(rows, "record_id int, kind string, received_at timestamp")
    line = F.concat(F.lit("<13>1 2024-03-01T10:00:00Z h "), "kind", F.lit(" - - - n"), F.col("record_id").cast("string"))
    df = df.select("record_id", "received_at", line.cast("binary").alias("message_raw"))
    df.coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def stream(spark, path, one_file=True):
    schema = "record_id int, received_at timestamp, message_raw binary"
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true").options(**throttle(max_files=1))
    return syslog.syslog_records(reader.parquet(path), "rfc5424", keep=("record_id",))


def test_stream_goes_on_after_a_restart(spark, folder):
    rows = sorted(make(2, 300), key=lambda r: (r[2], r[0]))
    for part, name in ((rows[:100], "1"), (rows[100:180], "2")):
        land(spark, part, f"{folder}/in", name)
    sinks = lambda: [run.table_sink(f"{folder}/out"), run.segment_sink(f"{folder}/seg", f"{folder}/state", 9, "1 hour")]
    start = lambda: run.run_to_end(
        run.stream_messages(stream(spark, f"{folder}/in"), f"{folder}/state", sinks()), f"{folder}/checkpoint"
    )
    start()
    land(spark, rows[180:], f"{folder}/in", "3")
    start()
    out = spark.read.parquet(f"{folder}/out")
    assert out.select("batch").distinct().count() == 3
    got = {int(r.message_text[1:]): r.sequence for r in out.collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(rows)}

    expected = {}
    for i, (token, number) in replay(rows, 9, timedelta(hours=1)).items():
        expected.setdefault((token, number), set()).add(got[i])
    files = {}
    for r in scan_archive(spark, f"{folder}/seg").collect():
        files.setdefault(r.segment_name, set()).add(r.sequence)
    assert sorted(map(sorted, files.values())) == sorted(map(sorted, expected.values()))


def test_replayed_batch_repeats_itself(spark, folder):
    rows = sorted(make(7, 120), key=lambda r: (r[2], r[0]))
    df = spark.createDataFrame(rows, "record_id int, kind string, received_at timestamp")
    numbers, opened = BatchState(f"{folder}/n"), BatchState(f"{folder}/s")

    def batch(part, batch_id):
        numbered = run.number_batch(df.where(part), batch_id, numbers, ("received_at", "record_id"))
        cut = run.segment_batch(numbered, batch_id, opened, 5, "1 hour", at="received_at")
        return {(r.record_id, r.sequence, r.token, r.segment, r.started_at) for r in cut.collect()}

    middle = rows[60][2]
    first = F.col("received_at") < F.lit(middle)
    zero = batch(first, 0)
    one = batch(~first, 1)
    assert batch(~first, 1) == one and batch(first, 0) == zero
    both = {r[0]: (r[2], r[3]) for r in zero | one}
    assert both == replay(rows, 5, timedelta(hours=1))


def test_text_frames_and_throttle(spark, folder):
    os.makedirs(f"{folder}/in")
    for i in range(3):
        with open(f"{folder}/in/{i}.log", "w") as f:
            f.write(f"<13>Mar  5 01:02:0{i} host app: hello {i}\n")
    df = scan_syslog(spark, f"{folder}/in", identifier="me", received_at=NOW)
    assert {r.message_text for r in syslog.syslog_records(df).collect()} == {"hello 0", "hello 1", "hello 2"}
    live = scan_syslog(spark, f"{folder}/in", streaming=True, options=throttle(max_files=1))
    sizes = []
    writer = syslog.syslog_records(live).writeStream.foreachBatch(lambda d, i: sizes.append(d.count()))
    run.run_to_end(writer, f"{folder}/checkpoint")
    assert sizes == [1, 1, 1]
    assert throttle(max_offsets=5) == {"maxOffsetsPerTrigger": "5"}


def test_time_report_on_a_stream(spark, folder):
    from weirlog.operators.reports import throughput_by_time

    rows = [(i, "a", START + timedelta(seconds=20 * i)) for i in range(12)]
    land(spark, rows, f"{folder}/in", "1")
    land(spark, [(99, "a", START + timedelta(hours=1))], f"{folder}/in", "2")
    report = throughput_by_time(stream(spark, f"{folder}/in"), "60 seconds", watermark="1 minute")
    writer = report.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    run.run_to_end(writer, f"{folder}/checkpoint")
    got = spark.read.parquet(f"{folder}/out").orderBy("start").collect()
    assert [r.messages for r in got] == [3, 3, 3, 3]


def test_archive_keeps_the_order_of_batches_and_can_be_repeated(spark, folder):
    df = messages(spark)
    for batch, part in ((9, F.col("sequence") <= 2), (10, F.col("sequence") > 2)):
        cut = segments.segment(df, 100, "1 hour", at="timestamp", position="sequence").where(part)
        cut = cut.withColumn("started_at", F.lit(NOW))
        write_segments(cut, f"{folder}/current", batch=batch)
    for _ in range(2):  # as after a failure before the originals were removed
        archive(spark, f"{folder}/current", f"{folder}/archived", "gz", remove=False)
    rows = scan_archive(spark, f"{folder}/archived").select("sequence", F.input_file_name().alias("f")).collect()
    by_batch = lambda r: int(r.f.split("batch=")[1].split("/")[0])
    assert [r.sequence for r in sorted(rows, key=by_batch)] == list(range(1, 11))
    assert archive(spark, f"{folder}/current", f"{folder}/archived", "gz") == 1
    assert not glob.glob(f"{folder}/current/month=*/segment_name=*/batch=*")
    assert scan_archive(spark, f"{folder}/archived").count() == 10


def test_archive_removes_originals_with_escaped_names_and_renames(spark, folder):
    cut = segments.segment(messages(spark), 4, "1 hour", at="timestamp", position="sequence")
    write_segments(cut, f"{folder}/current", layout="yyyy-MM-dd'T'HH:mm:ss")
    names = scan_archive(spark, f"{folder}/current").select("segment_name").distinct()
    assert all(":" in r.segment_name for r in names.collect())
    closed = spark.createDataFrame(
        [(r.segment_name, "new:" + r.segment_name) for r in names.collect()], "segment_name string, archived_name string"
    )
    assert archive(spark, f"{folder}/current", f"{folder}/archived", closed=closed) == 3
    assert not glob.glob(f"{folder}/current/month=*/segment_name=*")
    back = scan_archive(spark, f"{folder}/archived")
    assert back.count() == 10 and all(r.segment_name.startswith("new:") for r in back.collect())
    with pytest.raises(ValueError):
        archive(spark, f"{folder}/current", f"{folder}/current/")


def test_unreadable_records_are_not_lost_silently(spark, folder):
    df = messages(spark)
    write_segments(segments.segment(df, 100, "1 hour", at="timestamp", position="sequence"), f"{folder}/s")
    (file,) = glob.glob(f"{folder}/s/month=*/segment_name=*/part-*")
    with open(file) as f:
        text = f.read()
    for crc in glob.glob(os.path.join(os.path.dirname(file), ".*.crc")):
        os.remove(crc)
    with open(file, "w") as f:
        f.write(text[:-40] + "\n")
    with pytest.raises(Exception, match="unreadable record"):
        scan_archive(spark, f"{folder}/s").collect()
    assert scan_archive(spark, f"{folder}/s", unreadable="skip").count() == 9
    (bad,) = scan_unreadable(spark, f"{folder}/s").collect()
    assert bad.record and bad.month and bad.segment_name


def test_console_prints_every_message_in_order(spark, capfd):
    df = spark.range(100).select(F.lit(1).alias("one"), (100 - F.col("id")).alias("number"))
    df = messages(spark).limit(1).drop("sequence").crossJoin(df.select(F.col("number").alias("sequence")))
    write_console(df.select(*messages(spark).columns), pretty=False)
    out = capfd.readouterr().out
    numbers = [json.loads(line)["sequence"] for line in out.splitlines() if line.startswith("{")]
    assert numbers == list(range(1, 101))


def test_stream_from_text_gives_ids_and_spreads_one_instant(spark, folder):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.log", "w") as f:
        for i in range(500):
            f.write(f"<13>1 2024-03-01T10:00:00Z h a - - - n{i}\n" if i % 50 else "not syslog\n")
    frames = scan_syslog(spark, f"{folder}/in", streaming=True, format="rfc5424")
    sizes = []
    measured = numbering.measure_splits

    def spy(df, order, splits=None):
        found = measured(df, order, splits)
        sizes.append(found.counts)
        return found

    aside = f"{folder}/rejects"
    run.measure_splits, kept = spy, run.measure_splits
    try:
        writer = run.stream_messages(
            frames, f"{folder}/state", [run.table_sink(f"{folder}/out")],
            decode=lambda df: syslog.syslog_records(df, "rfc5424", keep=("record_id",)),
            rejects=lambda df: syslog.syslog_rejects(df, "rfc5424", keep=("record_id",)),
            quarantine=run.table_sink(aside),
        )
        run.run_to_end(writer, f"{folder}/checkpoint")
    finally:
        run.measure_splits = kept
    rows = spark.read.parquet(f"{folder}/out").orderBy("sequence").collect()
    assert [r.message_text for r in rows] == [f"n{i}" for i in range(500) if i % 50]
    assert [r.sequence for r in rows] == list(range(1, 491))
    assert len(sizes[0]) > 1 and max(sizes[0]) < 400
    assert spark.read.parquet(aside).count() == 10
    (totals,) = run.stream_totals(spark, f"{folder}/state").collect()
    assert (totals.processed, totals.dropped, totals.rejected) == (490, 0, 10)


def test_totals_of_a_long_stream(spark, folder):
    """More batches than Spark keeps: the totals are those of all of them."""
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "3")
    try:
        for i in range(9):
            land(spark, [(10 * i + k, "a", START + timedelta(minutes=10 * i + k)) for k in range(i + 1)], f"{folder}/in", str(i))
        source = stream(spark, f"{folder}/in", 1)
        writer = run.stream_messages(source, f"{folder}/state", [], transformer=lambda df: F.when(F.col("sequence") % 5 == 0, F.lit("null")), replacing=True)
        run.run_to_end(writer, f"{folder}/checkpoint")
    finally:
        spark.conf.unset("spark.sql.streaming.minBatchesToRetain")
    assert tuple(run.stream_totals(spark, f"{folder}/state").first()) == (45, 9, 0)
    assert run.stream_batches(spark, f"{folder}/state").count() <= 5


def test_cuts_asked_for_while_the_stream_runs(spark, folder):
    """A cut that lands between two batches splits the open segment; a replayed batch does not see later ones."""
    rows = [(i, "a", START + timedelta(seconds=10 * i)) for i in range(60)]
    control = f"{folder}/control"
    sink = run.segment_sink(f"{folder}/seg", f"{folder}/state", 1000, "1 hour", control=control)
    start = lambda: run.run_to_end(
        run.stream_messages(stream(spark, f"{folder}/in"), f"{folder}/state", [sink]), f"{folder}/checkpoint"
    )
    land(spark, rows[:20], f"{folder}/in", "1")
    start()
    run.ask_for_cut(spark, control, rows[25][2])
    land(spark, rows[20:40], f"{folder}/in", "2")
    start()
    run.ask_for_cut(spark, control, rows[39][2] + timedelta(seconds=1))
    # The second batch once more, as after a failure.
    again = spark.createDataFrame([(i + 1, t) for i, _, t in rows[20:40]], "sequence bigint, timestamp timestamp")
    state = BatchState(f"{folder}/state/segments")
    seen = [r["cut_at"] for r in BatchState(f"{folder}/state/cuts").before(spark, 2).collect()]
    assert seen == [rows[25][2]]
    assert {r.segment for r in run.segment_batch(again, 1, state, 1000, "1 hour", cut_at=seen).collect()} == {0, 1}
    land(spark, rows[40:], f"{folder}/in", "3")
    start()
    found = {}
    for r in scan_archive(spark, f"{folder}/seg").collect():
        found.setdefault(r.segment_name, set()).add(r.sequence)
    assert sorted(map(sorted, found.values())) == [list(range(1, 26)), list(range(26, 41)), list(range(41, 61))]


def test_reports_of_batches_equal_those_of_all(spark, folder):
    rows = sorted(make(21, 230), key=lambda r: (r[2], r[0]))
    df = with_sequence(frame(spark, rows), ("received_at", "record_id")).withColumn("dropped", F.col("record_id") % 3 == 0)
    df = spark.createDataFrame(df.collect(), df.schema)
    state = BatchState(f"{folder}/reports")
    sizes, at, got = [1, 60, 3, 25, 80, 0, 24, 37], 0, []
    for batch, n in enumerate(sizes):
        part = df.where((F.col("sequence") > at) & (F.col("sequence") <= at + n))
        once = run.report_batch(part, batch, state, 25, "received_at").collect()
        assert sorted(once) == sorted(run.report_batch(part, batch, state, 25, "received_at").collect())
        got += once
        at += n
    expected = [r for r in reports.throughput_by_count(df, 25).orderBy("report").collect() if r.messages == 25]
    assert at == 230 and [tuple(r) for r in sorted(got)] == [tuple(r) for r in expected]


def test_stream_caches_no_messages(spark, folder):
    """A batch may be larger than all memory: while sinks run, its messages are in a table, which goes afterwards."""
    rows = sorted(make(5, 40), key=lambda r: (r[2], r[0]))
    land(spark, rows, f"{folder}/in", "1")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    seen = []

    def sink(df, batch_id):
        assert df.count() == 35
        seen.append(spark.sparkContext._jsc.getPersistentRDDs().size() - cached)

    writer = run.stream_messages(
        stream(spark, f"{folder}/in"), f"{folder}/state", [sink, run.table_sink(f"{folder}/out")],
        transformer=lambda df: F.when(F.col("sequence") % 8 == 0, F.lit("null")), replacing=True,
        report=run.table_sink(f"{folder}/reports"), report_every=10,
    )
    run.run_to_end(writer, f"{folder}/checkpoint")
    assert seen == [0]
    kept = [r.sequence for r in spark.read.parquet(f"{folder}/out").orderBy("sequence").collect()]
    assert kept == [i for i in range(1, 41) if i % 8]
    assert [r.dropped for r in spark.read.parquet(f"{folder}/reports").orderBy("report").collect()] == [1, 2, 3, 5]
    assert tuple(run.stream_totals(spark, f"{folder}/state").first()) == (40, 5, 0)
    assert not os.path.exists(f"{folder}/state/work") or not os.listdir(f"{folder}/state/work")


def test_stream_leaves_nothing_cached(spark, folder):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    rows = sorted(make(3, 60), key=lambda r: (r[2], r[0]))
    land(spark, rows[:30], f"{folder}/in", "1")
    land(spark, rows[30:], f"{folder}/in", "2")
    sink = run.segment_sink(
        f"{folder}/seg", f"{folder}/state", 9, "1 hour", cut_at=[rows[10][2]], archive_store=f"{folder}/old",
        archive_codec="gz", archive_prefix="old-",
    )
    run.run_to_end(run.stream_messages(stream(spark, f"{folder}/in"), f"{folder}/state", [sink]), f"{folder}/checkpoint")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    old = scan_archive(spark, f"{folder}/old").collect()
    now = scan_archive(spark, f"{folder}/seg").collect()
    assert sorted(r.sequence for r in old + now) == list(range(1, 61))
    assert all(r.segment_name.startswith("old-") for r in old) and len({r.segment_name for r in now}) == 1
    files = {}
    for r in old + now:
        files.setdefault(r.segment_name.removesuffix(".json-stream")[-20:], set()).add(r.sequence)
    cut_before = {i + 1 for i, r in enumerate(rows) if r[2] < rows[10][2]}
    assert all(s <= cut_before or not s & cut_before for s in files.values()), (files, cut_before)
