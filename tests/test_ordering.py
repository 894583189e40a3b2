"""Numbering and segmentation against plain replays."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from weirlog.operators import chains, numbering, reports, segments
from weirlog.operators.numbering import prefix_sums, with_arrival_id, with_sequence

START = datetime(2024, 1, 1)


def make(seed, n, hot=0.35, step=300):
    """Rows of which a third share one instant, and some a token boundary."""
    rng = random.Random(seed)
    rows, t = [], START
    for i in range(n):
        if rng.random() > hot:
            t += timedelta(seconds=rng.choice([0, 1, rng.randrange(step), rng.randrange(step), 3600]))
        rows.append((i, rng.choice("ab"), t))
    hot_instant = rows[n // 3][2]
    rows = [(i, k, hot_instant if rng.random() < hot and abs(i - n // 3) < n // 6 else t) for i, k, t in rows]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "record_id int, kind string, received_at timestamp").repartition(5)


def replay(rows, messages, timeout=None, cuts=(), state=None):
    """The rotation rule, one row after the other, for one series."""
    out, opened, last = {}, None, {}
    for i, _, t in sorted(rows, key=lambda r: (r[2], r[0])):
        token, cut = t.strftime("%Y-%m-%d"), sum(c <= t for c in cuts)
        full = opened and (opened["count"] >= messages or (timeout and t - opened["start"] >= timeout))
        if not opened or full or opened["token"] != token or opened["cut"] != cut:
            last[token] = last.get(token, -1) + 1
            opened = {"start": t, "count": 0, "token": token, "cut": cut}
        opened["count"] += 1
        out[i] = (token, last[token])
    return out


CASES = [
    (50, "1 hour", timedelta(hours=1), ()),
    (3, "1 hour", timedelta(hours=1), ()),
    (1, "10 minutes", timedelta(minutes=10), ()),
    (40, "90 seconds", timedelta(seconds=90), (START + timedelta(hours=5), START + timedelta(hours=5, minutes=1))),
    (10_000, "2 hours", timedelta(hours=2), ()),
    (7, None, None, ()),
]


@pytest.mark.parametrize("messages, text, timeout, cuts", CASES)
def test_segments_equal_replay(spark, messages, text, timeout, cuts):
    rows = make(messages, 600)
    got = segments.segment(frame(spark, rows), messages, text, cut_at=cuts, splits=7)
    got = {r.record_id: (r.token, r.segment) for r in got.collect()}
    assert got == replay(rows, messages, timeout, cuts)


@pytest.mark.parametrize("many_runs", [False, True])
def test_segments_with_given_positions(spark, many_runs, monkeypatch):
    rows = make(5, 500)
    if many_runs:
        monkeypatch.setattr(segments, "_RUNS_PER_SPLIT", 0)
    df = with_sequence(frame(spark, rows), ("received_at", "record_id"), splits=5)
    got = segments.segment(df, 20, "1 hour", position="sequence", splits=6)
    got = {r.record_id: (r.token, r.segment) for r in got.collect()}
    assert got == replay(rows, 20, timedelta(hours=1))


@pytest.mark.parametrize("messages, text, timeout, cuts", CASES)
def test_segments_by_pointer_doubling(spark, monkeypatch, messages, text, timeout, cuts):
    monkeypatch.setattr(chains, "BLOCK", 64)
    rows = make(messages + 1, 500)
    got = segments.segment(frame(spark, rows), messages, text, cut_at=cuts, splits=4, scanned=0)
    got = {r.record_id: (r.token, r.segment) for r in got.collect()}
    assert got == replay(rows, messages, timeout, cuts)


@pytest.mark.parametrize("messages", [2, 5, 10_000])
def test_one_token_that_holds_all_rows(spark, messages):
    """More messages allowed than come within the age limit: every row is a candidate."""
    rows = [(i, "a", START + timedelta(seconds=40 * i + i % 7)) for i in range(700)]
    df = frame(spark, rows)
    ranked = segments.segment(df, messages, "5 minutes", "yyyy", splits=6, scanned=10).collect()
    scanned = segments.segment(df, messages, "5 minutes", "yyyy", splits=6).collect()
    number = lambda found: {r.record_id: r.segment for r in found}
    assert number(ranked) == number(scanned)
    start, count, segment, expected = None, 0, -1, {}
    for i, _, t in rows:
        if start is None or count >= messages or t - start >= timedelta(minutes=5):
            start, count, segment = t, 0, segment + 1
        count += 1
        expected[i] = segment
    assert number(ranked) == expected


@pytest.mark.parametrize("layout, python", [("HH", "%H"), ("mm", "%M"), ("ss", "%S"), ("dd", "%d")])
def test_tokens_that_come_back(spark, layout, python):
    rows = make(15, 500, step=1500)
    for keys, scanned in (((), None), (("kind",), 0)):
        got = segments.segment(frame(spark, rows), 6, "3 hours", layout, keys, splits=7, scanned=scanned)
        got = {r.record_id: (r.token, r.segment) for r in got.collect()}
        expected = {}
        for series in ("a", "b") if keys else ("ab",):
            opened, last = None, {}
            for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
                if k not in series:
                    continue
                token = t.strftime(python)
                if opened is None or opened[0] != token or opened[1] >= 6 or t - opened[2] >= timedelta(hours=3):
                    last[token] = last.get(token, -1) + 1
                    opened = [token, 0, t]
                opened[1] += 1
                expected[i] = (token, last[token])
        assert got == expected


def test_open_segments_by_pointer_doubling(spark):
    """Several batches, each going on with what the one before left open."""
    rows = sorted(make(12, 400), key=lambda r: (r[2], r[0]))
    cuts = (rows[90][2], rows[260][2])
    for scanned in (None, 0):
        opened, got = None, {}
        for part in (rows[:130], rows[130:270], rows[270:]):
            df = segments.segment(frame(spark, part), 9, "1 hour", cut_at=cuts, opened=opened, scanned=scanned)
            df = spark.createDataFrame(df.collect(), df.schema)
            got.update({r.record_id: (r.token, r.segment) for r in df.collect()})
            latest = segments.open_segments(df)
            if opened is not None:
                old = opened.withColumnsRenamed({"segment": "s0", "count": "c0", "started_at": "t0"})
                latest = latest.join(old, "token", "full")
                same = F.equal_null("segment", "s0")
                latest = latest.select(
                    "token",
                    F.coalesce("segment", "s0").alias("segment"),
                    F.when(same, F.col("count") + F.col("c0")).otherwise(F.coalesce("count", "c0")).alias("count"),
                    F.when(same, F.col("t0")).otherwise(F.coalesce("started_at", "t0")).alias("started_at"),
                )
            opened = spark.createDataFrame(latest.collect(), latest.schema)
        assert got == replay(rows, 9, timedelta(hours=1), cuts), scanned


def test_segments_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(segments, "MAX_BROADCAST_MARKS", 0)
    rows = make(6, 400)
    got = {r.record_id: (r.token, r.segment) for r in segments.segment(frame(spark, rows), 20, "1 hour").collect()}
    assert got == replay(rows, 20, timedelta(hours=1))


def test_segments_per_series(spark):
    rows = make(8, 500)
    got = segments.segment(frame(spark, rows), 9, "1 hour", keys=("kind",), splits=6)
    got = {r.record_id: (r.token, r.segment) for r in got.collect()}
    expected = {}
    for kind in "ab":
        expected.update(replay([r for r in rows if r[1] == kind], 9, timedelta(hours=1)))
    assert got == expected


def test_age_limit_cuts_at_equality(spark):
    rows = [(i, "a", START + timedelta(minutes=30 * i)) for i in range(6)]
    got = {r.record_id: r.segment for r in segments.segment(frame(spark, rows), 100, "1 hour").collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_single_and_no_row(spark):
    assert segments.segment(frame(spark, [(1, "a", START)])).select("segment").collect()[0][0] == 0
    assert segments.segment(frame(spark, [(1, "a", START)]).where("false")).count() == 0


def test_every_segment_obeys_the_limits(spark):
    rows = make(9, 800)
    df = segments.segment(frame(spark, rows), 25, "1 hour")
    manifest = segments.segment_manifest(df, 25, "1 hour").collect()
    assert sum(m["count"] for m in manifest) == 800
    for m in manifest:
        assert 1 <= m["count"] <= 25 and m.last_at - m.started_at < timedelta(hours=1)
        assert m.started_at.strftime("%Y-%m-%d") == m.token == m.last_at.strftime("%Y-%m-%d")
        assert (m.cut_reason == "messages") <= (m["count"] == 25)
    assert sum(m.cut_reason is None for m in manifest) == 1
    assert len({m.current_name for m in manifest}) == len(manifest)


def test_layouts():
    assert segments.layout_from_reference_time("2006-01/2006-01-02-15-04-05") == "yyyy-MM/yyyy-MM-dd-HH-mm-ss"
    assert segments.check_layout("yyyy-MM-dd'T'HH")
    for layout in ("HH", "MM-dd", "yyyy-dd", "yyyy-MM-dd hh", "DDD", "x"):
        with pytest.raises(ValueError):
            segments.check_layout(layout)


def test_due(spark):
    df = spark.createDataFrame(
        [("2024-01-01", 0, 5, START), ("2024-01-01", 1, 5, START + timedelta(minutes=50))],
        "token string, segment int, count int, started_at timestamp",
    )
    due = lambda now: {r.segment for r in segments.due(df, now, "1 hour").collect()}
    assert due(START + timedelta(minutes=59)) == set()
    assert due(START + timedelta(hours=1)) == {0}
    assert due(START + timedelta(days=1)) == {0, 1}


def test_sequence_with_a_hot_instant(spark):
    rows = make(3, 700)
    got = with_sequence(frame(spark, rows), ("received_at", "kind", "record_id"), start=11, splits=9).collect()
    expected = sorted(rows, key=lambda r: (r[2], r[1], r[0]))
    assert [r.record_id for r in sorted(got, key=lambda r: r.sequence)] == [r[0] for r in expected]
    assert sorted(r.sequence for r in got) == list(range(11, 711))


def test_sequence_with_many_bounds(spark, monkeypatch):
    """Bounds that do not fit the plan come from a table."""
    monkeypatch.setattr(numbering, "_PLANNED_BOUNDS", 3)
    rows = make(3, 700)
    expected = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[1], r[0]))]
    got = with_sequence(frame(spark, rows), ("received_at", "kind", "record_id"), splits=30).collect()
    assert [r.record_id for r in sorted(got, key=lambda r: r.sequence)] == expected
    measured = numbering.measure_splits(frame(spark, rows), ("received_at", "record_id"), 30)
    assert measured.total == 700 and len(measured.bounds) > 20 and max(measured.counts) < 100


def test_sequence_reads_its_input_once_and_sorts_nothing_later(spark, folder):
    rows = make(3, 300)
    frame(spark, rows).write.parquet(f"{folder}/in")
    got = with_sequence(spark.read.parquet(f"{folder}/in"), ("received_at", "record_id"), splits=9)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "hashpartitioning" not in plan and f"{folder}/in" not in plan
    first = {r.record_id: r.sequence for r in got.collect()}
    assert first == {r.record_id: r.sequence for r in got.repartition(3).collect()}
    assert sorted(first.values()) == list(range(1, 301))


def test_sequence_of_nothing(spark):
    got = with_sequence(frame(spark, [(1, "a", START)]).where("false"), ("received_at", "record_id"))
    assert got.collect() == [] and got.columns == ["record_id", "kind", "received_at", "sequence"]


def test_sample_does_not_grow_with_tasks(spark):
    """The keys that reach the driver are some per split, from one task or from many."""
    df = spark.range(200_000).select("id")
    for tasks in (1, 64):
        cut = numbering.cut_splits(df.repartition(tasks), ("id",), 10)
        sizes = [b - a for (a,), (b,) in zip(cut.bounds, cut.bounds[1:])]
        assert len(cut.bounds) == 10 and max(sizes) < 60_000


def test_sequence_of_copies(spark):
    df = spark.createDataFrame([("x", START)] * 300 + [("y", START)] * 9, "text string, received_at timestamp")
    got = with_sequence(with_arrival_id(df.repartition(6)), ("received_at", "record_id"), splits=8)
    assert sorted(r.sequence for r in got.collect()) == list(range(1, 310))
    # The ids are unique, so copies spread over the splits.
    assert got.select("record_id").distinct().count() == 309


def test_prefix_sums(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("v"))
    got = prefix_sums(df, "id", {"v": "total"}, block=64).orderBy("id").collect()
    assert [r.total for r in got] == [sum(j % 7 for j in range(i + 1)) for i in range(1000)]


def test_throughput_by_count(spark):
    rows = make(4, 130)
    df = with_sequence(frame(spark, rows), ("received_at", "record_id")).withColumn("dropped", F.col("record_id") % 3 == 0)
    got = reports.throughput_by_count(df, 25).orderBy("report").collect()
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    last, processed, dropped = ordered[0][2], 0, 0
    for i, report in enumerate(got):
        chunk = ordered[25 * i : 25 * i + 25]
        seconds = (chunk[-1][2] - last).total_seconds()
        processed += len(chunk)
        dropped += sum(r[0] % 3 == 0 for r in chunk)
        assert (report.messages, report.processed, report.dropped) == (len(chunk), processed, dropped)
        assert report.seconds == pytest.approx(seconds) and report.rate == pytest.approx(len(chunk) / (seconds + 1e-10))
        last = chunk[-1][2]
    assert processed == 130
