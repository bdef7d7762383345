import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkwarden.operators import scoring
from sparkwarden.plans.queries import QUERIES
from sparkwarden.sources.logs import read_log
from sparkwarden.streaming import jobs

SF = "/root/testdata/sf0.1"


def test_the_stream_equals_the_batch_chain(spark):
    """First clicks of feedback_unless_closed, row by row, on a table with closed and reported notifications."""
    got = QUERIES["stream_feedback"](spark, SF).collect()
    first = {r.shown_id for r in QUERIES["feedback_first_click"](spark, SF).collect()}
    open_ = {r.shown_id for r in QUERIES["feedback_unless_closed"](spark, SF).collect()}
    assert len(got) == len({r.shown_id for r in got}) and {r.shown_id for r in got} == open_ <= first
    assert len(got) > 10


def test_batches_closes_and_late_clicks(spark, tmp_path):
    """Over three batches: a click before anything, two clicks on one notification, a close before a click, a click after five minutes, one of no id."""
    shown = "values (1L, 7L, timestamp'2024-01-01 00:10:00', 'u'), (2L, 7L, timestamp'2024-01-01 01:00:00', 'u'), (3L, 8L, timestamp'2024-01-01 01:00:00', 'v'), (4L, 9L, timestamp'2024-01-01 01:00:00', 'w'), (5L, null, timestamp'2024-01-01 01:00:00', 'x')"
    spark.sql(f"select * from {shown} as t(shown_id, id, shown_ts, url)").coalesce(1).write.parquet(f"{tmp_path}/shown")
    batches = [
        ("(7L, timestamp'2024-01-01 00:00:00', 1), (7L, timestamp'2024-01-01 00:10:30', 0)", "(1L, timestamp'2024-01-01 00:00:00')"),
        ("(7L, timestamp'2024-01-01 01:02:00', 1), (7L, timestamp'2024-01-01 01:03:00', 0)", "(8L, timestamp'2024-01-01 01:00:30')"),
        ("(8L, timestamp'2024-01-01 01:01:30', 1), (9L, timestamp'2024-01-01 01:05:00', 1), (null, timestamp'2024-01-01 01:01:00', 1)", "(9L, timestamp'2024-01-01 02:00:00')"),
    ]
    for clicks, closes in batches:
        spark.sql(f"select * from values {clicks} as t(id, click_ts, button)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/clicks")
        spark.sql(f"select * from values {closes} as t(id, close_ts)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/closes")
        hour = 9 if clicks == batches[-1][0] else 0  # reports come out when time has passed them
        spark.sql(f"select timestamp'2024-01-01 0{hour}:00:00' as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        streams = [jobs.read_parquet_stream(spark, f"{tmp_path}/{n}", "*.parquet") for n in ("shown", "clicks", "closes", "ticks")]
        jobs.feedback_stream(*streams[:3], f"{tmp_path}/out", f"{tmp_path}/state", late="2 hours", once=True, ticks=streams[3]).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.shown_id, r.id, r.url, r.reported_label) for r in got) == [(1, 7, "u", 0), (2, 7, "u", 1)]


def test_a_repeated_batch_writes_once(spark, tmp_path):
    """score_stream's batches overwrite their own folder, keep null URLs on the model's side, and take a trusted list."""
    rows = "values ('http://a.b/x', 'complete'), ('http://www.trust.me/', 'complete'), ('http://a.b/y', 'loading')"
    spark.sql(f"select * from {rows} as t(url, status)").coalesce(1).write.parquet(f"{tmp_path}/in")
    model = lambda df: df.withColumns({"prediction": F.lit(1), "probability": F.lit(-1.0)})
    for state in ("one", "two"):  # a fresh state replays the batch
        jobs.score_stream(jobs.read_parquet_stream(spark, f"{tmp_path}/in", "*.parquet"), model, f"{tmp_path}/out", f"{tmp_path}/{state}", f"{tmp_path}/log", once=True, trusted=("trust.me",)).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.url, r.prediction, r.whitelisted) for r in got) == [("http://a.b/x", 1, False), ("http://www.trust.me/", 0, True)]
    assert read_log(spark, f"{tmp_path}/log", scoring.LOG).count() == 1
    nulls = spark.sql("select cast(null as string) as url, 'complete' as status")
    assert [r.whitelisted for r in scoring.score(nulls, model).collect()] == [False]


EVENTS = st.lists(st.tuples(st.integers(0, 12).map(lambda m: m * 60_000_000 + 1), st.sampled_from([jobs.SHOWN, jobs.CLOSE, jobs.CLICK, jobs.TICK]), st.integers(0, 2)), max_size=30)


@given(EVENTS, st.integers(0, 30))
def test_released_equals_the_definition(events, cut):
    """Whatever is open goes through two calls as through one, and a report is the first click within five minutes that no close came before."""
    events = sorted(((at, kind, button, str(k), "u") for k, (at, kind, button) in enumerate(events)), key=jobs._order)
    live = deque()
    got = list(jobs.released(live, events[:cut])) + list(jobs.released(live, events[cut:]))
    want = []
    for at, kind, _, shown_id, url in events:
        if kind == jobs.SHOWN:
            later = [e for e in events if e[1] in (jobs.CLICK, jobs.CLOSE) and at <= e[0] < at + jobs.LIFE]
            if later and later[0][1] == jobs.CLICK:
                want.append((shown_id, url, int(later[0][2] != 0), later[0][0]))
    assert sorted(got) == sorted(want)


def random_events(seed, ids=12, n=260):
    """(kind, id, ts, button or number) over two hours, many of them close together."""
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    return [(rng.choice(["shown", "shown", "clicks", "closes"]), f"note-{rng.randrange(ids)}-é", start + timedelta(minutes=rng.randrange(120), microseconds=rng.choice([0, 0, 1, 500, 999_999])), k) for k in range(n)]


def frame(spark, kind, events):
    columns = {"shown": "shown_id string, id string, shown_ts timestamp, url string", "clicks": "id string, click_ts timestamp, button int", "closes": "id string, close_ts timestamp"}
    rows = {"shown": lambda i, ts, k: (f"n{k}", i, ts, f"http://u/{k}"), "clicks": lambda i, ts, k: (i, ts, k % 3), "closes": lambda i, ts, k: (i, ts)}
    return spark.createDataFrame([rows[kind](i, ts, k) for x, i, ts, k in events if x == kind], columns[kind])


@pytest.mark.parametrize("seed, late", [(1, "5 hours"), (2, "21 minutes")])
def test_any_order_within_the_lateness_gives_the_batch_chain(spark, tmp_path, seed, late):
    """Text ids; random batches, in any order at all or each event up to twenty minutes behind; two runs on one checkpoint."""
    events = random_events(seed)
    shown, clicks, closes = (frame(spark, kind, events) for kind in ("shown", "clicks", "closes"))
    open_ = scoring.unless_closed(scoring.clicks_on_live(shown, clicks), closes)
    want = {(r.shown_id, r.id, r.url, r.reported_label, r.timestamp) for r in scoring.first_click(open_, ("shown_id",)).select("shown_id", "id", "url", scoring.button_label(F.col("button")).alias("reported_label"), F.col("click_ts").alias("timestamp")).collect()}
    rng = random.Random(seed)
    arrival = (lambda e: rng.random()) if late == "5 hours" else lambda e: e[2] + timedelta(minutes=20) * rng.random()
    order = sorted(events, key=arrival)
    cuts = [0, *sorted(rng.sample(range(1, len(order)), 4)), len(order)]
    for half in (range(3), range(3, 6)):
        for k in half:
            part = order[cuts[k] : cuts[k + 1]] if k < 5 else []
            for kind in ("shown", "clicks", "closes"):
                frame(spark, kind, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{kind}")
            spark.createDataFrame([(datetime(2024, 1, 1, 0 if k < 5 else 23),)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        streams = [jobs.read_parquet_stream(spark, f"{tmp_path}/{n}", "*.parquet", per_batch=1) for n in ("shown", "clicks", "closes", "ticks")]
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        jobs.feedback_stream(*streams[:3], f"{tmp_path}/out", f"{tmp_path}/state", late=late, once=True, ticks=streams[3]).awaitTermination()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 15


def test_a_click_may_arrive_before_its_notification(spark, tmp_path):
    for k, (kind, events) in enumerate([("clicks", [("clicks", "a", datetime(2024, 1, 1, 0, 0, 20), 1)]), ("shown", [("shown", "a", datetime(2024, 1, 1, 0, 0, 10), 5)])]):
        for name in ("shown", "clicks", "closes"):
            frame(spark, name, events if name == kind else []).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        spark.createDataFrame([(datetime(2024, 1, 1, k * 5),)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/ticks")
        streams = [jobs.read_parquet_stream(spark, f"{tmp_path}/{n}", "*.parquet") for n in ("shown", "clicks", "closes", "ticks")]
        jobs.feedback_stream(*streams[:3], f"{tmp_path}/out", f"{tmp_path}/state", late="1 hour", once=True, ticks=streams[3]).awaitTermination()
    assert [(r.shown_id, r.reported_label) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("n5", 1)]


def test_feedback_as_a_log(spark, tmp_path):
    """Reports as batches of a log, which a run on a fresh state does not write twice."""
    for kind, events in (("shown", [("shown", "a", datetime(2024, 1, 1), 5)]), ("clicks", [("clicks", "a", datetime(2024, 1, 1, 0, 1), 0)]), ("closes", [])):
        frame(spark, kind, events).coalesce(1).write.parquet(f"{tmp_path}/{kind}")
    spark.createDataFrame([(datetime(2024, 1, 2),)], "ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/ticks")
    for state in ("one", "two"):
        streams = [jobs.read_parquet_stream(spark, f"{tmp_path}/{n}", "*.parquet") for n in ("shown", "clicks", "closes", "ticks")]
        jobs.feedback_stream(*streams[:3], None, f"{tmp_path}/{state}", once=True, ticks=streams[3], log=f"{tmp_path}/log").awaitTermination()
    assert [(r.shown_id, r.reported_label) for r in read_log(spark, f"{tmp_path}/log", "shown_id string, id string, url string, reported_label int, timestamp timestamp").collect()] == [("n5", 0)]
