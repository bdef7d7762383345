"""Continuous scoring and feedback."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from sparkwarden.operators import scoring
from sparkwarden.sources.logs import append_log

#: Kinds of events, in the order in which those of one time count; a tick only says that time has passed.
SHOWN, CLOSE, CLICK, TICK = 0, 1, 2, 3
LIFE = 5 * 60 * 1_000_000  # microseconds that a notification lives


def score_stream(visits: DataFrame, model: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, log: str | None = None, once: bool = False, trusted: tuple[str, ...] = scoring.TRUSTED) -> StreamingQuery:
    """Score completed visits (url, status, ...) as they arrive; each batch writes its verdicts, and its untrusted part to the log.

    Verdicts are in folders by batch (`batch=<number>`); a batch that is tried again overwrites its own. The log takes each batch once (sources.logs). So nothing is written twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        scored = scoring.message(scoring.score(scoring.completed(df), model, trusted)).persist()
        scored.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if log:
            append_log(scoring.prediction_log(scored), log, number)
        scored.unpersist()

    writer = visits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


_EVENT = "at long, kind int, button int, shown_id string, url string"
_LIVE = "at long, shown_id string, url string"
_SAID = "shown_id string, id string, url string, reported_label int, at long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def released(live: deque, events: list[tuple]) -> Iterator[tuple]:
    """What one id's events, in the order of their time, report: a notification opens, a close ends what is open, a click reports on all that is open and ends it.

    live holds the open notifications (at, shown_id, url), oldest first, and is left as it is after the last event. Yields (shown_id, url, label, at).
    """
    for at, kind, button, shown_id, url in events:
        while live and live[0][0] + LIFE <= at:
            live.popleft()
        if kind == SHOWN:
            live.append((at, shown_id, url))
        if kind == CLICK:
            yield from ((of, where, 0 if button == 0 else 1, at) for _, of, where in live)
        if kind in (CLICK, CLOSE):
            live.clear()


class Feedback(StatefulProcessor):
    """One id's events wait until the watermark has passed them, and so no earlier one can come; then they count in the order of their time.

    Both states are lists: `waiting` is only appended to until something is due, `live` is what is open. A timer stands at the first
    event that waits, or where the last notification ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.live = handle.getListState("waiting", _EVENT), handle.getListState("live", _LIVE)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = [(r.at, r.kind, r.button, r.shown_id, r.url) for r in rows]
        self.waiting.appendList(events)
        self.handle.registerTimer(_timer(min(e[0] for e in events)))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [tuple(e) for e in self.waiting.get()]
        due = sorted((e for e in waiting if e[0] <= passed), key=_order)
        live = deque(tuple(x) for x in self.live.get())
        for shown_id, url, label, at in released(live, due):
            yield Row(shown_id=shown_id, id=key[0], url=url, reported_label=label, at=at)
        while live and live[0][0] + LIFE <= passed:
            live.popleft()
        left = [e for e in waiting if e[0] > passed]
        for state, rows in ((self.waiting, left), (self.live, list(live))):
            if rows:
                state.put(rows)
            else:
                state.clear()
        if left:
            self.handle.registerTimer(_timer(min(e[0] for e in left)))
        elif live:
            self.handle.registerTimer(_timer(live[-1][0] + LIFE))

    def close(self) -> None:
        pass


def _timer(at: int) -> int:
    """The first millisecond that is not before a time in microseconds."""
    return -(-at // 1000)


def _order(e: tuple) -> tuple:
    """By time, kind, then button and notification, nulls first."""
    at, kind, button, shown_id, _ = e
    return at, kind, button is not None, button or 0, shown_id is not None, shown_id or ""


def feedback_stream(shown: DataFrame, clicks: DataFrame, closes: DataFrame, out: str | None, checkpoint: str, late: str = "1 minute", once: bool = False, ticks: DataFrame | None = None, log: str | None = None) -> StreamingQuery:
    """Feedback on notifications (shown_id, id, shown_ts, url) from clicks (id, click_ts, button) and closes (id, close_ts), in the order of event time.

    The first click within five minutes reports, once; a close before it (or at its time) voids it. However events arrive and whatever batches they fall in, the result is
    that of the batch chain, as long as none comes later than `late` behind the newest; such rows are dropped, as everywhere in Spark. Reports come out when the watermark has
    passed their click, as files of `out`, or, where a `log` is given instead, as batches of that log. ticks(ts) are times that pass without events: they move the watermark and nothing else. Ids are of any type that has a text form, and come back in the type
    of `shown`. Rows without id or time are left out. State is kept by RocksDB; the session's own setting stays as it is.
    """
    spark, none = shown.sparkSession, lambda t: F.lit(None).cast(t)
    event = lambda df, id_, ts, kind, number, url, button: df.select(id_.cast("string").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.lit(kind).alias("kind"), button.cast("int").alias("button"), number.cast("string").alias("shown_id"), url.cast("string").alias("url"))
    events = event(shown, F.col("id"), "shown_ts", SHOWN, F.col("shown_id"), F.col("url"), none("int"))
    events = events.unionByName(event(closes, F.col("id"), "close_ts", CLOSE, none("string"), none("string"), none("int")))
    events = events.unionByName(event(clicks, F.col("id"), "click_ts", CLICK, none("string"), none("string"), F.col("button")))
    if ticks is not None:
        events = events.unionByName(event(ticks, F.lit(""), "ts", TICK, none("string"), none("string"), none("int")))
    events = events.withWatermark("ts", late).where("id is not null and ts is not null").withColumn("at", F.unix_micros("ts"))
    types = {c: shown.schema[c].dataType for c in ("shown_id", "id")}
    said = events.groupBy("id").transformWithState(Feedback(), _SAID, "append", "eventTime")
    records = said.select(*(F.col(c).cast(t).alias(c) for c, t in types.items()), "url", "reported_label", F.timestamp_micros("at").alias("timestamp"))
    def logged(df: DataFrame, number: int) -> None:
        if not append_log(df, log, number):
            df.write.format("noop").mode("overwrite").save()  # the log has it, but the state still has to be brought up to this batch

    writer = records.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(logged) if log else writer.format("parquet").option("path", out)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)  # a query keeps the settings that it starts with
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(key, before)


def read_parquet_stream(spark: SparkSession, folder: str, pattern: str, per_batch: int | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder that match a name pattern, at most `per_batch` of them a batch."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    return (reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(folder)
