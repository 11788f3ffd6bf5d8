"""Answer streams: first answer per question, accuracy per time window."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# the state function travels with its helper, so executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: State outside the heap, for more keys than fit into memory; sessions and their timers need it.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
OUT = "session_id bigint, q_idx bigint, epoch int, chosen int, ts timestamp, event_id bigint"
#: Stands for a null question among the keys of a session's map.
NO_QUESTION = -(1 << 62)


class FirstAnswers(StatefulProcessor):
    """State of one session: its epoch, and a map of the questions answered in it.

    A reset ends the epoch and empties the map. With ``forget`` (milliseconds) a timer ends the whole state when
    event time has passed the session's last event by that much."""

    def __init__(self, forget: int | None = None):
        self.forget = forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.epoch = handle.getValueState("epoch", "epoch int")
        self.answered = handle.getMapState("answered", "q_idx bigint", "event_id bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        session = key[0]
        events = sorted(((r.ts, r.event_id, r.kind, r.q_idx, r.chosen) for r in rows), key=lambda e: (
            e[0] is not None, e[0] or dt.datetime.min, e[1] is not None, e[1] or 0))
        epoch = self.epoch.get()[0] if self.epoch.exists() else 0
        known: set = {None if k[0] == NO_QUESTION else k[0] for k in self.answered.keys()}
        fresh: dict = {}
        reset = False
        for at, event, kind, question, chosen in events:
            if kind == "reset":
                epoch, reset = epoch + 1, True
                known, fresh = set(), {}
            elif question not in known:
                known.add(question)
                fresh[question] = event
                yield Row(session_id=session, q_idx=question, epoch=epoch, chosen=chosen, ts=at, event_id=event)
        if reset:
            self.answered.clear()
        self.epoch.update((epoch,))
        for question, event in fresh.items():
            self.answered.updateValue((question if question is not None else NO_QUESTION,), (event,))
        if self.forget is not None and events and events[-1][0] is not None:
            last = int(events[-1][0].replace(tzinfo=events[-1][0].tzinfo or dt.timezone.utc).timestamp() * 1000)
            due = max(last, timerValues.getCurrentWatermarkInMs()) + self.forget
            for timer in list(self.handle.listTimers()):
                due = max(due, timer)
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.epoch.clear()
        self.answered.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_answers(events: DataFrame, forget: str | None = None) -> DataFrame:
    """The first answer per session, question and epoch of a stream with ``session_id,
    q_idx, chosen, ts, event_id, kind``; a reset (``kind = 'reset'``) opens the next epoch of its session.

    Later answers of an epoch are ignored, as a given answer cannot be changed. With ``forget`` (a duration) a session's
    state ends when event time has passed its last event by that much; an answer that comes later starts anew. A
    session's events of one batch are ordered in memory, so limit the files of a batch where one session
    is busy. State is kept in RocksDB, see :func:`run_to_table`.
    """
    wait = pd.Timedelta(forget).value // 1_000_000 if forget else None
    return events.groupBy("session_id").transformWithState(
        FirstAnswers(wait), OUT, "append", "EventTime" if forget else "None",
    )


def windowed_accuracy(
    answers: DataFrame, window: str = "1 day", slide: str | None = None, gap: str | None = None,
    late: str = "1 hour", distinct: bool = False,
) -> DataFrame:
    """``start, end, answers, correct`` per event-time window of a stream with ``ts,
    chosen, correct_idx``: tumbling, sliding (``slide``) or session windows (``gap``).

    Answers later than ``late`` are dropped; ``distinct`` drops repeats of a question
    that arrive within that time.
    """
    marked = answers.withWatermark("ts", late)
    if distinct:
        marked = marked.dropDuplicatesWithinWatermark(["session_id", "q_idx"])
    if gap:
        frame, keys = F.session_window("ts", gap), ["session_id"]
    else:
        frame, keys = F.window("ts", window, slide), []
    counts = marked.groupBy(frame.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("answers"),
        F.count_if(F.col("chosen") == F.col("correct_idx")).alias("correct"),
    )
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "answers", "correct")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what is there and stop; results and progress survive a restart."""
    spark = stream.sparkSession
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)
