"""The recording timer: time spent reading and words a minute, as a table and as a stream with the same rows.

Events are (reader, ts, seq, action, position): start, pause, toggle, track and reset; position counts the words before
the reader's place. Time counts while the timer runs; words are those between the place where it was first started and the
last place tracked while it ran. A pace is known from MIN_MS of counted time on; the moment when it becomes known while
the timer runs is a row of its own, `known`. Reset forgets all.

paces() finds stretches of running time by windows (gaps and islands): what runs after an event is the last start, pause or
reset, turned over by each toggle since. pace_stream() keeps a reader's timer as state; events wait until the watermark
has passed them, so they are taken in the order of their times whatever the order of arrival, and a timer in event
time reports the known pace without waiting for another event.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MIN_MS = 20_000
PACE = "reader long, ts timestamp, seq long, action string, running boolean, elapsed_ms long, words long, wpm long"
KNOWN = "known"


def paces(events: DataFrame, until: str | None = None) -> DataFrame:
    """PACE of every event and known moment; of the known moments, those up to `until`, the last event of all by default. Events without reader or time are left out."""
    rows = events.filter("reader is not null and ts is not null").select("reader", "ts", "seq", "action", "position", F.unix_micros("ts").alias("at"))
    along = Window.partitionBy("reader").orderBy("ts", "seq")
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    sets = F.col("action").isin("start", "pause", "reset")
    rows = rows.withColumns({"island": F.sum(sets.cast("int")).over(upto), "toggles": F.sum((F.col("action") == "toggle").cast("int")).over(upto), "life": F.sum((F.col("action") == "reset").cast("int")).over(upto)})
    of_island = Window.partitionBy("reader", "island").orderBy("ts", "seq")
    first = F.first(F.struct((F.col("action") == "start").cast("int").alias("on"), "toggles")).over(of_island)
    value = F.when(F.col("island") == 0, F.struct(F.lit(0).alias("on"), F.lit(0).cast("long").alias("toggles"))).otherwise(first)
    rows = rows.withColumn("first", value).withColumn("running", (F.col("first.on") + F.col("toggles") - F.col("first.toggles")) % 2 == 1)
    rows = rows.withColumns({"ran": F.coalesce(F.lag("running").over(along), F.lit(False)), "last_at": F.lag("at").over(along), "next_at": F.lead("at").over(along)})
    of_life = Window.partitionBy("reader", "life").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.when(F.col("ran") & (F.col("action") != "reset"), F.col("at") - F.col("last_at")).otherwise(0)
    rows = rows.withColumn("micros", F.sum(counted).over(of_life)).withColumn("began", F.first(F.when(F.col("running") & ~F.col("ran"), F.col("position")), ignorenulls=True).over(of_life))
    tracked = F.when((F.col("action") == "track") & F.col("running"), F.greatest(F.col("position") - F.col("began"), F.lit(0)))
    rows = rows.withColumn("words", F.coalesce(F.last(tracked, ignorenulls=True).over(of_life), F.lit(0)).cast("long"))
    end = F.unix_micros(F.lit(events.agg(F.max("ts")).first()[0] if until is None else until).cast("timestamp"))
    rest = MIN_MS * 1000 - F.col("micros")
    moment = F.col("at") + rest
    soon = rows.filter(F.col("running") & (rest > 0) & (moment <= F.coalesce("next_at", moment))).filter(moment <= end)
    known = soon.select("reader", F.timestamp_micros(moment).alias("ts"), F.lit(None).cast("long").alias("seq"), F.lit(KNOWN).alias("action"), "running", F.lit(MIN_MS * 1000).cast("long").alias("micros"), "words")
    return _measured(rows.select("reader", "ts", "seq", "action", "running", "micros", "words").unionByName(known))


def _measured(rows: DataFrame) -> DataFrame:
    """PACE of rows with micros."""
    rows = rows.withColumn("elapsed_ms", F.floor(F.col("micros") / 1000))
    wpm = F.when((F.col("elapsed_ms") >= MIN_MS) & (F.col("words") > 0), F.floor(F.col("words") / (F.col("elapsed_ms") / 60_000) + 0.5))
    return rows.select("reader", "ts", "seq", "action", "running", "elapsed_ms", "words", wpm.cast("long").alias("wpm"))


RAW = "reader long, ts timestamp, seq long, action string, running boolean, micros long, words long"
NAMES = [x.split()[0] for x in RAW.split(", ")]


class Timer(StatefulProcessor):
    """A reader's timer. State: the timer itself, and the events that the watermark has not passed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("timer", "running boolean, micros long, last_at long, began long, words long")
        self.waiting = handle.getListState("waiting", "at long, seq long, action string, position long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            events = [(int(t.value) // 1000, int(s), a, None if pd.isna(p) else int(p)) for t, s, a, p in zip(batch["ts"], batch["seq"], batch["action"], batch["position"])]
            if events:
                self.waiting.appendList(events)
                for at in {_timer(e[0]) for e in events}:
                    self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # All up to the watermark has come, so the first of several timers that are due does the work of all.
        to, out = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()), []
        events = sorted(self.waiting.get()) if self.waiting.exists() else []
        due, rest = [e for e in events if _timer(e[0]) <= to], [e for e in events if _timer(e[0]) > to]
        if due and rest:
            self.waiting.put(rest)
        elif due:
            self.waiting.clear()
        state = self.now.get() if self.now.exists() else (False, 0, 0, None, 0)
        for at, seq, action, position in due:
            state, rows = stepped(state, at, action, position)
            out += [(key[0], at_, None if kind == KNOWN else seq, kind, *values) for kind, at_, *values in rows]
        state, rows = stepped(state, to * 1000, None, None)
        out += [(key[0], at_, None, kind, *values) for kind, at_, *values in rows]
        self.now.update(state)
        if state[0] and state[1] < MIN_MS * 1000:  # when the pace will be known, if nothing happens
            self.handle.registerTimer(_timer(state[2] + MIN_MS * 1000 - state[1]))
        frame = pd.DataFrame(out, columns=NAMES)
        frame["ts"] = pd.to_datetime(frame["ts"], unit="us")
        yield frame.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _timer(at: int) -> int:
    """The millisecond by which a microsecond has passed."""
    return -(-at // 1000)


def stepped(state: tuple, at: int, action: str | None, position: int | None) -> tuple[tuple, list[tuple]]:
    """The state after an event (without action: after time has passed), and rows (action, at, running, micros, words)."""
    running, micros, last_at, began, words = state
    rows = []
    if running:
        left = MIN_MS * 1000 - micros
        if 0 < left <= at - last_at:
            rows.append((KNOWN, last_at + left, True, MIN_MS * 1000, words))
        if action is None:
            return (running, micros + left, last_at + left, began, words) if rows else state, rows
        micros += at - last_at
    if action is None:
        return state, rows
    turns_on = not running and action in ("start", "toggle")
    if action == "reset":
        running, micros, began, words = False, 0, None, 0
    elif action == "pause" or (action == "toggle" and running):
        running = False
    elif turns_on:
        running, began = True, position if began is None else began
    elif action == "track" and running and position is not None and began is not None:
        words = max(0, position - began)
    rows.append((action, at, running, micros, words))
    return (running, micros, at, began, words), rows


def pace_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """PACE of a stream of events, once the watermark has passed them. Needs the RocksDB state store."""
    rows = events.filter("reader is not null and ts is not null").select("reader", "ts", "seq", "action", "position").withWatermark("ts", late)
    return _measured(rows.groupBy("reader").transformWithStateInPandas(Timer(), RAW, "Append", "EventTime"))
