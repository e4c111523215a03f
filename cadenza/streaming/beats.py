"""Structured Streaming: beat and tempo tracking, windows and densities, with their batch twins.

Event time is ``ts``; rows later than the watermark go. The stateful tracker keeps a
few numbers per track (last beat and the last intervals) and the rows that the
watermark has not passed yet, whatever the stream's length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WATERMARK = "10 seconds"
BEAT_SCHEMA = "track_id long, us long, tempo double"
STATE_SCHEMA = "last long, history array<double>, tempo double"


def prepare(events: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Rows once by ``event_id`` within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def track(us: np.ndarray, activation: np.ndarray, state: tuple, threshold: float, min_us: int, low: float, high: float, keep: int, unit: float, start: float, idle_us: int | None) -> tuple[list, tuple]:
    """Beats (us, tempo) of ordered rows and the next state (last beat, intervals, tempo). After a silence of more than
    ``idle_us`` a track begins anew."""
    last, history, tempo = state
    out = []
    for t, a in zip(us.tolist(), activation.tolist(), strict=True):
        if last is not None and idle_us is not None and t - last > idle_us:
            last, history, tempo = None, [], start
        if a < threshold or (last is not None and t - last < min_us):
            continue
        if last is not None:
            dt = (t - last) / unit
            if low < dt < high:
                history = (history + [dt])[-keep:]
                tempo = 60 / float(np.median(history))
        last = t
        out.append((t, tempo))
    return out, (last, history, tempo)


def _args(threshold: float, min_interval: float, low: float, high: float, history: int, unit: float, start: float, idle: float | None) -> tuple:
    return threshold, int(min_interval * unit), low, high, history, unit, start, None if idle is None else int(idle * unit)


class OrderedBeats(StatefulProcessor):
    """The tracker behind an ordering buffer in event time.

    Rows wait in list state until the watermark has passed them, and are then folded in
    order of time, so that rows which come late or in another micro-batch change nothing
    as long as the watermark lets them in. A timer at the oldest waiting row wakes the
    track; when nothing waits, a timer after the silent interval takes its state away.
    """

    def __init__(self, args: tuple, start: float, idle_us: int | None, per_us: float, last_only: bool):
        self.args, self.start, self.idle_us, self.per_us, self.last_only = args, start, idle_us, per_us, last_only

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, activation double, ms long")
        self.now = handle.getValueState("now", STATE_SCHEMA)

    def _wake(self, ms: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        ms = new["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
        added = [(int(u), float(a), int(m)) for u, a, m in zip(new["us"], new["activation"], ms, strict=True)]
        self.waiting.appendList(added)
        self._wake(min([m for _, _, m in self.waiting.get()], default=0) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.waiting.get())
        due, later = [w for w in waiting if w[2] < mark], [w for w in waiting if w[2] >= mark]
        now = (None, [], self.start)
        if self.now.exists():
            last, past, tempo = self.now.get()
            now = (last, list(past), tempo)
        beats, now = track(np.array([w[0] for w in due], np.int64), np.array([w[1] for w in due], float), now, *self.args)
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self._wake(later[0][2] + 1)
        elif self.idle_us is not None and now[0] is not None and not due:
            self.now.clear()  # the silent interval is over
            now = (None, [], self.start)
        elif self.idle_us is not None and now[0] is not None:
            self._wake(max(w[2] for w in due) + int(self.idle_us * self.per_us) + 1)
        if now[0] is not None:
            self.now.update((int(now[0]), [float(x) for x in now[1]], float(now[2])))
        if beats:
            yield pd.DataFrame([(key[0], t, bpm) for t, bpm in (beats[-1:] if self.last_only else beats)], columns=["track_id", "us", "tempo"])

    def close(self) -> None:
        pass


def _ordered(events: DataFrame, args: tuple, start: float, idle_us: int | None, per_us: float, last_only: bool) -> DataFrame:
    return events.select("track_id", "ts", "us", "activation").groupBy("track_id").transformWithStateInPandas(OrderedBeats(args, start, idle_us, per_us, last_only), BEAT_SCHEMA, "Append", "EventTime")


def stream_beats(
    events: DataFrame, threshold: float = 0.5, min_interval: float = 0.2, low: float = 0.2, high: float = 2.0, history: int = 8, unit: float = 1e6, start_tempo: float = 120.0, idle: float | None = None, ms_per_us: float = 1e-3
) -> DataFrame:
    """A stream of (track_id, ts, us, activation), with a watermark on ``ts``, to beats (track_id, us, tempo) with the running tempo.

    Rows are folded in order of time once the watermark has passed them, whatever
    micro-batch brought them. With ``idle`` (in units, as the other intervals) a track
    begins anew after that silence, and its state goes then. ``ms_per_us`` relates ``us``
    to ``ts``. Needs the RocksDB state store.
    """
    args = _args(threshold, min_interval, low, high, history, unit, start_tempo, idle)
    return _ordered(events, args, start_tempo, args[-1], ms_per_us, False)


def stream_tempo(
    beats: DataFrame, history: int = 8, low: float = 0.2, high: float = 2.0, unit: float = 1e6, start_tempo: float = 120.0, idle: float | None = None, ms_per_us: float = 1e-3
) -> DataFrame:
    """A stream of beats (track_id, ts, us), with a watermark on ``ts``, to each track's tempo after its last beat so far (track_id, us,
    tempo): a row for each track whenever the watermark passes beats of it. The last row of a track is ``last_tempo`` of its beats."""
    args = _args(0.5, 0.0, low, high, history, unit, start_tempo, idle)
    return _ordered(beats.withColumn("activation", F.lit(1.0)), args, start_tempo, args[-1], ms_per_us, True)


def batch_beats(
    events: DataFrame, threshold: float = 0.5, min_interval: float = 0.2, low: float = 0.2, high: float = 2.0, history: int = 8, unit: float = 1e6, start_tempo: float = 120.0, idle: float | None = None
) -> DataFrame:
    """The same fold over a finished table: one track is one group."""
    args = _args(threshold, min_interval, low, high, history, unit, start_tempo, idle)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "activation"], kind="stable")
        beats, _ = track(pdf["us"].to_numpy(), pdf["activation"].to_numpy(), (None, [], start_tempo), *args)
        return pd.DataFrame([(pdf["track_id"].iloc[0], t, bpm) for t, bpm in beats], columns=["track_id", "us", "tempo"])

    return events.select("track_id", "us", "activation").groupBy("track_id").applyInPandas(run, BEAT_SCHEMA)


def last_tempo(beats: DataFrame, history: int = 8, low: float = 0.2, high: float = 2.0, unit: float = 1e6, start_tempo: float = 120.0) -> DataFrame:
    """Tempo of each track after its last beat: 60 over the median of the last ``history`` valid intervals."""
    w = Window.partitionBy("track_id").orderBy("us")
    dt = beats.withColumn("dt", (F.col("us") - F.lag("us").over(w)) / unit)
    ok = dt.where((F.col("dt") > low) & (F.col("dt") < high))
    late = ok.withColumn("_r", F.row_number().over(Window.partitionBy("track_id").orderBy(F.desc("us")))).where(F.col("_r") <= history)
    by = late.groupBy("track_id").agg((60 / F.percentile("dt", F.lit(0.5))).alias("tempo"))
    return beats.select("track_id").distinct().join(by, "track_id", "left").select("track_id", F.coalesce("tempo", F.lit(start_tempo)).alias("tempo"))


def recent_beats(events: DataFrame, length: str = "5 seconds", slide: str = "1 second") -> DataFrame:
    """Beats of each track in sliding windows; works on streams (give a watermark) and tables."""
    return events.groupBy("track_id", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("track_id", F.col("w.start").alias("start"), "n")


def buffered_windows(events: DataFrame, length: str = "2 seconds", slide: str = "1 second", value: str = "value") -> DataFrame:
    """Half-overlapping windows with count and mean, the shape of a rolling analysis buffer."""
    return events.groupBy("track_id", F.window("ts", length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select("track_id", F.col("w.start").alias("start"), "n", "mean")


def stream_density(events: DataFrame, length: str = "5 seconds") -> DataFrame:
    """Events per type in tumbling windows."""
    return events.groupBy("type", F.window("ts", length).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("type", F.col("w.start").alias("start"), "n")


def file_beats(frames: DataFrame, threshold: float = 0.5, min_interval: float = 0.2, unit: float = 1e6) -> DataFrame:
    """First frame of each run of active frames, then the tracker's least interval, session by session: a frame at least that far
    behind the one before is a beat whatever came before it."""
    from ..operators.folds import picked
    from ..operators.windows import sessions

    w = Window.partitionBy("track_id").orderBy("us")
    on = (F.col("activation") >= threshold).cast("int")
    first = frames.withColumn("_on", on).withColumn("_was", F.lag(on).over(w)).where("_on = 1 AND coalesce(_was, 0) = 0").select("track_id", "us")
    least = int(min_interval * unit)

    def pick(begins: np.ndarray, us: np.ndarray) -> list[int]:
        starts, kept, last = set(begins.tolist()), [], None
        for i, t in enumerate(us.tolist()):
            if i in starts or t - last >= least:
                kept.append(i)
                last = t
        return kept

    return picked(sessions(first, ["track_id"], "us", least), ["track_id", "_session"], ["us"], ["us"], pick, ["track_id", "us"])


def on_beats(beats: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands every micro-batch of beats to a callback."""
    return beats.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def apply_to_segments(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema, keys: list[str] | None = None) -> DataFrame:
    """A user's function over bounded chunks (no keys) or over whole groups of ``keys``."""
    if keys:
        return df.groupBy(*keys).applyInPandas(fn, schema)

    def rows(batches):
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(rows, schema)
