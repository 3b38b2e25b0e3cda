"""Event spotting on streams: sessions of hits, running reference state, event-to-window joins.

Late rows: anything older than the watermark is dropped by Spark; other data gives the same events as the batch
operators, however it is cut into batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orbweave.functions.lineage import checkpoint_dir


def hit_sessions(hits: DataFrame, keys: Sequence[str], ts: str = "ts", gap: str = "2 seconds",
                 delay: str = "0 seconds", min_hits: int = 2) -> DataFrame:
    """Events closed after a silent gap: count, first and last hit, closest hit."""
    s = hits.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), *keys).agg(
        F.count(F.lit(1)).alias("n_hits"), F.min(ts).alias("t_first"), F.max(ts).alias("t_last"),
        F.min(F.struct("dist", ts)).alias("_best"))
    return s.filter(F.col("n_hits") >= min_hits).select(
        *keys, "n_hits", "t_first", "t_last", F.col(f"_best.{ts}").alias("event_t"),
        F.col("_best.dist").alias("min_dist"))


REFERENCE_OUT = ("key string, event_t timestamp, t_first timestamp, t_last timestamp, n_hits long, min_dist double, "
                 "x1 double, y1 double, x2 double, y2 double")
REFERENCE_STATE = ("waiting binary, box array<double>, first long, last long, best long, dist double, hits long, "
                   "at array<double>")
_WIDTH = 10                       # of a waiting row: time, frame, hoop box, ball box


def in_zone_of(box: np.ndarray, x: np.ndarray, y: np.ndarray, above: float = 1.2) -> np.ndarray:
    """Which points lie in the arrival zone of a box: a little wider, ``above`` heights up, down to its floor."""
    wide, high = box[2] - box[0], box[3] - box[1]
    return (x >= box[0] - 0.2 * wide) & (x <= box[2] + 0.2 * wide) & (y >= box[1] - above * high) & (y <= box[3])


def fold_frames(rows: np.ndarray, box, event, gap_us: float, keep: float):
    """Fold rows in time order: (running box, open event, closed events).

    ``rows``: time in microseconds, frame, hoop box and ball box, NaN where there is none; rows of one time and frame are
    one frame with several balls.  An event is (first, last, best, distance, hits, box at the last hit).
    """
    closed = []
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    edges = np.flatnonzero(np.append(True, (np.diff(rows[:, :2], axis=0) != 0).any(1))) if len(rows) else []
    for frame in np.split(rows, edges[1:]) if len(rows) else ():
        hoops = frame[~np.isnan(frame[:, 2:6]).any(1), 2:6]
        if len(hoops):
            box = hoops[0].copy() if box is None else keep * box + (1 - keep) * hoops[0]
        if box is None:
            continue
        balls = frame[~np.isnan(frame[:, 6:]).any(1), 6:]
        x, y = (balls[:, 0] + balls[:, 2]) / 2, (balls[:, 1] + balls[:, 3]) / 2
        near = in_zone_of(box, x, y)
        if not near.any():
            continue
        dist = float(np.hypot(x[near] - (box[0] + box[2]) / 2, y[near] - (box[1] + box[3]) / 2).min())
        t = int(frame[0, 0])
        if event is not None and t - event[1] > gap_us:
            closed.append(event)
            event = None
        if event is None:
            event = (t, t, t, dist, 1, box)
        else:
            event = (event[0], t, *((t, dist) if dist < event[3] else event[2:4]), event[4] + 1, box)
    return box, event, closed


def _reference_state(gap_s: float, keep: float, min_hits: int, reach: float):
    """State function: rows wait until the watermark has passed their time, then they are folded in order.

    Nothing depends on when a row came, only on its time, so neither the cut into batches nor the order in them shows.
    """
    gap_us = gap_s * 1e6

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, box, first, last, best, dist, hits, at = state.get if state.exists else (b"", *(None,) * 7)
        held = [np.frombuffer(waiting, "f8").reshape(-1, _WIDTH)]
        if not state.hasTimedOut:
            for pdf in batches:
                t = pdf["ts"].to_numpy().astype("datetime64[us]").astype("i8").astype("f8")
                held.append(np.column_stack([t, pdf.drop(columns=["key", "ts"]).to_numpy("f8", na_value=np.nan)]))
        rows = np.concatenate(held)
        now = state.getCurrentWatermarkMs() * 1000
        due = rows[:, 0] <= now
        event = None if first is None else (first, last, best, dist, hits, np.array(at))
        box, event, closed = fold_frames(rows[due], None if box is None else np.array(box), event, gap_us, keep)
        rows = rows[~due]
        if event is not None and now > event[1] + gap_us:
            closed, event = [*closed, event], None
        opened = (None,) * 6 if event is None else (*event[:5], event[5].tolist())
        state.update((rows.tobytes(), None if box is None else box.tolist(), *opened))
        wake = [rows[:, 0].min() / 1000] if len(rows) else []
        if event is not None:
            wake.append((event[1] + gap_us) / 1000)
        if wake:
            state.setTimeoutTimestamp(max(int(min(wake)) + 1, state.getCurrentWatermarkMs() + 1))
        out = [(key[0], *(pd.Timestamp(v, unit="us") for v in (e[2], e[0], e[1])), e[4], e[3], *e[5].tolist())
               for e in closed if e[4] >= min_hits and e[3] < reach * (e[5][2] - e[5][0])]
        yield pd.DataFrame(out, columns=["key", "event_t", "t_first", "t_last", "n_hits", "min_dist", "x1", "y1", "x2", "y2"])
    return run


HOOP, BALL = ("hoop_x1", "hoop_y1", "hoop_x2", "hoop_y2"), ("ball_x1", "ball_y1", "ball_x2", "ball_y2")


def reference_events(rows: DataFrame, key: str, gap_s: float = 2.0, keep: float = 0.95, delay: str = "0 seconds",
                     min_hits: int = 2, reach: float = 99.0) -> DataFrame:
    """Running hoop box and the events of balls in its zone, per key.

    ``rows``: key, ts, frame, a hoop box and a ball box (null where none was found); several rows of one time and frame
    are one frame with several balls, whose nearest counts.  Rows wait in the state until the watermark passes
    them and are folded in the order of time and frame, so the result depends neither on arrival within ``delay`` nor on
    batches.  Later rows are dropped.  An event leaves when its gap passes the watermark, with the box at its last hit.
    The state of a key is its open event and the rows of the last ``delay``.
    """
    src = rows.withWatermark("ts", delay).select(
        F.col(key).cast("string").alias("key"), "ts", F.col("frame").cast("double").alias("frame"),
        *[F.col(c).cast("double").alias(c) for c in (*HOOP, *BALL)])
    return src.groupBy("key").applyInPandasWithState(
        _reference_state(gap_s, keep, min_hits, reach), REFERENCE_OUT, REFERENCE_STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def match_stream(events: DataFrame, windows: DataFrame, key: str, before: str = "2 seconds",
                 after: str = "2500 milliseconds", delay: str = "10 minutes",
                 cols: Sequence[str] = ()) -> DataFrame:
    """Events joined to label windows [start - before, end + after] on two streams.

    ``events``: key, event_t; ``windows``: key, win_id, start, end.
    """
    e = events.withWatermark("event_t", delay).alias("e")
    w = windows.withWatermark("start", delay).alias("w")
    cond = ((F.col(f"e.{key}") == F.col(f"w.{key}"))
            & (F.col("e.event_t") >= F.col("w.start") - F.expr(f"INTERVAL {before}"))
            & (F.col("e.event_t") <= F.col("w.end") + F.expr(f"INTERVAL {after}")))
    return e.join(w, cond, "inner").select(F.col(f"e.{key}").alias(key), "e.event_t",
                                        *[f"e.{c}" for c in cols], "w.win_id", "w.start")


def run_available(stream: DataFrame, mode: str = "append", seconds: int | None = None) -> DataFrame:
    """Drain what is available into parquet in the shared folder and return it as a table.

    ``seconds`` bounds the wait; without it the stream may take as long as it needs.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start())
    if seconds is None:
        q.awaitTermination()
    elif not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError("stream did not finish")
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, with its batch schema."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
