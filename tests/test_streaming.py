"""The running reference of a stream does not depend on batches or on the order of arrival."""
import datetime as dt
import itertools
import uuid

import numpy as np
import pytest

from orbweave.streaming import spotter

SCHEMA = ("cam string, ts timestamp, frame long, hoop_x1 double, hoop_y1 double, hoop_x2 double, hoop_y2 double, "
          "ball_x1 double, ball_y1 double, ball_x2 double, ball_y2 double")
T0 = dt.datetime(2024, 6, 1, 12)


def frames(seed=0, n=80):
    """Frames of two cameras with equal times, frames of several balls, missing hoops and silent gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for cam in ("NL", "FR"):
        t = 0.0
        for i in range(n):
            t += float(rng.choice([0.0, 0.1, 0.5, 3.0], p=[0.2, 0.5, 0.2, 0.1]))
            hoop = (None,) * 4 if rng.random() < 0.3 else tuple((np.array([100.0, 100, 200, 160]) + rng.normal(0, 4, 4)).tolist())
            for _ in range(int(rng.integers(1, 3))):
                x, y = rng.uniform(60, 240), rng.uniform(20, 170)
                ball = (None,) * 4 if rng.random() < 0.2 else (x - 5, y - 5, x + 5, y + 5)
                rows.append((cam, T0 + dt.timedelta(seconds=round(t, 3)), i, *hoop, *ball))
    return rows


def plain(rows, gap, keep=0.95):
    """Frame after frame, as one would by hand; events up to the last time of all."""
    end, out = max(r[1] for r in rows), []
    for cam, mine in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        box, hits = None, []
        for (t, _), balls in itertools.groupby(mine, key=lambda r: (r[1], r[2])):
            balls = list(balls)
            if balls[0][3] is not None:
                new = np.array(balls[0][3:7])
                box = new if box is None else keep * box + (1 - keep) * new
            if box is None:
                continue
            cx, cy, w, h = (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]
            seen = [((b[7] + b[9]) / 2, (b[8] + b[10]) / 2) for b in balls if b[7] is not None]
            inside = [np.hypot(x - cx, y - cy) for x, y in seen
                      if box[0] - 0.2 * w <= x <= box[2] + 0.2 * w and box[1] - 1.2 * h <= y <= box[3]]
            if inside:
                hits.append((t, float(min(inside)), box))
        events = []
        for hit in hits:
            if not events or (hit[0] - events[-1][-1][0]).total_seconds() > gap:
                events.append([])
            events[-1].append(hit)
        for e in events:
            if len(e) >= 2 and (end - e[-1][0]).total_seconds() > gap:
                best = min(e, key=lambda x: x[1])
                out.append((cam, best[0], e[0][0], e[-1][0], len(e), round(best[1], 9), *np.round(e[-1][2], 9).tolist()))
    return sorted(out)


def run(spark, tmp_path, batches, delay):
    """Write each batch as a file of its own and read one per micro-batch; the last row only moves the watermark."""
    folder = tmp_path / uuid.uuid4().hex
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{i:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    got = spotter.run_available(spotter.reference_events(stream, "cam", 1.0, delay=delay)).collect()
    return sorted((r.key, r.event_t, r.t_first, r.t_last, r.n_hits, round(r.min_dist, 9), *(round(r[c], 9) for c in ("x1", "y1", "x2", "y2")))
                  for r in got)


@pytest.mark.parametrize("cuts, shuffled", [(1, False), (3, False), (20, False), (6, True)])
def test_batches_and_disorder_do_not_show(spark, tmp_path, cuts, shuffled):
    rows = frames()
    end = max(r[1] for r in rows)
    given = sorted(rows, key=lambda r: r[1])
    if shuffled:                                             # out of order by up to the delay
        rng = np.random.default_rng(5)
        given = sorted(rows, key=lambda r: r[1] + dt.timedelta(seconds=float(rng.uniform(0, 4))))
    batches = [given[i * len(given) // cuts:(i + 1) * len(given) // cuts] for i in range(cuts)]
    last = ("NL", end + dt.timedelta(seconds=20), 10 ** 6, *(None,) * 8)
    expect = plain([*rows, ("NL", end + dt.timedelta(seconds=10), 10 ** 6, *(None,) * 8)], 1.0)
    assert len(expect) > 5
    assert run(spark, tmp_path, [*batches, [last]], "10 seconds") == expect
