"""Readers and writers over small files."""
import json

import pytest
from pyspark.sql import functions as F

from orbweave.operators import tables as A
from orbweave.sources import readers as R, sinks as W


def test_manifest_windows_and_filters(spark, tmp_path):
    m = tmp_path / "m.json"
    m.write_text(json.dumps({"games": [{"game_id": "a", "date": "d", "split": "val", "shots": 3},
                                       {"game_id": "b", "date": "d"}]}, indent=1))
    g = R.read_manifest(spark, str(m))
    assert {(r.game_id, r.shots, r.split) for r in g.collect()} == {("a", 3, "val"), ("b", 0, "train")}
    assert R.games_for_split(g, "val").count() == 1 and R.games_for_split(g, "all").count() == 2
    with pytest.raises(ValueError):
        R.games_for_split(g, "bad")
    w = tmp_path / "w.json"
    w.write_text(json.dumps({"games": {"a": [
        {"id": "p1", "classification": "FG_MAKE", "start_timestamp": 5.0, "end_timestamp": 6.0},
        {"play_id": "p2", "classification": "FG_MISS", "start_timestamp": None, "end_timestamp": 6.0},
        {"play_id": "p3", "classification": "FOUL", "start_timestamp": 1.0, "end_timestamp": 2.0}]}}, indent=1))
    rows = R.shot_windows(R.read_windows(spark, str(w), "a")).collect()
    assert [r.play_id for r in rows] == ["p1"]
    with pytest.raises(ValueError):
        R.read_windows(spark, str(w), "zzz")


def test_samples_cache_and_labels(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"name": "n", "gt": "FG_MAKE", "verdict": "MAKE", "samples": [
        {"frame": 1, "t": 0.1, "fr_px": [1, 2], "nr_px": [3, 4], "X_cm": [10, 20, 30]},
        {"frame": 2, "t": 0.2, "fr_px": [1, 2], "nr_px": [3, 4], "X_cm": [11, 21, 31]}]}, indent=1))
    s = R.read_samples(spark, str(tmp_path / "s.json")).orderBy("pos").collect()
    assert [(r.frame, r.z) for r in s] == [(1, 30.0), (2, 31.0)]
    (tmp_path / "c.json").write_text(json.dumps({"fps": 30.0, "t0": 0, "t1": 9, "stride": 1, "rim": [0, 0, 4, 4],
        "frames": [{"f": 1, "balls": [[0, 0, 2, 2], [5, 5, 6, 6]]}, {"f": 2, "balls": []}]}, indent=1))
    c = R.read_detection_cache(spark, str(tmp_path / "c.json")).collect()
    assert sorted((r.f, r.x1) for r in c if r.x1 is not None) == [(1, 0.0), (1, 5.0)]
    assert [r.f for r in c if r.x1 is None] == [2]
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.25 0.5\n\n1 0.1 0.1 0.2 0.2\n")
    b = R.read_label_text(spark, str(tmp_path / "l.txt")).filter("cls = 0").first()
    assert (b.x1, b.y1, b.x2, b.y2) == (720.0, 270.0, 1200.0, 810.0)


def test_parquet_first_then_json_lines(spark, tmp_path):
    base = str(tmp_path / "nm")
    (tmp_path / "nm.jsonl").write_text(json.dumps({"play_id": "p", "angle": "FL", "frame_idx": 1}) + "\n")
    assert R.read_parquet_or_json(spark, base, R.NETMOTION).count() == 1
    spark.createDataFrame([("q", "FL", 2), ("r", "FL", 3)], "play_id string, angle string, frame_idx long") \
        .write.parquet(base + ".parquet")
    assert R.read_parquet_or_json(spark, base, R.NETMOTION).count() == 2


def test_tracks_missing_game_and_nan(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "p", float("nan")), ("b", "q", 2.0)],
                               "game_id string, play_id string, ball_x double")
    df.write.partitionBy("game_id").parquet(p)
    t = R.read_tracks(spark, p, ["a"])
    assert [r.ball_x for r in t.collect()] == [None]
    with pytest.raises(ValueError):
        R.read_tracks(spark, p, ["a", "zz"])


def test_idempotent_game_output(spark, tmp_path):
    p = str(tmp_path / "out")
    a = spark.createDataFrame([("a", 1), ("b", 2)], "game_id string, v int")
    W.write_new_games(a, p)
    W.write_new_games(a.withColumn("v", F.col("v") * 10).unionByName(
        spark.createDataFrame([("c", 3)], "game_id string, v int")), p)
    assert {(r.game_id, r.v) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 2), ("c", 3)}
    W.write_new_games(spark.createDataFrame([("b", 7)], "game_id string, v int"), p, force=True)
    assert {(r.game_id, r.v) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 7), ("c", 3)}


def test_prediction_rows_and_checks(spark, tmp_path):
    df = spark.createDataFrame([("g", "b", "FG_MAKE", 1, 0.12345650, 1), ("g", "a", "FG_MISS", 0, 0.5, 1)],
                               "game_id string, play_id string, classification string, label int, prob double, pred int")
    W.write_predictions(df, str(tmp_path / "p"))
    assert [(r.play_id, r.correct) for r in W.prediction_rows(df).collect()] == [("a", False), ("b", True)]
    W.write_report(df, str(tmp_path / "r"))
    assert R.read_predictions(spark, str(tmp_path / "r")).count() == 2
    f = A.fingerprint(df).first()
    assert A.fingerprint(df.orderBy("play_id")).first() == f
    A.verify_fingerprint(df, f.n_rows, f.digest)
    with pytest.raises(ValueError):
        A.verify_fingerprint(df.limit(1), f.n_rows, f.digest)
    with pytest.raises(ValueError):
        A.assemble(df, [df.unionAll(df).select("play_id", "prob")], ["play_id"])
