"""The 28-column table of a shot and its held-out games."""
import pytest

from orbweave.operators import shotmodel

SHOTS = ("game_id string, shot long, gt string, verdict string, tri string, fr string, nr string, fr_n_deep int, fr_rebound_px double, "
         "fr_max_cy double, nr_n_deep int, nr_rebound_px double, nr_max_cy double")
SAMPLES = "game_id string, shot long, frame long, x double, y double, z double"


def test_columns(spark):
    shots = spark.createDataFrame([
        ("G1", 1, "FG_MAKE", "MAKE (passed through rim plane at r=12cm, bounce=7cm)", "MAKE CLEAN: passed through", "MAKE-weak", "MISS", 3, 40.0, 900.0, None, None, 0.0),
        ("G1", 2, "FG_MISS", "MISS r=0cm", None, None, "UND", None, None, None, 1, 2.0, 3.0), ("G1", 3, None, None, "UNDECIDED", "MISS-weak", "MAKE", 0, 0.0, 5.0, 1, 1.0, 1.0)], SHOTS)
    samples = spark.createDataFrame([("G1", 1, f, 2008.7 + f, 713.2, z) for f, z in enumerate([300.0, 420.0, 420.0, 310.0, 330.0])]
                                    + [("G1", 2, f, 0.0, 0.0, 1.0) for f in range(2)], SAMPLES)
    a, b, c = shotmodel.shot_columns(shots, samples).orderBy("shot").collect()
    assert list(shotmodel.COLUMNS) == a.__fields__[4:] and len(shotmodel.COLUMNS) == 28
    assert (a.label, a.n_samples, a.apex_z, a.z_min, a.cross_r, a.bounce_cm) == (1, 5, 420.0, 310.0, 12.0, 7.0)
    assert a.apex_r == pytest.approx(1.0)                             # the first of two equal heights
    assert (a.tri_make, a.tri_has_clean_clean, a.tri_has_pass_through, a.fr_strength, a.fr_is_make, a.nr_is_miss) == (1, 1, 1, 1, 1, 1)
    assert (a.nr_n_deep, a.nr_rebound_px, a.nr_max_cy) == (0.0, 0.0, -1.0)
    assert (b.n_samples, b.apex_r, b.cross_r, b.z_min, b.bounce_cm, b.fr_strength, b.tri_und) == (2, -1.0, -1.0, -1.0, -1.0, 0, 0)
    assert (c.n_samples, c.apex_z, c.label) == (0, -1.0, None)


def test_held_out_games_learn(spark):
    zero = dict.fromkeys(shotmodel.COLUMNS, 0.0)
    rows = [{"game_id": f"G{i % 3}", "shot": i, "label": int(i % 7 < 3), **zero, "cross_r": float(10 + 50 * (i % 7 >= 3) + i % 5)} for i in range(90)]
    table = {r.game_id: r for r in shotmodel.held_out_games(spark.createDataFrame(rows), rounds=15).collect()}
    assert sorted(table) == ["G0", "G1", "G2"] and all(r.accuracy == 1.0 and r.n == 30 for r in table.values())
