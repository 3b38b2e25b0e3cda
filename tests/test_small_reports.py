"""Balance counts, false events per minute, re-votes, verdict kinds, single-column AUC, feature buckets."""
import numpy as np

from orbweave.functions import ordered
from orbweave.operators import decide as D, evaluate as E, spotting as P, tables as X
from orbweave.sources import readers


def test_balance(spark):
    rows = [("a", 1, True), ("a", 0, True), ("a", 1, False), ("b", None, True), ("b", 1, None), (None, 1, True), ("c", 0, False)]
    df = spark.createDataFrame(rows, "game_id string, label int, usable boolean")
    got = {r.game: tuple(r)[1:] for r in X.balance(df).collect()}
    assert got == {"a": (3, 2, 1, 1, 1, 1), "b": (2, 1, 1, 0, 0, 1), None: (1, 1, 0, 1, 0, 0), "c": (1, 0, 1, 0, 0, 0),
                   "ALL": (7, 4, 3, 2, 1, 2)}


def test_false_events_per_minute(spark):
    events = spark.createDataFrame([("a", 10.0), ("a", 300.0), ("a", 500.0), ("b", 5.0), ("c", 7.0)], "game string, t double")
    windows = spark.createDataFrame([("a", 0.0, 20.0), ("b", 90.0, 95.0)], "game string, lo double, hi double")
    spans = spark.createDataFrame([("a", 8.0), ("b", 0.2), ("c", None)], "game string, minutes double")
    s = P.spot_scores(events, windows, ["game"], "t", "lo", "hi", lambda c: ordered.value_bucket(c, 60.0))
    got = {r.game: (r.recall, r.n_false, r.false_pm) for r in P.false_rate(s, spans, ["game"]).collect()}
    assert got == {"a": (1.0, 2, 0.25), "b": (0.0, 1, 1.0), "c": (0.0, 1, 0.05)}
    none = P.false_rate(s, spans.limit(0), ["game"]).filter("game = 'a'").first()
    assert none.false_pm == 0.1                              # length not known: twenty minutes


def test_configs_rank_by_rate(spark):
    cols = "recall double, precision double, false_pm double, n_false long, stride int, zone double, min_hits int, reach double, downward boolean"
    df = spark.createDataFrame([(1.0, 0.5, 0.2, 1, 1, 1.2, 1, -1.0, False), (1.0, 0.5 + 1e-15, 0.1, 9, 2, 1.2, 1, -1.0, False),
                                (0.9, 1.0, 0.0, 0, 3, 1.2, 1, -1.0, False)], cols)
    assert [r.stride for r in P.rank_configs(df).collect()] == [2, 1, 3]
    assert [r.stride for r in P.rank_configs(df.drop("false_pm")).collect()] == [1, 2, 3]


def test_revote_lists_changed_outcomes_only(spark):
    rows = [(1, "FG_MAKE", "UND", "UNDECIDED (x)", "MAKE", "UND"), (2, "FG_MISS", "TN", "MISS (CLEAN: far)", "MAKE", "UND"),
            (3, "FG_MAKE", "TP", "MAKE (r=1)", "UND", "UND"), (4, "FG_MISS", None, "MISS (r=9)", "UND", "UND")]
    df = spark.createDataFrame(rows, "name int, gt string, before string, tri string, fr string, nr string")
    got = [tuple(r) for r in D.revote_changes(df, ["name"], "gt", "before", "tri", "fr", "nr").orderBy("name").collect()]
    assert got == [(1, "UND", "TP", "MAKE", "fill"), (2, "TN", "FP", "MAKE", "weak-miss"), (4, None, "TN", "MISS (r=9)", "kept")]
    assert D.revote_changes(df.limit(0), ["name"], "gt", "before", "tri", "fr", "nr").count() == 0


def test_verdict_kinds(spark):
    rows = [("MISS (RIM-OUT: bounce=3cm)", "FN"), ("MISS ( RIM-OUT : x)", "FN"), ("MISS", "FN"), ("MISS: (odd)", "FN"),
            ("MISS (crossed r=9)", "FN"), ("MISS (RIM-OUT: y)", "TN"), (None, "FN"), ("MISS", None)]
    df = spark.createDataFrame(rows, "verdict string, cat string")
    assert {r.verdict_type: r.n for r in E.verdict_types(df).collect()} == {
        "RIM-OUT": 2, "MISS": 2, "crossed r=9)": 1, None: 1}


def test_best_single_auc(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 300)
    data = {"near": y + rng.normal(0, 1, 300), "far": -y + rng.normal(0, 2, 300), "flat": np.ones(300), "noise": np.round(rng.normal(size=300), 1)}
    data["near"][::9] = np.nan
    rows = [(int(y[i]), *(None if np.isnan(v[i]) else float(v[i]) for v in data.values()), None) for i in range(300)]
    df = spark.createDataFrame(rows, "label int, near double, far double, flat double, noise double, empty double")

    def plain(v):
        v = np.where(np.isnan(v), np.nanmedian(v), v)
        pos, neg = v[y == 1][:, None], v[y == 0][None, :]
        a = ((pos > neg) + 0.5 * (pos == neg)).mean()
        return max(a, 1 - a)
    families = {"cameras": ["far", "near", "flat"], "twice": ["near", "near"], "rest": ["noise"], "none": ["flat", "empty"]}
    got = {r.family: (r.feature, r.auc) for r in E.best_single_auc(df, families).collect()}
    assert got["none"] == (None, 0.5) and got["cameras"][0] == got["twice"][0] == "near" and got["rest"][0] == "noise"
    assert np.allclose([got["cameras"][1], got["rest"][1]], [plain(data["near"]), plain(data["noise"])])


def test_feature_buckets(spark):
    df = spark.createDataFrame([], "game_id string, label int, arc_a double, arc_b float, cln_arc_a double, n long, seen boolean")
    cols = X.numeric_features(df, ["label"])
    assert cols == ["arc_a", "arc_b", "cln_arc_a", "n"]
    assert X.feature_buckets(cols, {"arc": ["arc_"], "clean": ["cln_"]}) == {
        "arc": ["arc_a", "arc_b"], "clean": ["cln_arc_a"], "other": ["n"]}


def test_windows_come_in_order_of_start(spark):
    rows = [("FG_MAKE", 9.0, 10.0), ("FG_MISS", 1.0, 2.0), ("OTHER", 0.0, 1.0), ("FG_MAKE", 5.0, None), ("FG_MISS", 4.0, 6.0)]
    df = spark.createDataFrame(rows, "classification string, start_timestamp double, end_timestamp double").repartition(4)
    assert [r.start_timestamp for r in readers.shot_windows(df).collect()] == [1.0, 4.0, 9.0]


def test_suspects_at_the_border(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (2, 0, 0.9), (3, 1, 0.11), (4, 0, 0.89), (5, 1, 0.9)], "id int, label int, prob double")
    assert {r.id for r in E.label_suspects(df, 0.9).collect()} == {1, 2}


def test_sweep_pairs_windows_with_few_events(spark):
    """Every setting's scores, counted plainly; windows go through one explode by time, not one per setting."""
    balls = [("a", 2 * i, t, need, dist, y) for i, (t, need, dist, y) in enumerate(
        [(0, 1.0, 9.0, 5), (1, 1.5, 3.0, 4), (10, 2.0, 30.0, 1), (11, 1.1, 28.0, 2), (40, 2.4, 31.0, 1), (41, 3.0, 1.0, 1)])]
    df = spark.createDataFrame([*balls, ("b", 1, 5, 1.0, 1.0, 1)], "k string, step long, t long, need double, dist double, y long")
    win = spark.createDataFrame([("a", 0, 3), ("a", 0, 3), ("a", 9, 41), ("c", 0, 9)], "k string, lo long, hi long")
    sweep = P.config_sweep(df, win, ["k"], lambda c: ordered.value_bucket(c, 7), 40.0)
    plan = sweep._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([false,true])" not in plan                   # direction and reach multiply no rows of windows or events
    got = {tuple(r)[:5]: tuple(r)[5:] for r in sweep.collect()}
    assert len(got) == 108
    for (stride, zone, least, reach, down), row in got.items():
        hit, ok, n_ev, false = 0.0, {}, {}, 0
        for k, limit in (("a", [(0, 3), (0, 3), (9, 41)]), ("b", [])):
            rows = sorted((t, dist, y) for kk, step, t, need, dist, y in [*balls, ("b", 1, 5, 1.0, 1.0, 1)]
                          if kk == k and step % stride == 0 and need <= zone)
            runs = []
            for r in rows:
                if runs and r[0] - runs[-1][-1][0] <= 2.0:
                    runs[-1].append(r)
                else:
                    runs.append([r])
            best = [(min(q, key=lambda r: (r[1], r[0])), q) for q in runs]
            ev = [m[0] for m, q in best if len(q) >= least and (reach < 0 or m[1] <= reach * 40)
                  and (not down or m[0] == q[0][0] or m[2] >= q[0][2])]
            inside = [e for e in ev if any(lo <= e <= hi for lo, hi in limit)]
            false += len(ev) - len(inside)
            n_ev[k], ok[k] = len(ev), len(inside)
            if limit:
                hit = sum(any(lo <= e <= hi for e in ev) for lo, hi in limit) / 3
        expect = (hit / 2, (ok["a"] / n_ev["a"] if n_ev["a"] else 0.0) / 2, false, sum(n_ev.values()))
        assert np.allclose(row, expect), (stride, zone, least, reach, down)
