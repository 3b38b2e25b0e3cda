"""What grows with the input: shuffled columns, copies of points, parts of a fit."""
import itertools
import random

from pyspark.sql import functions as F

from orbweave.operators import decide as D, learn, temporal as M, trajectory as H
from orbweave.plans import catalog
from orbweave.plans.inputs import samples

SF = "/root/testdata/sf0.001"


def test_name_merges_shuffle_no_texts(spark):
    for name in ("tiered_merge", "promote_only_merge", "first_decided_source"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
        whole = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Join" not in plan, name
        assert whole.count("Exchange") == 1 and whole.count(" Sort ") == 1, whole
        below = whole[whole.index("Exchange"):]
        assert "rim plane" not in below and "rim plane" in whole, name


def test_layers_equal_joined_sources(spark):
    texts = ["MAKE (a)", "MISS (RIM-OUT: bounce=9cm at z=300cm, r=30cm)", "UNDECIDED (x)", None]
    cams = ["MAKE", "MISS", "UND", "MISS-weak", None]
    rows = [(i, "FG_MAKE", v, r, f, n, h, k, r) for i, (v, r, f, n, h, k) in enumerate(itertools.product(
        texts[1:3], texts, cams, cams[:3], texts, (None, 1, 2)))]
    j = spark.createDataFrame(rows, "name_id long, gt string, verdict string, rerun string, fr string, nr string, hires string, "
                                    "n_attempts int, first_attempt string")
    sides = [j.select("name_id", *c) for c in (["rerun"], ["fr", "nr"], ["hires"], ["n_attempts", "first_attempt"])]
    first = j.select("name_id", "gt", "verdict")
    assert sorted(D.layers(j, ["name_id", "gt"]).collect()) == sorted(D.tiered_merge(first, "name_id", *sides).collect())
    none = {c: F.lit(None).cast("string") for c in ("hires", "first_attempt")} | {"n_attempts": F.lit(None).cast("int")}
    assert sorted(D.layers(j.withColumns(none), ["name_id", "gt"]).collect()) == sorted(
        D.promote_only(first, "name_id", *sides[:2]).collect())


def test_first_decided_of_one_row(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(itertools.product(["MAKE", "UNDECIDED x", "", None], repeat=2))]
    df = spark.createDataFrame(rows, "k long, a string, b string")
    long = df.select("k", F.lit(1).alias("priority"), F.col("b").alias("verdict")).unionByName(
        df.select("k", F.lit(2).alias("priority"), F.col("a").alias("verdict")))
    got = df.select("k", *D.first_decided_of([(2, F.col("a")), (1, F.col("b"))]))
    key = lambda r: r[0]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, D.first_decided(long, ["k"]).collect()), key=key)


def test_close_tracks_copies_few_points(spark):
    rng = random.Random(3)
    pts = [(rng.randrange(2), t, rng.randrange(-20, 400), rng.choice([-90.0, 0.0, 30.0, rng.uniform(-200, 900)]),
            rng.choice([0.0, 29.999999, rng.uniform(-200, 900)])) for t in range(12) for _ in range(60)]
    df = spark.createDataFrame(pts, "g long, track long, frame_idx long, cx double, cy double")
    kept = [(g, t) for g in (0, 1) for t in (0, 5)]
    got = M.join_close_tracks(df, spark.createDataFrame(kept, "g long, track long"), ["g"], "track", 5, 30.0).collect()
    close = {(a[0], a[1]) for a in pts for b in pts if a[0] == b[0] and (a[0], a[1]) not in kept and (b[0], b[1]) in kept
             and abs(a[2] - b[2]) <= 5 and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 < 900.0}
    assert sorted(map(tuple, got)) == sorted([*close, *kept]) and 0 < len(close) < 20
    copies = M.near_cells(df, {"a": ("frame_idx", 5, 40), "b": ("cx", 30.0, 120.0), "c": ("cy", 30.0, 120.0)}).count()
    assert copies < 4 * len(pts)


def test_parameter_sets_share_rows_and_walks(spark, monkeypatch):
    x = samples(spark, SF)
    sets = {"plain": H.DescentRules(), "no_guard": H.DescentRules(y_guard=False), "wide": H.DescentRules(make_r=60.0),
            "strict": H.DescentRules(skip_noisy=False), "short": H.DescentRules(max_rows=5)}
    alone = {n: sorted(map(tuple, H.rescore(x, rules=r).collect()), key=repr) for n, r in sets.items()}
    calls = []
    for f in ("_after_apex", "descent_walk"):
        monkeypatch.setattr(H, f, lambda *a, f=f, real=getattr(H, f), **k: calls.append(f) or real(*a, **k))
    got = H.rescore_all(x, sets).collect()
    for n in sets:
        assert sorted((tuple(v for c, v in r.asDict().items() if c != "params") for r in got if r.params == n), key=repr) == alone[n], n
    assert calls.count("_after_apex") == 2 and calls.count("descent_walk") == 3
    calls.clear()
    catalog.QUERIES["descent_verdict_tally"](spark, SF)
    assert calls.count("_after_apex") == 1 and calls.count("descent_walk") == 2


def test_arbiter_numbers_samples_once(spark):
    plan = catalog.QUERIES["arbiter_table"](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "FileScan" not in plan and "ExistingRDD" in plan


def test_fits_use_several_parts(spark, monkeypatch):
    met = []
    monkeypatch.setattr(learn, "PART_ROWS", 10_000)

    class Pipe:
        def fit(self, df):
            met.append((df.rdd.getNumPartitions(), df.count()))
    monkeypatch.setattr(learn, "score", lambda model, df: df.withColumn("p", F.col("x")))
    df = spark.range(45_000, numPartitions=1).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 97 / 97).alias("x"), F.when(
        F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test").alias("split"))
    assert learn.select_refit_test(df, {"one": Pipe()}).first().n == 15_000
    assert met == [(5, 15_000), (5, 30_000)]
