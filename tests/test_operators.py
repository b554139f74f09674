import datetime as dt
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainshift.functions import control as C
from strainshift.operators import align as A
from strainshift.operators import expand as E
from strainshift.operators import integral as I
from strainshift.operators import reshape as S
from strainshift.operators import rows as R
from strainshift.operators import score as K
from strainshift.operators import summaries as M
from strainshift.operators import windows as O
from strainshift.operators.resample import wild_replicates
from strainshift.plans.q_windows import normal_score
from strainshift.sources import sinks, tables
from strainshift.session import scratch_path

DAY = dt.date(2020, 8, 3)


def test_control_integral_of_five_days(spark):
    days = spark.createDataFrame(list(enumerate([60.0, 70.0, 75.0, 50.0, 80.0])), "day_idx int, psi double")
    daily = I.daily_integrands(days.withColumns({"k": F.lit(0.999219), "a": F.lit(3.782533)}))
    span = spark.createDataFrame([(0.5, 3.5)], "lo double, hi double")
    assert I.interval_integrals(span, daily, ["f1"]).first()["f1"] == pytest.approx(6.484028489236548, abs=1e-12)
    pre = I.daily_prefix(daily.withColumn("g", F.lit(1)), ["g"], ["f1"])
    times = spark.createDataFrame([(0, 0.5), (3, 3.5)], "day_idx int, t double")
    at = {r["t"]: r["p"] for r in times.join(pre, "day_idx").select("t", I.integral_at("p_f1", "f1", F.col("t")).alias("p")).collect()}
    assert at[3.5] - at[0.5] == pytest.approx(6.484028489236548, abs=1e-12)


def test_segment_prefix_equals_interval_join(spark):
    rng = np.random.default_rng(3)
    days = spark.createDataFrame([(i, float(p)) for i, p in enumerate(rng.choice([20.0, 40.0, 55.5, 80.0], 60))],
                                 "day_idx int, psi double")
    points = spark.createDataFrame([(1, 3.5), (2, 3.75), (3, 20.5), (4, 59.0)], "j int, t double")
    models = spark.createDataFrame([(1, 0.9, 2.0), (2, 0.5, 4.0)], "model_id int, k double, a double")
    got = I.prefix_integrals(models.repartition(4, "model_id"), I.segment_weights(points, days),
                             {"t": F.lit(1.0), "f1": F.col("f1"), "f2": F.col("f2")})
    spans = points.select(F.lit(0.0).alias("lo"), F.col("t").alias("hi"))
    for row in models.collect():
        daily = I.daily_integrands(days.withColumns({"k": F.lit(row["k"]), "a": F.lit(row["a"])}))
        want = {r["hi"]: r for r in I.interval_integrals(spans, daily, ["f1", "f2"]).collect()}
        for r in got.filter(F.col("model_id") == row["model_id"]).collect():
            w = min(want.values(), key=lambda x: abs(x["hi"] - r["t"]))
            assert w["hi"] == pytest.approx(r["t"], abs=1e-12)
            assert (r["f1"], r["f2"]) == pytest.approx((w["f1"], w["f2"]), rel=1e-12)


def test_week_blocks_keep_complete_weeks_only(spark):
    rows = [(DAY + dt.timedelta(i), float(i)) for i in range(21) if i != 10]
    df = spark.createDataFrame(rows, "day date, psi double")
    got = {r["week"]: r["block_mean"] for r in A.block_means(df, "day", "psi", F.lit(DAY)).collect()}
    assert got == {DAY: 3.0, DAY + dt.timedelta(14): 17.0}


def test_centred_death_mean(spark):
    deaths = [31, 20, 17, 23, 27, 13, 21]
    df = spark.createDataFrame([(DAY + dt.timedelta(i - 3), n) for i, n in enumerate(deaths)], "day date, n int")
    near = df.filter(F.date_diff("day", F.lit(DAY)).between(-3, 3))
    assert near.agg(A.guarded_mean(F.col("n"))).first()[0] == pytest.approx(21.714285714285716)
    gap = near.withColumn("n", F.when(F.col("n") != 13, F.col("n")))
    assert gap.agg(A.guarded_mean(F.col("n"))).first()[0] is None


def test_calendar_align_first_wins_and_gaps_are_null(spark):
    series = spark.createDataFrame([(DAY, 2, 20), (DAY, 1, 10), (DAY + dt.timedelta(2), 1, 30)], "day date, pos int, v int")
    days = A.calendar(A.date_bounds(series, "day"), "first_day", "last_day")
    got = {r["day"]: r["v"] for r in A.calendar_align(days, series, "day", "pos", ["v"]).collect()}
    assert list(got.values()).count(None) == 1 and got[DAY] == 10 and len(got) == 3


def test_date_window_bounds(spark):
    weeks = spark.createDataFrame([(DAY,), (DAY + dt.timedelta(7),)], "week date")
    days = spark.createDataFrame([(DAY + dt.timedelta(i),) for i in range(-20, 30)], "day date")
    got = [r[0] for r in R.date_window(days, F.col("day"), weeks, "week").collect()]
    assert min(got) == DAY - dt.timedelta(7) and max(got) == DAY + dt.timedelta(13)
    stamps = days.select(F.col("day").cast("timestamp_ntz").alias("ts"), (F.col("day").cast("timestamp_ntz") + F.expr("interval 23 hours")).alias("late"))
    assert R.date_window(stamps, F.col("late"), weeks, "week").count() == len(got)


def test_central_difference_and_contiguity(spark):
    rows = [("a", DAY + dt.timedelta(7 * i), float(i * i)) for i in (0, 1, 2, 5)]
    df = spark.createDataFrame(rows, "region string, week date, y double")
    assert [r["s"] for r in O.selection_coef_diff(df, ["region"], "week", "y").orderBy("week").collect()] == [2.0, 12.0]
    tight = O.selection_coef_diff(df, ["region"], "week", "y", contiguous_days=14)
    assert [r["s"] for r in tight.collect()] == [2.0]


def test_exclude_category_with_no_hit_keeps_all(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "legend string")
    assert R.exclude_category(df, "legend", "zzz").count() == 3
    assert R.exclude_category(df, "legend", "a").count() == 2


def test_clamp_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in df.select(R.clamp_floor(F.col("x"))).collect()] == [0.0, None, 3.0]


def test_sweep_drops_inadmissible_shares(spark):
    df = spark.createDataFrame([(1,)], "id int")
    out = R.cross_sweep(df, {"R0": F.lit(2.5), "kappa": F.lit(.2), "gamma": F.lit(.1), "SN0": F.lit(.9)}, {"SN0": 1.0})
    assert out.count() == 19
    assert {round(r["SN0"], 3) for r in out.collect()} == {0.72, 0.81, 0.9, 0.99}


def test_composite_join_of_an_expanded_table_is_no_broadcast(spark, tmp_path):
    """A file of few bytes may expand to any number of rows: no side goes through the driver."""
    spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 4.0)], "id int, v double").write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    wide = R.cross_sweep(few, {"p": F.lit(1.0)}, {}).select("id", "fixed_parm", "multiplier", "v")
    keys = ["id", "fixed_parm", "multiplier"]
    out = A.composite_key_join(wide, wide.withColumnRenamed("v", "w"), keys)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["multiplier"], r["v"], r["w"]) for r in out.collect()) == [
        (m, v, w) for m in R.SWEEP_MULTIPLIERS for v in (2.0, 3.0) for w in (2.0, 3.0)]


def test_ensemble_with_an_empty_category(spark):
    base = spark.createDataFrame([(1, 2.0)], "t int, value double")
    none = base.limit(0).withColumn("replicate", F.lit(1))
    out = S.ensemble_union(base, base, none)
    parts = R.split_origin(out)
    assert [parts[k].count() for k in ("observed", "best", "replicate")] == [1, 1, 0]
    assert parts["observed"].first()["replicate"] is None and parts["best"].first()["replicate"] == 0


def test_quantiles_of_four_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("a", None), ("a", float("nan"))], "g string, x double")
    q = M.exact_quantiles(df, ["g"], "x", [.025, .5, .975]).first()["q"]
    assert q == pytest.approx([1.075, 2.5, 9.475])
    s = M.five_number_summary(df.dropna(), ["g"], "x").first()
    assert s["sd"] == pytest.approx(4.08248290463863) and s["median"] == 2.5


def test_corr_matrix_known_value(spark):
    df = spark.createDataFrame([(1.0, 1.0, 5.0), (2.0, 4.0, 5.0), (3.0, 9.0, 5.0), (10.0, 100.0, 5.0), (7.0, None, 1.0)], "x double, y double, z double")
    got = {(r["p"], r["q"]): r["r"] for r in M.corr_matrix(df, [], ["x", "y", "z"]).collect()}
    assert got[("x", "y")] == pytest.approx(0.9911272306452977) and got[("x", "z")] is None


def test_bracketed_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(5)
    hot = rng.lognormal(0, 2, 60000)
    tied = rng.integers(0, 30000, 50000) / 7.0
    rows = [("hot", float(x)) for x in hot] + [("tied", float(x)) for x in tied]
    df = spark.createDataFrame(rows, "g string, x double").repartition(8)
    probs = [0.0, .025, .25, .5, .975, 1.0]
    got = {r["g"]: r["q"] for r in M.exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got["hot"] == pytest.approx(list(np.quantile(hot, probs)), rel=1e-12)
    assert got["tied"] == pytest.approx(list(np.quantile(tied, probs)), rel=1e-12)
    whole = M.exact_quantiles(df, [], "x", probs).first()["q"]
    assert whole == pytest.approx(list(np.quantile(np.concatenate([hot, tied]), probs)), rel=1e-12)


def test_quantiles_of_small_and_null_groups(spark):
    rng = np.random.default_rng(11)
    groups = {f"g{n}": rng.normal(size=n).round(1) for n in (1, 2, 3, 4, 7, 40, 999, 2600)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [(None, 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    probs = [0.0, .025, .25, .3, .5, .77, .975, 1.0]
    got = {r["g"]: r["q"] for r in M.exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got[None] == pytest.approx(list(np.quantile([1.0, 4.0], probs)))
    for g, xs in groups.items():
        assert got[g] == pytest.approx(list(np.quantile(xs, probs)), abs=1e-12), g
    assert M.exact_quantiles(df.limit(0), ["g"], "x", probs).count() == 0


def test_quantiles_refine_missed_brackets(spark, monkeypatch):
    """Brackets of no width from a sketch of five marks miss; ties pile up right beside the ranks."""
    rng = np.random.default_rng(3)
    step = np.repeat(np.arange(7.0), [1, 4000, 1, 2, 4000, 3, 1])  # nearly all rows on two values
    groups = {"normal": rng.normal(size=9000), "step": step, "heavy": rng.standard_cauchy(7001), "ends": np.array([-np.inf, 1.0, 2.0, 2.0, np.inf]),
              None: rng.exponential(size=5000)}
    rows = [(g, float(x)) for g, xs in groups.items() for x in rng.permutation(xs)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(7)
    probs, slacks = [.025, .25, .5, .75, .975], []
    plain = M._bracket_quantiles
    monkeypatch.setattr(M, "_bracket_quantiles", lambda *args: (slacks.append(args[3]), plain(*args))[1])
    got = {r["g"]: r["q"] for r in M.exact_quantiles(df, ["g"], "x", probs, accuracy=5, reach=0.0).collect()}
    assert len(slacks) > 1 and slacks[0] == 0.0
    assert set(got) == set(groups)
    for g, xs in groups.items():
        if g != "ends":
            assert got[g] == pytest.approx(list(np.quantile(xs, probs)), rel=1e-12, abs=1e-12), g
    assert got["ends"][1:4] == [1.0, 2.0, 2.0]


def density_case(xs, points):
    """Grid, bandwidth and the exact sums over all values."""
    lo, hi = np.quantile(xs, [.025, .975])
    kept = xs[(xs >= lo) & (xs <= hi)]
    q1, q3 = np.quantile(kept, [.25, .75])
    bw = 0.9 * min(kept.std(ddof=1), (q3 - q1) / 1.34) * len(kept) ** -0.2
    grid = np.linspace(lo, hi, points)
    peak = 1 / (bw * np.sqrt(2 * np.pi))
    return grid, bw, peak, np.exp(-((kept[None, :] - grid[:, None]) / bw) ** 2 / 2).mean(1) * peak


def test_density_is_within_its_bound_of_the_exact_sum(spark):
    rng = np.random.default_rng(9)
    cases = {"gamma": np.round(rng.gamma(3, 2, 400), 2), "two": np.concatenate([rng.normal(0, .01, 3000), rng.normal(50, .01, 2000)]),
             "few": np.array([1.0, 2.0, 4.0, 8.0, 16.0])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in cases.items() for x in xs] + [("flat", 3.0)] * 5 + [("gamma", None)], "name string, x double")
    for points in (64, 512):
        out = M.density_table(df, ["name"], "x", points=points).orderBy("name", "g").collect()
        assert {r["name"] for r in out} == set(cases)  # equal values have no bandwidth
        for name, xs in cases.items():
            rows = [r for r in out if r["name"] == name]
            grid, bw, peak, want = density_case(xs, points)
            assert [r["g"] for r in rows] == list(range(points))
            assert [r["x"] for r in rows] == pytest.approx(list(grid), rel=1e-12)
            assert rows[0]["bw"] == pytest.approx(bw, rel=1e-12)
            bound = (1 / 64) ** 2 / 8 * peak
            assert np.abs(np.array([r["density"] for r in rows]) - want).max() <= bound * (1 + 1e-9), name
    whole = M.density_table(df.filter("name = 'gamma'"), [], "x", points=64).count()
    assert whole == 64
    with pytest.raises(ValueError):
        M.density_table(df, [], "x", tail=1.0)


def test_density_is_the_exact_sum(spark):
    """No term is binned or cut, also of points between two clusters that most values are far from."""
    rng = np.random.default_rng(10)
    cases = {"gamma": np.round(rng.gamma(3, 2, 400), 2), "two": np.concatenate([rng.normal(0, 1, 300), rng.normal(30, 1, 200)])}
    df = spark.createDataFrame([(g, float(x)) for g, xs in cases.items() for x in xs], "name string, x double").repartition(3)
    out = M.density_table(df, ["name"], "x", points=64).orderBy("name", "g").collect()
    for name, xs in cases.items():
        want = density_case(xs, 64)[3]
        assert [r["density"] for r in out if r["name"] == name] == pytest.approx(list(want), rel=1e-9, abs=0), name


def test_normal_scores_of_a_hot_group(spark):
    """One group holds nearly all rows; its ranks come from ranges in several tasks, and no window spans it."""
    rng = np.random.default_rng(21)
    groups = {"hot": np.round(rng.normal(size=40000), 2), "small": rng.exponential(size=50), None: rng.normal(size=9), "flat": np.full(4, 2.0)}
    rows = [(g, float(x), i) for g, xs in groups.items() for i, x in enumerate(xs)] + [("small", None, 99)]
    df = spark.createDataFrame(rows, "g string, e double, i int").repartition(6)
    got = {r["g"]: (r["n"], r["w"]) for r in M.normal_scores(df, ["g"], "e", ["i"], normal_score).collect()}
    quantile = NormalDist().inv_cdf
    for g, xs in groups.items():
        z = np.array([quantile((k + .625) / (len(xs) + .25)) for k in range(len(xs))])
        assert got[g][0] == len(xs)
        if g == "flat":
            assert got[g][1] is None
        else:
            assert got[g][1] == pytest.approx(np.corrcoef(np.sort(xs), z)[0, 1] ** 2, abs=2e-4), g


def test_expand_beyond_one_array_is_whole(spark):
    df = spark.range(3).withColumnRenamed("id", "m")
    dim = spark.range(1000).selectExpr("id AS d", "id * 2 AS w")
    out = E.expand_by(df, dim, limit=100)
    assert out.count() == 3000 and out.distinct().count() == 3000
    with pytest.raises(Exception, match="more rows than fit"):
        df.select(F.explode(E.as_array(dim, limit=10))).collect()


def test_blocks_give_every_pair_by_either_join(spark):
    df = spark.range(4).withColumnRenamed("id", "m").withColumn("k", F.lit(None).cast("string"))
    dim = spark.range(0, 1000, 1, 3).selectExpr("id AS d", "id * 2.0D AS w", "IF(id % 7 = 0, NULL, 'x') AS note")
    blocks = E.row_blocks(dim, 100)
    assert blocks.agg(F.max(F.size("_rows"))).first()[0] <= 100 and blocks.count() >= 10
    whole = E.expand_blocks(df, dim)
    assert whole.columns == ["m", "k", "d", "w", "note"]
    for most in (64, 1):  # broadcast, joined as Spark sees fit
        out = E.expand_blocks(df, dim, 100, most)
        assert out.count() == 4000 and out.distinct().count() == 4000
        assert out.exceptAll(whole).isEmpty()
    assert E.expand_blocks(df, dim.limit(0)).count() == 0 and E.expand_blocks(df.limit(0), dim).count() == 0


def test_scores_over_many_blocks_scan_candidates_once(spark, monkeypatch):
    """Points of many blocks: scores equal the plain sum, and the plan reads the candidates in one place."""
    rng = np.random.default_rng(8)
    obs_rows = [(float(t), float(x)) for t, x in enumerate(rng.uniform(5, 9, 300))]
    cand_rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(4, 9, 40), rng.uniform(-.001, .01, 40)))]
    obs = spark.createDataFrame(obs_rows, "t double, value double")
    folder = scratch_path(spark, "candidates")
    spark.createDataFrame(cand_rows, "candidate int, a double, b double").write.parquet(folder)
    monkeypatch.setattr(K, "expand_blocks", lambda df, dim: E.expand_blocks(df, dim, 32))
    scored = K.score_candidates(spark.read.parquet(folder), obs, lambda: F.col("a") + F.col("b") * F.col("t"))
    t, x = np.array(obs_rows).T
    want = {i: float((((x - a - b * t) ** 2) / np.maximum(a + b * t, max(1e-3, x.min()))).sum()) for i, a, b in cand_rows}
    assert {r["candidate"]: r["score"] for r in scored.collect()} == pytest.approx(want, rel=1e-12)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line and "candidate#" in line for line in plan.splitlines()) == 1


def test_index_of_a_hot_group(spark):
    df = spark.range(0, 5000).selectExpr("id AS key", "IF(id % 3 = 0, 'hot', concat('g', id % 40)) AS g").repartition(8)
    got = sorted((r["key"], r["repeat"]) for r in O.repeat_index(df, [], ["key"]).collect())
    assert [x[1] for x in got] == list(range(1, 5001))
    hot = sorted((r["key"], r["repeat"]) for r in O.repeat_index(df, ["g"], ["key"]).filter("g = 'hot'").collect())
    assert [x[1] for x in hot] == list(range(1, len(hot) + 1))
    dates = df.selectExpr("date_add(date '2020-01-01', cast(key / 7 as int)) AS day", "key")
    back = sorted((r["day"], r["key"], r["repeat"]) for r in O.repeat_index(dates, [], ["day", "key"]).collect())
    assert [x[2] for x in back] == list(range(1, 5001))


def test_durbin_watson_across_groups(spark):
    rng = np.random.default_rng(2)
    e = rng.normal(size=30)
    rows = [(f"r{i // 10}", i % 10, float(v)) for i, v in enumerate(e)]
    df = spark.createDataFrame(rows, "region string, week int, e double")
    got = O.durbin_watson(df, [], "region", "week", "e").first()
    assert got["dw"] == pytest.approx((np.diff(e) ** 2).sum() / (e ** 2).sum()) and got["n"] == 30


def test_wls_floors_the_divisor_only(spark):
    obs = spark.createDataFrame([(1, "a", 10.0), (2, "a", 4.0), (1, "b", 0.5)], "t int, series string, value double")
    exp = spark.createDataFrame([(7, 1, "a", 9.0), (7, 2, "a", 0.1), (7, 1, "b", -1.0)], "candidate int, t int, series string, expected double")
    losses = K.point_losses(obs, exp, ["t", "series"])
    want = 1 / 9 + 3.9 ** 2 / 0.5 + 1.5 ** 2 / 0.5
    assert K.wls_score(losses, ["candidate"]).first()["score"] == pytest.approx(want)
    by = {r["series"]: r["score"] for r in K.wls_by_series(losses, ["candidate"]).collect()}
    assert by[None] == pytest.approx(want) and by["a"] + by["b"] == pytest.approx(want)


def test_wls_of_exact_data_is_zero_and_null_spreads(spark):
    obs = spark.createDataFrame([(1, 3.0), (2, 5.0)], "t int, value double")
    exact = spark.createDataFrame([(1, 1, 3.0), (1, 2, 5.0), (2, 1, 3.0), (2, 2, None)], "candidate int, t int, expected double")
    got = {r["candidate"]: r["score"] for r in K.wls_score(K.point_losses(obs, exact, ["t"]), ["candidate"]).collect()}
    assert got == {1: 0.0, 2: None}


def test_search_finds_a_line(spark):
    obs = spark.createDataFrame([("a", t, 100 + 3.0 * t, 100.0) for t in range(1, 20)], "series string, t int, value double, base double")
    ids = spark.range(3000).withColumnRenamed("id", "candidate")
    best = K.candidate_search(ids, obs, {"mu": (0.5, 1.5), "eta": (-.1, .1)},
                              lambda: F.col("base") * (F.col("mu") + F.col("eta") * F.col("t")), keep=10, rounds=4)
    rows = best.orderBy("round", "score").collect()
    assert len(rows) == 40
    first, last = rows[0], rows[30]
    assert last["score"] <= first["score"]
    assert last["mu"] == pytest.approx(1.0, abs=5e-3) and last["eta"] == pytest.approx(0.03, abs=5e-4)


def test_keyed_search_has_boxes_per_key(spark):
    obs = spark.createDataFrame([(g, "a", t, 100 + s * t, 100.0) for g, s in (("up", 4.0), ("down", -3.0)) for t in range(1, 20)],
                                "g string, series string, t int, value double, base double")
    ids = spark.range(2000).selectExpr("id AS candidate", "IF(id % 2 = 0, 'up', 'down') AS g")
    line = lambda: F.col("base") * (F.col("mu") + F.col("eta") * F.col("t"))
    best = K.candidate_search(ids, obs, {"mu": (0.5, 1.5), "eta": (-.1, .1)}, line, keep=8, rounds=5, by=["g"])
    rows = best.collect()
    assert len(rows) == 2 * 8 * 5
    for g, slope in (("up", 0.04), ("down", -0.03)):
        last = min((r["score"], r["mu"], r["eta"]) for r in rows if r["g"] == g and r["round"] == 5)
        assert last[1] == pytest.approx(1.0, abs=0.01) and last[2] == pytest.approx(slope, abs=1e-3)


def test_best_start_keeps_failed_replicates(spark):
    df = spark.createDataFrame([(1, 5.0, 0, 1), (1, 4.0, 1, 2), (1, 6.0, 0, 3), (2, 1.0, 10, 4)], "b int, value double, code int, start int")
    got = {r["b"]: tuple(r)[1:] for r in K.best_start(df, "b", "value", "code", ["start"]).collect()}
    assert got == {1: ("Successful completion", 5.0, 1), 2: ("No convergence", None, None)}


def test_profile_with_no_converged_start_is_null(spark):
    df = spark.createDataFrame([(0.1, 5.0, 0), (0.1, 3.0, 1), (0.2, 9.0, 10)], "parm double, score double, code int")
    got = {r["parm"]: r["wls"] for r in K.profile_scan(df, "parm", "score", F.col("code") == 0).collect()}
    assert got == {0.1: 5.0, 0.2: None}
    low = O.bottom_rows(K.profile_scan(df, "parm", "score", F.col("code") == 0), [], "wls").collect()
    assert [(r["parm"], r["wls"]) for r in low] == [(0.1, 5.0)]


def test_replicates_recover_the_data_on_average(spark):
    res = spark.createDataFrame([(i, 10.0, float(i)) for i in range(5)], "t int, expected double, residual double")
    out = wild_replicates(res, ["t"], 2000, "Rademacher", 1)
    m = {r["t"]: (r["m"], r["s"]) for r in out.groupBy("t").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).collect()}
    for t, (mean, sd) in m.items():
        assert mean == pytest.approx(10, abs=0.3) and sd == pytest.approx(t, abs=0.05)


def test_relative_to_reference(spark):
    df = spark.createDataFrame([("k", 0.8, 1.2), ("k", 1.0, 1.0), ("a", 1.0, 4.0), ("a", 1.2, 3.0)], "p string, m double, est double")
    out = O.relative_to_reference(df.withColumn("ref", F.col("m") == 1), ["p"], "est", "ref", "rel")
    assert {(r["p"], r["m"]): round(r["rel"], 9) for r in out.collect()} == {
        ("k", 0.8): 0.2, ("k", 1.0): 0.0, ("a", 1.0): 0.0, ("a", 1.2): -0.25}


def test_drop_worst_with_ties(spark):
    df = spark.createDataFrame([(1, 9.0), (2, 9.0), (3, 1.0)], "model_id int, rss double")
    assert sorted(r["model_id"] for r in O.drop_worst(df, "rss", "model_id").collect()) == [2, 3]


def test_read_tests_header_and_blanks(spark, tmp_path):
    text = (f'Entity,Code,Day,new_tests_7day_smoothed,142752-annotations,"{tables.CASES_HEADER}"\n'
            "United Kingdom,GBR,2020-08-03,154054,tests performed,791.85714\n"
            "United Kingdom,GBR,2020-08-04,,tests performed,800.5\n")
    (tmp_path / "t.csv").write_text(text)
    rows = tables.read_tests(spark, str(tmp_path / "t.csv")).orderBy("day").collect()
    assert rows[0]["new_tests"] == 154054 and rows[0]["new_cases"] == 791.85714 and rows[1]["new_tests"] is None


def test_read_deaths_decimal_comma(spark, tmp_path):
    text = ("areaType,areaName,areaCode,date,newDailyNsoDeathsByDeathDate,cumDailyNsoDeathsByDeathDate,7-day_average\n"
            'overview,United Kingdom,K02000001,2021-04-23,20,152491,\n'
            'overview,United Kingdom,K02000001,2020-08-03,23,57373,"21,7142857143"\n'
            "overview,United Kingdom,K02000001,2020-07-31,31,57313,23\n")
    (tmp_path / "d.csv").write_text(text)
    got = [r["average7"] for r in tables.read_deaths(spark, str(tmp_path / "d.csv")).orderBy("day").collect()]
    assert got == [23.0, 21.7142857143, None]


def test_param_table_rename_is_simultaneous(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Repeat,Value,Convergence,v,k,exit_rate\n196,55012.49,Successful completion,0.978,0.999,NA\n')
    row = tables.read_params(spark, str(tmp_path / "p.csv"), ["Repeat", "Value", "Convergence", "v", "k", "exit_rate"], {"v": "exit_rate", "exit_rate": "eta"}).first()
    assert row["exit_rate"] == 0.978 and row["eta"] is None and row["k"] == 0.999


def test_batches_resume_after_a_death_midway(spark):
    path, tasks, seen = scratch_path(spark, "test-batches"), spark.range(200).withColumnRenamed("id", "task"), []

    def work(df):
        seen.append(1)
        return df.withColumn("result", F.col("task") * 2)

    def dies(df):
        if len(seen) > 3:
            raise InterruptedError
        return work(df)

    with pytest.raises(InterruptedError):
        sinks.run_batches(tasks, dies, path, "task", batches=6)
    done = sinks.committed(spark, path, "1")
    assert 0 < len(done) < 6
    seen.clear()
    out = sinks.run_batches(tasks, work, path, "task", batches=6)
    assert len(seen) == 1 + 6 - len(done)
    assert sorted(r["task"] for r in out.collect()) == list(range(200))
    seen.clear()
    assert sinks.run_batches(tasks, work, path, "task", batches=6).count() == 200 and len(seen) == 1
    assert sinks.run_batches(tasks, work, path, "task", batches=2, run="2").count() == 200


def test_malformed_cells_are_errors(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Entity,Code,Day,stringency_index\na,b,2021-01-01,oops\n")
    with pytest.raises(Exception):
        tables.read_control(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "ok.csv").write_text("Entity,Code,Day,stringency_index\na,b,2021-01-01,\na,b,NA,NA\n")
    assert [(r["day"] is None, r["psi"]) for r in tables.read_control(spark, str(tmp_path / "ok.csv")).collect()] == [(False, None), (True, None)]
    df = spark.createDataFrame([("1,5", "31/12/2020"), ("", ""), (None, None)], "x string, d string")
    got = df.select(tables.decimal_comma(F.col("x")).alias("x"), tables.day_first("d").alias("d")).collect()
    assert [r["x"] for r in got] == [1.5, None, None] and str(got[0]["d"]) == "2020-12-31" and got[1]["d"] is None
    for bad in ("notadate", "2020-12-31"):
        with pytest.raises(Exception, match="no date"):
            spark.createDataFrame([(bad,)], "d string").select(tables.day_first("d")).collect()
    with pytest.raises(Exception, match="no number"):
        spark.createDataFrame([("oops",)], "x string").select(tables.decimal_comma(F.col("x"))).collect()


def test_index_of_null_and_text_keys(spark):
    rows = [(None if i % 10 == 0 else f"k{i % 37}x{i}", None if i % 4 == 0 else f"g{i % 3}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, g string, i int").repartition(5)
    whole = O.repeat_index(df, [], ["key", "i"]).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[2]))
    assert {r["i"]: r["repeat"] for r in whole} == {r[2]: k + 1 for k, r in enumerate(want)}
    by_group = {r["i"]: r["repeat"] for r in O.repeat_index(df, ["g"], ["key", "i"]).collect()}
    count = {}
    for _, g, i in want:
        count[g] = count.get(g, 0) + 1
        assert by_group[i] == count[g]
    ties = spark.range(1000).selectExpr("1 AS key", "id % 2 AS g")
    assert sorted(r["repeat"] for r in O.repeat_index(ties, [], ["key"]).collect()) == list(range(1, 1001))


def test_candidate_with_a_gap_has_no_score(spark):
    obs = spark.createDataFrame([(1, "a", 3.0), (2, "a", 5.0), (1, "b", 1.0)], "t int, series string, value double")
    exp = spark.createDataFrame([(1, 1, "a", 3.0), (1, 1, "b", 1.0), (2, 1, "a", 9.0), (2, 2, "a", 5.0), (2, 1, "b", 1.0),
                                 (3, 1, "a", 3.0), (3, 1, "a", 3.0), (3, 1, "b", 1.0)], "candidate int, t int, series string, expected double")
    losses = K.point_losses(obs, exp, ["t", "series"])
    got = {r["candidate"]: r["score"] for r in K.wls_score(losses, ["candidate"]).collect()}
    assert got[1] is None and got[2] == pytest.approx(4.0) and got[3] is not None
    by = {(r["candidate"], r["series"]): r["score"] for r in K.wls_by_series(losses, ["candidate"]).collect()}
    assert by[(1, "a")] is None and by[(1, "b")] == 0.0 and by[(1, None)] is None and by[(2, "a")] == pytest.approx(4.0)


def test_missing_control_days_have_one_rule(spark):
    control = spark.createDataFrame([(0, 50.0), (1, 50.0), (3, 50.0)], "day_idx int, psi double")
    daily = I.daily_integrands(control.withColumns({"k": F.lit(0.5), "a": F.lit(1.0)}))
    span = spark.createDataFrame([(0.0, 4.5), (0.0, 2.0)], "lo double, hi double")
    points = spark.createDataFrame([(1, 2.0), (2, 4.5)], "j int, t double")
    models = spark.createDataFrame([(1, 0.5, 1.0)], "model_id int, k double, a double")

    def prefix(fill):
        out = I.prefix_integrals(models, I.segment_weights(points, control, fill), {"f1": F.col("f1")})
        return {r["j"]: r["f1"] for r in out.collect()}

    zero = {r["hi"]: r["f1"] for r in I.interval_integrals(span, daily, ["f1"], missing=I.uncontrolled()).collect()}
    assert prefix("zero") == {1: pytest.approx(zero[2.0]), 2: pytest.approx(zero[4.5])}
    none = {r["hi"]: r["f1"] for r in I.interval_integrals(span, daily, ["f1"]).collect()}
    assert none[4.5] is None and none[2.0] == pytest.approx(zero[2.0])
    assert prefix("null") == {1: pytest.approx(zero[2.0]), 2: None}


def test_laws_are_drawn_in_one_pass(spark):
    res = spark.createDataFrame([(i, 10.0, float(i)) for i in range(5)], "t int, expected double, residual double")
    both = {(r["law"], r["t"], r["replicate"]): r["value"] for r in wild_replicates(res, ["t"], 20, ["Rademacher", "Mammen2"], 1).collect()}
    for law in ("Rademacher", "Mammen2"):
        for r in wild_replicates(res, ["t"], 20, law, 1).collect():
            assert both[(law, r["t"], r["replicate"])] == r["value"]


def test_best_control_parameters_are_admissible():
    assert 0 < C.BEST_K < 1 and 0 < C.BEST_A < 10
