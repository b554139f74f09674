"""Searches per key: racing changes nothing, and plain loops give the same rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strainshift.operators import race as R
from strainshift.session import materialise

BOXES = {"m": (0.0, 4.0), "e": (-1.0, 1.0)}


def line():
    return F.col("m") + F.col("e") * F.col("t")


def uniform(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16) / 4503599627370496


def plain(sets, starts, keep, rounds, near=lambda k, best: best.get(k, [])):
    best = {}
    for number in range(1, rounds + 1):
        new = {}
        for k, points in sets.items():
            seen = near(k, best)
            rows = list(best.get(k, []))
            for c in range(1, starts + 1):
                draw = {}
                for n, (lo, hi) in BOXES.items():
                    at = [r[3 + list(BOXES).index(n)] for r in seen]
                    lo, hi = (min(at), max(at)) if at else (lo, hi)
                    draw[n] = lo + (hi - lo) * uniform(f"7-{number}", k, c, n)
                floor = max(1e-3, min(v for _, v in points))
                ex = [draw["m"] + draw["e"] * t for t, _ in points]
                if min(ex) > 0:
                    rows.append((sum((v - x) ** 2 / max(x, floor) for (_, v), x in zip(points, ex)), number, c, draw["m"], draw["e"]))
            new[k] = sorted(rows)[:keep]
        best = {k: v for k, v in new.items() if v}
    return best


@pytest.fixture(scope="module")
def sets():
    rng = random.Random(5)
    out = {k: [(t, 2 + 0.1 * k + 0.2 * t + rng.random()) for t in range(1, 9)] for k in range(6)}
    out[6] = [(1, 2.0)]                       # fewer points than blocks
    out[7] = [(t, 1.0) for t in (-100, 100)]  # a line that stays positive needs a start that no draw gives
    return out


def run(spark, sets, blocks, **more):
    obs = spark.createDataFrame([(k, t, float(v)) for k, p in sets.items() for t, v in p], "k int, t int, value double")
    keys = obs.select("k").distinct()
    return R.race_search(keys, obs, ["t"], BOXES, line, 12, 4, 3, 7, blocks, **more), keys


def test_racing_equals_plain_loops(spark, sets):
    want = plain(sets, 12, 4, 3)
    for blocks in (1, 4):
        best, keys = run(spark, sets, blocks)
        got = {}
        for r in best.collect():
            got.setdefault(r.k, []).append((r.score, r.round, r.candidate, r.m, r.e))
        assert set(got) == set(want) and 7 not in got
        for k in want:
            assert [r[1:3] for r in sorted(got[k])] == [r[1:3] for r in want[k]]
            assert [x for r in sorted(got[k]) for x in (r[0], r[3], r[4])] == pytest.approx([x for r in want[k] for x in (r[0], r[3], r[4])])
        rows = {r.k: r for r in R.best_of_each(keys, best, ["score", "m", "e"]).collect()}
        assert set(rows) == set(sets) and rows[7].convergence == "No convergence" and rows[7].score is None and rows[7].m is None
        assert all(rows[k].score == pytest.approx(want[k][0][0]) for k in want)


def test_candidates_leave_after_a_block(spark):
    starts = spark.createDataFrame([(1, c, None if c == 3 else 5.0, float(c), 0.0) for c in (1, 2, 3)], "k int, candidate int, _bound double, m double, e double")
    blocks = [spark.createDataFrame([(1, t, 3.0, 0.001)], "k int, t int, value double, _floor double") for t in (1, 2)]
    first = {r.candidate for r in R.raced(starts, blocks[:1], ["k"], line).collect()}
    assert first == {1, 2, 3}
    assert {(r.candidate, r.score) for r in R.raced(starts, blocks, ["k"], line).collect()} == {(2, 1.0), (3, 0.0)}


def test_one_exchange_of_starts_and_one_per_block(spark, sets):
    obs = spark.createDataFrame([(k, t, float(v)) for k, p in sets.items() for t, v in p], "k int, t int, value double")
    dealt = R.dealt_blocks(obs, ["k"], ["t"], 3)
    parts = [dealt.filter(F.col("_block") == i).drop("_block") for i in range(3)]
    starts = materialise(spark.createDataFrame([(1, 1, 9.0, 1.0, 0.0)], "k int, candidate int, _bound double, m double, e double"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = R.raced(starts, parts, ["k"], line)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 4


def test_warm_starts_come_from_neighbours(spark):
    best = spark.createDataFrame([("p", 0, 1.0), ("p", 5, 2.0)], "parm string, g int, score double")
    got = {(r.g, r.score) for r in R.neighbours(best, "g", 5).collect()}
    assert got == {(0, 1.0), (1, 1.0), (4, 2.0), (5, 2.0)}


def test_fixed_values_and_a_profile_minimum(spark):
    """One data set for all keys; the profile over the level has its minimum where the data have it."""
    obs = spark.createDataFrame([(t, 2.0 + 0.25 * t) for t in range(1, 11)], "t int, value double")
    keys = spark.range(9).select(F.col("id").cast("int").alias("g"))
    best = R.race_search(keys, obs, ["t"], BOXES, line, 20, 4, 4, fixed={"m": lambda draw: F.col("g") / 2.0}, informs=lambda rows: R.neighbours(rows, "g", 8))
    low = {r.g: r.score for r in R.best_of_each(keys, best, ["score"]).collect()}
    assert min(low, key=low.get) == 4 and low[4] < 1e-3
