"""Order without one task, bootstrap draws, posterior sums and bursts, held against plain procedures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.compare import SF, plain

from tessera.functions.scalars import ln_gamma
from tessera.operators import analytics as A
from tessera.operators import evaluation as M
from tessera.operators import ordered as O
from tessera.operators import resampling as B
from tessera.operators import routing as R
from tessera.plans import catalog

import __spark_entry__  # noqa: F401, E402  registers the queries


def q_values(p, ids):
    order = sorted(range(len(p)), key=lambda i: (p[i], ids[i]))
    low, out = 1.0, {}
    for r in range(len(p), 0, -1):
        low = min(low, p[order[r - 1]] * len(p) / r)
        out[ids[order[r - 1]]] = low
    return out


def test_q_values_by_ranges(spark):
    rng = np.random.default_rng(3)
    p = np.where(rng.random(3000) < 0.34, 0.031, rng.random(3000))  # a third has one value
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "u int, p double")
    x = A.with_q_values(df, "p", "u")
    assert x.columns == ["u", "p", "q_value"]
    want = q_values(p.tolist(), list(range(3000)))
    assert all(r["q_value"] == pytest.approx(want[r["u"]], abs=1e-12) for r in x.collect())
    assert O.ranged(df, "p", "u").select(O.RANGE).distinct().count() > 1
    for few in (df.limit(0), df.limit(1)):
        assert A.with_q_values(few, "p", "u").count() == few.count()


def test_no_window_over_everything(spark):
    df = spark.range(50).select(F.col("id").alias("u"), (F.col("id") / 50).alias("p"))
    plan = A.with_q_values(df, "p", "u")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_running_sums(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i % 5) for i in range(200)], "k int, n int")
    v = [0 if i % 7 == 0 else i % 5 for i in range(200)]
    for back in (False, True):
        got, total = O.running_sum(O.ranged(df, "k"), "n", ("k",), "s", back)
        assert total == sum(v)
        assert {r["k"]: r["s"] for r in got.collect()} == {i: sum(v[i:]) if back else sum(v[: i + 1]) for i in range(200)}
    tail, _ = O.running_sum(O.ranged(df.withColumn("n", F.when(F.col("k") < 20, F.col("n"))), "k"), "n", ("k",), "s", True)
    assert max(r["s"] for r in tail.where("k >= 20").collect()) == 0
    some = O.running_min_down(O.ranged(df, "k"), "n", ("k",), "m")
    assert {r["k"]: r["m"] for r in some.where("k >= 190").collect()} == {i: min([x for j, x in zip(range(i, 200), v[i:], strict=True) if j % 7] or [None]) for i in range(190, 200)}


def test_conformal_threshold(spark):
    df = spark.createDataFrame([(i % 50, i % 50 < 20) for i in range(500)] + [(None, True)], "s int, wrong boolean")
    best = min(s for s in range(50) if (n := 10 * (50 - s)) >= 20 and (10 * max(20 - s, 0) + 1) / (n + 1) <= 0.1)
    assert M.conformal_threshold(df, "s", "wrong").first()[0] == best
    assert M.conformal_threshold(df.limit(0), "s", "wrong").first()[0] is None


def test_poisson_limits():
    t = [int(x, 16) / 2**32 for x in B.poisson_limits()]
    assert t == sorted(t) and t[0] == pytest.approx(math.exp(-1)) and sum(1 - x for x in t) == pytest.approx(1, abs=1e-6)


def test_draws(spark):
    df = spark.range(4000).select("id", (F.col("id") % 3).alias("g"), F.when(F.col("id") % 11 > 0, F.col("id").cast("double")).alias("v"))
    one = B.weighted_draws(df, F.col("id"), 10, 1)
    again = B.weighted_draws(df.repartition(7), F.col("id"), 10, 1)
    key = lambda x: sorted((r["draw"], r["id"], r["weight"]) for r in x.collect())
    assert key(one) == key(again)
    per = {r["draw"]: r for r in one.groupBy("draw").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q")).collect()}
    assert set(per) == set(range(11)) and per[0]["s"] == 4000
    assert all(abs(per[d]["s"] - 4000) < 5 * 4000**0.5 and per[d]["q"] / 4000 == pytest.approx(2, abs=0.3) for d in range(1, 11))
    got = {r["g"]: r for r in B.bootstrap_mean(df, "v", F.col("id"), ["g"]).collect()}
    for g in range(3):
        v = np.array([i for i in range(4000) if i % 3 == g and i % 11])
        se = v.std() / len(v) ** 0.5
        assert got[g]["n"] == len(v) and got[g]["mean"] == pytest.approx(v.mean())
        assert (got[g]["hi"] - got[g]["lo"]) / (2 * 1.96 * se) == pytest.approx(1, abs=0.2)
    assert B.bootstrap_mean(df.where("v is null"), "v", F.col("id"), ["g"]).count() == 0


def test_uplift_by_hand(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(3)), int(rng.integers(2)), 0.5, float(rng.integers(2))) for i in range(300)] + [(999, 0, 0, 0.5, None)]
    log = spark.createDataFrame(rows, "k int, context int, arm int, propensity double, reward double")
    pi = F.col("context") % 2
    got = R.uplift(log, pi, 100, key=F.col("k")).first()
    w = B.weighted_draws(log.where("reward is not null"), F.col("k"), 100, 7).toPandas()

    def value(x):
        up = down = 0.0
        for r in x.itertuples():
            cell = x[(x.context == r.context) & (x.arm == r.context % 2)]
            q = ((cell.weight * cell.reward).sum() + 0.5) / (cell.weight.sum() + 1)
            up += r.weight * (q + (r.reward - q) / r.propensity * (r.arm == r.context % 2))
            down += r.weight * r.reward
        return up / x.weight.sum(), down / x.weight.sum()

    dr, inc = value(w[w.draw == 0])
    assert got["n"] == 300 and got["dr"] == pytest.approx(dr) and got["incumbent"] == pytest.approx(inc)
    ups = sorted(np.subtract(*value(w[w.draw == d])) for d in range(1, 101))
    assert got["lo"] == pytest.approx(ups[2]) and got["hi"] == pytest.approx(ups[97]) and got["verdict"] == "insufficient"
    none = R.uplift(log.limit(0), pi, key=F.col("k")).first()
    assert none["n"] == 0 and none["dr"] is None and none["verdict"] == "insufficient"


def test_posterior_by_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(3)), float(rng.integers(2)), [float(v) for v in rng.integers(-1, 2, 26)], "c" if i % 5 else None) for i in range(200)] + [(None, 1.0, [1.0] * 26, "c"), (1, None, [1.0] * 26, "c")]
    log = spark.createDataFrame(rows, "arm int, reward double, x array<double>, context string")
    got = R.ThompsonPolicy.replay(log, F.col("x"))
    want = R.ThompsonPolicy()
    for arm, r, x, c in rows:
        if c is not None and arm is not None and r is not None:
            want.update(arm, np.array(x), r)
    assert np.allclose(got.a, want.a) and np.allclose(got.b, want.b) and got.seen == len(rows)
    assert R.ThompsonPolicy.replay(log.limit(0), F.col("x")).seen == 0


def test_ln_gamma():
    x = np.array([0.1, 0.3, 0.5, 1, 1.5, 2, 7, 55.5, 1e4, 1e8])
    assert np.allclose(ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def series():
    rng = np.random.default_rng(8)
    flat = [rng.poisson(rng.uniform(0.1, 30), 28) for _ in range(60)]
    rise = [np.r_[rng.poisson(5, 20), rng.poisson(16, 8)] for _ in range(60)]
    wild = [rng.negative_binomial(1, 0.1, 28) for _ in range(60)]
    return np.array([*flat, *rise, *wild, np.zeros(28, int), np.full(28, 4)])


def test_paths_of_many_units():
    days = series()
    for n in (6, 7, 15, 28):
        path, able = A.burst_paths(days[:, :n])
        for x, p, ok in zip(days, path, able, strict=True):
            want = A.burst_states(x[:n])
            assert (want is None) == (not ok) and (want is None or (want == p).all())


def test_bursts_and_detections(spark):
    days = series()
    rows = [(f"u{i}", 100 + t, int(v)) for i, x in enumerate(days) for t, v in enumerate(x)] + [("short", 100 + t, 3) for t in range(5)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["u", "day", "n"])).repartition(5)
    got = {r["u"]: r for r in A.bursts(df, "u").collect()}
    seen = {r["u"]: r for r in A.burst_detections(df, "u").collect()}
    assert len(seen) == len(days) + 1 and seen["short"]["seen_day"] is None
    found = 0
    for i, x in enumerate(days):
        path = A.burst_states(x)
        assert (path is None) == (f"u{i}" not in got)
        if path is not None:
            on, at, k = A.burst_summary(path)
            r = got[f"u{i}"]
            assert (r["active"], r["onset_day"], r["days_active"]) == (on, None if at is None else 100 + at, k)
        first = next((t for t in range(7, 29) if (p := A.burst_states(x[:t])) is not None and p[-1]), None)
        found += first is not None
        assert seen[f"u{i}"]["seen_after"] == first and seen[f"u{i}"]["seen_day"] == (None if first is None else 99 + first)
    assert found > 60
    assert A.bursts(df.limit(0), "u").count() == 0


def test_registered_bursts(spark):
    """The registered query against the plain procedure, unit by unit."""
    spine = catalog.QUERIES["zero_filled_spine"](spark, SF).toPandas().sort_values("day")
    rows = []
    for u, x in spine.groupby("user_id"):
        path = A.burst_states(x["n"].to_numpy())
        if path is not None:
            on, at, k = A.burst_summary(path)
            rows.append((u, on, None if at is None else int(x["day"].iloc[at]), k))
    want = pd.DataFrame(rows, columns=["user_id", "active", "onset_day", "days_active"])
    assert plain(catalog.QUERIES["burst_decode"](spark, SF).toPandas()) == plain(want)
