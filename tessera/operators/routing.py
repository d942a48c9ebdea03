"""Choosing arms, logging decisions, and judging policies from the log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.resampling import interval, weighted_draws
from tessera.plans.lineage import cut

#: Arms and the engines behind them.
ARMS: dict[str, tuple[str, ...]] = {
    "fast": ("duckduckgo", "brave", "mojeek"),
    "broad": ("duckduckgo", "brave", "qwant", "startpage", "wikipedia"),
    "reference": ("wikipedia", "wikidata", "arxiv", "crossref"),
}
K_FLOOR, ROW_BYTES = 5, 60
DIM, RIDGE, SPREAD, DRAWS = 26, 1.0, 0.25, 64


def arm_stats(log: DataFrame, by: Sequence[str], arm: str, reward: str) -> DataFrame:
    """Pulls, reward and mean of each arm; the mean of an arm without pulls is one half."""
    g = log.groupBy(*by, arm).agg(F.count("*").alias("pulls"), F.sum(F.col(reward).cast("long")).alias("reward_sum"))
    return g.withColumn("mean", F.when(F.col("pulls") == 0, 0.5).otherwise(F.col("reward_sum") / F.col("pulls")))


def greedy_arms(stats: DataFrame, intents: DataFrame, by: str = "intent", arm: str = "arm", arms: int = len(ARMS)) -> DataFrame:
    """The arm with the highest mean of each intent; of equals the last one, so that without data it is the last arm."""
    every = intents.select(by).distinct().withColumn(arm, F.explode(F.sequence(F.lit(0), F.lit(arms - 1))))
    x = every.join(stats.select(by, arm, "mean"), [by, arm], "left").withColumn("mean", F.coalesce("mean", F.lit(0.5)))
    w = Window.partitionBy(by).orderBy(F.desc("mean"), F.desc(arm))
    return x.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(by, F.col(arm).alias("greedy"))


def choose(decisions: DataFrame, salt: Column, greedy: Column, epsilon: float = 0.1, arms: int = len(ARMS)) -> DataFrame:
    """Adds ``arm`` and ``propensity``: with probability epsilon (by the salt) the arm that the salt names, else the greedy one."""
    roll = F.pmod(salt, F.lit(1_000_003)) / 1_000_003.0
    arm = F.when(roll < epsilon, F.pmod(salt, F.lit(arms)).cast("int")).otherwise(greedy)
    return decisions.withColumn("arm", arm).withColumn("propensity", propensity(F.col("arm"), greedy, epsilon, arms))


def propensity(arm: Column, greedy: Column, epsilon: float = 0.1, arms: int = len(ARMS)) -> Column:
    return F.when(arm == greedy, (1 - epsilon) + epsilon / arms).otherwise(epsilon / arms)


def anonymise(log: DataFrame, day: str, context: str, order: str, floor: int = K_FLOOR) -> DataFrame:
    """Adds ``shown``: the context from its ``floor``-th row of the day on; null before."""
    n = F.row_number().over(Window.partitionBy(day, context).orderBy(order))
    return log.withColumn("shown", F.when(n >= floor, F.col(context)))


def sweep(log: DataFrame, today: int, day: str = "day", keep_days: int = 30, most_bytes: int = 20 << 20) -> DataFrame:
    """Rows of the last days, without the oldest days if the log is over its size; never without today's."""
    x = log.where(F.col(day) >= today - keep_days)
    per = x.groupBy(day).agg((F.count("*") * ROW_BYTES).alias("b"))
    newer = per.withColumn("c", F.sum("b").over(Window.orderBy(F.desc(day))))  # one row for each day kept
    return x.join(F.broadcast(newer.where((F.col("c") <= most_bytes) | (F.col(day) >= today)).select(day)), day, "left_semi")


def reward_model(log: DataFrame, context: str = "context", arm: str = "arm", reward: str = "reward") -> DataFrame:
    """Mean reward of each context and arm with a prior of one half that weighs one observation."""
    return log.groupBy(context, arm).agg(((F.sum(reward) + 0.5) / (F.count("*") + 1)).alias("q"))


def ips(log: DataFrame, policy: Column, clip: float = 0.0) -> DataFrame:
    """Inverse-propensity value of a policy; null for an empty log."""
    w = 1 / F.greatest(F.col("propensity"), F.lit(1e-9))
    w = F.least(w, F.lit(clip)) if clip > 0 else w
    return log.agg(F.avg(F.when(F.col("arm") == policy, w * F.col("reward")).otherwise(0.0)).alias("ips"))


def _terms(log: DataFrame, policy: Column) -> DataFrame:
    q = reward_model(log)
    x = log.withColumn("pi", policy)
    x = x.join(q.select("context", F.col("arm").alias("pi"), F.col("q").alias("qp")), ["context", "pi"], "left").withColumn("qp", F.coalesce("qp", F.lit(0.5)))
    return x.withColumn("dr", F.col("qp") + F.when(F.col("arm") == F.col("pi"), (F.col("reward") - F.col("qp")) / F.greatest(F.col("propensity"), F.lit(1e-9))).otherwise(0.0))


def doubly_robust(log: DataFrame, policy: Column) -> DataFrame:
    """Doubly robust value of a policy; null for an empty log."""
    return _terms(log, policy).agg(F.avg("dr").alias("dr"))


def uplift(log: DataFrame, policy: Column, draws: int = 200, seed: int = 7, key: Column | None = None) -> DataFrame:
    """Doubly robust value of a policy less the realised mean, with a percentile interval of at least 100 draws and a verdict, as one row.

    The reward model is fitted anew in each draw. All draws are one aggregation by (draw, context, arm, policy's arm) of sums that are
    linear in the rows; what follows works on those sums. ``key`` names a row, so that it weighs the same whenever it is read; without
    one it is the row's place in its partition. Rows without reward or propensity are left out. An empty log gives nulls.
    """
    draws, own = max(draws, 100), F.col("arm") == F.col("pi")
    x = log.where("reward is not null and propensity is not null")
    x = x.select("context", "arm", F.col("reward").cast("double").alias("r"), F.greatest("propensity", F.lit(1e-9)).cast("double").alias("p"), policy.alias("pi"), (F.monotonically_increasing_id() if key is None else key).alias("_key"))
    w = F.col("weight")
    sums = weighted_draws(x, F.col("_key"), draws, seed).groupBy("draw", "context", "arm", "pi").agg(
        F.sum(w).alias("n"),
        F.sum(w * F.col("r")).alias("r"),
        F.sum(F.when(own, w * F.col("r") / F.col("p")).otherwise(0.0)).alias("up"),
        F.sum(F.when(own, w / F.col("p")).otherwise(0.0)).alias("down"),
    )
    sums = cut(sums, "draws")
    q = sums.groupBy("draw", "context", F.col("arm").alias("pi")).agg(((F.sum("r") + 0.5) / (F.sum("n") + 1)).alias("q"))
    y = sums.join(q, ["draw", "context", "pi"], "left").withColumn("q", F.coalesce("q", F.lit(0.5)))
    dr = F.sum(F.col("q") * F.col("n") + F.col("up") - F.col("q") * F.col("down")) / F.sum("n")
    each = y.groupBy("draw").agg(F.sum("n").alias("n"), dr.alias("dr"), (F.sum("r") / F.sum("n")).alias("inc"))
    each = each.withColumn("_up", F.when(F.col("draw") > 0, F.col("dr") - F.col("inc")))
    lo, hi = interval("_up")
    seen = lambda c: F.max(F.when(F.col("draw") == 0, F.col(c)))
    out = each.agg(F.coalesce(seen("n"), F.lit(0)).alias("n"), seen("inc").alias("incumbent"), seen("dr").alias("dr"), (seen("dr") - seen("inc")).alias("uplift"), lo.alias("lo"), hi.alias("hi"))
    said = F.when(F.col("n") < 10_000, "insufficient").when(F.col("lo") > 0, "pass").when(F.col("hi") < 0, "negative").otherwise("inconclusive")
    return out.withColumn("verdict", said)


def verdict(n: int, lo: float, hi: float) -> str:
    return "insufficient" if n < 10_000 else "pass" if lo > 0 else "negative" if hi < 0 else "inconclusive"


def temporal_split(log: DataFrame, order: str) -> DataFrame:
    """Adds ``train``: the first four fifths in order of a dense sequence column."""
    n = log.agg(F.count("*").alias("_n"))
    return log.join(F.broadcast(n)).withColumn("train", F.col(order) <= F.floor(F.col("_n") * 4 / 5)).drop("_n")


def posterior_sums(log: DataFrame, features: Column, arm: str = "arm", reward: str = "reward", shown: str = "context") -> DataFrame:
    """``(arm, i, j, s)``: sums of the outer products of designs (i <= j); with j null, of rewards times designs; with i null, how many rows.

    Rows without a context, an arm or a reward only count. Designs are counted with their rewards first, where the rows are, so that hot ones
    come once from each task; zeros make no row. The result has no more rows than arms and components allow.
    """
    x = log.select(F.col(arm).alias("arm"), F.col(reward).cast("double").alias("r"), F.when(F.col(arm).isNotNull() & F.col(shown).isNotNull() & F.col(reward).isNotNull(), features).alias("x"))
    g = x.groupBy("arm", "x").agg(F.count("*").alias("n"), F.sum("r").alias("r"))
    some = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda e: e["v"] != 0)
    g = g.withColumn("e", some)
    item = lambda i, j, s: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), s.alias("s"))
    none = F.lit(None)
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: b["i"] >= a["i"]), lambda b: item(a["i"], b["i"], a["v"] * b["v"] * F.col("n")))))
    moments = F.transform("e", lambda a: item(a["i"], none, a["v"] * F.col("r")))
    rows = F.array(item(none, none, F.col("n").cast("double")))
    every = F.when(F.col("x").isNull(), rows).otherwise(F.concat(rows, moments, pairs))
    return g.select("arm", F.explode(every).alias("t")).groupBy("arm", F.col("t.i").alias("i"), F.col("t.j").alias("j")).agg(F.sum("t.s").alias("s"))


@dataclass
class ThompsonPolicy:
    """Bayesian linear regression for each arm, and draws from it."""

    a: np.ndarray = field(default_factory=lambda: np.stack([RIDGE * np.eye(DIM)] * len(ARMS)))
    b: np.ndarray = field(default_factory=lambda: np.zeros((len(ARMS), DIM)))
    seen: int = 0

    @classmethod
    def replay(cls, log: DataFrame, features: Column, arm: str = "arm", reward: str = "reward", shown: str = "context") -> ThompsonPolicy:
        """From a log: sums of outer products, taken where the rows are; rows without a context only count."""
        out = cls()
        # at most arms x DIM x (DIM + 3) / 2 sums, whatever the log
        for r in posterior_sums(log, features, arm, reward, shown).collect():
            if r["i"] is None:
                out.seen += r["s"]
            elif r["j"] is None:
                out.b[r["arm"], r["i"]] += r["s"]
            else:
                out.a[r["arm"], r["i"], r["j"]] += r["s"]
                if r["i"] != r["j"]:
                    out.a[r["arm"], r["j"], r["i"]] += r["s"]
        out.seen = int(out.seen)
        return out

    def update(self, arm: int, x: np.ndarray, reward: float) -> None:
        self.a[arm] += np.outer(x, x)
        self.b[arm] += reward * x
        self.seen += 1

    def greedy(self, x: np.ndarray) -> int:
        """The arm with the highest expected reward, the first of equals."""
        return int(np.argmax([x @ np.linalg.solve(a, b) for a, b in zip(self.a, self.b, strict=True)]))

    def draw(self, x: np.ndarray, rng: np.random.Generator) -> int:
        value = []
        for a, b in zip(self.a, self.b, strict=True):
            low = np.linalg.cholesky(a)
            value.append(x @ (np.linalg.solve(a, b) + np.sqrt(SPREAD) * np.linalg.solve(low.T, rng.standard_normal(DIM))))
        return int(np.argmax(value))

    def choose(self, x: np.ndarray, seed: int) -> tuple[int, float]:
        """A drawn arm and its propensity by further draws, one part in their number at least."""
        rng = np.random.default_rng(seed)
        arm = self.draw(x, rng)
        return arm, max(sum(self.draw(x, rng) == arm for _ in range(DRAWS)) / DRAWS, 1 / DRAWS)
