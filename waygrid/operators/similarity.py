"""Similarity of series as expressions and aggregates; all pairs of two sides are in `blocks`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pearson(x: Column, y: Column, least: int = 3) -> Column:
    """|r| of a group; 0 for under `least` rows or a constant side. (corr() fails on constants.)"""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    r = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when((F.count(x) < least) | (sx < 1e-8) | (sy < 1e-8) | r.isNull(), 0.0).otherwise(F.abs(r))


def correlations(rows: DataFrame, keys: list[str], features: dict[str, tuple[str, str]], least: int = 3) -> DataFrame:
    """|r| of several feature pairs at once: one shuffle."""
    return rows.groupBy(*keys).agg(F.count("*").alias("overlap"), *[pearson(F.col(a), F.col(b), least).alias(name) for name, (a, b) in features.items()])


def most_varied(df: DataFrame, key: str, idx: str, features: list[str]) -> DataFrame:
    """key, idx, signature: the steps of the feature whose steps vary most (the first on ties)."""
    w = W.partitionBy(key).orderBy(idx)
    d = df.select(key, idx, *[(F.col(f) - F.lag(f).over(w)).alias(f) for f in features]).where(F.col(features[0]).isNotNull())
    v = d.groupBy(key).agg(*[F.var_pop(f).alias(f) for f in features])
    best = F.greatest(*features) if len(features) > 1 else F.col(features[0])
    pick = None
    for i, f in enumerate(features):
        pick = F.when(F.col(f) == best, i) if pick is None else pick.when(F.col(f) == best, i)
    chosen = v.select(key, pick.alias("pick"))
    value = F.element_at(F.array(*features), (F.col("pick") + 1).cast("int"))
    return d.join(chosen, key).select(key, (F.row_number().over(w) - 1).alias(idx), value.alias("signature"))


def statistical_profile(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """key, profile: mean, deviation, median and IQR of each feature, in the features' order."""
    parts = []
    for f in features:
        q = F.percentile(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts += [F.avg(f), F.stddev_pop(f), q[1], q[2] - q[0]]
    return df.groupBy(key).agg(F.array(*parts).alias("profile"))


def robust_profile(profiles: DataFrame) -> DataFrame:
    """Profiles less their median, over their median absolute deviation; only centred if that is 0."""

    def middle(x):
        x, n = F.array_sort(x), F.size(x)
        return (F.get(x, F.floor((n - 1) / 2).cast("int")) + F.get(x, F.floor(n / 2).cast("int"))) / 2

    d = profiles.withColumn("__mid", middle(F.col("profile"))).withColumn("profile", F.transform("profile", lambda x: x - F.col("__mid")))
    d = d.withColumn("__mad", middle(F.transform("profile", F.abs)))
    return d.withColumn("profile", F.transform("profile", lambda x: F.when(F.col("__mad") > 1e-8, F.try_divide(x, F.col("__mad"))).otherwise(x))).drop("__mid", "__mad")


def lagged(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, most: int = 20, idx: str = "idx", least: int = 3) -> DataFrame:
    """Best |r| over lags of b against a, and its lag (the smallest on ties). Lags go up to a quarter of a's length, and `most`."""
    k = F.least(F.floor(F.count("*").over(W.partitionBy(*keys)) / 4).cast("int"), F.lit(most))
    lags = a.withColumn("__most", k).withColumn("lag", F.explode(F.sequence(-F.col("__most"), F.col("__most")))).drop("__most").withColumn("__at", F.col(idx) + F.col("lag"))
    m = lags.join(b.withColumnRenamed(idx, "__at"), [*keys, "__at"])
    r = m.groupBy(*keys, "lag").agg(pearson(F.col(x), F.col(y), least).alias("r"))
    return r.groupBy(*keys).agg(F.max("r").alias("score"), F.min_by("lag", F.struct(-F.col("r"), F.abs("lag"), "lag")).alias("lag"))


def cross_correlation(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str, idx: str = "idx") -> DataFrame:
    """Lag with the greatest sum of products (the least lag on ties), over all lags at which the series meet."""
    m = a.join(b.withColumnRenamed(idx, "__at"), keys).withColumn("lag", F.col(idx) - F.col("__at"))
    s = m.groupBy(*keys, "lag").agg(F.sum(F.col(x) * F.col(y)).alias("s"))
    return s.groupBy(*keys).agg(F.max("s").alias("peak"), F.max_by("lag", F.struct("s", -F.col("lag"))).alias("offset"))


def resampled(df: DataFrame, key: str, value: str, length: int = 512, idx: str = "idx") -> DataFrame:
    """key, i, value at `length` even places (cell centres, ends clamped)."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    at = F.least(F.greatest((F.col("i") + 0.5) * F.col("n") / length - 0.5, F.lit(0.0)), (F.col("n") - 1).cast("double"))
    g = n.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn("at", at).withColumn("lo", F.floor("at").cast("long"))
    g = g.withColumn("hi", F.least(F.col("lo") + 1, F.col("n") - 1))
    v = df.select(key, F.col(idx).cast("long").alias("p"), F.col(value).alias("v"))
    lo, hi = v.withColumnsRenamed({"p": "lo", "v": "v0"}), v.withColumnsRenamed({"p": "hi", "v": "v1"})
    j = g.join(lo, [key, "lo"]).join(hi, [key, "hi"])
    return j.select(key, "i", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("lo"))).alias(value))


def best_by_overlap(scored: DataFrame, key: str, least: int = 10) -> DataFrame:
    """Of a key's pairs with a score, the one with the longest overlap above `least`."""
    ok = scored.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.col("overlap") > least))
    return ok.groupBy(key).agg(F.max_by(F.struct("track_id", "overlap", "score"), F.struct("overlap", F.col("score"))).alias("m")).select(key, "m.*")


def weights_ema(scores: DataFrame, features: list[str], order: str = "ord", keep: float = 0.9) -> DataFrame:
    """Feature weights after an ordered run of matches: each step keeps 0.9 and adds 0.1 score * final.
    An ordered fold of one feature's list; the run is a bounded log of accepted matches."""
    out = []
    for f in features:
        series = F.transform(F.sort_array(F.collect_list(F.struct(order, (F.col(f) * F.col("final")).alias("v")))), lambda s: s["v"])
        out.append(F.aggregate(series, F.lit(1.0), lambda w, v: w * keep + v * (1 - keep)).alias(f))
    return scores.agg(*out)
