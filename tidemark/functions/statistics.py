"""Exact rank and payoff statistics, drift, bootstrap and dependence measures as grouped DataFrame plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranges import in_ranges, sums_before
from tidemark.functions.windows import corr
from tidemark.shared import written


def ranked(rows: DataFrame, score: str, keys: Sequence[str], out: str = "_rank") -> DataFrame:
    """Average rank (from 1) of the score within the keys; rows with a null score don't come out.

    Ties are counted first, so what is ordered has a row a distinct score, in ranges of (keys, score): no task holds a key.
    The join brings ranks back.
    """
    counts = rows.groupBy(*keys, score).agg(F.count("*").alias("_t"))
    places = sums_before(in_ranges(counts, *keys, score), keys, [score], {"_below": "_t"})
    places = places.select(*keys, score, (F.col("_below") + (F.col("_t") + 1) / 2).alias(out))
    return rows.join(places, [*keys, score])


def auc(rows: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by the rank-sum of positives, ties at half; null if a class is missing.

    Works on counts by (key, score) in ranges, so neither a key nor the whole is one task.
    """
    rows = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    c = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count("*").alias("_t")).withColumn("_n", F.col("_t") - F.col("_p"))
    c = sums_before(in_ranges(c, *keys, score), keys, [score], {"_below": "_n"})
    out = c.groupBy(*keys).agg(F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2)).alias("_w"), F.sum("_p").alias("n_pos"), F.sum("_n").alias("n_neg"))
    return out.select(*keys, "n_pos", "n_neg", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def losses(rows: DataFrame, p: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Log loss (probabilities kept 1e-6 from 0 and 1), Brier score and base rate."""
    y, q = F.col(label), F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return rows.groupBy(*keys).agg(
        F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("logloss"), F.avg((F.col(p) - y) ** 2).alias("brier"), F.avg(y.cast("double")).alias("base_rate"), F.count("*").alias("n")
    )


def top_payoff(rows: DataFrame, p: str, label: str, order: str, keys: Sequence[str] = (), share: float = 0.05, take: float = 1.5, stop: float = 1.0) -> DataFrame:
    """Mean payoff of the max(1, floor(share * n)) rows with the largest p (ties by ``order``): take for 1, -stop for 0."""
    n = rows.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*"))).alias("_k"))
    down = [F.col(p).desc(), F.col(order)]
    placed = sums_before(in_ranges(rows.select(*keys, p, order, label, F.lit(1).cast("long").alias("_one")), *keys, *down), keys, down, {"_i": "_one"})
    top = (placed.join(n, list(keys)) if keys else placed.join(F.broadcast(n))).where("_i < _k")
    return top.groupBy(*keys).agg(F.count("*").alias("top_n"), F.avg(F.col(label) * (take + stop) - stop).alias("top_payoff"))


def rank_average(rows: DataFrame, scores: Sequence[str], keys: Sequence[str], out: str = "ensemble") -> DataFrame:
    """Mean of the average ranks over n of several scores."""
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    for s in scores:
        rows = ranked(rows, s, keys, f"_r_{s}")
    mean = sum((F.col(f"_r_{s}") for s in scores), F.lit(0.0)) / (len(scores) * F.col("_n"))
    return rows.join(n, list(keys)).withColumn(out, mean).drop("_n", *(f"_r_{s}" for s in scores))


def spearman(rows: DataFrame, x: str, y: str, keys: Sequence[str], least: int = 1) -> DataFrame:
    """Rank correlation of the rows with both values; null below ``least`` rows or where one is constant."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    r = ranked(ranked(both, x, keys, "_rx"), y, keys, "_ry")
    varied = (F.stddev_pop("_rx") > 0) & (F.stddev_pop("_ry") > 0) & (F.count("*") >= least)
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.when(varied, corr("_rx", "_ry")).alias("ic"))


def spearman_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """x, y, rho of every two columns, x < y; rows with nulls in one of them are left out of all, undefined counts as 0.

    All columns are ranked in one pass over the counts of (column, value); a row gets its ranks from one small or even
    join a column, so rows aren't multiplied or put together again.
    """
    whole = rows.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    counts = melted(whole, columns, []).groupBy("column", "value").agg(F.count("*").alias("_t"))
    places = sums_before(in_ranges(counts, "column", "value"), ["column"], ["value"], {"_below": "_t"})
    places = written(places.select("column", "value", (F.col("_below") + (F.col("_t") + 1) / 2).alias("_rank")).repartition("column").sortWithinPartitions("column"), "places")
    back = whole
    for c in columns:
        back = back.join(places.where(F.col("column") == c).select(F.col("value").alias(c), F.col("_rank").alias(f"_r_{c}")), c).drop(c).withColumnRenamed(f"_r_{c}", c)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = back.agg(*(F.coalesce(corr(a, b), F.lit(0.0)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"p{i}").alias("rho")) for i, (a, b) in enumerate(pairs)))).alias("c")).select("c.*")


def melted(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A row for each row and column: ``keep``, column (its name) and value."""
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns))
    return rows.select(*keep, F.explode(pairs).alias("_c")).select(*keep, "_c.*")


def gram(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Correlation matrix from one aggregate of sums; as small as the columns are few."""
    whole = rows.select(*columns).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    one = whole.agg(*(corr(columns[i], columns[j]).alias(f"p{i}_{j}") for i, j in pairs)).first()
    out = np.eye(len(columns))
    for i, j in pairs:
        v = one[f"p{i}_{j}"]
        out[i, j] = out[j, i] = 1.0 if i == j else 0.0 if v is None or v != v else v
    return out


def variance_inflation(rows: DataFrame, columns: Sequence[str], ridge: float = 1e-6) -> DataFrame:
    """feature, vif: the diagonal of the pseudo-inverse of the ridge-stabilised correlation matrix."""
    c = gram(rows, columns)
    vif = np.diag(np.linalg.pinv(c + ridge * np.eye(len(columns))))
    return rows.sparkSession.createDataFrame([(n, float(v)) for n, v in zip(columns, vif, strict=True)], "feature string, vif double")


def clusters(matrix: np.ndarray, columns: Sequence[str], cut: float = 0.1) -> list[tuple[str, int, bool]]:
    """Average-linkage clusters of 1 - abs(correlation), cut at a distance: (column, cluster, whether it has others in it)."""
    groups = [[i] for i in range(len(columns))]
    d = 1 - np.abs(matrix)
    while len(groups) > 1:
        best = min(((float(d[np.ix_(a, b)].mean()), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > cut:
            break
        groups[best[1]] += groups.pop(best[2])
    return [(columns[i], k + 1, len(g) > 1) for k, g in enumerate(sorted(map(sorted, groups))) for i in g]


def binned_information(rows: DataFrame, x: str, label: str, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """Mutual information (nats) of a column's quantile bin and a label: an approximation by bins of the nearest-neighbour estimate."""
    own = rows.where(F.col(x).isNotNull() & F.col(label).isNotNull())
    edges = own.groupBy(*keys).agg(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("_e"))
    b = own.join(edges, list(keys)).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(x))))
    joint = b.groupBy(*keys, "_b", label).agg(F.count("*").alias("_n"))
    wk = Window.partitionBy(*keys)  # a few rows a key
    t = joint.withColumns({"_all": F.sum("_n").over(wk), "_nb": F.sum("_n").over(Window.partitionBy(*keys, "_b")), "_ny": F.sum("_n").over(Window.partitionBy(*keys, label))})
    return t.groupBy(*keys).agg(F.sum(F.col("_n") / F.col("_all") * F.log(F.col("_n") * F.col("_all") / (F.col("_nb") * F.col("_ny")))).alias("information"))


def digamma(x: Column) -> Column:
    """The digamma function for x >= 1: its asymptotic series at x + 8, taken back in eight steps; right to 1e-13."""
    y = x.cast("double") + 8
    series = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 1 / (132 * y**10)
    return series - sum((1 / (x + i) for i in range(8)), F.lit(0.0))


def neighbour_information(rows: DataFrame, x: str, label: str, keys: Sequence[str] = (), k: int = 5, stretch: int = 20_000) -> DataFrame:
    """Mutual information (nats, at least 0) of a column and a class by nearest neighbours (Ross 2014), with ``n`` rows, by key.

    A row's radius is the distance to its k-th neighbour in its class (of fewer, the last); m counts the key's rows, itself
    included, strictly inside the radius, or equal to it where the radius is 0. The estimate is psi(n) + mean psi(k) - mean
    psi(class size) - mean psi(m). Rows without a value or class, and classes of one row, are left out.

    In one dimension the neighbours are the k rows on either side in order: rows are numbered by ranges and looked at in
    stretches with k rows of their neighbours. Counts are differences of running sums at the two ends of the radius, so no
    key and no class is one task, and no pairs are made.
    """
    own = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(label).isNotNull())
    own = own.select(*keys, F.col(x).cast("double").alias("_x"), F.col(label).alias("_y"), F.lit(1).cast("long").alias("_one"), F.monotonically_increasing_id().alias("_row"))
    sizes = own.groupBy(*keys, "_y").agg(F.count("*").alias("_many")).where("_many > 1")
    placed = sums_before(in_ranges(own.join(sizes, [*keys, "_y"]), *keys, "_y", "_x", "_row"), [*keys, "_y"], ["_x", "_row"], {"_i": "_one"})
    chunk, near = F.floor(F.col("_i") / stretch), F.array(*(F.floor((F.col("_i") + d) / stretch) for d in (-k, 0, k)))
    spread = placed.withColumn("_chunk", F.explode(F.array_distinct(near))).withColumn("_own", F.col("_chunk") == chunk)
    w = Window.partitionBy(*keys, "_y", "_chunk").orderBy("_i")
    far = F.lit(float("inf"))
    # a window of k + 1 rows around a row holds k neighbours; the best one reaches least far
    reach = [F.greatest(F.coalesce(F.col("_x") - F.lag("_x", j).over(w), far) if j else F.lit(0.0), F.coalesce(F.lead("_x", k - j).over(w) - F.col("_x"), far) if j < k else F.lit(0.0)) for j in range(k + 1)]
    spread = spread.withColumns({"_r": F.least(*reach), "_k": F.least(F.lit(k), F.col("_many") - 1)})
    few = Window.partitionBy(*keys, "_y", "_chunk")  # classes of at most k rows: the farthest of them
    spread = spread.withColumn("_r", F.when(F.col("_many") <= k, F.greatest(F.col("_x") - F.min("_x").over(few), F.max("_x").over(few) - F.col("_x"))).otherwise(F.col("_r")))
    points = written(spread.where("_own").select(*keys, "_x", "_r", "_k", "_many", "_row"), "radii")
    zero, no = F.col("_r") == 0, F.lit(0).cast("long")
    # at equal values: an open upper end comes before the points, an open lower end after them; the ends of a radius of 0 the other way round
    at = lambda v, place, weight, sign: F.struct(v.alias("_v"), place.alias("_o"), weight.alias("_w"), sign.alias("_s"))
    ends = F.array(
        at(F.col("_x"), F.lit(2), no + 1, F.lit(0)),
        at(F.col("_x") + F.col("_r"), F.when(zero, 3).otherwise(1), no, F.lit(1)),
        at(F.col("_x") - F.col("_r"), F.when(zero, 1).otherwise(3), no, F.lit(-1)),
    )
    line = points.select(*keys, "_row", F.explode(ends).alias("_e")).select(*keys, "_row", "_e.*")
    order = ["_v", "_o", "_row", "_s"]
    counted = sums_before(in_ranges(line, *keys, *order), keys, order, {"_c": "_w"}).where("_s != 0").groupBy(*keys, "_row").agg(F.sum(F.col("_s") * F.col("_c")).alias("_m"))
    both = points.join(counted.select("_row", "_m"), "_row")
    mean = lambda c: F.avg(digamma(F.col(c)))
    out = both.groupBy(*keys).agg(F.count("*").alias("n"), (digamma(F.count("*")) + mean("_k") - mean("_many") - mean("_m")).alias("information"))
    return out.withColumn("information", F.greatest("information", F.lit(0.0)))


def psi(rows: DataFrame, x: str, in_a: Column, keys: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability of the rows not ``in_a`` against quantile bins of those that are; shares are smoothed by 1e-6."""
    own = rows.where(F.col(x).isNotNull()).withColumn("_a", in_a)
    edges = own.where("_a").groupBy(*keys).agg(F.percentile(x, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("_e"))
    b = own.join(edges, list(keys)).withColumn("_b", F.size(F.filter("_e", lambda e: e <= F.col(x))))
    n = b.groupBy(*keys, "_b").agg(F.count_if("_a").alias("_na"), F.count_if(~F.col("_a")).alias("_nb"))
    every = n.select(*keys).distinct().withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    n = every.join(n, [*keys, "_b"], "left").fillna(0, ["_na", "_nb"])
    wk = Window.partitionBy(*keys)  # ten rows a key
    t = n.withColumns({"_pa": F.col("_na") / F.sum("_na").over(wk) + 1e-6, "_pb": F.col("_nb") / F.sum("_nb").over(wk) + 1e-6})
    return t.groupBy(*keys).agg(F.sum((F.col("_pa") - F.col("_pb")) * F.log(F.col("_pa") / F.col("_pb"))).alias("psi"))


def t_test(rows: DataFrame, x: str, keys: Sequence[str]) -> DataFrame:
    """n, mean, t statistic and two-sided p of a mean of zero (normal tail beyond 30 values, else the incomplete beta series)."""
    t = rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("_s"))
    t = t.withColumn("t", F.when((F.col("n") > 1) & (F.col("_s") > 0), F.col("mean") / (F.col("_s") / F.sqrt("n"))))

    @F.pandas_udf("double")
    def tail(t, n):
        import pandas as pd

        return pd.Series([None if v != v or m < 2 else student_tail(v, m - 1) for v, m in zip(t, n, strict=True)], dtype="float64")

    return t.withColumn("p", tail("t", "n")).drop("_s")


def student_tail(t: float, freedom: float) -> float:
    """Two-sided tail of Student's t by the continued fraction of the incomplete beta function."""
    x = freedom / (freedom + t * t)
    a, b = freedom / 2, 0.5
    if x >= 1:
        return 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 / max(1 - (a + b) * x / (a + 1), tiny)
        h = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + step * d or tiny)
                c = 1 + step / c or tiny
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def day_bootstrap(trades: DataFrame, value: str, day: Column, keys: Sequence[str] = (), reps: int = 5000, seed: int = 11) -> DataFrame:
    """Mean, 2.5 and 97.5 % bounds and share of means at or below 0 over resampled whole days.

    Days become (sum, count) rows first, numbered from 0. Draw k of a repetition is a hash of (seed, rep, k), see ``draws``,
    so a lost task repeats its draws.
    """
    ks = list(keys) or ["_all"]
    rows = trades if keys else trades.withColumn("_all", F.lit(0))
    days = rows.groupBy(*ks, day.alias("_day")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    drawn = draws(days, "_day", ks, reps, seed)
    means = drawn.groupBy(*ks, "rep").agg((F.sum("s") / F.sum("n")).alias("m"))
    out = means.groupBy(*ks).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"), F.avg((F.col("m") <= 0).cast("double")).alias("p_not_above_zero"))
    mean = days.groupBy(*ks).agg((F.sum("s") / F.sum("n")).alias("mean"), F.count("*").alias("n_days"))
    return mean.join(out, ks).drop("_all")


def draws(days: DataFrame, day: str, keys: Sequence[str], reps: int, seed: int) -> DataFrame:
    """As many drawn days, with replacement, as a key has, for each of ``reps`` repetitions: rows with ``rep``, ``k`` and the day's columns.

    Draw k takes the day whose number is the first 32 bits of md5("seed:rep:k") modulo the number of days. Days are a row a
    day; draws are rows, spread over tasks by (key, rep), and no row holds all days of a key.
    """
    w = Window.partitionBy(*keys).orderBy(day)
    numbered = days.withColumn("_i", (F.row_number().over(w) - 1).cast("long"))
    many = days.groupBy(*keys).agg(F.count("*").alias("_many"))
    rep = many.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).repartition(*keys, "rep")
    k = rep.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_many") - 1)))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rep", "k")), 1, 8), 16, 10).cast("long")
    return k.withColumn("_i", hashed % F.col("_many")).join(numbered, [*keys, "_i"]).drop("_i", "_many")


def choose_threshold(rows: DataFrame, p: str, payoff: str, bars_per_day: float, keys: Sequence[str], least: int = 30, low: float = 0.1, high: float = 5.0, steps: int = 60) -> DataFrame:
    """The cut among quantiles .5 to .995 of p with the largest mean payoff of rows at or above it.

    A cut needs ``least`` rows and between ``low`` and ``high`` of them a day; without any, the largest quantile and no
    expectancy. Each row finds its place in the grid; sums of the places are then added up from the top.
    """
    qs = [0.5 + (0.995 - 0.5) * i / (steps - 1) for i in range(steps)]
    grid = rows.groupBy(*keys).agg(F.percentile(p, F.array(*(F.lit(q) for q in qs))).alias("_g"), (F.count("*") / bars_per_day).alias("_days"))
    place = F.size(F.filter("_g", lambda x: x <= F.col(p))).alias("_place")
    sums = rows.join(grid, list(keys)).groupBy(*keys, place).agg(F.count("*").alias("_n"), F.count(payoff).alias("_m"), F.sum(payoff).alias("_s"))
    cuts = grid.select(*keys, "_days", F.posexplode("_g").alias("_i", "threshold"))
    cut = cuts.join(sums, list(keys)).where("_place > _i").groupBy(*keys, "_i", "threshold", "_days").agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_m")).alias("expectancy"))
    fine = cut.where((F.col("n") >= least) & (F.col("n") / F.col("_days")).between(low, high))
    best = fine.groupBy(*keys).agg(F.max_by(F.struct("threshold", "expectancy"), F.struct("expectancy", -F.col("_i"))).alias("b"))
    return grid.join(best, list(keys), "left").select(*keys, F.coalesce("b.threshold", F.element_at("_g", -1)).alias("threshold"), F.col("b.expectancy").alias("expectancy"))
