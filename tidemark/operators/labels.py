"""Forward-looking labels: returns, directions and barrier outcomes, from frames of the following bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import windows as R
from tidemark.operators.bars import by_stretch


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """fwd_ret_n and y_dir_n; the last n bars have no return and direction 0."""
    w = R.series("symbol", "chunk")
    ret = {f"fwd_ret_{n}": F.log(F.lead("close", n).over(w) / F.col("close")) for n in horizons}
    return by_stretch(bars, lambda b: b.withColumns(ret), ahead=max(horizons)).withColumns({f"y_dir_{n}": R.flag(F.col(f"fwd_ret_{n}") > 0).cast("byte") for n in horizons})


def following(horizon: int, *columns: str) -> Column:
    """The next ``horizon`` bars of a stretch as an array of structs."""
    return F.collect_list(F.struct(*columns)).over(R.series("symbol", "chunk").rowsBetween(1, horizon))


def first_at(path: Column, test) -> Column:
    """Place (from 1) of the first element that passes; null if none does."""
    return F.nullif(F.array_position(F.transform(path, lambda b: F.coalesce(test(b), F.lit(False))), True), F.lit(0))


def barriers(bars: DataFrame, atr: str = "a14", take: float = 1.5, stop: float = 1.0, horizon: int = 16, gap_minutes: float = 120) -> DataFrame:
    """y_tp_long, y_tp_short, mfe_<horizon>, mae_<horizon>, time_to_hit of entries at the next bar's open.

    The path is the next ``horizon`` bars up to the first gap. A stop and a target in one bar count as the stop. Excursions
    run until both sides are resolved. No label where the path is empty, the range measure is missing or not positive,
    or fewer than horizon + 1 bars follow.
    """
    w = R.series("symbol", "chunk")
    gap = F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) / 60
    seen = {"_entry": F.lead("open").over(w), "_path": following(horizon, "high", "low", "_gap"), "_after": F.lead("open", horizon + 1).over(w)}
    b = by_stretch(bars, lambda b: b.withColumn("_gap", gap).withColumns(seen), 1, horizon + 1)
    break_at = first_at(F.col("_path"), lambda x: x["_gap"] > gap_minutes)
    usable = F.col("_after").isNotNull() & (F.col(atr) > 0)
    b = b.withColumn("_path", F.when(usable, F.when(break_at.isNull(), F.col("_path")).otherwise(F.slice("_path", 1, F.greatest(break_at - 1, F.lit(0))))))
    e, a, path = F.col("_entry"), F.col(atr), F.col("_path")
    b = b.withColumns({
        "_sl_l": first_at(path, lambda x: x["low"] <= e - stop * a), "_tp_l": first_at(path, lambda x: x["high"] >= e + take * a),
        "_sl_s": first_at(path, lambda x: x["high"] >= e + stop * a), "_tp_s": first_at(path, lambda x: x["low"] <= e - take * a),
    })

    def outcome(sl: str, tp: str) -> Column:
        s, t = F.col(sl), F.col(tp)
        return F.when(s.isNotNull() & (t.isNull() | (s <= t)), F.lit(0.0)).when(t.isNotNull(), F.lit(1.0))

    b = b.withColumns({"_hit_l": F.least("_sl_l", "_tp_l"), "_hit_s": F.least("_sl_s", "_tp_s")})
    both = F.col("_hit_l").isNotNull() & F.col("_hit_s").isNotNull()
    b = b.withColumn("_seen", F.when(F.size("_path") > 0, F.when(both, F.slice("_path", 1, F.greatest("_hit_l", "_hit_s"))).otherwise(F.col("_path"))))
    out = {
        "y_tp_long": outcome("_sl_l", "_tp_l"), "y_tp_short": outcome("_sl_s", "_tp_s"), f"mfe_{horizon}": (F.array_max(F.transform("_seen", lambda x: x["high"])) - e) / a,
        f"mae_{horizon}": (e - F.array_min(F.transform("_seen", lambda x: x["low"]))) / a, "time_to_hit": F.col("_hit_l").cast("double"),
    }
    b = b.withColumns(out)
    return b.drop(*(c for c in b.columns if c.startswith("_")))


def expansion(labelled: DataFrame, horizon: int = 16, least: float = 2.0) -> DataFrame:
    """y_exp: whether either excursion reaches ``least``; null where one is missing."""
    mfe, mae = F.col(f"mfe_{horizon}"), F.col(f"mae_{horizon}")
    return labelled.withColumn("y_exp", F.when(mfe.isNotNull() & mae.isNotNull(), (F.greatest(mfe, mae, F.lit(0.0)) >= least).cast("int")))


def above_train_median(labelled: DataFrame, value: str, train: Column, name: str) -> DataFrame:
    """1 where the value is above the median of its symbol's training rows."""
    middle = labelled.where(train).groupBy("symbol").agg(F.percentile(value, 0.5).alias("_m"))
    return labelled.join(middle, "symbol", "left").withColumn(name, F.when(F.col(value).isNotNull(), (F.col(value) > F.col("_m")).cast("int"))).drop("_m")
