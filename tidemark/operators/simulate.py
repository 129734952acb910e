"""Path-dependent trading rules as state machines over bars, and what is measured on their trades.

All prices a machine needs of other rows (next open, gaps) are columns made by windows; the machine sees one row at a
time. Scenarios are part of the key, so rules, costs and placebo shuffles run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.functions import windows as R
from tidemark.functions.ranges import in_ranges, sums_before
from tidemark.operators.bars import by_stretch
from tidemark.operators.fold import fold

TRADES = "symbol string, scenario string, signal_ts timestamp_ntz, entry_ts timestamp_ntz, exit_ts timestamp_ntz, side int, entry double, exit double, reason string, pnl double, r_mult double, p double, bars int, filled boolean"


@dataclass(frozen=True)
class Rules:
    """entry: market (next open), limit (``offset`` ranges better than the close, ``life`` bars) or bracket (a stop ``offset`` ranges on either side, ``life`` bars)."""

    entry: str = "market"
    take: float = 1.5
    stop: float = 1.0
    horizon: int = 16
    cost_bp: float = 2.5
    risk: float = 0.01
    per_day: int = 5
    day_stop: float = -0.03
    gap: float = 120.0
    flatten_before_gap: bool = False
    max_leverage: float | None = None
    offset: float = 0.25
    life: int = 4
    tick: float = 0.01


def with_context(bars: DataFrame, atr: str = "a14") -> DataFrame:
    """The columns that machines read: range, gaps before and after in minutes, next open, trading day, Friday afternoon.

    p_long, p_short, threshold, gate and minutes may be there; a bar without a threshold gives no signal.
    """
    w = R.series("symbol", "chunk")
    gap = lambda a, b: F.timestamp_diff("SECOND", a, b) / 60
    near = {
        "atr": F.col(atr), "gap": gap(F.lag("ts").over(w), F.col("ts")), "gap_next": gap(F.col("ts"), F.lead("ts").over(w)), "next_open": F.lead("open").over(w), "next_ts": F.lead("ts").over(w),
        "day": F.to_date(F.col("ts") - F.expr("INTERVAL 18 HOURS")), "late_friday": (F.weekday("ts") == 4) & (F.hour("ts") >= 15),
    }
    out = by_stretch(bars, lambda b: b.withColumns(near), 1, 1)
    for name, default in (("gate", F.lit(True)), ("minutes", F.array().cast("array<struct<high:double,low:double>>")), ("scenario", F.lit("base"))):
        if name not in out.columns:
            out = out.withColumn(name, default)
    return out


def attach_minutes(bars: DataFrame, minute: DataFrame, width: int = 15) -> DataFrame:
    """``minutes``: the (high, low) of those of each bar's minute records, in order, that trade higher or lower than all before them in the bar.

    Only such a record can be the first to reach a level, so what is reached first, and what in one minute, is as with all
    of them; repeated records add nothing. An equi-join on the bar's start replaces the range join.
    """
    start = F.window("ts", f"{width} minutes")["start"]
    before = Window.partitionBy("symbol", "_start").orderBy("ts", "high", "low").rowsBetween(Window.unboundedPreceding, -1)
    new = lambda x, most, way: F.coalesce(way(F.col(x), most(x).over(before)), F.col(x).isNotNull())
    m = minute.select("symbol", "ts", "high", "low", start.alias("_start"))
    m = m.withColumn("_new", new("high", F.max, lambda a, b: a > b) | new("low", F.min, lambda a, b: a < b)).where("_new")
    held = m.groupBy("symbol", F.col("_start").alias("ts")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("ts").alias("at"), "high", "low"))), lambda m: F.struct(m["high"].alias("high"), m["low"].alias("low"))).alias("minutes"))
    return bars.join(held, ["symbol", "ts"], "left").withColumn("minutes", F.coalesce("minutes", F.array().cast("array<struct<high:double,low:double>>")))


def first_touched(minutes: Column, a: Column, a_up: bool, b: Column, b_up: bool) -> Column:
    """Which level the minutes trade first: a, b, both (in one minute) or none."""
    hit = lambda m, level, up: (m["high"] >= level) if up else (m["low"] <= level)
    at = lambda level, up: F.nullif(F.array_position(F.transform(minutes, lambda m: hit(m, level, up)), True), F.lit(0))
    i, j = at(a, a_up), at(b, b_up)
    return F.when(i.isNull() & j.isNull(), "none").when(i == j, "both").when(j.isNull() | (i < j), "a").otherwise("b")


class Trader:
    """One series under one set of rules. A bar first manages what is open, then what waits, then may signal."""

    def __init__(self, key: tuple, rules: Rules):
        self.key, self.rules = key, rules
        self.open: dict | None = None
        self.waiting: dict | None = None
        self.day = None
        self.day_pnl, self.day_signals, self.n = 0.0, 0, -1

    def step(self, b) -> list[tuple]:
        self.n += 1
        if b.day != self.day:
            self.day, self.day_pnl, self.day_signals = b.day, 0.0, 0
        out: list[tuple] = []
        if self.open is not None:
            self.manage(b, out)
        if self.open is None and self.waiting is not None:
            self.fill(b, out)
        if self.open is None and self.waiting is None:
            self.signal(b, out)
        return out

    def close(self, b, price: float, reason: str, out: list[tuple]) -> None:
        o, r = self.open, self.rules
        pnl = (o["side"] * (price - o["entry"]) / o["entry"] - r.cost_bp * 1e-4) * o["leverage"]
        self.day_pnl += pnl
        out.append((*self.key, o["signal_ts"], o["entry_ts"], b.ts, o["side"], o["entry"], price, reason, pnl, pnl / r.risk, o["p"], self.n - o["at"], True))
        self.open = None

    def manage(self, b, out: list[tuple]) -> None:
        o, r = self.open, self.rules
        stopped = b.low <= o["sl"] if o["side"] == 1 else b.high >= o["sl"]
        taken = b.high >= o["tp"] if o["side"] == 1 else b.low <= o["tp"]
        leaving = r.flatten_before_gap and b.gap_next is not None and b.gap_next > r.gap
        if not leaving and b.gap > r.gap:
            self.close(b, b.open, "gap", out)
        elif stopped:
            self.close(b, o["sl"], "sl", out)
        elif taken:
            self.close(b, o["tp"], "tp", out)
        elif leaving:
            self.close(b, b.close, "pre_gap", out)
        elif self.n >= o["expiry"]:
            self.close(b, b.close, "timeout", out)

    def enter(self, side: int, price: float, atr: float, at: int, expiry: int, entry_ts, signal_ts, p: float) -> None:
        r = self.rules
        leverage = r.risk / (r.stop * atr / price)
        leverage = leverage if r.max_leverage is None else min(leverage, r.max_leverage)
        self.open = {"side": side, "entry": price, "sl": price - side * r.stop * atr, "tp": price + side * r.take * atr, "leverage": leverage, "at": at, "expiry": expiry, "entry_ts": entry_ts, "signal_ts": signal_ts, "p": p}

    def fill(self, b, out: list[tuple]) -> None:
        w, r = self.waiting, self.rules
        if b.gap > r.gap or self.n > w["expiry"]:
            self.waiting = None
            if r.entry == "limit":
                out.append((*self.key, w["ts"], None, b.ts, w["side"], None, None, "cancel", 0.0, 0.0, w["p"], 0, False))
        elif r.entry == "limit":
            side, limit = w["side"], w["limit"]
            if (b.low <= limit - r.tick) if side == 1 else (b.high >= limit + r.tick):
                self.waiting = None
                self.enter(side, limit, w["atr"], self.n, self.n + r.horizon, b.ts, w["ts"], w["p"])
                sl = self.open["sl"]
                if (b.low <= sl if side == 1 else b.high >= sl) and stop_first(b.minutes, limit, sl, side):
                    self.close(b, sl, "sl_samebar", out)
        else:
            up, down = b.high >= w["up"], b.low <= w["down"]
            if up or down:
                self.waiting = None
                side = (1 if w["up"] - b.open < b.open - w["down"] else -1) if up and down else 1 if up else -1
                self.enter(side, w["up"] if side == 1 else w["down"], w["atr"], self.n, self.n + r.horizon, b.ts, w["ts"], 0.0)
                if up and down:
                    self.close(b, w["down"] if side == 1 else w["up"], "whipsaw", out)

    def signal(self, b, out: list[tuple]) -> None:
        r = self.rules
        if b.gap_next != b.gap_next or b.gap_next > r.gap or b.late_friday or self.day_signals >= r.per_day or not b.atr > 0 or not b.gate or b.next_ts is None:
            return
        if r.entry == "bracket":
            self.waiting = {"up": b.close + r.offset * b.atr, "down": b.close - r.offset * b.atr, "atr": b.atr, "expiry": self.n + r.life, "ts": b.ts}
            self.day_signals += 1
            return
        if r.entry == "market" and self.day_pnl <= r.day_stop:
            return
        side = 1 if b.p_long >= b.threshold and b.p_long >= b.p_short else -1 if b.p_short >= b.threshold else 0
        if not side:
            return
        self.day_signals += 1
        p = max(b.p_long, b.p_short)
        if r.entry == "market":
            self.enter(side, b.next_open, b.atr, self.n + 1, self.n + r.horizon, b.next_ts, b.ts, p)
        else:
            self.waiting = {"side": side, "limit": b.close - side * r.offset * b.atr, "atr": b.atr, "expiry": self.n + r.life, "ts": b.ts, "p": p}


def stop_first(minutes, limit: float, sl: float, side: int) -> bool:
    """Whether the minutes trade the stop before the limit, or both in one minute."""
    for m in minutes if minutes is not None else ():
        at_limit = m["low"] <= limit if side == 1 else m["high"] >= limit
        at_stop = m["low"] <= sl if side == 1 else m["high"] >= sl
        if at_stop:
            return True
        if at_limit:
            return False
    return False


def simulate(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Trades of every (symbol, scenario) of bars with context and p_long, p_short, threshold; unfilled limit orders come out with 0."""
    for name in ("p_long", "p_short", "threshold"):
        if name not in bars.columns:
            bars = bars.withColumn(name, F.lit(0.0))
    cols = "symbol scenario ts open high low close atr gap gap_next next_open next_ts day late_friday gate minutes p_long p_short threshold".split()
    return fold(bars.select(*cols), ["symbol", "scenario"], "ts", lambda key: Trader(key, rules).step, TRADES)


def market_outcomes(bars: DataFrame, side: Column, rules: Rules = Rules()) -> DataFrame:
    """r_mult of a market entry at every bar with a side, each for itself: no state, so fully parallel."""
    path = F.collect_list(F.struct("open", "high", "low", "close", "gap")).over(R.series("symbol", "chunk").rowsBetween(1, rules.horizon))
    b = by_stretch(bars, lambda b: b.withColumn("_path", path), ahead=rules.horizon).withColumns({"_side": side, "_e": F.col("next_open")}).where("_side <> 0 and _e is not null and atr > 0")
    sl, tp = F.col("_e") - F.col("_side") * rules.stop * F.col("atr"), F.col("_e") + F.col("_side") * rules.take * F.col("atr")
    long_ = F.col("_side") == 1

    def outcome(x: Column) -> Column:
        stopped = (long_ & (x["low"] <= sl)) | (~long_ & (x["high"] >= sl))
        taken = (long_ & (x["high"] >= tp)) | (~long_ & (x["low"] <= tp))
        return F.when(x["gap"] > rules.gap, x["open"]).when(stopped, sl).when(taken, tp)

    exits = F.filter(F.transform("_path", outcome), lambda v: v.isNotNull())
    price = F.coalesce(F.get(exits, F.lit(0)), F.element_at("_path", -1)["close"])
    leverage = rules.risk / (rules.stop * F.col("atr") / F.col("_e"))
    r = (F.col("_side") * (price - F.col("_e")) / F.col("_e") - rules.cost_bp * 1e-4) * leverage / rules.risk
    return b.withColumn("r_mult", r).drop("_side", "_path", "_e")


def placebo(bars: DataFrame, shuffles: int, seed: int = 5) -> DataFrame:
    """A scenario for every shuffle, with (p_long, p_short) dealt anew, together, within symbol and year by a seeded hash order."""
    s = bars.withColumn("scenario", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shuffles - 1)), lambda i: F.format_string("placebo%03d", i)))).withColumn("_y", F.year("ts"))
    own = ["symbol", "scenario", "_y"]
    mixed = s.select(*own, "p_long", "p_short", F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64(F.lit(seed), "scenario", "ts"))).alias("_i"))
    return s.drop("p_long", "p_short").withColumn("_i", F.row_number().over(Window.partitionBy(*own).orderBy("ts"))).join(mixed, [*own, "_i"]).drop("_i", "_y")


def daily_equity(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Equity at the end of every trading day that has bars: the product of 1 + pnl of trades closed so far."""
    day = F.to_date(F.col("exit_ts") - F.expr("INTERVAL 18 HOURS"))
    gains = trades.where("filled").groupBy("symbol", "scenario", day.alias("day")).agg(F.sum(F.log1p("pnl")).alias("_g"))
    days = bars.select("symbol", "scenario", F.to_date(F.col("ts") - F.expr("INTERVAL 18 HOURS")).alias("day")).distinct()
    w = Window.partitionBy("symbol", "scenario").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    return days.join(gains, ["symbol", "scenario", "day"], "left").withColumn("equity", F.exp(F.sum(F.coalesce("_g", F.lit(0.0))).over(w))).drop("_g")


def performance(trades: DataFrame, equity: DataFrame) -> DataFrame:
    """A row of trade and equity measures for each (symbol, scenario)."""
    key = ["symbol", "scenario"]
    t = trades.where("filled")
    r, won = F.col("r_mult"), F.col("r_mult") > 0
    w = Window.partitionBy(*key).orderBy("exit_ts", "entry_ts")
    turned = t.withColumn("_w", won.cast("int")).withColumn("_t", F.when(F.col("_w") == F.lag("_w").over(w), 0).otherwise(1))
    streak = turned.withColumn("_s", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*key, "_s", "_w").agg(F.count("*").alias("_n"))
    streaks = streak.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("_w") == 1, F.col("_n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(F.col("_w") == 0, F.col("_n"))), F.lit(0)).alias("max_losses"))
    a = t.groupBy(*key).agg(
        F.count("*").alias("n_trades"), F.avg(won.cast("double")).alias("win_rate"), F.avg(r).alias("expectancy"), F.percentile(r, 0.5).alias("median_r"), F.avg(F.when(won, r)).alias("avg_win"), F.avg(F.when(~won, r)).alias("avg_loss"),
        (F.coalesce(F.sum(F.when(won, r)), F.lit(0.0)) / F.greatest(F.coalesce(-F.sum(F.when(~won, r)), F.lit(0.0)), F.lit(1e-12))).alias("profit_factor"), F.avg("bars").alias("avg_bars"), (F.avg(r) / F.nullif(F.var_pop(r), F.lit(0.0))).alias("kelly"),
    )
    d = Window.partitionBy(*key).orderBy("day")
    e = equity.withColumns({"_c": F.col("equity") / F.lag("equity").over(d) - 1, "_dd": F.col("equity") / F.max("equity").over(d.rowsBetween(Window.unboundedPreceding, 0)) - 1})
    q = e.groupBy(*key).agg(
        F.count("*").alias("n_days"), F.max_by("equity", "day").alias("final_equity"), F.min("_dd").alias("max_drawdown"), (F.avg("_c") / F.nullif(F.stddev_samp("_c"), F.lit(0.0)) * 252**0.5).alias("sharpe"),
        (F.avg("_c") / F.nullif(F.stddev_samp(F.when(F.col("_c") < 0, F.col("_c"))), F.lit(0.0)) * 252**0.5).alias("sortino"), (F.datediff(F.max("day"), F.min("day")) / 365.25).alias("_years"),
    )
    q = q.withColumn("cagr", F.when(F.col("_years") > 0, F.pow("final_equity", 1 / F.col("_years")) - 1)).withColumn("calmar", F.when(F.col("max_drawdown") < 0, F.col("cagr") / -F.col("max_drawdown")))
    return a.join(streaks, key).join(q, key).withColumn("trades_per_day", F.col("n_trades") / F.col("n_days")).drop("_years")


#: Trades of one stretch; steps in 1 to which logs of gains are cut before they are added up.
STRETCH, GRID = 20_000, float(2**40)


def sized(trades: DataFrame, rule: str, threshold: float = 0.9) -> DataFrame:
    """``fraction`` of equity risked on each trade, and the ``curve`` of equity after it; rules flat1, prob, kelly025 and ddthrottle.

    The first three read only the row or the 300 trades before it; trades are numbered by ranges and looked at in stretches,
    and the curve is a sum of logs over one row a stretch and then inside it, so no key is one task. Logs are cut to a grid on
    which doubles add up exactly wherever the curve is finite, and what the cuts leave is added apart: however rows are dealt,
    the sum is that of all its terms to one rounding. The last rule reads its own drawdown and is a fold. ``prob`` takes each trade's own ``threshold`` where trades have that column.
    """
    if rule == "ddthrottle":

        def start(key: tuple):
            state = {"equity": 1.0, "peak": 1.0}

            def step(t) -> list[tuple]:
                dd = state["equity"] / state["peak"] - 1
                f = 0.01 * (0.25 if dd < -0.2 else 0.5 if dd < -0.1 else 1.0)
                state["equity"] *= 1 + f * t.r_mult
                state["peak"] = max(state["peak"], state["equity"])
                return [(*key, t.exit_ts, t.entry_ts, t.r_mult, f, state["equity"])]

            return step

        return fold(trades.where("filled").select("symbol", "scenario", "exit_ts", "entry_ts", "r_mult"), ["symbol", "scenario"], "exit_ts", start, "symbol string, scenario string, exit_ts timestamp_ntz, entry_ts timestamp_ntz, r_mult double, fraction double, curve double")
    keys, order = ["symbol", "scenario"], ["exit_ts", "entry_ts", "_u"]
    t = trades.where("filled").withColumns({"_u": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")})
    t = sums_before(in_ranges(t, *keys, *order), keys, order, {"_i": "_one"})
    if rule == "kelly025":  # stretches with the 300 trades before them
        own = F.floor(F.col("_i") / STRETCH)
        t = t.withColumn("_chunk", F.explode(F.array_distinct(F.array(own, F.floor((F.col("_i") + 300) / STRETCH)))))
        w = Window.partitionBy(*keys, "_chunk").orderBy("_i")  # running sums less those of 300 rows before: a frame would be added up anew for each row
        t = t.withColumn("_from", F.first("r_mult", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        finite = F.abs("r_mult") < float("inf")
        x = F.when(finite, F.col("r_mult") - F.when(F.abs("_from") < float("inf"), F.col("_from")).otherwise(0.0))
        sums = {"_n": F.count("r_mult"), "_wild": F.count(F.when(~finite, 1)), "_s": F.sum(x), "_q": F.sum(x * x)}
        t = t.withColumns({name: F.coalesce(total.over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for name, total in sums.items()})
        t = t.withColumns({name: F.col(name) - F.coalesce(F.lag(name, 300).over(w), F.lit(0)) for name in sums})
        s, q = (F.col(name) / F.nullif(F.col("_n"), F.lit(0)) for name in ("_s", "_q"))
        k = F.when(F.col("_wild") > 0, float("nan")).otherwise((s + F.col("_from")) / (F.greatest(q - s * s, F.lit(0.0)) + 1e-12))
        f = F.when(F.col("_n") < 100, 0.01).when(k > 0, F.least(F.greatest(0.25 * k * 0.01, F.lit(0.0025)), F.lit(0.02))).otherwise(0.0025)
        t = t.withColumn("fraction", f).where(F.col("_chunk") == own)
    else:
        edge = F.least(F.greatest((F.col("p") - (F.col("threshold") if "threshold" in trades.columns else F.lit(threshold))) / 0.1, F.lit(0.0)), F.lit(1.0))
        t = t.withColumn("fraction", {"flat1": F.lit(0.01), "prob": 0.005 + 0.015 * edge}[rule])
    gain = F.coalesce(F.log(1 + F.col("fraction") * F.col("r_mult")), F.lit(0.0))
    t = t.withColumns({"_g": gain, "_c": F.rint(gain * GRID) / GRID, "_range": F.floor(F.col("_i") / STRETCH)}).withColumn("_f", F.col("_g") - F.col("_c"))
    t = sums_before(t, keys, ["_i"], {"_b": "_c", "_e": "_f"})
    return t.withColumn("curve", F.exp((F.col("_b") + F.col("_c")) + (F.col("_e") + F.col("_f")))).select("symbol", "scenario", "exit_ts", "entry_ts", "r_mult", "fraction", "curve")


def ruin(trades: DataFrame, reps: int = 2000, fraction: float = 0.01, floor: float = -0.5, seed: int = 9) -> DataFrame:
    """Share of day-resampled histories whose drawdown reaches ``floor``, at a fixed fraction of equity a trade.

    A day becomes one row in logs of equity: its gain, its top and its low against its start (the start counts as a top),
    and its worst fall. A drawn history's worst fall follows from those rows by running sums, so no trade is copied for a
    repetition. A trade that loses all is a fall of practically 1; rows that aren't filled or have no r_mult don't count.
    """
    key = ["symbol", "scenario"]
    own = Window.partitionBy(*key, "_d").orderBy("exit_ts", "entry_ts", "r_mult").rowsBetween(Window.unboundedPreceding, 0)
    t = trades.where("filled and r_mult is not null").withColumns({"_d": F.to_date("entry_ts"), "_x": F.log1p(F.greatest(fraction * F.col("r_mult"), F.lit(1e-12 - 1)))})
    t = t.withColumn("_g", F.sum("_x").over(own)).withColumn("_p", F.greatest(F.max("_g").over(own), F.lit(0.0)))
    days = t.groupBy(*key, "_d").agg(F.sum("_x").alias("gain"), F.max("_p").alias("top"), F.min("_g").alias("low"), F.min(F.col("_g") - F.col("_p")).alias("fall"))
    before = Window.partitionBy(*key, "rep").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    path = S.draws(days, "_d", key, reps, seed).withColumn("_s", F.coalesce(F.sum("gain").over(before), F.lit(0.0)))
    path = path.withColumn("_peak", F.coalesce(F.max(F.col("_s") + F.col("top")).over(before), F.lit(0.0)))
    worst = path.groupBy(*key, "rep").agg(F.expm1(F.least(F.min("fall"), F.min(F.col("_s") + F.col("low") - F.col("_peak")), F.lit(0.0))).alias("dd"))
    return worst.groupBy(*key).agg(F.avg((F.col("dd") <= floor).cast("double")).alias("ruin"), F.avg("dd").alias("mean_worst"))


def event_study(bars: DataFrame, horizons: tuple[int, ...] = (8, 16, 32), cost_bp: float = 2.5) -> DataFrame:
    """Fading the move from a trading day's first open to its first bar of the London morning: a row for each event.

    The event is the first bar of the trading day with London hour 8 or later, kept only between 1 and 5 o'clock of the
    series' clock; in winter the day starts after 8 in London, so those days have none.
    """
    w = R.series("symbol", "chunk")
    later = {**{f"_c{h}": F.lead("close", h).over(w) for h in horizons}, "_o1": F.lead("open", 1).over(w)}
    london = F.hour(F.convert_timezone(F.lit("UTC"), F.lit("Europe/London"), F.col("utc")))
    b = by_stretch(bars, lambda b: b.withColumns(later), ahead=max(horizons)).withColumns({"_day": F.to_date(F.col("ts") - F.expr("INTERVAL 18 HOURS")), "_late": (london >= 8).cast("int"), "_range": F.col("high") - F.col("low")})
    day = Window.partitionBy("symbol", "_day").orderBy("ts")
    b = b.withColumns({"_nth": F.sum("_late").over(day), "_first": F.first("open").over(day)})
    e = b.where((F.col("_nth") == 1) & (F.col("_late") == 1) & F.hour("ts").between(1, 5)).withColumn("move", F.log(F.col("open") / F.col("_first")))
    return e.select("symbol", "ts", "move", *((-F.signum("move") * F.log(F.col(f"_c{h}") / F.col("_o1")) * 1e4 - cost_bp).alias(f"fade_{h}") for h in horizons))
