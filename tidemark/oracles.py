"""DuckDB SQL that the bar queries are checked against; written apart from the DataFrame plans."""

from __future__ import annotations

P = "PARTITION BY symbol ORDER BY ts"
BARS = """
t AS (SELECT event_type AS symbol, ts, value AS price, ln(value) - lag(ln(value)) OVER (PARTITION BY event_type ORDER BY ts) AS d FROM events WHERE value > 0),
bars AS (
  SELECT symbol, time_bucket(INTERVAL 15 MINUTES, ts) AS ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, count(*) AS n,
    coalesce(sum(d * d), 0.0) AS rv, coalesce(sum(abs(d)), 0.0) AS absret, CAST(count(*) FILTER (d > 0) AS BIGINT) AS up, CAST(count(*) FILTER (d < 0) AS BIGINT) AS down, 0.0::DOUBLE AS range_sum
  FROM t GROUP BY ALL
)"""


def roll(f: str, x: str, n: int) -> str:
    over = f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {f}({x}) {over} END"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({P})"


def zs(x: str, n: int) -> str:
    return f"({x} - ({roll('avg', x, n)})) / (({roll('stddev_samp', x, n)}) + 1e-12)"


def slope(x: str, n: int) -> str:
    over = f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {over} = {n} THEN regr_slope({x}, CAST(rn AS DOUBLE)) {over} END"


BASE = f"""{BARS},
b0 AS (
  SELECT *, row_number() OVER ({P}) AS rn, ln(close) - ln({lag('close')}) AS lr, close - {lag('close')} AS dc, high - {lag('high')} AS um, {lag('low')} - low AS dm,
    greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr, (high + low + close) / 3 AS typical FROM bars
), b1 AS (SELECT *, CASE WHEN um > dm AND um > 0 THEN um ELSE 0.0 END AS pdm_in, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0.0 END AS mdm_in, greatest(dc, 0.0) AS gain, greatest(-dc, 0.0) AS loss FROM b0)"""

_E = [(f"e{n}", "close", 2 / (n + 1), 1) for n in (8, 12, 20, 26, 50, 100, 200)]
_E += [("s14", "tr", 1 / 14, 1), ("s96", "tr", 1 / 96, 1), ("spdm", "pdm_in", 1 / 14, 1), ("smdm", "mdm_in", 1 / 14, 1)]
_E += [(f"s{x}{n}", x, 1 / n, 2) for n in (7, 14, 28) for x in ("gain", "loss")]
_STEP = ", ".join(f"CASE WHEN b.rn <= {s} THEN CAST(b.{x} AS DOUBLE) ELSE {a!r} * b.{x} + {1 - a!r} * e.{n} END AS {n}" for n, x, a, s in _E)
_SEED = ", ".join(f"CAST({x if s == 1 else 'NULL'} AS DOUBLE) AS {n}" for n, x, a, s in _E)
_DX = "100 * abs(spdm - smdm) / (s14 + 1e-12) / (100 * (spdm + smdm) / (s14 + 1e-12) + 1e-12) * 100"
SMOOTHED = f"""{BASE},
w AS (SELECT symbol, rn, {_SEED} FROM b1 WHERE rn = 1 UNION ALL SELECT b.symbol, b.rn, {_STEP} FROM w AS e JOIN b1 AS b ON b.symbol = e.symbol AND b.rn = e.rn + 1),
w1 AS (SELECT *, e12 - e26 AS macd, {_DX} AS dx FROM w),
w2 AS (
  SELECT symbol, rn, CAST(NULL AS DOUBLE) AS sig, CAST(NULL AS DOUBLE) AS adx FROM w1 WHERE rn = 1 UNION ALL
  SELECT b.symbol, b.rn, CASE WHEN b.rn < 26 THEN NULL WHEN b.rn = 26 THEN b.macd ELSE 0.2 * b.macd + 0.8 * e.sig END, CASE WHEN b.rn < 14 THEN NULL WHEN b.rn = 14 THEN b.dx ELSE b.dx / 14 + 13.0::DOUBLE / 14 * e.adx END
  FROM w2 AS e JOIN w1 AS b ON b.symbol = e.symbol AND b.rn = e.rn + 1
), b AS (
  SELECT b1.*, CASE WHEN rn >= 14 THEN s14 END AS a14, CASE WHEN rn >= 96 THEN s96 END AS a96, s14 + 1e-12 + CASE WHEN rn < 14 THEN NULL ELSE 0 END AS atr,
    {', '.join(f'CASE WHEN rn >= {n} THEN e{n} END AS ema{n}' for n in (8, 12, 20, 26, 50, 100, 200))},
    {', '.join(f'CASE WHEN rn > {n} THEN 100 - 100 / (1 + sgain{n} / (sloss{n} + 1e-12)) END AS rsi{n}' for n in (7, 14, 28))},
    CASE WHEN rn >= 26 THEN macd END AS macd, sig, CASE WHEN rn >= 14 THEN 100 * (spdm - smdm) / (s14 + 1e-12) END AS di_diff, CASE WHEN rn >= 27 THEN adx END AS adx14
  FROM b1 JOIN w1 USING (symbol, rn) JOIN w2 USING (symbol, rn)
)"""


def query(ctes: str, columns: dict[str, str], source: str, more: str = "") -> str:
    return f"WITH RECURSIVE {ctes}{more} SELECT symbol, ts, {', '.join(f'{x} AS {n}' for n, x in columns.items())} FROM {source}"


def r6(columns: dict[str, str], ints: str = "") -> dict[str, str]:
    return {n: x if n in ints.split() else f"round({x}, 6)" for n, x in columns.items()}


def volatility_sql(year: int) -> str:
    """The volatility family with ranks over ``year`` rows."""
    more = f""", c0 AS (SELECT *, a14 / close AS rel, {roll('sum', 'rv', 96)} AS rv96, sqrt({roll('sum', 'rv', 8)}) AS rv8, abs(lr) AS alr, a14 / {lag('a14')} - 1 AS ac, pow(ln(high / low), 2) AS hl FROM b),
c AS (SELECT *, list(rel) OVER ({P} ROWS BETWEEN {year - 1} PRECEDING AND 1 PRECEDING) AS rels, list(rv96) OVER ({P} ROWS BETWEEN {year - 1} PRECEDING AND 1 PRECEDING) AS rvs, {roll('count', 'rel', year)} AS n_rel, {roll('count', 'rv96', year)} AS n_rv, {roll('avg', 'close', 20)} AS m, {roll('stddev_samp', 'close', 20)} AS sd FROM c0)"""
    rank = lambda x, held, n: f"CASE WHEN {n} = {year} THEN len(list_filter({held}, lambda y: y < {x})) / {year - 1}.0::DOUBLE END"
    cols = {
        "atr14_p": "a14 / close * 1e4", "atr96_p": "a96 / close * 1e4", "atr_ratio": "a14 / (a96 + 1e-12)", "atr14_rank_1y": rank("rel", "rels", "n_rel"), "rv_rank_1y": rank("rv96", "rvs", "n_rv"),
        "bb_pos": "(close - m) / (2 * sd + 1e-12)", "bb_width": "4 * sd / (m + 1e-12) * 1e4", "kc_pos": "(close - ema20) / (2 * a14 + 1e-12)", "squeeze": "CASE WHEN 2 * sd < 1.5 * a14 THEN 1 ELSE 0 END",
        "rv_1": "sqrt(rv) * 1e3", "rv_8": "rv8 * 1e3", "rv_z_96": zs("rv8", 96), "vol_expansion": f"({roll('avg', 'alr', 4)}) / (({roll('avg', 'alr', 96)}) + 1e-12)", "vol_of_vol": roll("stddev_samp", "ac", 96),
        "park_20": f"sqrt(({roll('avg', 'hl', 20)}) / (4 * ln(2))) * 1e3", "compression_20": f"(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)})) / (a96 * 20 + 1e-12)",
    }
    for n in (20, 96):
        hi, lo = f"({roll('max', 'high', n)})", f"({roll('min', 'low', n)})"
        cols |= {f"donch_pos_{n}": f"(close - {lo}) / ({hi} - {lo} + 1e-12)", f"donch_width_{n}": f"({hi} - {lo}) / atr"}
    return query(SMOOTHED, r6(cols, "squeeze"), "c", more)


def family_sql() -> dict[str, str]:
    out = {}
    more = f", c AS (SELECT *, {lag('lr')} AS lr1, {roll('sum', 'lr', 4)} AS sum4 FROM b0)"
    cols = {f"ret_{n}": f"ln(close / {lag('close', n)})" for n in (1, 2, 4, 8, 16, 32, 96, 192, 480)} | {f"ret_z_{n}": zs("lr", n) for n in (16, 96, 480)}
    cols |= {"ret_skew_32": roll("skewness", "lr", 32), "ret_skew_96": roll("skewness", "lr", 96), "ret_kurt_96": roll("kurtosis", "lr", 96)}
    inner = f"corr(lr, lr1) OVER ({P} ROWS BETWEEN 94 PRECEDING AND CURRENT ROW)"
    cols["ret_autocorr1_96"] = f"CASE WHEN count(lr) OVER ({P} ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) = 96 THEN {inner} END"
    cols["var_ratio_4_96"] = f"({roll('var_samp', 'sum4', 96)}) / (4 * ({roll('var_samp', 'lr', 96)}) + 1e-12)"
    out["features_returns"] = query(BASE, r6(cols), "c", more)

    po, pc = lag("open"), lag("close")
    more = f""", c0 AS (SELECT *, coalesce(sign(dc), 0) AS way, CASE WHEN close > open THEN 1 ELSE 0 END AS up1, nullif(high - low, 0) AS rng FROM b),
c1 AS (SELECT *, CASE WHEN way = {lag('way')} THEN 0 ELSE 1 END AS turn FROM c0), c2 AS (SELECT *, sum(turn) OVER ({P}) AS run FROM c1)"""
    cols = {
        "body_atr": "(close - open) / atr", "range_atr": "(high - low) / atr", "upwick_frac": "(high - greatest(open, close)) / rng", "dnwick_frac": "(least(open, close) - low) / rng", "close_pos": "(close - low) / rng",
        "body_frac": "abs(close - open) / rng", "gap_atr": f"(open - {pc}) / atr", "close_streak": "CAST(way * row_number() OVER (PARTITION BY symbol, run ORDER BY ts) AS DOUBLE)",
        "engulf": f"CASE WHEN close > open AND {pc} < {po} AND close >= {po} AND open <= {pc} THEN 1 ELSE 0 END - CASE WHEN close < open AND {pc} > {po} AND close <= {po} AND open >= {pc} THEN 1 ELSE 0 END",
        "inside_bar": f"CASE WHEN high <= {lag('high')} AND low >= {lag('low')} THEN 1 ELSE 0 END", "outside_bar": f"CASE WHEN high > {lag('high')} AND low < {lag('low')} THEN 1 ELSE 0 END",
    } | {f"up_frac_{n}": roll("avg", "up1", n) for n in (3, 8, 20)}
    out["features_candles"] = query(SMOOTHED, r6(cols, "engulf inside_bar outside_bar"), "c2", more)

    spans = (8, 20, 50, 100, 200)
    more = f", c AS (SELECT *, {', '.join(f'close - ({roll("avg", "close", n)}) AS res{n}, {slope("close", n)} AS sl{n}' for n in (20, 96))}, ln(close) AS lc FROM b)"
    cols = {f"ema{n}_dist": f"(close - ema{n}) / atr" for n in spans} | {f"ema{n}_slope": f"(ema{n} - {lag(f'ema{n}', 4)}) / atr" for n in spans}
    cols |= {"sma20_dist": f"(close - ({roll('avg', 'close', 20)})) / atr", "ema_ribbon": " + ".join(f"CASE WHEN ema{x} > ema{y} THEN 1 ELSE 0 END" for x, y in zip(spans, spans[1:], strict=False)), "adx14": "adx14", "di_diff": "di_diff"}
    for name, x, f in (("aroon_up", "high", "list_max"), ("aroon_dn", "low", "list_min")):
        held = f"list({x}) OVER ({P} ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)"
        cols[name] = f"CASE WHEN rn >= 26 THEN (list_position({held}, {f}({held})) - 1) / 25.0::DOUBLE * 100 END"
    for n in (20, 96):
        cols[f"lr_slope_{n}"] = f"({slope('lc', n)}) * 1e4"
        fit = f"(sl{n} * sl{n} * {n * (n * n - 1) / 12} / (({roll('var_samp', f'res{n}', n)}) * {n} + 1e-12))"
        cols[f"lr_r2_{n}"] = f"CASE WHEN {fit} IS NOT NULL THEN least(greatest({fit}, 0), 1) END"
    out["features_trend"] = query(SMOOTHED, r6(cols, "ema_ribbon"), "c", more)

    lo, hi = f"({roll('min', 'low', 14)})", f"({roll('max', 'high', 14)})"
    held = f"list(typical) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
    more = f", c AS (SELECT *, macd - sig AS hist, 100 * (close - {lo}) / ({hi} - {lo} + 1e-12) AS k, {lo} AS lo, {hi} AS hi, {slope('close', 14)} AS ps, {slope('rsi14', 14)} AS rs, {held} AS held, {roll('avg', 'typical', 20)} AS m20 FROM b)"
    cols = {f"rsi{n}": f"rsi{n}" for n in (7, 14, 28)} | {
        "macd_n": "macd / close * 1e4", "macd_hist_n": "hist / close * 1e4", "macd_hist_slope": f"(hist - {lag('hist', 3)}) / close * 1e4", "stoch_k": "k", "stoch_d": roll("avg", "k", 3), "willr14": "-100 * (hi - close) / (hi - lo + 1e-12)",
        "cci20": "(typical - m20) / (0.015 * list_avg(list_transform(held, lambda y: abs(y - list_avg(held)))) + 1e-12)",
        "div_rsi": f"sign(ps) * sign(-rs) * CASE WHEN abs(ps) > ({roll('stddev_samp', 'ps', 96)}) THEN 1.0::DOUBLE ELSE 0 END", "rsi14_z96": zs("rsi14", 96),
    }
    out["features_momentum"] = query(SMOOTHED, r6(cols), "c", more)

    out["features_volatility"] = volatility_sql(6048)

    more = ", c AS (SELECT *, (up - down) / (up + down + 1e-12) AS imb FROM b0)"
    cols = {
        "n_m1": "n", "absret_z": zs("absret", 96), "m1_imb": "imb", "m1_imb_8": roll("avg", "imb", 8), "m1_imb_32": roll("avg", "imb", 32), "efficiency_1": f"abs(ln(close / {lag('close')})) / (absret + 1e-12)",
        "efficiency_8": f"abs(ln(close / {lag('close', 8)})) / (({roll('sum', 'absret', 8)}) + 1e-12)", "range_sum_z": zs("range_sum", 96),
    }
    out["features_activity"] = query(BASE, r6(cols, "n_m1"), "c", more)

    ff = lambda x: f"last_value({x} IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    earlier = lambda x: f"last_value({x} IGNORE NULLS) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    one = lambda x: f"CASE WHEN {x} THEN 1 ELSE 0 END"
    more = f""", c0 AS (SELECT *, CASE WHEN {lag('high', 3)} = ({roll('max', 'high', 7)}) THEN {lag('high', 3)} END AS sh, CASE WHEN {lag('low', 3)} = ({roll('min', 'low', 7)}) THEN {lag('low', 3)} END AS sl,
  {one(f"low > {lag('high', 2)}")} AS gu, {one(f"high < {lag('low', 2)}")} AS gd, (low + {lag('high', 2)}) / 2 AS gum, (high + {lag('low', 2)}) / 2 AS gdm FROM b),
c1 AS (SELECT *, {ff('sh')} AS hi, {ff('sl')} AS lo, {earlier('sh')} AS psh, {earlier('sl')} AS psl, {ff('CASE WHEN close < open THEN low END')} AS dlow, {ff('CASE WHEN close > open THEN high END')} AS uhigh, {ff('CASE WHEN gu = 1 THEN gum END')} AS fgu, {ff('CASE WHEN gd = 1 THEN gdm END')} AS fgd FROM c0),
c2 AS (SELECT *, {one(f"close > hi AND {lag('close')} <= {lag('hi')}")} AS bu, {one(f"close < lo AND {lag('close')} >= {lag('lo')}")} AS bd, {one('high > hi AND close < hi')} AS swh, {one('low < lo AND close > lo')} AS swl FROM c1),
c3 AS (SELECT *, CASE WHEN bu = 1 THEN 1 WHEN bd = 1 THEN -1 END AS way FROM c2)"""
    cols = {
        "dist_swing_high": "(hi - close) / atr", "dist_swing_low": "(close - lo) / atr", "hh": f"coalesce({ff('CASE WHEN sh > psh THEN 1 WHEN sh IS NOT NULL THEN -1 END')}, 0)", "ll": f"coalesce({ff('CASE WHEN sl < psl THEN 1 WHEN sl IS NOT NULL THEN -1 END')}, 0)",
        "structure": f"coalesce({ff('CASE WHEN sh > psh THEN 1 WHEN sh IS NOT NULL THEN -1 END')}, 0) - coalesce({ff('CASE WHEN sl < psl THEN 1 WHEN sl IS NOT NULL THEN -1 END')}, 0)", "bos_up": "bu", "bos_dn": "bd", "last_bos_dir": f"coalesce({ff('way')}, 0)",
        "choch": one(f"way = -coalesce({earlier('way')}, 0)"), "bars_since_bos": f"least(rn - coalesce({ff('CASE WHEN way IS NOT NULL THEN rn END')}, 1), 500)", "sweep_high": "swh", "sweep_low": "swl",
        "sweep_high_8": f"CAST({roll('sum', 'swh', 8)} AS BIGINT)", "sweep_low_8": f"CAST({roll('sum', 'swl', 8)} AS BIGINT)", "fvg_bull": "gu", "fvg_bear": "gd", "fvg_bull_32": f"CAST({roll('sum', 'gu', 32)} AS BIGINT)", "fvg_bear_32": f"CAST({roll('sum', 'gd', 32)} AS BIGINT)",
        "dist_fvg_bull": "(close - fgu) / atr", "dist_fvg_bear": "(fgd - close) / atr", "dist_ob_bull": f"(close - {ff('CASE WHEN bu = 1 THEN dlow END')}) / atr", "dist_ob_bear": f"({ff('CASE WHEN bd = 1 THEN uhigh END')} - close) / atr",
    }
    ints = " ".join(c for c in cols if not c.startswith("dist"))
    out["features_structure"] = query(SMOOTHED, r6(cols, ints), "c3", more)

    more = ", c0 AS (SELECT *, CAST(ts - INTERVAL 18 HOURS AS DATE) AS day, isoyear(ts - INTERVAL 18 HOURS) * 100 + week(ts - INTERVAL 18 HOURS) AS wk, year(ts - INTERVAL 18 HOURS) * 100 + month(ts - INTERVAL 18 HOURS) AS mo FROM b)"
    for key, p in (("day", "d"), ("wk", "w"), ("mo", "m")):
        more += f", g{p} AS (SELECT symbol, {key}, {p}o, lag(h) OVER o AS p{p}h, lag(l) OVER o AS p{p}l, lag(c) OVER o AS p{p}c FROM (SELECT symbol, {key}, arg_min(open, ts) AS {p}o, max(high) AS h, min(low) AS l, arg_max(close, ts) AS c FROM c0 GROUP BY ALL) WINDOW o AS (PARTITION BY symbol ORDER BY {key}))"
    day = "OVER (PARTITION BY symbol, day ORDER BY ts)"
    more += f", c AS (SELECT *, max(high) {day} AS dh, min(low) {day} AS dl, avg(typical) {day} AS twap, (pdh + pdl + pdc) / 3 AS pp FROM c0 JOIN gd USING (symbol, day) JOIN gw USING (symbol, wk) JOIN gm USING (symbol, mo))"
    cols = {
        "dist_day_open": "(close - do_) / atr", "dist_day_high": "(dh - close) / atr", "dist_day_low": "(close - dl) / atr", "day_range_atr": "(dh - dl) / (a14 * 8 + 1e-12)", "pos_in_day_range": "(close - dl) / (dh - dl + 1e-12)", "dist_pdh": "(pdh - close) / atr", "dist_pdl": "(close - pdl) / atr",
        "dist_pdc": "(close - pdc) / atr", "above_pdh": one("close > pdh"), "below_pdl": one("close < pdl"), "dist_pp": "(close - pp) / atr", "dist_r1": "(2 * pp - pdl - close) / atr", "dist_s1": "(close - (2 * pp - pdh)) / atr", "dist_week_open": "(close - wo) / atr",
        "dist_pwh": "(pwh - close) / atr", "dist_pwl": "(close - pwl) / atr", "dist_month_open": "(close - mo_) / atr", "dist_pmh": "(pmh - close) / atr", "dist_pml": "(close - pml) / atr", "dist_r10": "(close - round_even(close / 10, 0) * 10) / atr", "dist_r50": "(close - round_even(close / 50, 0) * 50) / atr",
        "dist_vwap_day": "(close - twap) / atr", "dist_vwap_96": f"(close - ({roll('avg', 'typical', 96)})) / atr",
    }
    more = more.replace(" do,", " do_,").replace(" AS do ", " AS do_ ").replace("AS do,", "AS do_,").replace("SELECT symbol, day, do", "SELECT symbol, day, do").replace(", mo, mo,", ", mo, mo_,").replace("arg_min(open, ts) AS mo,", "arg_min(open, ts) AS mo_,")
    out["features_levels"] = query(SMOOTHED, r6(cols, "above_pdh below_pdl"), "c", more)

    hour = "(hour(ts) + minute(ts) / 60.0::DOUBLE)"
    zone = lambda z: f"((ts + INTERVAL 5 HOURS) AT TIME ZONE 'UTC' AT TIME ZONE '{z}')"
    more = f""", c0 AS (SELECT *, {zone('America/New_York')} AS ny, {zone('Europe/London')} AS ldn, date_diff('second', {lag('ts')}, ts) / 60.0::DOUBLE AS gap, {lag('close')} AS pc FROM b),
c1 AS (SELECT *, hour(ny) + minute(ny) / 60.0::DOUBLE AS nyh, hour(ldn) + minute(ldn) / 60.0::DOUBLE AS ldnh, CAST(ny AS DATE) AS nyd FROM c0),
cal AS (SELECT d AS date, 'NFP' AS event FROM (SELECT CAST(m + INTERVAL ((12 - isodow(m)) % 7) DAYS AS DATE) AS d FROM generate_series(TIMESTAMP '2023-10-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH) AS g(m)) UNION ALL SELECT CAST(m + INTERVAL 14 DAYS AS DATE), 'FOMC' FROM generate_series(TIMESTAMP '2023-10-01', TIMESTAMP '2024-12-01', INTERVAL 1 MONTH) AS g(m)),
c AS (SELECT *, EXISTS (SELECT 1 FROM cal WHERE cal.date = nyd AND event = 'FOMC') AS f, EXISTS (SELECT 1 FROM cal WHERE cal.date = nyd AND event = 'NFP') AS nf, (SELECT min(date) FROM cal WHERE cal.date >= nyd) AS nx, (SELECT max(date) FROM cal WHERE cal.date < nyd) AS pv FROM c1)"""
    within = lambda x, lo, hi: one(f"{x} >= {lo} AND {x} < {hi}")
    fmod = lambda x: f"((({x}) % 24 + 24) % 24)"
    cols = {
        "hour_sin": f"sin(2 * pi() * {hour} / 24)", "hour_cos": f"cos(2 * pi() * {hour} / 24)", "hour_est": hour, "dow": "CAST(isodow(ts) - 1 AS INTEGER)", "day_of_month": "CAST(day(ts) AS INTEGER)", "month": "CAST(month(ts) AS INTEGER)", "bar_of_day": f"CAST(floor({fmod(f'{hour} - 18')} * 4) AS INTEGER)",
        "sess_tokyo": one(f"{hour} >= 19 OR {hour} < 4"), "sess_london": within("ldnh", 8, 16.5), "sess_ny": within("nyh", 8, 17), "sess_overlap": one("ldnh >= 8 AND ldnh < 16.5 AND nyh >= 8 AND nyh < 17"), "mins_since_ny_open": f"{fmod('nyh - 9.5')} * 60", "mins_to_ny_close": f"{fmod('17 - nyh')} * 60",
        "is_ny_open_hour": within("nyh", 9.5, 10.5), "is_london_open_hour": within("ldnh", 8, 9), "is_830_window": within("nyh", 8.25, 9), "is_1000_window": within("nyh", 10, 10.5), "is_1400_window": within("nyh", 14, 15), "is_friday_pm": one(f"isodow(ts) = 5 AND {hour} >= 12"),
        "is_sunday_open": one(f"isodow(ts) = 7 OR (isodow(ts) = 1 AND {hour} < 2)"), "bar_gap_min": "coalesce(least(gap, 4000.0::DOUBLE), 15.0::DOUBLE)", "after_gap": one("gap > 15"), "weekend_gap_atr": "CASE WHEN gap > 2000 THEN abs(open - pc) / atr ELSE 0.0 END", "is_fomc_day": one("f"),
        "hrs_to_fomc": "CASE WHEN f THEN least(greatest(14 - nyh, -12.0::DOUBLE), 12.0::DOUBLE) ELSE 24.0::DOUBLE END", "is_nfp_day": one("nf"), "hrs_to_nfp": "CASE WHEN nf THEN least(greatest(8.5::DOUBLE - nyh, -12.0::DOUBLE), 12.0::DOUBLE) ELSE 24.0::DOUBLE END",
        "days_to_event": "CAST(coalesce(least(greatest(date_diff('day', nyd, nx), 0), 30), 0) AS INTEGER)", "days_since_event": "CAST(coalesce(least(greatest(date_diff('day', pv, nyd), 0), 30), 0) AS INTEGER)",
    }
    ints = " ".join(c for c in cols if c not in ("hour_sin", "hour_cos", "hour_est", "mins_since_ny_open", "mins_to_ny_close", "bar_gap_min", "weekend_gap_atr", "hrs_to_fomc", "hrs_to_nfp"))
    out["features_sessions"] = query(SMOOTHED, r6(cols, ints), "c", more)
    return out


WEEKEND = "isodow(ts) = 6 OR (isodow(ts) = 5 AND hour(ts) >= 17) OR (isodow(ts) = 7 AND hour(ts) < 18)"
QUALITY = f"""WITH {BARS}, c AS (SELECT *, close / {lag('close')} - 1 AS ch FROM bars)
SELECT symbol, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, CAST(count(*) FILTER (high < low OR high < open OR high < close OR low > open OR low > close) AS BIGINT) AS violations,
  CAST(count(*) FILTER (least(open, high, low, close) <= 0) AS BIGINT) AS non_positive, CAST(count(*) FILTER (abs(ch) > 0.02) AS BIGINT) AS outliers, CAST(count(*) FILTER ({WEEKEND}) AS BIGINT) AS weekend_rows FROM c GROUP BY symbol"""
HOLES = f"""WITH {BARS}, d AS (SELECT symbol, date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS n FROM bars GROUP BY ALL), m AS (SELECT symbol, quantile_cont(n, 0.5) AS med FROM d GROUP BY symbol)
SELECT symbol, period, n, round(n / med, 6) AS share FROM d JOIN m USING (symbol) WHERE n < 0.95 * med"""
KEEP_LAST = """SELECT symbol, ts, arg_max(price, seq) AS price, max(seq) AS seq FROM (SELECT event_type AS symbol, date_trunc('hour', ts)::TIMESTAMP AS ts, value AS price, event_id AS seq FROM events WHERE value > 0) GROUP BY ALL"""
FRIDAYS = "SELECT CAST(m + INTERVAL ((12 - isodow(m)) % 7) DAYS AS DATE) AS date FROM generate_series(TIMESTAMP '2009-01-01', TIMESTAMP '2026-12-01', INTERVAL 1 MONTH) AS g(m)"
HEADINGS = "SELECT page_id, CAST(i - 1 AS INTEGER) AS position, h[i] AS heading FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h1[^>]*>(.*?)</h1>', 1) AS h FROM pages), unnest(range(1, len(h) + 1)) AS r(i)"
FORWARD = f"WITH {BARS}, c AS (SELECT *, {', '.join(f'ln(lead(close, {n}) OVER ({P}) / close) AS f{n}' for n in (1, 5, 10))} FROM bars) SELECT symbol, ts, {', '.join(f'round(f{n}, 6) AS fwd_ret_{n}, CAST(CASE WHEN f{n} > 0 THEN 1 ELSE 0 END AS TINYINT) AS y_dir_{n}' for n in (1, 5, 10))} FROM c"


def barrier_sql(take: float = 1.5, stop: float = 1.0, h: int = 16) -> str:
    return f"""WITH RECURSIVE {SMOOTHED}, g AS (SELECT *, date_diff('second', {lag('ts')}, ts) / 60.0 AS gap, lead(open) OVER ({P}) AS e, lead(open, {h + 1}) OVER ({P}) AS aft FROM b),
f AS (SELECT x.symbol, x.rn, x.e, x.a14 AS a, y.rn - x.rn AS j, y.high, y.low, max(CASE WHEN y.gap > 120 THEN 1 ELSE 0 END) OVER (PARTITION BY x.symbol, x.rn ORDER BY y.rn) AS cut FROM g x JOIN g y ON x.symbol = y.symbol AND y.rn BETWEEN x.rn + 1 AND x.rn + {h} WHERE x.aft IS NOT NULL AND x.a14 > 0),
k AS (SELECT symbol, rn, e, a, min(CASE WHEN low <= e - {stop} * a THEN j END) AS sll, min(CASE WHEN high >= e + {take} * a THEN j END) AS tpl, min(CASE WHEN high >= e + {stop} * a THEN j END) AS sls, min(CASE WHEN low <= e - {take} * a THEN j END) AS tps FROM f WHERE cut = 0 GROUP BY ALL),
s AS (SELECT k.*, least(sll, tpl) AS hl, least(sls, tps) AS hs FROM k),
m AS (SELECT s.symbol, s.rn, max(high) AS mx, min(low) AS mn FROM s JOIN f ON f.symbol = s.symbol AND f.rn = s.rn AND f.cut = 0 AND (hl IS NULL OR hs IS NULL OR f.j <= greatest(hl, hs)) GROUP BY ALL)
SELECT g.symbol, g.ts, CASE WHEN sll <= tpl OR (sll IS NOT NULL AND tpl IS NULL) THEN 0.0::DOUBLE WHEN tpl IS NOT NULL THEN 1.0::DOUBLE END AS y_tp_long, CASE WHEN sls <= tps OR (sls IS NOT NULL AND tps IS NULL) THEN 0.0::DOUBLE WHEN tps IS NOT NULL THEN 1.0::DOUBLE END AS y_tp_short,
  round((mx - s.e) / s.a, 6) AS mfe_{h}, round((s.e - mn) / s.a, 6) AS mae_{h}, CAST(hl AS DOUBLE) AS time_to_hit FROM g LEFT JOIN s USING (symbol, rn) LEFT JOIN m USING (symbol, rn)"""


YEARS = "y AS (SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)"
FOLDS = f"""WITH {YEARS}, s AS (SELECT symbol, CAST(year(ts) AS INTEGER) AS test_year, min(rn) AS test_first, max(rn) AS test_last FROM y GROUP BY ALL)
SELECT *, train_last - train_first + 1 AS n_train FROM (SELECT a.symbol, a.test_year, a.test_first, a.test_last, min(b.test_first) AS train_first, a.test_first - 97 AS train_last, a.test_last - a.test_first + 1 AS n_test
FROM s a JOIN s b ON a.symbol = b.symbol AND b.test_year >= a.test_year - 3 GROUP BY a.symbol, a.test_year, a.test_first, a.test_last) WHERE train_last >= train_first"""
SCORED = "s AS (SELECT lang AS k, doc_id, n_chars AS p, quality AS y FROM documents JOIN labels USING (doc_id))"
AUC = f"""WITH {SCORED} SELECT a.k, n_pos, n_neg, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN w / (n_pos * n_neg) END, 6) AS auc FROM
(SELECT k, CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM s GROUP BY k) a LEFT JOIN (SELECT a.k, sum(CASE WHEN a.p > b.p THEN 1.0::DOUBLE WHEN a.p = b.p THEN 0.5::DOUBLE ELSE 0 END) AS w FROM s a JOIN s b ON a.k = b.k AND a.y = 1 AND b.y = 0 GROUP BY a.k) b USING (k)"""
PROB = "s AS (SELECT lang AS k, doc_id, 1 / (1 + exp(-(n_chars - 1500) / 1000.0::DOUBLE)) AS p, n_chars % 97 / 97.0::DOUBLE AS p2, quality AS y FROM documents JOIN labels USING (doc_id))"
LOSSES = f"WITH {PROB}, q AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS c FROM s) SELECT k, round(avg(-(y * ln(c) + (1 - y) * ln(1 - c))), 6) AS logloss, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(y), 6) AS base_rate, count(*) AS n FROM q GROUP BY k"
TOP = f"WITH {PROB}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p DESC, doc_id) AS i, greatest(1, floor(0.05::DOUBLE * count(*) OVER (PARTITION BY k))) AS m FROM s) SELECT k, count(*) AS top_n, round(avg(y * 2.5 - 1.0), 6) AS top_payoff FROM r WHERE i <= m GROUP BY k"
_RANK = "(rank() OVER (PARTITION BY k ORDER BY {0}) + (count(*) OVER (PARTITION BY k, {0}) - 1) / 2.0::DOUBLE)"
ENSEMBLE = f"WITH {PROB} SELECT k, doc_id, round(({_RANK.format('p')} + {_RANK.format('p2')}) / (2 * count(*) OVER (PARTITION BY k)), 6) AS ensemble FROM s"
IC = f"WITH {PROB}, r AS (SELECT k, {_RANK.format('p')} AS a, {_RANK.format('p2')} AS b FROM s) SELECT k, count(*) AS n, round(CASE WHEN stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END, 6) AS ic FROM r GROUP BY k"
_NUM = "l_quantity l_extendedprice l_discount l_tax".split()
_AVG = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0::DOUBLE)"
MATRIX = f"WITH r AS (SELECT {', '.join(f'{_AVG.format(c)} AS {c}' for c in _NUM)} FROM lineitem) " + " UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS rho FROM r" for i, a in enumerate(_NUM) for b in _NUM[i + 1 :])
PSI = f"""WITH {YEARS}, e AS (SELECT symbol, quantile_cont(x, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM y WHERE year(ts) < 1998 GROUP BY symbol),
b AS (SELECT symbol, len(list_filter(e, lambda v: v <= x)) AS bin, year(ts) < 1998 AS a FROM y JOIN e USING (symbol)),
c AS (SELECT symbol, bin, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM b GROUP BY ALL), g AS (SELECT s.symbol, i AS bin, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM (SELECT DISTINCT symbol FROM c) s CROSS JOIN range(0, 10) r(i) LEFT JOIN c ON c.symbol = s.symbol AND c.bin = i),
p AS (SELECT symbol, na / sum(na) OVER (PARTITION BY symbol) + 1e-6 AS pa, nb / sum(nb) OVER (PARTITION BY symbol) + 1e-6 AS pb FROM g) SELECT symbol, round(sum((pa - pb) * ln(pa / pb)), 6) AS psi FROM p GROUP BY symbol"""
INFORMATION = f"""WITH {PROB}, e AS (SELECT k, quantile_cont(p, [{', '.join(str(i / 8) for i in range(1, 8))}]) AS e FROM s GROUP BY k), b AS (SELECT s.k, y, len(list_filter(e, lambda v: v < p)) AS bin FROM s JOIN e USING (k)),
j AS (SELECT k, bin, y, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY k) AS a, sum(n) OVER (PARTITION BY k, bin) AS nb, sum(n) OVER (PARTITION BY k, y) AS ny FROM j) SELECT k, round(sum(n / a * ln(n * a / (nb * ny))), 6) AS information FROM t GROUP BY k"""
THRESHOLD = f"""WITH {YEARS}, v AS (SELECT symbol, x / 1000 AS p, CASE WHEN CAST(floor(x) AS BIGINT) % 3 = 0 THEN 1.5::DOUBLE ELSE -1.0::DOUBLE END AS pay FROM y), g AS (SELECT symbol, quantile_cont(p, [{', '.join(str(0.5 + (0.995 - 0.5) * i / 59) for i in range(60))}]) AS g, count(*) / 20.0::DOUBLE AS days FROM v GROUP BY symbol),
h AS (SELECT symbol, i, g[i] AS thr, days FROM g, range(1, 61) r(i)), c AS (SELECT h.symbol, i, thr, days, count(*) AS n, avg(pay) AS ex FROM h JOIN v ON v.symbol = h.symbol AND v.p >= thr GROUP BY ALL),
b AS (SELECT symbol, arg_max({{'t': thr, 'e': ex}}, ex * 1000000000 - i) AS b FROM c WHERE n >= 30 AND n / days BETWEEN 0.1 AND 5 GROUP BY symbol) SELECT g.symbol, round(coalesce(b.b.t, g.g[60]), 6) AS threshold, round(b.b.e, 6) AS expectancy FROM g LEFT JOIN b USING (symbol)"""
DRAWDOWN = f"WITH {BARS} SELECT symbol, ts, round(close / max(close) OVER ({P}) - 1, 6) AS drawdown FROM bars"
DAILY = f"WITH {BARS} SELECT symbol, CAST(ts - INTERVAL 18 HOURS AS DATE) AS trading_day, arg_max(close, ts) AS close, count(*) AS n FROM bars GROUP BY ALL"
TENSOR = f"WITH {BARS}, c AS (SELECT symbol, ts, row_number() OVER ({P}) AS rn, list(round(close, 4)) OVER ({P} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS l FROM bars) SELECT symbol, ts, CAST(unnest(range(32)) AS INTEGER) AS step, unnest(l) AS close FROM c WHERE len(l) = 32"
RUNS = f"WITH {BARS}, s AS (SELECT symbol, ts, sign(close - open) AS st FROM bars), tt AS (SELECT *, CASE WHEN st = {lag('st')} THEN 0 ELSE 1 END AS tn FROM s), u AS (SELECT *, sum(tn) OVER ({P}) AS run FROM tt), l AS (SELECT symbol, st, run, count(*) AS n FROM u GROUP BY ALL) SELECT symbol, CAST(st AS INTEGER) AS state, count(*) AS n_runs, max(n) AS longest, round(quantile_cont(n, 0.5), 6) AS median FROM l GROUP BY symbol, st"


ASOF = """WITH l AS (SELECT event_type AS symbol, ts, event_id FROM events), r AS (SELECT event_type AS symbol, ts, value FROM events WHERE value > 0)
SELECT l.symbol, l.ts, l.event_id, r.ts AS r_ts, r.value AS r_value FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts > r.ts"""
INTERVAL = f"""WITH {BARS}, s AS (SELECT symbol, ts AS t0, ts + INTERVAL 40 MINUTES AS t1 FROM bars) SELECT s.symbol, s.t0, count(*) AS n, round(min(e.value), 6) AS low, round(max(e.value), 6) AS high
FROM events e JOIN s ON e.event_type = s.symbol AND e.ts >= t0 AND e.ts < t1 GROUP BY ALL"""
_IMB = "(up - down) / (up + down + 1.0::DOUBLE)"
GRAMMAR = f"""WITH {BARS}, z AS (SELECT *, ln(close / {lag('close')}) AS r, (high - low) / close AS hl, {_IMB} AS imb, ln(1 + n) AS act FROM bars), y AS (SELECT *, {zs('r', 32)} AS zr, {roll('stddev_samp', 'hl', 16)} AS sd, CASE WHEN count(r) OVER ({P} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) = 32 THEN corr(r, act) OVER ({P} ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) END AS co,
  list(imb) OVER ({P} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS li FROM z)
SELECT symbol, ts, round(lag(zr, 2) OVER ({P}), 6) AS f1, round(sd / (abs(r) + 1e-12) * CASE WHEN r >= 0 THEN 1 WHEN r IS NULL THEN NULL ELSE -1 END, 2) AS f2, round(co, 6) AS f3, round(CASE WHEN len(li) = 8 THEN (len(list_filter(li, lambda v: v < imb)) + (len(list_filter(li, lambda v: v = imb)) + 1) / 2.0::DOUBLE) / 8 END, 6) AS f4 FROM y"""
EVENTS = f"""WITH {BARS}, z AS (SELECT *, CAST(ts - INTERVAL 18 HOURS AS DATE) AS day, hour((ts + INTERVAL 5 HOURS) AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/London') >= 8 AS late, {', '.join(f'lead(close, {h}) OVER ({P}) AS c{h}' for h in (8, 16, 32))}, lead(open) OVER ({P}) AS o1 FROM bars),
y AS (SELECT *, sum(CASE WHEN late THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts) AS nth, first_value(open) OVER (PARTITION BY symbol, day ORDER BY ts) AS f FROM z)
SELECT symbol, ts, round(ln(open / f), 6) AS move, {', '.join(f'round(-sign(ln(open / f)) * ln(c{h} / o1) * 1e4 - 2.5, 6) AS fade_{h}' for h in (8, 16, 32))} FROM y WHERE late AND nth = 1 AND hour(ts) BETWEEN 1 AND 5"""
STREAM = f"WITH {BARS} SELECT symbol, ts, open, high, low, close, n FROM bars"
HISTOGRAM = f"WITH {BARS}, c AS (SELECT ln(close / {lag('close')}) AS x FROM bars) SELECT CAST(least(greatest(floor((x + 1) / 2 * 60), 0), 59) AS INTEGER) AS bin, count(*) AS n FROM c WHERE x IS NOT NULL GROUP BY bin"
CONDITIONS = f"""WITH {BARS}, c AS (SELECT *, ln(close / {lag('close')}) AS x FROM bars), g AS (SELECT 'asia' AS condition, x FROM c WHERE hour(ts) >= 19 OR hour(ts) < 4 UNION ALL SELECT 'late', x FROM c WHERE hour(ts) >= 12 UNION ALL SELECT 'busy', x FROM c WHERE n >= 2)
SELECT condition, count(x) AS n, round(avg(x), 6) AS mean, round(1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS margin FROM g GROUP BY condition HAVING count(x) >= 10"""

TRADES = """t AS (SELECT event_type AS symbol, 'base' AS scenario, ts AS entry_ts, ts AS exit_ts, CAST(ts AS DATE) AS d, 2.64::DOUBLE - 4 * sqrt((event_id * 7919 % 401)::DOUBLE / 401) AS r_mult,
  0.8::DOUBLE + 0.2::DOUBLE * sqrt(1 - (event_id * 7919 % 401)::DOUBLE / 401) AS p FROM events)"""


def draws_sql(days: str, seed: int, reps: int) -> str:
    """Drawn days of each repetition; ``days`` has symbol and d."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS many FROM {days}),
rk AS (SELECT symbol, rep, k, CAST('0x' || substr(md5('{seed}:' || rep || ':' || k), 1, 8) AS BIGINT) % many AS i FROM (SELECT DISTINCT symbol, many FROM num), range({reps}) a(rep), LATERAL (SELECT unnest(range(many)) AS k)),
drawn AS (SELECT rk.rep, rk.k, num.* FROM rk JOIN num USING (symbol, i))"""


BOOTSTRAP = f"""WITH {TRADES}, days AS (SELECT symbol, d, sum(r_mult) AS s, count(*) AS n FROM t GROUP BY ALL), {draws_sql("days", 11, 5000)}, m AS (SELECT symbol, rep, sum(s) / sum(n) AS m FROM drawn GROUP BY ALL),
o AS (SELECT symbol, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high, round(avg(CASE WHEN m <= 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_not_above_zero FROM m GROUP BY symbol)
SELECT symbol, round(sum(s) / sum(n), 6) AS mean, count(*) AS n_days, low, high, p_not_above_zero FROM days JOIN o USING (symbol) GROUP BY symbol, low, high, p_not_above_zero"""
RUIN = f"""WITH {TRADES}, g AS (SELECT *, ln(1 + 0.01::DOUBLE * r_mult) AS x, sum(ln(1 + 0.01::DOUBLE * r_mult)) OVER (PARTITION BY symbol, d ORDER BY exit_ts, entry_ts, r_mult ROWS UNBOUNDED PRECEDING) AS g FROM t),
p AS (SELECT *, greatest(max(g) OVER (PARTITION BY symbol, d ORDER BY exit_ts, entry_ts, r_mult ROWS UNBOUNDED PRECEDING), 0) AS top FROM g), days AS (SELECT symbol, d, sum(x) AS gain, max(top) AS top, min(g) AS low, min(g - top) AS fall FROM p GROUP BY ALL),
{draws_sql("days", 9, 2000)}, c AS (SELECT *, coalesce(sum(gain) OVER w, 0) AS s FROM drawn WINDOW w AS (PARTITION BY symbol, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, coalesce(max(s + top) OVER (PARTITION BY symbol, rep ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS peak FROM c), dd AS (SELECT symbol, rep, exp(least(min(fall), min(s + low - peak), 0)) - 1 AS dd FROM q GROUP BY ALL)
SELECT symbol, 'base' AS scenario, round(avg(CASE WHEN dd <= -0.5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS ruin, round(avg(dd), 6) AS mean_worst FROM dd GROUP BY symbol"""


def outcomes_sql(stop: float, take: float, horizon: int, gap: float, cost_bp: float, risk: float, cut: float) -> str:
    """The market outcome of every bar whose made probability passes ``cut``."""
    up = "1.0::DOUBLE / (1 + exp(-5 * coalesce(lr, 0)))"
    return f"""WITH RECURSIVE {SMOOTHED}, c AS (SELECT symbol, ts, rn, open, high, low, close, a14, lead(open) OVER ({P}) AS e, date_diff('second', lag(ts) OVER ({P}), ts) / 60.0::DOUBLE AS gap,
  CASE WHEN {up} >= {cut} THEN 1 WHEN 1 - {up} >= {cut} THEN -1 ELSE 0 END AS side FROM b),
s AS (SELECT symbol, ts AS t0, rn AS own, side, e, a14 AS a, e - side * {stop}::DOUBLE * a14 AS sl, e + side * {take}::DOUBLE * a14 AS tp FROM c WHERE side <> 0 AND e IS NOT NULL AND a14 > 0),
j AS (SELECT s.*, c.rn, c.close, CASE WHEN gap > {gap} THEN open WHEN (s.side = 1 AND low <= sl) OR (s.side = -1 AND high >= sl) THEN sl WHEN (s.side = 1 AND high >= tp) OR (s.side = -1 AND low <= tp) THEN tp END AS px
  FROM s JOIN c ON c.symbol = s.symbol AND c.rn BETWEEN own + 1 AND own + {horizon}),
p AS (SELECT symbol, t0, side, e, a, coalesce(arg_min(px, rn) FILTER (px IS NOT NULL), arg_max(close, rn)) AS price FROM j GROUP BY ALL)
SELECT symbol, t0 AS ts, round((side * (price - e) / e - {cost_bp}::DOUBLE * 1e-4) * ({risk}::DOUBLE / ({stop}::DOUBLE * a / e)) / {risk}::DOUBLE, 6) AS r_mult FROM p"""


def sizing_sql() -> dict[str, str]:
    """Fractions and curves of the rules that need no state of their own."""
    by = "PARTITION BY symbol ORDER BY exit_ts, entry_ts"
    k = "m / (v + 1e-12)"
    rules = {
        "flat1": "0.01::DOUBLE", "prob": "0.005::DOUBLE + 0.015::DOUBLE * least(greatest((p - 0.9::DOUBLE) / 0.1::DOUBLE, 0), 1)",
        "kelly025": f"CASE WHEN n < 100 THEN 0.01::DOUBLE WHEN {k} > 0 THEN least(greatest(0.25::DOUBLE * {k} * 0.01::DOUBLE, 0.0025::DOUBLE), 0.02::DOUBLE) ELSE 0.0025::DOUBLE END",
    }
    return {
        f"sizing_{name}": f"""WITH {TRADES}, h AS (SELECT *, avg(r_mult) OVER w AS m, var_pop(r_mult) OVER w AS v, count(*) OVER w AS n FROM t WINDOW w AS ({by} ROWS BETWEEN 300 PRECEDING AND 1 PRECEDING)), f AS (SELECT *, {rule} AS fraction FROM h)
SELECT symbol, scenario, exit_ts, entry_ts, round(r_mult, 6) AS r_mult, round(fraction, 6) AS fraction, round(exp(sum(ln(1 + fraction * r_mult)) OVER ({by} ROWS UNBOUNDED PRECEDING)), 6) AS curve FROM f"""
        for name, rule in rules.items()
    }
