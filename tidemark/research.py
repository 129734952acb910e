"""Queries of model importance, the formula screen and dependence by neighbours, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import oracles as O
from tidemark.functions import statistics as S
from tidemark.functions import windows as R
from tidemark.operators import features as X
from tidemark.operators import folds, labels
from tidemark.operators import importance as I
from tidemark.operators import models as L
from tidemark.operators import series as Z
from tidemark.operators import simulate as M
from tidemark.operators import study as Y
from tidemark.operators.bars import by_stretch
from tidemark.plans import grammar as G
from tidemark.plans.screen import screen
from tidemark.queries import bars_of, calendar_of, numbered_years, prepared, rounded, scored
from tidemark.shared import written
from tidemark.sources.ticks import table, ticks_from_events
from tidemark.study import TRADES, trades

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def harmonic(n: str) -> str:
    """Digamma of a whole number in SQL."""
    return f"(-0.5772156649015329::DOUBLE + coalesce(list_sum(list_transform(range(1, ({n})::BIGINT), lambda i: 1.0::DOUBLE / i)), 0))"


NEIGHBOURS = f"""WITH s AS (SELECT d.lang, d.doc_id, l.quality AS y, unnest(['n_chars', 'turn']) AS "column", unnest([CAST(d.n_chars AS DOUBLE), CAST(d.n_chars % 97 AS DOUBLE)]) AS x FROM documents d JOIN labels l USING (doc_id)),
p AS (SELECT *, count(*) OVER (PARTITION BY lang, "column", y) AS many, count(*) OVER (PARTITION BY lang, "column") AS n FROM s),
r AS (SELECT a.lang, a."column", a.doc_id, a.x, a.many, list_sort(list(abs(a.x - b.x)))[least(5, a.many - 1)] AS r FROM p a JOIN p b ON a.lang = b.lang AND a."column" = b."column" AND a.y = b.y AND a.doc_id <> b.doc_id GROUP BY a.lang, a."column", a.doc_id, a.x, a.many),
m AS (SELECT r.lang, r."column", r.doc_id, r.many, count(*) AS m FROM r JOIN p USING (lang, "column") WHERE p.x > r.x - r.r AND p.x < r.x + r.r OR r.r = 0 AND p.x = r.x GROUP BY ALL),
h AS (SELECT lang, "column", {harmonic('least(5, many - 1)')} AS k, {harmonic('many')} AS c, {harmonic('m')} AS m FROM m),
g AS (SELECT lang, "column", count(*) AS n, avg(k) - avg(c) - avg(m) AS rest FROM h GROUP BY ALL)
SELECT lang, "column", n, round(greatest(0, {harmonic('n')} + rest), 6) AS information FROM g"""


@query(NEIGHBOURS)
def mutual_information_neighbours(spark, sf_dir):
    """What length, and its remainder by 97, tell of quality in each language: every labelled document."""
    d = scored(spark, sf_dir).select(F.col("k").alias("lang"), F.col("n_chars").cast("double").alias("n_chars"), (F.col("n_chars") % 97).alias("turn"), "y")
    return rounded(S.neighbour_information(S.melted(d, ["n_chars", "turn"], ["lang", "y"]), "value", "y", ["lang", "column"]).select("lang", "column", "n", "information"))


WEIGHTS = {"value": 0.02, "user_id": 0.001, "hour": -0.05}
SCORE = " + ".join(f"{w}::DOUBLE * {f}" for f, w in WEIGHTS.items())
PERMUTED = f"""WITH e AS (SELECT event_id, value, CAST(user_id AS DOUBLE) AS user_id, CAST(hour(ts) AS DOUBLE) AS hour, CAST(value * 3 + user_id % 50 + hour(ts) * 2 > 220 AS INT) AS y, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL),
m AS (SELECT event_id, unnest(['value', 'user_id', 'hour']) AS "column", unnest([value, user_id, hour]) AS v FROM e),
d AS (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY md5('7:' || "column" || ':' || event_id)) AS n FROM m),
s AS (SELECT "column", y, {' + '.join(f"{w}::DOUBLE * CASE WHEN d.column = '{f}' THEN v ELSE {f} END" for f, w in WEIGHTS.items())} AS s FROM e JOIN d USING (n) UNION ALL SELECT '', y, {SCORE} FROM e),
k AS (SELECT "column", y, rank() OVER (PARTITION BY "column" ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY "column", round(s, 9)) - 1) / 2.0::DOUBLE AS r FROM s),
a AS (SELECT "column", (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM k GROUP BY "column")
SELECT "column", round(auc, 6) AS auc, round((SELECT auc FROM a WHERE "column" = '') - auc, 6) AS "drop" FROM a WHERE "column" <> ''"""


@query(PERMUTED)
def importance_permutation(spark, sf_dir):
    """A fixed linear score of all events: what its exact AUC loses by each feature's shuffle."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL AND user_id IS NOT NULL")
    e = e.select("event_id", "value", F.col("user_id").cast("double").alias("user_id"), F.hour("ts").cast("double").alias("hour"), (F.col("value") * 3 + F.col("user_id") % 50 + F.hour("ts") * 2 > 220).cast("int").alias("y"))
    linear = F.round(sum((F.lit(w) * F.col(f) for f, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["value"]) * F.col("value")), 9)
    return rounded(I.auc_drops(e, "event_id", list(WEIGHTS), "y", lambda r: r.withColumn("score", linear)))


def changes(spark, sf_dir) -> DataFrame:
    """Orders by priority as series of years: log changes against the last orders and the time of year as features, ``y`` if the next order is larger."""
    return written(L.examples(numbered_years(spark, sf_dir), (1, 2, 3, 5, 8, 13)), "changes")


def gains(kind: str):
    def run(spark, sf_dir):
        b = changes(spark, sf_dir)
        features = [c for c in b.columns if c not in ("symbol", "ts", "rn", "y")]
        return rounded(I.gain_importance(b, folds.year_folds(b), features, "y", kind))

    return run


@query()
def walk_forward_models(spark, sf_dir):
    """Logistic regression, support vectors, a perceptron, a forest and boosted trees under the same yearly folds and features."""
    b = changes(spark, sf_dir)
    features = [c for c in b.columns if c not in ("symbol", "ts", "rn", "y")]
    return rounded(L.walk_forward(b, folds.year_folds(b), features, "y", dict.fromkeys(("logistic", "svm", "mlp", "forest", "gbt"))))


QUERIES["importance_gain_gbt"] = gains("gbt")
QUERIES["importance_gain_forest"] = gains("forest")

one = lambda op, a, w=4: {"op": op, "w": w, "a": {"op": a} if isinstance(a, str) else a}
two = lambda op, a, b: {"op": op, "w": 4, "a": {"op": a}, "b": {"op": b}}
TREES = {
    "lag": one("lag", "r", 8), "diff": one("diff", "hl"), "sum": one("sum", "imb", 8), "abs": one("abs", "r"), "sign": one("sign", "imb"), "add": two("add", "r", "body"), "sub": two("sub", "upw", "dnw"),
    "mul": two("mul", "r", "act"), "std": one("std", "hl", 16), "zs": one("zs", "r", 32), "ema": one("ema", "r", 8), "lag_abs": one("lag", one("abs", "r"), 8),
}
_W = f"OVER ({O.P} ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"
TREE_COLUMNS = f"""z AS (SELECT *, ln(close / {O.lag('close')}) AS r, (high - low) / close AS hl, (close - open) / close AS body, (high - greatest(open, close)) / close AS upw, (least(open, close) - low) / close AS dnw,
  (up - down) / (up + down + 1.0::DOUBLE) AS imb, ln(1 + n) AS act, ln(lead(close, 5) OVER ({O.P}) / close) AS y FROM bars),
e AS (SELECT symbol, ts, list(r) OVER ({O.P} ROWS BETWEEN 300 PRECEDING AND CURRENT ROW) AS h FROM z),
v AS (SELECT z.symbol, z.ts, y, {O.lag('r', 2)} AS "lag", hl - {O.lag('hl', 4)} AS diff, {O.roll('sum', 'imb', 8)} AS sum, abs(r) AS abs, CAST(sign(imb) AS DOUBLE) AS sign, r + body AS add, upw - dnw AS sub, r * act AS mul, {O.roll('stddev_samp', 'hl', 16)} AS std,
  {O.zs('r', 32)} AS zs, {O.lag('abs(r)', 2)} AS lag_abs FROM z),
s AS (SELECT symbol, ts, CASE WHEN len(list_filter(h, lambda x: x IS NOT NULL)) >= 8 THEN
  list_sum(list_transform(h, lambda x, i: coalesce(x, 0) * pow(7.0::DOUBLE / 9, len(h) - i))) / list_sum(list_transform(h, lambda x, i: CASE WHEN x IS NULL THEN 0 ELSE pow(7.0::DOUBLE / 9, len(h) - i) END)) END AS ema FROM e),
c AS (SELECT v.*, s.ema FROM v JOIN s USING (symbol, ts))"""


@query(f"WITH {O.BARS}, {TREE_COLUMNS} SELECT symbol, ts, {', '.join(f'round(\"{t}\", 9) AS \"{t}\"' for t in TREES)} FROM c")
def grammar_operations(spark, sf_dir):
    """A tree of each of the grammar's remaining operations, over all bars."""
    return rounded(G.evaluate(G.base_series(bars_of(spark, sf_dir)), TREES).select("symbol", "ts", *TREES), 9)


def tail(t: str, freedom: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by its finite series in the angle."""
    a = f"atan(abs({t}) / sqrt({freedom}))"
    products = lambda first, last: f"list_sum(list_transform(range({first}, {last}), lambda i: list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(1, i + 1), lambda j: {{f}})), lambda p, q: p * q) * pow(cos({a}), {{e}})))"
    odd = products("0", f"(({freedom}) - 1) // 2").replace("{f}", "(2.0 * j) / (2 * j + 1)").replace("{e}", "2 * i + 1")
    even = products("0", f"({freedom}) // 2").replace("{f}", "(2.0 * j - 1) / (2 * j)").replace("{e}", "2 * i")
    return f"1 - CASE WHEN ({freedom}) % 2 = 1 THEN 2 / pi() * ({a} + sin({a}) * coalesce({odd}, 0)) ELSE sin({a}) * {even} END"


def ranked_ic(source: str, keys: str, least: int) -> str:
    """Rank correlation of value and y by keys in SQL."""
    r = lambda x: f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0::DOUBLE"
    return f"SELECT {keys}, CASE WHEN count(*) >= {least} AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END AS ic FROM (SELECT {keys}, {r('value')} AS rx, {r('y')} AS ry FROM {source}) GROUP BY {keys}"


SCREEN = f"""WITH {O.BARS}, {TREE_COLUMNS},
l AS (SELECT ts, round(y, 9) AS y, unnest([{', '.join(f"'{t}'" for t in TREES)}]) AS "column", unnest([{', '.join(f'round("{t}", 9)' for t in TREES)}]) AS value FROM c),
f AS (SELECT *, CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 'a' ELSE 'b' END AS half, date_trunc('day', ts) AS period FROM l WHERE y IS NOT NULL AND value IS NOT NULL),
d AS (SELECT * FROM f WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-17'), h AS ({ranked_ic('d', '"column", half', 100)}),
b AS (SELECT a."column", a.ic AS ic_a, b.ic AS ic_b FROM h a JOIN h b ON a."column" = b."column" AND a.half = 'a' AND b.half = 'b' WHERE sign(a.ic) = sign(b.ic) ORDER BY least(abs(a.ic), abs(b.ic)) DESC, a."column" LIMIT 6),
o AS (SELECT * FROM f SEMI JOIN b USING ("column") WHERE ts >= TIMESTAMP '2024-01-17'), i AS ({ranked_ic('o', '"column", period', 100)}),
w AS (SELECT "column", count(ic) AS n, avg(ic) AS m, avg(ic) / (stddev_samp(ic) / sqrt(count(ic))) AS t FROM i GROUP BY "column"),
p AS (SELECT *, {tail('t', 'n - 1')} AS p FROM w)
SELECT "column" AS name, round(ic_a, 6) AS ic_a, round(ic_b, 6) AS ic_b, n AS n_periods, round(m, 6) AS oos_ic, round(t, 6) AS t, round(p, 6) AS p, p < 0.05 / (SELECT count(*) FROM b) AND abs(m) >= 0.01 AND sign(m) = sign(ic_a) AS accepted FROM b JOIN p USING ("column")"""


@query(SCREEN)
def grammar_screen(spark, sf_dir):
    """The screen of the twelve trees against the return of the next five bars: two halves of eight days, then days, as the tables span a month; the best six."""
    b = G.evaluate(G.base_series(bars_of(spark, sf_dir)), TREES | {"_r": {"op": "r"}})
    ahead = F.log(F.lead("close", 5).over(R.series("symbol", "chunk")) / F.col("close"))
    b = by_stretch(b, lambda x: x.withColumn("y", ahead), ahead=5)
    values = written(rounded(b.select("ts", "y", *TREES), 9), "values")
    return rounded(screen(values, list(TREES), "y", "2024-01-01", "2024-01-09", "2024-01-17", "day", 6, 100))


@query(f"""WITH b AS ({O.barrier_sql()}) SELECT symbol, ts, CASE WHEN mfe_16 IS NOT NULL AND mae_16 IS NOT NULL THEN CAST(greatest(mfe_16, mae_16, 0) >= 2 AS INTEGER) END AS y_exp,
CASE WHEN mfe_16 IS NOT NULL THEN CAST(mfe_16 > (SELECT quantile_cont(mfe_16, 0.5) FROM b z WHERE z.symbol = b.symbol AND z.ts < TIMESTAMP '2024-01-16') AS INTEGER) END AS y_wide FROM b""")
def labels_expansion(spark, sf_dir):
    """Whether either excursion of 16 bars reaches two ranges, and whether the favourable one is above its median of the first 15 days."""
    b = rounded(labels.barriers(prepared(spark, sf_dir), "a14", 1.5, 1.0, 16))
    b = labels.above_train_median(labels.expansion(b), "mfe_16", F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "y_wide")
    return b.select("symbol", "ts", "y_exp", "y_wide")


@query(f"""WITH {O.YEARS}, s AS (SELECT symbol, year(ts) AS y, min(rn) AS a, max(rn) AS b FROM y GROUP BY ALL),
f AS (SELECT t.symbol, CAST(t.y AS INTEGER) AS test_year, t.a AS test_first, t.b AS test_last, min(p.a) FILTER (p.y < t.y - 1) AS fit_first, max(p.b) FILTER (p.y < t.y - 1) AS fb, min(p.a) FILTER (p.y >= t.y - 1) AS va, t.a - 97 AS last FROM s t JOIN s p ON p.symbol = t.symbol AND p.y < t.y GROUP BY ALL),
g AS (SELECT symbol, test_year, fit_first, least(fb, last) AS fit_last, CASE WHEN va <= last THEN va END AS val_first, CASE WHEN va <= last THEN last END AS val_last, test_first, test_last FROM f WHERE fit_first <= least(fb, last))
SELECT *, fit_last - fit_first + 1 AS n_fit, coalesce(val_last - val_first + 1, 0) AS n_val, test_last - test_first + 1 AS n_test FROM g""")
def folds_expanding_purged(spark, sf_dir):
    """Expanding training rows, the year before the test year for validation, 96 rows before it left out."""
    return folds.expanding(numbered_years(spark, sf_dir), 1995)


@query(f"""WITH {TRADES}, s AS (SELECT symbol, CAST(date_trunc('month', ts) AS DATE) AS month, sum(r) AS total FROM t WHERE k % 97 = 0 GROUP BY ALL),
m AS (SELECT symbol, CAST(unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS DATE) AS month FROM s GROUP BY symbol) SELECT symbol, month, round(coalesce(total, 0), 6) AS total FROM m LEFT JOIN s USING (symbol, month)""")
def monthly_sums_filled(spark, sf_dir):
    """Results by month of one customer group of each priority, empty months as 0."""
    return rounded(Y.filled_months(trades(spark, sf_dir).where("k % 97 = 0"), "ts", "r", ["symbol"]))


DRIFT = f"""WITH {O.YEARS}, p AS (SELECT symbol, year(ts) AS y, x / 600000 + 0.01::DOUBLE * (year(ts) - 1995) AS p, CAST(CAST(floor(x) AS BIGINT) % 7 < 2 + CAST(x > 200000 AS INT) AS INT) AS up FROM y),
f AS (SELECT DISTINCT symbol, y AS fold FROM p WHERE y > 1995), r AS (SELECT f.symbol, fold, p.y, p, up FROM f JOIN p ON p.symbol = f.symbol AND p.y <= fold),
e AS (SELECT symbol, fold, quantile_cont(p, [{', '.join(str(i / 10) for i in range(1, 10))}]) AS e FROM r WHERE y < fold GROUP BY ALL),
b AS (SELECT symbol, fold, len(list_filter(e, lambda v: v <= p)) AS bin, y < fold AS a FROM r JOIN e USING (symbol, fold)),
c AS (SELECT symbol, fold, bin, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM b GROUP BY ALL),
g AS (SELECT s.symbol, s.fold, i, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb FROM f s CROSS JOIN range(0, 10) q(i) LEFT JOIN c ON c.symbol = s.symbol AND c.fold = s.fold AND c.bin = i),
h AS (SELECT symbol, fold, na / sum(na) OVER (PARTITION BY symbol, fold) + 1e-6 AS pa, nb / sum(nb) OVER (PARTITION BY symbol, fold) + 1e-6 AS pb FROM g),
d AS (SELECT symbol, fold, sum((pa - pb) * ln(pa / pb)) AS drift FROM h GROUP BY ALL),
k AS (SELECT symbol, y, up, rank() OVER (PARTITION BY symbol, y ORDER BY p) + (count(*) OVER (PARTITION BY symbol, y, p) - 1) / 2.0::DOUBLE AS r FROM p),
u AS (SELECT symbol, y AS fold, (sum(r) FILTER (up = 1) - count(*) FILTER (up = 1) * (count(*) FILTER (up = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (up = 1) * count(*) FILTER (up = 0)) AS score FROM k GROUP BY ALL)
SELECT symbol, count(*) AS n, round(avg(drift), 6) AS drift, round(avg(score), 6) AS score, round(corr(drift, score), 6) AS correlation, round(avg(score) FILTER (fold < 1999), 6) AS early, round(avg(score) FILTER (fold >= 1999), 6) AS late FROM d JOIN u USING (symbol, fold) GROUP BY symbol"""


@query(DRIFT)
def drift_against_auc(spark, sf_dir):
    """How far each year's scores have drifted from all earlier years' (stability index) against the year's AUC, with era means."""
    o = numbered_years(spark, sf_dir).select("symbol", F.year("ts").alias("y"), (F.col("x") / 600000 + F.lit(0.01) * (F.year("ts") - 1995)).alias("p"), (F.floor("x") % 7 < 2 + (F.col("x") > 200000).cast("int")).cast("int").alias("up"))
    o = written(o, "scores")
    years = o.select("symbol", F.col("y").alias("fold")).distinct().where("fold > 1995")  # a row a year
    past = o.join(years, "symbol").where("y <= fold")
    drift = S.psi(past, "p", F.col("y") < F.col("fold"), ["symbol", "fold"])
    area = S.auc(o, "p", "up", ["symbol", "y"]).select("symbol", F.col("y").alias("fold"), F.col("auc").alias("score"))
    both = written(drift.join(area, ["symbol", "fold"]), "years")
    eras = both.groupBy("symbol").agg(F.avg(F.when(F.col("fold") < 1999, F.col("score"))).alias("early"), F.avg(F.when(F.col("fold") >= 1999, F.col("score"))).alias("late"))
    return rounded(Y.drift_against(both, "psi", "score", ["symbol"]).join(eras, "symbol"))


_LAGS = [f"lag({x}, {n}) OVER ({O.P}) AS {x}_l{n}" for x in X.LAGGED for n in (1, 2)]
_OF = {x: f for f, names in X.FAMILIES.items() for x in names if x in X.LAGGED}


@query("WITH " + ", ".join(f"f_{f} AS ({O.family_sql()[f'features_{f}']})" for f in sorted(set(_OF.values()))) + f" SELECT symbol, ts, {', '.join(_LAGS)} FROM " + " JOIN ".join(f"f_{f}" + (" USING (symbol, ts)" if i else "") for i, f in enumerate(sorted(set(_OF.values())))))
def features_lags(spark, sf_dir):
    """The 40 lags of all bars, over the families that they are taken from."""
    b = X.prepare(bars_of(spark, sf_dir))
    for family in (X.returns, X.candles, X.trend, X.momentum, lambda x: X.volatility(x, 96), X.activity, X.structure, X.levels, X.short_lags):
        b = family(b)
    return rounded(b.where("not halo").select("symbol", "ts", *X.FAMILIES["lags"]))


_C = "l_quantity l_extendedprice l_discount l_tax".split()


def determinant(names: list[str], other: list[str]) -> str:
    """The determinant of the correlations of some columns with others, written out."""
    if not names:
        return "1"
    entry = lambda a, b: f"{1 + 1e-6!r}::DOUBLE" if a == b else "c_" + "_".join(sorted((a, b)))
    return "(" + " ".join(f"{'-' if j % 2 else '+'} {entry(names[0], b)} * {determinant(names[1:], other[:j] + other[j + 1 :])}" for j, b in enumerate(other)) + ")"


VIF = f"WITH c AS (SELECT {', '.join(f'corr({a}, {b}) AS c_' + '_'.join(sorted((a, b))) for i, a in enumerate(_C) for b in _C[i + 1 :])} FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{x}' AS feature, round({determinant([c for c in _C if c != x], [c for c in _C if c != x])} / {determinant(_C, _C)}, 6) AS vif FROM c" for x in _C
)
ORACLES["variance_inflation"] = VIF

CONDITIONS = {
    "london": "sess_london = 1", "ny": "sess_ny = 1", "tokyo": "sess_tokyo = 1", "trend": "adx14 > 25", "range": "adx14 < 20", "high_vol": "atr14_rank_1y > 0.75", "low_vol": "atr14_rank_1y < 0.25",
    "fomc_day": "is_fomc_day = 1", "nfp_day": "is_nfp_day = 1", "all": "true",
}


@query(f"""WITH s AS ({O.family_sql()['features_sessions']}), t AS ({O.family_sql()['features_trend']}), v AS ({O.volatility_sql(96)}), r AS (SELECT symbol, ts, ret_1 FROM ({O.family_sql()['features_returns']})),
j AS (SELECT s.symbol, s.ts, lead(ret_1) OVER (PARTITION BY s.symbol ORDER BY s.ts) AS x, sess_london, sess_ny, sess_tokyo, is_fomc_day, is_nfp_day, adx14, atr14_rank_1y FROM s JOIN t USING (symbol, ts) JOIN v USING (symbol, ts) JOIN r USING (symbol, ts)),
g AS ({' UNION ALL '.join(f"SELECT '{n}' AS condition, x FROM j WHERE {c}" for n, c in CONDITIONS.items())})
SELECT condition, count(x) AS n, round(avg(x), 6) AS mean, round(1.96 * stddev_samp(x) / sqrt(count(x)), 6) AS margin FROM g GROUP BY condition HAVING count(x) >= 10""")
def conditioned_by_regime(spark, sf_dir):
    """The next bar's return by session, trend, volatility (ranked over a day of bars) and event day: all ten groups."""
    b = X.prepare(bars_of(spark, sf_dir))
    b = X.sessions(X.returns(X.volatility(X.trend(b), 96)), calendar_of(spark))
    b = written(rounded(b.where("not halo").select("symbol", "ts", "rn", "ret_1", "adx14", "atr14_rank_1y", "sess_london", "sess_ny", "sess_tokyo", "is_fomc_day", "is_nfp_day")), "conditions")
    ahead = b.select("symbol", (F.col("rn") - 1).alias("rn"), F.col("ret_1").alias("x"))
    return rounded(Z.conditioned(b.join(ahead, ["symbol", "rn"], "left"), "x", {n: F.expr(c) for n, c in CONDITIONS.items()}))


@query(f"""WITH {O.BARS}, j AS (SELECT bars.symbol, bars.ts, min(t.ts) FILTER (t.price >= open * 1.01) AS i, min(t.ts) FILTER (t.price <= open * 0.99) AS k FROM bars JOIN t ON t.symbol = bars.symbol AND time_bucket(INTERVAL 15 MINUTES, t.ts) = bars.ts GROUP BY ALL)
SELECT symbol, ts, CASE WHEN i IS NULL AND k IS NULL THEN 'none' WHEN i = k THEN 'both' WHEN k IS NULL OR i < k THEN 'a' ELSE 'b' END AS first FROM j""")
def first_touch(spark, sf_dir):
    """Which of two levels, one percent above or below its open, the ticks of each bar reach first."""
    ticks = ticks_from_events(table(spark, sf_dir, "events")).withColumns({"high": F.col("price"), "low": F.col("price")})
    b = M.attach_minutes(bars_of(spark, sf_dir), ticks)
    return b.select("symbol", "ts", M.first_touched(F.col("minutes"), F.col("open") * 1.01, True, F.col("open") * 0.99, False).alias("first"))


_ALL = ", ".join(f"f_{f} AS ({sql})" for f, sql in ((f, O.family_sql()[f"features_{f}"]) for f in X.FAMILIES if f != "lags"))
_JOINED = " JOIN ".join(f"f_{f}" + (" USING (symbol, ts)" if i else "") for i, f in enumerate(f for f in X.FAMILIES if f != "lags"))
ORACLES["features_all"] = f"""WITH RECURSIVE {_ALL}, base AS (WITH RECURSIVE {O.SMOOTHED} SELECT symbol, ts, open, high, low, close, round(a14, 6) AS a14, rn FROM b)
SELECT base.*, {', '.join(c for f, names in X.FAMILIES.items() if f != 'lags' for c in names)}, {', '.join(_LAGS)} FROM base JOIN {_JOINED.replace('f_returns', 'f_returns USING (symbol, ts)', 1)}"""


@query(f"""WITH {TRADES}, m AS (SELECT symbol, median(CASE WHEN k % 5 <> 0 THEN r END) AS md FROM t WHERE year(ts) < 1998 GROUP BY symbol) SELECT symbol, ts, k, round(coalesce(CASE WHEN k % 5 <> 0 THEN r END, md), 6) AS r FROM t JOIN m USING (symbol)""")
def imputed_medians(spark, sf_dir):
    """Every fifth customer's result taken out and put back as the median of the years before 1998."""
    t = trades(spark, sf_dir).withColumn("r", F.when(F.col("k") % 5 != 0, F.col("r")))
    return rounded(Y.imputed(t, ["r"], ["symbol"], F.year("ts") < 1998)).select("symbol", "ts", "k", "r")


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY md5('7:' || event_id), event_id LIMIT 500")
def seeded_sample_rows(spark, sf_dir):
    """A sample of 500 events that is the same on every cluster."""
    return folds.seeded_sample(table(spark, sf_dir, "events").dropna(subset=["value"]).select("event_id", "value"), "event_id", 500)


@query(f"SELECT * FROM ({O.FOLDS}) WHERE n_train >= 1200 AND n_test >= 300")
def folds_gated(spark, sf_dir):
    """Rolling folds of three years with at least 1,200 training and 300 test rows."""
    return folds.year_folds(numbered_years(spark, sf_dir), years=3, least_train=1200, least_test=300).select("symbol", "test_year", "test_first", "test_last", "train_first", "train_last", "n_train", "n_test")


@query(f"""WITH {TRADES}, y AS (SELECT symbol, year(ts) AS y, avg(r) AS m FROM t GROUP BY ALL), d AS (SELECT symbol, avg(m) FILTER (y < 1997) AS dev FROM y GROUP BY symbol),
w AS (SELECT symbol, count(m) AS n, avg(m) AS mean, avg(m) / (stddev_samp(m) / sqrt(count(m))) AS t FROM y WHERE y >= 1997 GROUP BY symbol), p AS (SELECT *, {tail('t', 'n - 1')} AS p FROM w)
SELECT symbol, n, round(mean, 6) AS mean, round(t, 6) AS t, round(p, 6) AS p, p < 0.05 / (SELECT count(*) FROM p) AND abs(mean) >= 1 AND sign(mean) = sign(dev) AS accepted FROM p JOIN d USING (symbol)""")
def yearly_t_test(spark, sf_dir):
    """Mean yearly results from 1997 on against zero by priority: accepted after Bonferroni if at least 1 from zero and of the sign of the years before."""
    y = written(trades(spark, sf_dir).groupBy("symbol", F.year("ts").alias("y")).agg(F.avg("r").alias("m")), "years")
    dev = y.where("y < 1997").groupBy("symbol").agg(F.avg("m").alias("dev"))
    tests = S.t_test(y.where("y >= 1997"), "m", ["symbol"]).join(dev, "symbol")
    return rounded(Y.judged(tests, "p", 0.05, "mean", 1.0, "dev").select("symbol", "n", "mean", "t", "p", "accepted"))


@query("SELECT 'order' AS kind, o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'customer', c_custkey, count(*) FROM customer GROUP BY ALL")
def stacked_keys(spark, sf_dir):
    """Keys of two tables one below the other, repeated ones too."""
    count = lambda name, kind, k: table(spark, sf_dir, name).groupBy(F.lit(kind).alias("kind"), F.col(k).alias("k")).agg(F.count("*").alias("n"))
    return count("orders", "order", "o_custkey").unionByName(count("customer", "customer", "c_custkey"))
