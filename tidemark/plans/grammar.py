"""A small expression language over bar series: trees become columns, level by level, and are stored as JSON."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import windows as R
from tidemark.functions.windows import EPS
from tidemark.operators.bars import by_stretch, previous
from tidemark.operators.smoothing import smoothed, span

BASES = ("r", "hl", "body", "upw", "dnw", "rv", "imb", "act")
WINDOWS = (4, 8, 16, 32, 96, 192)
ONE, TWO = ("lag", "diff", "ema", "std", "zs", "sum", "rank", "abs", "sign"), ("add", "sub", "mul", "div", "corr")


def base_series(bars: DataFrame) -> DataFrame:
    """The eight series that trees start from."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return previous(bars, "close", "_before").withColumns({
        "r": F.log(c / F.col("_before")), "hl": (h - low) / c, "body": (c - o) / c, "upw": (h - F.greatest(o, c)) / c, "dnw": (F.least(o, c) - low) / c, "rv": F.sqrt("rv"),
        "imb": (F.col("up") - F.col("down")) / (F.col("up") + F.col("down") + 1), "act": F.log1p(F.col("n").cast("double")),
    }).drop("_before", "_day")


def random_tree(rng: random.Random, depth: int = 3) -> dict:
    """A random tree of at most the given depth."""
    if depth == 0 or rng.random() < 0.2:
        return {"op": rng.choice(BASES)}
    if rng.random() < 0.65:
        return {"op": rng.choice(ONE), "w": rng.choice(WINDOWS), "a": random_tree(rng, depth - 1)}
    return {"op": rng.choice(TWO), "w": rng.choice(WINDOWS), "a": random_tree(rng, depth - 1), "b": random_tree(rng, depth - 1)}


def text(tree: dict) -> str:
    """The tree as text."""
    parts = [text(tree[x]) for x in ("a", "b") if x in tree] + ([str(tree["w"])] if "w" in tree and tree["op"] not in ("abs", "sign", "add", "sub", "mul", "div") else [])
    return tree["op"] + (f"({', '.join(parts)})" if parts else "")


def reach(tree: dict) -> int:
    """Rows before a row that a tree's value there depends on; smoothing is cut where its weights are below a double's precision."""
    n = tree.get("w", 0)
    own = {"lag": max(1, n // 4), "ema": 20 * n}.get(tree["op"], n)
    return own + max((reach(tree[x]) for x in ("a", "b") if x in tree), default=0)


def evaluate(bars: DataFrame, trees: dict[str, dict]) -> DataFrame:
    """Adds a column for each named tree, over stretches of the series with as many rows before them as the trees look back."""
    return by_stretch(bars, lambda b: _columns(b, trees), max(map(reach, trees.values()), default=0))


def _columns(bars: DataFrame, trees: dict[str, dict]) -> DataFrame:
    """The trees' columns. Equal subtrees are computed once; windows can't nest, so all subtrees of one height are one projection, and their smoothings one pass."""
    w = R.series("symbol", "chunk")
    names: dict[str, str] = {b: b for b in BASES}
    levels: dict[int, dict[str, dict]] = {}

    def height(tree: dict) -> int:
        below = [height(tree[x]) for x in ("a", "b") if x in tree]
        if below:
            levels.setdefault(1 + max(below), {}).setdefault(text(tree), tree)
        return 1 + max(below, default=-1)

    for tree in trees.values():
        height(tree)
    for _, level in sorted(levels.items()):
        for name in level:
            names[name] = f"_g{len(names)}"
        own = {names[t]: (tree["op"], F.col(names[text(tree["a"])]), F.col(names[text(tree["b"])]) if "b" in tree else None, tree.get("w", 0)) for t, tree in level.items() if tree["op"] != "ema"}
        if own:
            bars = bars.withColumns({out: _value(op, x, y, n, w) for out, (op, x, y, n) in own.items()})
        if smooth := {names[t]: (names[text(tree["a"])], span(tree["w"]), tree["w"]) for t, tree in level.items() if tree["op"] == "ema"}:
            bars = smoothed(bars, smooth, adjust=True)
    bars = bars.withColumns({name: F.col(names[text(tree)]).cast("double") for name, tree in trees.items()})
    return bars.drop(*(c for c in bars.columns if c.startswith("_g")))


def _value(op: str, x: Column, y: Column | None, n: int, w: WindowSpec) -> Column:
    """One operation over its inputs' columns."""
    return {
        "lag": lambda: F.lag(x, max(1, n // 4)).over(w), "diff": lambda: x - F.lag(x, n).over(w), "std": lambda: R.rolling("stddev_samp", x, w, n), "zs": lambda: R.zscore(x, w, n), "sum": lambda: R.rolling("sum", x, w, n),
        "rank": lambda: R.rank_share(x, w, n), "abs": lambda: F.abs(x), "sign": lambda: F.signum(x), "add": lambda: x + y, "sub": lambda: x - y, "mul": lambda: x * y,
        "div": lambda: x / (F.abs(y) + EPS) * F.when(y >= 0, 1).otherwise(-1),
        "corr": lambda: R.full(R.corr(x, y, R.frame(w, n)), F.when(x.isNotNull() & y.isNotNull(), 1), w, n),
    }[op]()
