"""What a fitted model owes to each feature: shares of its gain by fold, and what the AUC loses when a feature is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import statistics as S
from tidemark.functions.ranges import in_ranges, sums_before
from tidemark.operators import models
from tidemark.shared import written


def shuffled(rows: DataFrame, id: str, features: Sequence[str], keep: Sequence[str], seed: int = 7) -> DataFrame:
    """The rows once for each feature, with that feature's values dealt anew among all rows, and once as they are: ``column`` says which ('' for none).

    Row n by id gets the value of row n in the order of md5("seed:feature:id"). Both orders are numbered by ranges, so a
    feature's shuffle is an exchange of rows and no task holds a feature. Ids are unique and not null.
    """
    one = F.lit(1).cast("long").alias("_one")
    base = sums_before(in_ranges(rows.select(id, *keep, *(F.col(f).cast("double").alias(f) for f in features), one), id), [], [id], {"_n": "_one"})
    base = written(base, "base")
    mixed = S.melted(base, features, [id, "_one"]).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "column", F.col(id).cast("string"))))
    dealt = sums_before(in_ranges(mixed, "column", "_h"), ["column"], ["_h"], {"_n": "_one"}).select("column", "_n", F.col("value").alias("_dealt"))
    other = base.join(dealt, "_n").select(id, *keep, "column", *(F.when(F.col("column") == f, F.col("_dealt")).otherwise(F.col(f)).alias(f) for f in features))
    return other.unionByName(base.select(id, *keep, F.lit("").alias("column"), *features))


def auc_drops(rows: DataFrame, id: str, features: Sequence[str], label: str, score: Callable[[DataFrame], DataFrame], seed: int = 7) -> DataFrame:
    """column, auc (with it shuffled) and drop (exact AUC as it is, less that) of each feature.

    ``score`` adds the column ``score`` of one fitted model; it is applied to all shuffles in one pass.
    """
    scored = score(shuffled(rows, id, features, [label], seed)).select("column", label, "score")
    areas = written(S.auc(scored, "score", label, ["column"]).select("column", "auc"), "areas")  # a row a feature
    whole = areas.where("column = ''").select(F.col("auc").alias("_whole"))
    return areas.where("column != ''").join(F.broadcast(whole)).select("column", "auc", (F.col("_whole") - F.col("auc")).alias("drop"))


def gain_shares(fitted: dict, features: Sequence[str]) -> list[tuple[int, str, float]]:
    """test_year, feature and its share of the gain of the year's trees; a year's shares sum to one (to nothing if no tree splits)."""
    out = []
    for year, model in fitted.items():
        gains = model.stages[-1].featureImportances.toArray()
        total = gains.sum() or 1.0
        out += [(year, f, float(g / total)) for f, g in zip(features, gains, strict=True)]
    return out


def gain_importance(rows: DataFrame, plan: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", rounds: int | None = None, top: int = 25) -> DataFrame:
    """feature, n_folds and its mean share of gain over the folds: the ``top`` largest, ties by name. Trees: kind gbt or forest."""
    shares = gain_shares(models.fold_models(rows, plan, features, label, kind, rounds), features)
    table = rows.sparkSession.createDataFrame(shares, "test_year int, feature string, share double")  # a row a year and feature
    return table.groupBy("feature").agg(F.count("*").alias("n_folds"), F.avg("share").alias("mean_gain_share")).orderBy(F.desc("mean_gain_share"), "feature").limit(top)
