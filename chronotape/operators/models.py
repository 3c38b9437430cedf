"""Models on feature tables with Spark ML: logistic heads and boosted trees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotape.operators import logistic
from chronotape.operators.evaluate import best_threshold, folds, holdout, score_counts
from chronotape.plans.shared import written
from chronotape.plans.split import quantiles

# Inverse regularisation strengths tried, and folds.
STRENGTHS = (0.001, 0.01, 0.1, 1.0, 10.0)
FOLDS = 3


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def scored(predicted: DataFrame, *columns: str) -> DataFrame:
    """Predictions as rows of y and the chance of class 1."""
    return predicted.select(*columns, "y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))


def fitted_heads(
    rows: DataFrame, others: DataFrame, row: str, sets: dict[str, Sequence[int]], strengths: Sequence[float] = STRENGTHS, k: int = FOLDS
) -> tuple[DataFrame, dict[str, float], dict[str, float]]:
    """Logistic heads on several sets of places in the `features` array, all fitted together.

    Scaling is learned inside every fold. Returns the scores of `others` (name, row, y, score) under the fit on
    all rows with the strength of the lowest mean log-loss, that strength, and the threshold of the largest F1
    on out-of-fold scores.
    """
    marked = written(folds(rows.select(row, "y", "features"), row, k).drop("_u"), "folds")
    fits = logistic.fit_all(marked, sets, strengths, k)
    best = logistic.best_strengths(fits)
    chosen = [f for f in fits if f.strength == best[f.name]]
    outside = logistic.scores(marked, [f for f in chosen if f.fold >= 0], row, out_of_fold=True)
    found = best_threshold(score_counts(outside, ["name"]), ["name"]).collect()
    thresholds = {r["name"]: r["threshold"] for r in found}
    return logistic.scores(others, [f for f in chosen if f.fold < 0], row), best, thresholds


def probe(
    train: DataFrame, others: DataFrame, vector: str, row: str, strengths: Sequence[float] = STRENGTHS
) -> tuple[DataFrame, float, float]:
    """A logistic head on vectors: scores of `others`, the chosen strength, the threshold from out-of-fold scores."""
    ready = lambda df: df.withColumn("features", F.col(vector).cast("array<double>"))
    width = train.select(F.size(vector).alias("n")).first()["n"]
    scores, best, thresholds = fitted_heads(ready(train), ready(others), row, {"head": range(width)}, strengths)
    return scores.drop("name"), best["head"], thresholds["head"]


def arrays(train: DataFrame, others: Sequence[DataFrame], numeric: Sequence[str], categorical: Sequence[str]) -> tuple[list[DataFrame], list[str]]:
    """The tables with all inputs in one array `features`, and the column that each place comes from.

    Numbers are signed logs with the median of the training rows in place of a gap (0 without any value) and a
    flag for it; a text is one place per value of the training rows and one for all other texts. Medians and
    values come from one aggregate; a text column has few values.
    """
    ready = [prepared(df, numeric, categorical, log=True) for df in (train, *others)]
    facts = ready[0].agg(
        *[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in numeric], *[F.array_sort(F.collect_set(c)).alias(c) for c in categorical]
    ).first()
    cells: list[Column] = []
    names: list[str] = []
    for c in numeric:
        cells += [F.coalesce(F.col(c), F.lit(facts[c] if facts[c] is not None else 0.0)), F.col(f"{c}_missing")]
        names += [c, c]
    for c in categorical:
        cells += [(F.col(c) == v).cast("double") for v in facts[c]] + [(~F.col(c).isin(*facts[c])).cast("double")]
        names += [c] * (len(facts[c]) + 1)
    return [df.withColumn("features", F.array(*cells)) for df in ready], names


def mixed_features(numeric: Sequence[str], categorical: Sequence[str]) -> list:
    """Stages that turn numeric and text columns into one vector; gaps take the median, unseen texts a class of their own."""
    filled = [f"_f_{c}" for c in numeric]
    indexed = [f"_i_{c}" for c in categorical]
    stages: list = [Imputer(inputCols=list(numeric), outputCols=filled, strategy="median")] if numeric else []
    inputs = list(filled)
    if categorical:
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"))
        inputs += indexed
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


def prepared(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], log: bool = False) -> DataFrame:
    """Numbers as doubles (optionally signed logs, with a flag per column that has gaps), texts without nulls."""
    number = lambda c: signed_log(F.col(c).cast("double")) if log else F.col(c).cast("double")
    return rows.withColumns(
        {
            **{c: number(c) for c in numeric},
            **{f"{c}_missing": F.col(c).isNull().cast("double") for c in numeric},
            **{c: F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in categorical},
        }
    )


def empty_as_zero(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Columns of the training rows without any value have no median: they become 0, as in hand features."""
    counts = train.agg(*[F.count(c).alias(c) for c in numeric]).first()
    empty = [c for c in numeric if counts[c] == 0]
    return train.fillna(0.0, subset=empty) if empty else train


def fill_hand_features(rows: DataFrame, numeric: Sequence[str], row: str) -> DataFrame:
    """Signed logs with the exact median of the column in place of a gap, and a flag for it; all columns in one plan."""
    logged = rows.select(row, *[signed_log(F.col(c).cast("double")).alias(c) for c in numeric])
    long = logged.unpivot([], list(numeric), "column", "value")
    medians = quantiles(long, ["column"], "value", {"median": 0.5})
    # One row per column.
    wide = medians.agg(F.map_from_entries(F.collect_list(F.struct("column", "median"))).alias("medians"))
    return logged.join(F.broadcast(wide)).select(
        row,
        *[F.coalesce(F.col(c), F.element_at("medians", F.lit(c)), F.lit(0.0)).alias(c) for c in numeric],
        *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in numeric],
    )


def boosted(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    row: str,
    trees: int = 20,
    depth: int = 4,
    held_share: float = 0.2,
) -> tuple[PipelineModel, float, int]:
    """Boosted trees: early stop and threshold on a held-out share, then a refit on all rows with that many trees."""
    rows = empty_as_zero(prepared(holdout(train, row, held_share), numeric, categorical), numeric).cache()
    features = mixed_features(numeric, categorical)
    gbt = GBTClassifier(
        labelCol="y", maxIter=trees, maxDepth=depth, maxBins=256, validationIndicatorCol="held_out", seed=7
    )
    stopped = Pipeline(stages=[*features, gbt]).fit(rows)
    held = scored(stopped.transform(rows.filter("held_out")), row)
    threshold = best_threshold(score_counts(held)).first()["threshold"]
    size = stopped.stages[-1].getNumTrees
    final = GBTClassifier(labelCol="y", maxIter=size, maxDepth=depth, maxBins=256, seed=7)
    return Pipeline(stages=[*features, final]).fit(rows), threshold, size


def importance(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[tuple[str, float]]:
    """Features by importance, the largest first."""
    weights = model.stages[-1].featureImportances.toArray()
    names = [*numeric, *categorical]
    return sorted(((n, float(w)) for n, w in zip(names, weights)), key=lambda x: (-x[1], x[0]))
