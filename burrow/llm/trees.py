"""Decision trees and forests that Spark's ml library has fitted, as rules.

A tree is a nested tuple (feature, threshold, tree if <=, tree if >) whose
leaves are the predicted class, 0.0 or 1.0.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)")


def _read(lines: list[str], at: int):
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return float(line.split()[1]), at + 1
    feature, threshold = _SPLIT.match(line).groups()
    low, at = _read(lines, at + 1)
    high, at = _read(lines, at + 1)  # behind the Else line
    return (int(feature), float(threshold), low, high), at


def rules_of(model) -> list:
    """The trees of a fitted model of continuous features."""
    lines = [line for line in model.toDebugString.split("\n")[1:] if line.strip()]
    starts = [k + 1 for k, line in enumerate(lines) if line.strip().startswith("Tree ")] or [0]
    return [_read(lines, k)[0] for k in starts]


def fitted(table: DataFrame, features: list[str], label: str, trees: int, depth: int, seed: int = 1) -> list:
    """Trees fitted to a small labelled table, the same in every run."""
    rows = VectorAssembler(inputCols=features, outputCol="_x").transform(
        table.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("_y"))
    ).select("_x", "_y").coalesce(1)
    settings = {"featuresCol": "_x", "labelCol": "_y", "maxDepth": depth, "seed": seed}
    if trees == 1:
        return rules_of(DecisionTreeClassifier(**settings).fit(rows))
    return rules_of(RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", **settings).fit(rows))


_made: dict[tuple[str, str], list] = {}


def once(spark: SparkSession, name: str, make) -> list:
    """What ``make`` fits to a fixed table, fitted once in an application."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def as_column(tree, value) -> Column:
    """The tree's prediction; ``value`` gives the column of a feature."""
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(value(feature) <= threshold, as_column(low, value)).otherwise(as_column(high, value))


def predict(tree, row) -> float:
    while not isinstance(tree, float):
        feature, threshold, low, high = tree
        tree = low if row[feature] <= threshold else high
    return tree
