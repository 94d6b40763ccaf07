"""Readable rules and feature importance for segments, with MLlib."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def assembled(df: DataFrame, cols: list[str], label: str) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="features").transform(df.withColumn("label", F.col(label).cast("double")))


def hash_groups(df: DataFrame, key: str, seed: int, least: int = 16, rows_per_group: int = 50_000) -> Column:
    """A group of each row by its hash; the groups grow in number with the table, not in size."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(max(least, math.ceil(df.count() / rows_per_group))))


def dealt(df: DataFrame, col: str, group: Column, key: str, seed: int) -> DataFrame:
    """``df`` with the values of ``col`` dealt anew among the rows of each group, in hashed order."""
    a = df.drop(col).withColumn("_g", group).withColumn("_k", F.row_number().over(W.partitionBy("_g").orderBy(key)))
    b = df.select(group.alias("_g"), F.col(col), F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), key), key)).alias("_k"))
    return a.join(b, ["_g", "_k"]).drop("_g", "_k")


def folds(df: DataFrame, n: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """``fold``: stratified by hashed order within the label, in rounds."""
    group = hash_groups(df, key, seed, least=64)
    order = W.partitionBy("label", group).orderBy(F.xxhash64(F.lit(seed + 1), key), key)
    return df.withColumn("fold", ((F.row_number().over(order) + group) % n).cast("int"))


def _score(predicted: DataFrame) -> tuple[float, float]:
    """Accuracy and macro F1 from the confusion counts."""
    rows = predicted.groupBy("label", "prediction").count().collect()  # classes squared
    n, hit = sum(r[2] for r in rows), sum(r[2] for r in rows if r[0] == r[1])
    f1 = []
    for c in {r[0] for r in rows} | {r[1] for r in rows}:
        tp = sum(r[2] for r in rows if r[0] == r[1] == c)
        size = sum(r[2] for r in rows if r[0] == c) + sum(r[2] for r in rows if r[1] == c)
        f1.append(2 * tp / size if size else 0.0)
    return hit / n, float(np.mean(f1))


def tree(depth: int = 4, leaf: int = 20, impurity: str = "gini", seed: int = 42) -> DecisionTreeClassifier:
    return DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=leaf, impurity=impurity, maxBins=256, seed=seed)


def forest(trees: int = 100, leaf: int = 5, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, minInstancesPerNode=leaf, maxDepth=10, seed=seed)


def cross_validate(df: DataFrame, cols: list[str], label: str, model=None, n: int = 5, scaled: bool = False) -> dict[str, float]:
    """Mean and sd of accuracy, mean macro F1 over stratified folds."""
    data = folds(assembled(df, cols, label), n).cache()
    if scaled:
        data = StandardScaler(inputCol="features", outputCol="_s", withMean=True).fit(data).transform(data).drop("features").withColumnRenamed("_s", "features")
    found = [_score((model or tree()).fit(data.filter(F.col("fold") != i)).transform(data.filter(F.col("fold") == i))) for i in range(n)]
    data.unpersist()
    return {"accuracy": float(np.mean([a for a, _ in found])), "sd": float(np.std([a for a, _ in found])), "macro_f1": float(np.mean([f for _, f in found]))}


def baseline(df: DataFrame, label: str) -> DataFrame:
    """The majority class and its share."""
    n = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("label"), (F.max("n") / F.sum("n")).alias("share"))


def tree_rules(df: DataFrame, cols: list[str], label: str, depth: int = 4, leaf: int = 20) -> list[dict]:
    """One row per leaf: the rule, the class, rows and purity."""
    model = tree(depth, leaf).fit(assembled(df, cols, label))
    out: list[dict] = []

    def walk(node, path: list[str]) -> None:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            out.append({"rule": " and ".join(path) or "all", "label": float(node.prediction()), "n": int(sum(stats)), "purity_pct": 100 * max(stats) / sum(stats)})
            return
        name, at = cols[node.split().featureIndex()], float(node.split().threshold())
        walk(node.leftChild(), [*path, f"{name} <= {at:.4g}"])
        walk(node.rightChild(), [*path, f"{name} > {at:.4g}"])

    walk(model._call_java("rootNode"), [])
    return out


def permutation_importance(df: DataFrame, cols: list[str], label: str, repeats: int = 5, seed: int = 42, key: str = "row_id", trees: int = 60) -> list[dict]:
    """Loss of accuracy on a held-out quarter when one column is dealt anew among its rows; Gini importance beside it.

    Values are dealt by hashed order within groups that grow in number with the table, so that no shuffle of a column is one task.
    """
    cell = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1024))
    train, test = df.filter(cell >= 256), df.filter(cell < 256).cache()
    model = forest(trees).fit(assembled(train, cols, label))
    whole, _ = _score(model.transform(assembled(test, cols, label)))
    group, out = hash_groups(test, key, seed), []
    for i, c in enumerate(cols):
        losses = []
        for r in range(repeats):
            losses.append(whole - _score(model.transform(assembled(dealt(test, c, group, key, seed + r + 1), cols, label)))[0])
        out.append({"feature": c, "importance": float(np.mean(losses)), "sd": float(np.std(losses)), "gini": float(model.featureImportances[i])})
    test.unpersist()
    return sorted(out, key=lambda x: -x["importance"])


def feature_sets(df: DataFrame, sets: dict[str, list[str]], label: str, small: float = 0.03, n: int = 5) -> list[dict]:
    """Nested feature sets by cross-validation: accuracy, lift over the majority class and over the set before, and a verdict on the last."""
    base, out = baseline(df, label).first()["share"], []
    for name, cols in sets.items():
        r = cross_validate(df, cols, label, forest(40), n)
        gain = r["accuracy"] - (out[-1]["accuracy"] if out else base)
        out.append({"set": name, **r, "lift": r["accuracy"] - base, "gain": gain, "verdict": "adds nothing" if gain < 0.01 else "adds little" if gain < small else "adds"})
    return out


def label_permutation(df: DataFrame, cols: list[str], label: str, shuffles: int = 10, seed: int = 42, key: str = "row_id") -> dict[str, float]:
    """Accuracy of a tree against accuracies with labels dealt anew, and the share at least as high."""
    seen = cross_validate(df, cols, label, n=3)["accuracy"]
    group = hash_groups(df, key, seed)
    null = [cross_validate(dealt(df, label, group, key, seed + r + 1), cols, label, n=3)["accuracy"] for r in range(shuffles)]
    return {"accuracy": seen, "null_mean": float(np.mean(null)), "p": (1 + sum(x >= seen for x in null)) / (1 + shuffles)}


def logistic() -> LogisticRegression:
    return LogisticRegression(maxIter=100)
