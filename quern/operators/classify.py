"""A text classifier: sentence vectors and multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[Column], Column]


class Classifier:
    """``labels[i]`` is class i of ``model``."""

    def __init__(self, model: LogisticRegressionModel, labels: list[str], encode: Encode):
        self.model, self.labels, self.encode = model, labels, encode

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``scores``, a map from label to probability; empty for blank texts."""
        blank = F.btrim(F.coalesce("text", F.lit(""))) == ""
        out = self.model.transform(rows.withColumn("features", array_to_vector(self.encode(F.col("text")))))
        names = F.array(*map(F.lit, self.labels))
        scores = F.map_from_arrays(names, F.slice(vector_to_array("probability"), 1, len(self.labels)))
        empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        return out.select(*rows.columns, F.when(blank, empty).otherwise(scores).alias("scores"))


def best(scores: Column) -> Column:
    """(score, label) of the largest score, the first label of equal ones; null for an empty map."""
    pairs = F.transform(F.sort_array(F.map_entries(scores)), lambda e: F.struct(e["value"].alias("score"), e["key"].alias("label")))
    pick = lambda a, x: F.when(a["score"].isNull() | (x["score"] > a["score"]), x).otherwise(a)
    none = F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"))
    return F.aggregate(pairs, none, pick)


def train(rows: DataFrame, encode: Encode, rounds: int = 100) -> Classifier:
    """From rows (text, label); the labels are few and come to the driver, the rows don't."""
    labels = sorted(r["label"] for r in rows.select("label").where("label is not null").distinct().collect())
    if len(labels) < 2:
        raise ValueError("a classifier needs two labels or more")
    place = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    data = rows.where("label is not null").select(array_to_vector(encode(F.col("text"))).alias("features"), place.cast("double").alias("y"))
    fit = LogisticRegression(featuresCol="features", labelCol="y", maxIter=rounds, regParam=0.001, family="multinomial")
    return Classifier(fit.fit(data), labels, encode)


def save(c: Classifier, path: str) -> None:
    from pyspark.sql import SparkSession

    c.model.write().overwrite().save(f"{path}/model")
    rows = list(enumerate(c.labels))
    SparkSession.active().createDataFrame(rows, "i int, label string").write.mode("overwrite").parquet(f"{path}/labels")


def load(path: str, encode: Encode) -> Classifier:
    from pyspark.sql import SparkSession

    labels = SparkSession.active().read.parquet(f"{path}/labels").orderBy("i").collect()
    return Classifier(LogisticRegressionModel.load(f"{path}/model"), [r["label"] for r in labels], encode)
