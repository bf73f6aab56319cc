"""Outcome classifier on the feature table with Spark ML (distributed training and scoring)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ["home_avg_goals_scored_last_5", "home_avg_goals_conceded_last_5",
            "away_avg_goals_scored_last_5", "away_avg_goals_conceded_last_5"]
LABEL = "match_result"
CLASSES = ["HOME_WIN", "AWAY_WIN", "DRAW"]


def pipeline(num_trees: int = 100, seed: int = 42) -> Pipeline:
    idx = StringIndexer(inputCol=LABEL, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep")
    vec = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(numTrees=num_trees, seed=seed, featuresCol="features", labelCol="label")
    return Pipeline(stages=[idx, vec, rf])


def split(df: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    return df.randomSplit([0.8, 0.2], seed=seed)


def train_evaluate(features: DataFrame, num_trees: int = 100, seed: int = 42):
    """Fit on 80 %, score the held-out 20 %. Returns (model, one-row metrics DataFrame)."""
    data = features.select(*FEATURES, LABEL).filter(F.col(LABEL).isNotNull())
    train, test = split(data, seed)
    model = pipeline(num_trees, seed).fit(train)
    pred = model.transform(test)
    acc = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                            metricName="accuracy").evaluate(pred)
    counts = test.groupBy(LABEL).count()
    metrics = test.agg(F.count(F.lit(1)).alias("n_test")).select(
        F.lit(float(acc)).alias("accuracy"), "n_test",
        train.agg(F.count(F.lit(1))).scalar().alias("n_train"),
        F.round(counts.agg(F.max("count")).scalar() / F.col("n_test"), 4).alias("majority_rate"))
    return model, metrics


def labels(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labelsArray[0])


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Append p_<class> for every outcome class; a class absent in training gets 0."""
    out = model.transform(df)
    arr = vector_to_array("probability")
    known = labels(model)
    cols = [(arr[known.index(c)] if c in known else F.lit(0.0)).alias(f"p_{c.lower()}") for c in CLASSES]
    pred = IndexToString(inputCol="prediction", outputCol="predicted", labels=known)
    return pred.transform(out).select(*df.columns, *cols, "predicted")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
