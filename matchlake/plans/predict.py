"""Training and batch scoring of the outcome classifier.

Scoring pairs come from the fact (each distinct (home, away) pairing that occurred), so
the work grows with the data and never enumerates all entity pairs. Features of a pair
are the home side's latest home form and the away side's latest away form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ml
from ..operators.latest import latest_by
from ..operators.unpivot import two_sided
from ..sources.tables import Tables
from . import marts


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.training_dataset(marts.as_table(marts.fct_matches(marts.stg_matches(Tables(spark, sf_dir)))))


def latest_role_form(feat: DataFrame) -> DataFrame:
    sides = two_sided(feat, [
        {"team_id": "home_team_id", "role": F.lit("home"), "scored": "home_avg_goals_scored_last_5",
         "conceded": "home_avg_goals_conceded_last_5"},
        {"team_id": "away_team_id", "role": F.lit("away"), "scored": "away_avg_goals_scored_last_5",
         "conceded": "away_avg_goals_conceded_last_5"},
    ], keep=["match_id", "match_date"])
    return latest_by(sides, ["team_id", "role"], ["match_date", "match_id"])


def pair_features(feat: DataFrame) -> DataFrame:
    form = latest_role_form(feat)
    pairs = (feat.select("home_team_id", "away_team_id")
             .filter(F.col("home_team_id") != F.col("away_team_id")).distinct())
    h = form.filter(F.col("role") == "home").select(
        F.col("team_id").alias("home_team_id"), F.col("scored").alias("home_avg_goals_scored_last_5"),
        F.col("conceded").alias("home_avg_goals_conceded_last_5"))
    a = form.filter(F.col("role") == "away").select(
        F.col("team_id").alias("away_team_id"), F.col("scored").alias("away_avg_goals_scored_last_5"),
        F.col("conceded").alias("away_avg_goals_conceded_last_5"))
    return pairs.join(h, "home_team_id").join(a, "away_team_id")


def train(spark, sf_dir, num_trees: int = 100):
    """Features are materialised once (Parquet): the split and both passes reuse them."""
    return ml.train_evaluate(marts.as_table(features(spark, sf_dir), "features"), num_trees)


def model_metrics(spark, sf_dir):
    return train(spark, sf_dir)[1]


def pair_scores(spark, sf_dir):
    feat = marts.as_table(features(spark, sf_dir), "features")
    model, _ = ml.train_evaluate(feat)
    return ml.class_probabilities(model, pair_features(feat))
