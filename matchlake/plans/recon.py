"""Cross-store reconciliation of the marts against a migrated copy.

The copy is what a migration to another store produces: upper-case column names and
dates stored as ISO text. To exercise every comparison path the feature table's copy
also carries controlled drift, chosen by row attributes (whole tables are compared):

* even DRAW rows: home_avg_goals_scored_last_5 + 0.001 (inside the 0.0011 tolerance);
  odd DRAW rows of home team 5: that average lost (NULL in a tolerance column);
* HOME_WIN rows of home team 1: away_avg_goals_conceded_last_5 + 0.01 (outside); home team 6:
  the same + 0.00001 where above 1 (a strict difference only);
* AWAY_WIN rows: away_team_name lost for away team 2 (NULL on one side), the text ``\\N`` for
  team 3 (not a NULL), delimiters and quotes appended for team 4;
* DRAW rows of home team 3: missing in the copy;  DRAW rows of home team 4: copied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..sources.tables import Tables
from . import marts
from .parallel import together

# Compared tables, their key and tolerance columns.
TABLES = {
    "dim_teams": ("team_id", ["team_id", "team_name"], []),
    "fct_matches": ("match_id", list(marts.FACT_COLUMNS), []),
    "fct_training_dataset": ("match_id", list(marts.FEATURE_COLUMNS),
                             ["home_avg_goals_scored_last_5", "home_avg_goals_conceded_last_5",
                              "away_avg_goals_scored_last_5", "away_avg_goals_conceded_last_5"]),
}


def source_marts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The source store's marts; staging is materialised once (Parquet in the shared folder)."""
    stg = marts.as_table(marts.stg_matches(Tables(spark, sf_dir)), "stg_matches")
    fct = marts.as_table(marts.fct_matches(stg), "fct_matches")
    # every table is read by several comparisons (both checksums, the diff, the null
    # profile): materialise each once, as the source store holds them as tables
    dim, features = together(lambda x: marts.as_table(x[0](x[1]), x[2]), [
        (marts.dim_teams, stg, "dim_teams"), (marts.training_dataset, fct, "fct_training_dataset")])
    return {"dim_teams": dim, "fct_matches": fct, "fct_training_dataset": features}


def drift(features: DataFrame) -> DataFrame:
    r, h, a = F.col("match_result"), F.col("home_team_id"), F.col("away_team_id")
    scored, conceded, name = (F.col(c) for c in ("home_avg_goals_scored_last_5", "away_avg_goals_conceded_last_5", "away_team_name"))
    win, draw, lost = r == "HOME_WIN", r == "DRAW", r == "AWAY_WIN"
    d = (features
         .withColumn("home_avg_goals_scored_last_5",
                     F.when(draw & (F.col("match_id") % 2 == 0), scored + 0.001)
                     .when(draw & (h == 5), F.lit(None).cast("double")).otherwise(scored))
         .withColumn("away_avg_goals_conceded_last_5",
                     F.when(win & (h == 1), conceded + 0.01).when((h == 6) & (conceded > 1), conceded + 0.00001).otherwise(conceded))
         .withColumn("away_team_name", F.when(lost & (a == 2), F.lit(None).cast("string")).when(lost & (a == 3), F.lit("\\N"))
                     .when(lost & (a == 4), F.concat(name, F.lit('|","'))).otherwise(name))
         .filter(~(draw & (h == 3))))
    return d.unionByName(d.filter(draw & (h == 4)))


def migrated(df: DataFrame) -> DataFrame:
    """Store-side shape: upper-case names, dates as ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if f.dataType.simpleString() == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name.upper()))
    return df.select(*cols)


def target_marts(src: dict[str, DataFrame]) -> dict[str, DataFrame]:
    out = dict(src)
    out["fct_training_dataset"] = drift(src["fct_training_dataset"])
    return {k: migrated(v) for k, v in out.items()}


def pairs(spark: SparkSession, sf_dir: str):
    src = source_marts(spark, sf_dir)
    dst = target_marts(src)
    for name, (key, cols, num) in TABLES.items():
        yield name, key, cols, num, R.normalise(src[name], cols, num), R.normalise(dst[name], cols, num)


def _union(dfs):
    out = None
    for d in dfs:
        out = d if out is None else out.unionByName(d)
    return out


def recon_counts(spark, sf_dir):
    return _union([R.counts(l, r).select(F.lit(n).alias("table"), "*") for n, _, _, _, l, r in pairs(spark, sf_dir)])


def recon_nulls(spark, sf_dir):
    return _union([R.null_compare(l, r, c).select(F.lit(n).alias("table"), "*")
                   for n, _, c, _, l, r in pairs(spark, sf_dir)])


def recon_checksum(spark, sf_dir):
    parts = []
    for n, _, c, _, l, r in pairs(spark, sf_dir):
        rc = R.checksum(r, c).select(F.struct("rows", "checksum")).scalar()
        parts.append(R.checksum(l, c).select(
            F.lit(n).alias("table"), F.col("rows").alias("left_rows"), F.col("checksum").alias("left_checksum"),
            rc.getField("rows").alias("right_rows"), rc.getField("checksum").alias("right_checksum"))
            .withColumn("checksum_match", F.col("left_checksum") == F.col("right_checksum")))
    return _union(parts)


def recon_diff_rows(spark, sf_dir):
    def one(x):
        n, k, c, num, l, r = x
        return R.diff(l, r, k, c, num).select(F.lit(n).alias("table"), F.col(k).alias("key"), "occ", "side",
                                              F.array_join("diff_columns", ",").alias("diff_columns"))
    return _union(together(one, pairs(spark, sf_dir)))


def recon_diff_cells(spark, sf_dir):
    def one(x):
        n, k, c, num, l, r = x
        return R.cell_diffs(l, r, k, c, num).select(F.lit(n).alias("table"), F.col(k).alias("key"), "occ", "column", "left_value", "right_value")
    return _union(together(one, pairs(spark, sf_dir)))


def recon_first_diffs(spark, sf_dir, n: int = 10):
    """The first ``n`` differing cells in (table, key, column) order — a top-k report."""
    return recon_diff_cells(spark, sf_dir).orderBy("table", F.col("key").cast("bigint"), "occ", "column").limit(n)


def recon_summary(spark, sf_dir):
    return _union(together(lambda x: R.summary(x[0], x[4], x[5], x[1], x[2], x[3]), pairs(spark, sf_dir)))


def recon_status(spark, sf_dir):
    return R.overall(recon_summary(spark, sf_dir))
