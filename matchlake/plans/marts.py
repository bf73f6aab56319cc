"""Curated marts: entity dimension, finished-event fact (full or incremental) and the
leakage-free rolling feature table. Every function takes and returns DataFrames; the
whole chain is one lazy plan that Catalyst prunes and pushes down to the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import outcome, typed
from ..operators.rolling import trailing_mean
from ..operators.unpivot import two_sided
from ..sources.events import FINISHED, Tables, event_rows, staged

# Output columns of the fact and of the feature table.
FACT_COLUMNS = ("match_id", "league_id", "season", "match_date", "match_status", "home_team_id",
                "home_team_name", "home_team_score", "away_team_id", "away_team_name", "away_team_score")

FEATURE_COLUMNS = ("match_id", "match_date", "match_result", "home_team_id", "home_team_name",
                   "home_avg_goals_scored_last_5", "home_avg_goals_conceded_last_5",
                   "away_team_id", "away_team_name", "away_avg_goals_scored_last_5",
                   "away_avg_goals_conceded_last_5")


def as_table(df: DataFrame, name: str = "mart") -> DataFrame:
    """Materialise a mart as a Parquet table in the shared checkpoint folder and read it back.

    This cuts the lineage (a lost executor does not re-run the joins), and unlike an RDD
    checkpoint the stored table is columnar: later reads prune columns (including nested
    fields) and push filters down to it."""
    from ..session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def stg_matches(tables: Tables, status: str | None = None) -> DataFrame:
    return staged(event_rows(tables, status))


def fct_from_source(tables: Tables) -> DataFrame:
    """The fact straight from the source: the status filter is pushed to the order scan."""
    return fct_matches(stg_matches(tables, FINISHED))


def fct_matches(stg: DataFrame, strict: bool = True) -> DataFrame:
    """Finished events, typed. The status predicate sits on the nested field, before any cast."""
    m = lambda f: F.col(f"match_data.{f}")
    return (stg.filter(m("strStatus") == F.lit(FINISHED))
            .select(typed(m("idEvent"), "bigint", strict).alias("match_id"),
                    typed(m("idLeague"), "int", strict).alias("league_id"),
                    m("strSeason").alias("season"),
                    typed(m("dateEvent"), "date", strict).alias("match_date"),
                    m("strStatus").alias("match_status"),
                    typed(m("idHomeTeam"), "int", strict).alias("home_team_id"),
                    m("strHomeTeam").alias("home_team_name"),
                    typed(m("intHomeScore"), "int", strict).alias("home_team_score"),
                    typed(m("idAwayTeam"), "int", strict).alias("away_team_id"),
                    m("strAwayTeam").alias("away_team_name"),
                    typed(m("intAwayScore"), "int", strict).alias("away_team_score")))


def dim_teams(stg: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct (id, name) over both sides of every staged event (one scan, one shuffle)."""
    sides = two_sided(stg, [
        {"team_id": typed(F.col("match_data.idHomeTeam"), "int", strict), "team_name": F.col("match_data.strHomeTeam")},
        {"team_id": typed(F.col("match_data.idAwayTeam"), "int", strict), "team_name": F.col("match_data.strAwayTeam")},
    ])
    return sides.distinct()


def team_form(fct: DataFrame, k: int = 5, chunk_rows: int = 1_000_000) -> DataFrame:
    """Per (team, date): trailing mean of goals for/against over the k previous events.

    Same-date events are ordered by id (the reference leaves them unordered); several
    values of one date collapse with MAX, as in the reference model.
    """
    per_side = two_sided(fct, [
        {"team_id": "home_team_id", "goals_scored": "home_team_score", "goals_conceded": "away_team_score"},
        {"team_id": "away_team_id", "goals_scored": "away_team_score", "goals_conceded": "home_team_score"},
    ], keep=["match_id", "match_date"])
    rolled = trailing_mean(per_side, "team_id", ["match_date", "match_id"],
                           {"avg_goals_scored_last_5": "goals_scored",
                            "avg_goals_conceded_last_5": "goals_conceded"}, k=k, chunk_rows=chunk_rows)
    return (rolled.groupBy("team_id", "match_date")
            .agg(F.max("avg_goals_scored_last_5").alias("avg_goals_scored_last_5"),
                 F.max("avg_goals_conceded_last_5").alias("avg_goals_conceded_last_5")))


def training_dataset(fct: DataFrame, k: int = 5, chunk_rows: int = 1_000_000) -> DataFrame:
    """Fact + outcome + both sides' form as of the event date (missing form → 0)."""
    form = team_form(fct, k, chunk_rows)
    h = form.select(F.col("team_id").alias("_ht"), F.col("match_date").alias("_hd"),
                    F.col("avg_goals_scored_last_5").alias("_hs"), F.col("avg_goals_conceded_last_5").alias("_hc"))
    a = form.select(F.col("team_id").alias("_at"), F.col("match_date").alias("_ad"),
                    F.col("avg_goals_scored_last_5").alias("_as"), F.col("avg_goals_conceded_last_5").alias("_ac"))
    m = fct.select("match_id", "match_date", "home_team_id", "home_team_name", "away_team_id",
                   "away_team_name", outcome("home_team_score", "away_team_score").alias("match_result"))
    j = (m.join(h, (m.home_team_id == h._ht) & (m.match_date == h._hd), "left")
         .join(a, (m.away_team_id == a._at) & (m.match_date == a._ad), "left"))
    z = F.lit(0.0)
    return j.select("match_id", "match_date", "match_result", "home_team_id", "home_team_name",
                    F.coalesce("_hs", z).alias("home_avg_goals_scored_last_5"),
                    F.coalesce("_hc", z).alias("home_avg_goals_conceded_last_5"),
                    "away_team_id", "away_team_name",
                    F.coalesce("_as", z).alias("away_avg_goals_scored_last_5"),
                    F.coalesce("_ac", z).alias("away_avg_goals_conceded_last_5"))


def dedupe_by_key(df: DataFrame, key: str, prefer: list[str] | None = None) -> DataFrame:
    """One row per non-NULL key: the greatest row by (``prefer``..., all columns).

    ``max(struct)`` is a combinable aggregate, so a hot key is reduced map-side instead
    of being gathered into one window partition. NULL keys pass through untouched.
    """
    prefer = prefer or []
    cols = df.columns
    order = [*prefer, *[c for c in cols if c not in prefer]]
    best = (df.filter(F.col(key).isNotNull())
            .groupBy(key).agg(F.max(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)])).alias("_r")))
    picked = best.select(*[F.col(f"_r._{i}").alias(c) for i, c in enumerate(order)]).select(*cols)
    return picked.unionByName(df.filter(F.col(key).isNull()))


def incremental_batch(new: DataFrame, target: DataFrame | None, date_col: str = "match_date",
                      full_refresh: bool = False, inclusive: bool = False) -> DataFrame:
    """High-water-mark filter: keep new rows after ``max(date_col)`` of the target.

    The watermark is an uncorrelated scalar subquery inside the same plan (evaluated
    once). An empty target (NULL watermark) loads everything.
    """
    if full_refresh or target is None:
        return new
    wm = target.agg(F.max(date_col)).scalar()
    c = F.col(date_col)
    newer = c >= wm if inclusive else c > wm
    return new.filter(F.coalesce(newer, wm.isNull()))


def upsert(target: DataFrame, batch: DataFrame, key: str, prefer: list[str] | None = None) -> DataFrame:
    """New rows replace target rows with the same key; the batch is de-duplicated first."""
    b = dedupe_by_key(batch, key, prefer)
    keys = b.select(key).filter(F.col(key).isNotNull())
    return target.join(keys, key, "left_anti").unionByName(b)
