"""Controlled corruption of tables, applied as an ordered fold of lazy DataFrame edits.

Each step sees the result of the previous ones (an update after an insert also hits
the inserted row). Targets are the n-th key of the *clean* table in key order, found
with a bounded top-k (``orderBy(key).limit(n+1)``), never with a global window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Injection:
    anomaly_id: str
    table: str
    op: str            # set_null | set_value | insert_renamed | insert_copy
    column: str | None
    position: int      # n-th key (0-based) of the clean table in key order
    value: str | None = None  # new value (set_value) or name suffix (insert_renamed)


# Key column and name column per injectable table.
KEYS = {"dim_teams": ("team_id", "team_name"), "fct_matches": ("match_id", None)}

# The three anomaly batches of the reference experiment, in order.
BATCHES: dict[str, list[Injection]] = {
    "batch_A_key_integrity": [
        Injection("null_dim_teams_team_id", "dim_teams", "set_null", "team_id", 1),
        Injection("duplicate_dim_teams_team_id", "dim_teams", "insert_renamed", "team_name", 0, "_DUP"),
        Injection("null_fct_matches_match_id", "fct_matches", "set_null", "match_id", 1),
        Injection("duplicate_fct_matches_match_id", "fct_matches", "insert_copy", None, 0),
    ],
    "batch_B_semantic_domain": [
        Injection("null_dim_teams_team_name", "dim_teams", "set_null", "team_name", 3),
        Injection("null_fct_matches_match_status", "fct_matches", "set_null", "match_status", 10),
        Injection("invalid_fct_matches_match_status", "fct_matches", "set_value", "match_status", 11, "BROKEN_STATUS"),
        Injection("null_fct_matches_home_team_id", "fct_matches", "set_null", "home_team_id", 12),
        Injection("null_fct_matches_away_team_id", "fct_matches", "set_null", "away_team_id", 13),
        Injection("null_fct_matches_match_date", "fct_matches", "set_null", "match_date", 14),
    ],
    "batch_C_mixed_full_stack": [
        Injection("null_dim_teams_team_id", "dim_teams", "set_null", "team_id", 5),
        Injection("duplicate_dim_teams_team_id", "dim_teams", "insert_renamed", "team_name", 4, "_DUP2"),
        Injection("null_dim_teams_team_name", "dim_teams", "set_null", "team_name", 4),
        Injection("duplicate_fct_matches_match_id", "fct_matches", "insert_copy", None, 20),
        Injection("null_fct_matches_home_team_id", "fct_matches", "set_null", "home_team_id", 21),
        Injection("null_fct_matches_match_date", "fct_matches", "set_null", "match_date", 22),
    ],
}


def targets(tables: dict[str, DataFrame], specs: list[Injection]) -> dict[tuple[str, int], tuple]:
    """(table, position) → (key, name) of the clean table; one bounded top-k per table."""
    out = {}
    for t in sorted({s.table for s in specs}):
        key, name = KEYS[t]
        need = max(s.position for s in specs if s.table == t) + 1
        cols = [key] + ([name] if name else [])
        rows = (tables[t].select(*cols).filter(F.col(key).isNotNull())
                .orderBy(*[F.col(c).asc_nulls_last() for c in cols]).limit(need).collect())
        for i, r in enumerate(rows):
            out[(t, i)] = (r[0], r[1] if name else None)
    return out


def apply(spark: SparkSession, tables: dict[str, DataFrame], specs: list[Injection],
          batch_id: str, tg: dict | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Fold ``specs`` over ``tables``; return the corrupted tables and the manifest.

    ``tg`` are precomputed targets (one top-k per table for several batches at once)."""
    tg = tg if tg is not None else targets(tables, specs)
    cur = dict(tables)
    manifest = []
    for s in specs:
        key, name = KEYS[s.table]
        tkey, tname = tg[(s.table, s.position)]
        df = cur[s.table]
        hit = F.col(key) == F.lit(tkey)
        if s.op == "set_null":
            df = df.withColumn(s.column, F.when(hit, F.lit(None).cast(df.schema[s.column].dataType))
                               .otherwise(F.col(s.column)))
        elif s.op == "set_value":
            df = df.withColumn(s.column, F.when(hit, F.lit(s.value)).otherwise(F.col(s.column)))
        elif s.op == "insert_renamed":
            row = spark.createDataFrame([(tkey, f"{tname}{s.value}")], df.select(key, name).schema)
            df = df.unionByName(row, allowMissingColumns=True)
        elif s.op == "insert_copy":
            # one pass: a hit row is written twice
            times = F.when(hit, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
            df = df.select("*", F.explode(times).alias("_copy")).drop("_copy")
        else:
            raise ValueError(s.op)
        cur[s.table] = df
        manifest.append((batch_id, s.anomaly_id, s.table, key, str(tkey), f"{s.table}.{key}={tkey}"))
    mf = spark.createDataFrame(manifest, "batch_id string, anomaly_id string, table string, column string, "
                                         "target_value string, target string")
    return cur, mf


def verify(tables: dict[str, DataFrame], specs: list[Injection]) -> DataFrame:
    """Check every injection is present: one aggregate per table, one flag per spec."""
    res = None
    for t in sorted({s.table for s in specs}):
        key, name = KEYS[t]
        df = tables[t]
        flags = []
        for s in specs:
            if s.table != t:
                continue
            if s.op == "set_null":
                e = F.count_if(F.col(s.column).isNull()) > 0
            elif s.op == "set_value":
                e = F.count_if(F.col(s.column) == F.lit(s.value)) > 0
            else:
                e = F.count_if(F.col(key).isNotNull()) > F.count_distinct(F.col(key))
            flags.append(F.struct(F.lit(s.anomaly_id).alias("anomaly_id"), e.alias("present")))
        one = df.agg(F.array(*flags).alias("f")).select(F.explode("f").alias("x")).select("x.*")
        res = one if res is None else res.unionByName(one)
    return res


def to_sql(specs: list[Injection], base: dict[str, str], prefix: str) -> tuple[list[str], dict[str, str]]:
    """The same fold as SQL CTEs (oracle form); returns CTE texts and final names per table."""
    ctes, cur, n = [], dict(base), 0
    for s in specs:
        key, name = KEYS[s.table]
        clean = base[s.table]
        order = ", ".join([key] + ([name] if name else []))
        tkey = f"(SELECT {key} FROM {clean} WHERE {key} IS NOT NULL ORDER BY {order} LIMIT 1 OFFSET {s.position})"
        prev = cur[s.table]
        n += 1
        nm = f"{prefix}_{s.table}_{n}"
        if s.op in ("set_null", "set_value"):
            v = "NULL" if s.op == "set_null" else "'" + s.value + "'"
            sql = f"SELECT * REPLACE (CASE WHEN {key} = {tkey} THEN {v} ELSE {s.column} END AS {s.column}) FROM {prev}"
        elif s.op == "insert_renamed":
            tname = (f"(SELECT {name} FROM {clean} WHERE {key} IS NOT NULL ORDER BY {order} "
                     f"LIMIT 1 OFFSET {s.position})")
            sql = f"SELECT * FROM {prev} UNION ALL SELECT {tkey} AS {key}, {tname} || '{s.value}' AS {name}"
        else:
            sql = f"SELECT * FROM {prev} UNION ALL SELECT * FROM {prev} WHERE {key} = {tkey}"
        ctes.append(f"{nm} AS ({sql})")
        cur[s.table] = nm
    return ctes, cur
