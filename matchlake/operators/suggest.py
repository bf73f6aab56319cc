"""Rule suggestion from data (the rule-generation step re-aimed at statistics).

Conservative, restricted to the four rule kinds, never inventing columns:

* ``not_null``        the column has no NULL;
* ``unique``          integral/text column without duplicate non-NULL values;
* ``accepted_values`` text column with at most ``max_values`` distinct values (the list);
* ``relationships``   integral column whose name ends with the (prefix-stripped) name of
                      a unique column of another table, and every value has a parent.

Every candidate is decided exactly by a fused Spark job; no estimate takes part. Only the
per-column counts and the value lists (at most ``max_values + 1`` each) reach the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import Rule, _relationship_rules, _unique_rules

INTEGRAL = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)


def _kind(dt) -> str:
    if isinstance(dt, INTEGRAL):
        return "int"
    if isinstance(dt, T.StringType):
        return "string"
    return "other"


def base_name(col: str) -> str:
    """``o_orderkey`` → ``orderkey`` (single-letter table prefix dropped)."""
    return re.sub(r"^[a-z]_", "", col)


def _stats_frame(model: str, df: DataFrame) -> DataFrame:
    """(model, column, rows, nulls) from one aggregate over the table."""
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        exprs.append(F.count_if(F.col(c).isNull()).alias(f"n{i}"))
    one = df.agg(*exprs)
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("nulls")) for i, c in enumerate(df.columns)])
    return one.select(F.lit(model).alias("model"), "rows", F.explode(per).alias("x")).select(
        "model", "x.column", "rows", "x.nulls")


def _union(parts):
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def suggest(models: dict[str, DataFrame], max_values: int = 10) -> list[Rule]:
    """Suggested rules, in (table, column, kind) order. Four Spark jobs in total — table
    statistics, unique confirmation, value lists, containment — each a union over all
    tables, so independent tables are scanned in parallel."""
    prof: dict[str, dict] = {m: {"rows": 0, "cols": {}} for m in models}
    for r in _union([_stats_frame(m, df) for m, df in models.items()]).collect():
        prof[r["model"]]["rows"] = r["rows"]
        prof[r["model"]]["cols"][r["column"]] = r["nulls"]
    kinds = {m: {f.name: _kind(f.dataType) for f in df.schema.fields} for m, df in models.items()}

    # unique: exact, all candidate columns of a table in one grouped count
    cands: dict[int, Rule] = {}
    checks = []
    for m, df in models.items():
        p, rows = prof[m], prof[m]["rows"]
        items = []
        for c in df.columns:
            if kinds[m][c] != "other" and rows > p["cols"][c]:
                i = len(cands)
                cands[i] = Rule.make(m, c, "unique")
                items.append((i, cands[i]))
        u = _unique_rules(df, items)
        if u is not None:
            checks.append(u.select("rule_id"))
    dup = {r["rule_id"] for r in _union(checks).collect()} if checks else set()
    unique_ok: dict[str, set[str]] = {m: set() for m in models}
    for i, r in cands.items():
        if i not in dup:
            unique_ok[r.model].add(r.column)

    # accepted values: exact value lists for low-cardinality text columns (bounded)
    vparts = []
    for m, df in models.items():
        low = [c for c in df.columns if kinds[m][c] == "string" and prof[m]["rows"] > prof[m]["cols"][c]]
        if low:
            arr = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in low])
            vparts.append(df.select(F.explode(arr).alias("x")).select(F.lit(m).alias("m"), "x.c", "x.v")
                          .filter(F.col("v").isNotNull()).distinct())
    values: dict[tuple[str, str], list] = {}
    if vparts:
        seen = _union(vparts)
        few = seen.groupBy("m", "c").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= max_values)
        lists = seen.join(few, ["m", "c"]).groupBy("m", "c").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        values = {(r["m"], r["c"]): list(r["vs"]) for r in lists.collect()}

    # relationships: name-suffix candidates, exact containment (one anti join per parent)
    rel: list[tuple[str, str, str, str]] = []
    for m, df in models.items():
        for c in df.columns:
            if kinds[m][c] != "int":
                continue
            for pm, pdf in models.items():
                if pm == m:
                    continue
                for pc in sorted(unique_ok[pm]):
                    if kinds[pm][pc] == "int" and base_name(c).endswith(base_name(pc)):
                        rel.append((m, c, pm, pc))
    by_parent: dict[tuple[str, str, str], list] = {}
    for i, (m, c, pm, pc) in enumerate(rel):
        by_parent.setdefault((m, pm, pc), []).append((i, Rule.make(m, c, "relationships", to=pm, field=pc)))
    rparts = [_relationship_rules(models[m], models[pm], pc, items).select("rule_id")
              for (m, pm, pc), items in by_parent.items()]
    bad = {r["rule_id"] for r in _union(rparts).collect()} if rparts else set()
    rel_ok = {i for i in range(len(rel)) if i not in bad}

    out: list[Rule] = []
    for m, df in models.items():
        p = prof[m]
        for c in df.columns:
            if p["rows"] > 0 and p["cols"][c] == 0:
                out.append(Rule.make(m, c, "not_null"))
            if c in unique_ok[m]:
                out.append(Rule.make(m, c, "unique"))
            if (m, c) in values:
                out.append(Rule.make(m, c, "accepted_values", values=values[(m, c)]))
            for i, (rm, rc, pm, pc) in enumerate(rel):
                if rm == m and rc == c and i in rel_ok:
                    out.append(Rule.make(m, c, "relationships", to=pm, field=pc))
    return out
