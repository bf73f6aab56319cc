"""Keys and references found in the data, without looking at names.

Inclusion dependencies: every column's distinct values are unpivoted to (value, column), and
one aggregation by value gives the set of columns that hold it, as bits. A column's values
are contained in another column's exactly where that column is in the set of every one of its
values: the sets are de-duplicated (there are few, whatever the number of values) and
intersected per column. Two shuffles, both combined map-side; a value that stands in every
row crosses once per task, and no pairs of columns are formed.

Composite keys: level by level, a set of columns is tried where none of its subsets is a key
already. A slice of the values (by their hash, so with all rows of a value) settles the sets in
which a value of the slice repeats. Of the others all rows are counted by 64-bit hashes: where
no hash repeats, no value does. Where one does, its rows' values are compared, and only if
hashes met by chance are all rows grouped by the values themselves. So the answer is exact and
what crosses the network is a hash per row and set that is a key or nearly one.

Values are compared as ``rule_table`` compares them: numbers by their digits whatever their
type, text, dates and flags among themselves. NULLs are no values.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..session import scratch_path
from .rule_table import DAY, FLAG, NUMBER, TEXT, WHOLE, _value, kind_of

WORD = 62      # columns per word of bits
SLICES = 64    # slices of values, of which one is looked at first
CLASS = {WHOLE: NUMBER, NUMBER: NUMBER, TEXT: TEXT, DAY: DAY, FLAG: FLAG}


def _cells(models: dict[str, DataFrame]) -> tuple[list[tuple[str, str]], DataFrame]:
    """The comparable columns, and (c, class, value, n): how often column number c holds a value."""
    names, out = [], None
    for m, df in models.items():
        cell = []
        for f in df.schema.fields:
            kind = CLASS.get(kind_of(f.dataType))
            if kind:
                cell.append(F.struct(F.lit(len(names)).alias("c"), F.lit(kind).alias("class"), _value(F.col(f"`{f.name}`"), f.dataType).alias("value")))
                names.append((m, f.name))
        if cell:
            one = (df.select(F.explode(F.array(*cell)).alias("x")).select("x.*").filter("value IS NOT NULL")
                   .groupBy("c", "class", "value").agg(F.count(F.lit(1)).alias("n")))
            out = one if out is None else out.unionByName(one)
    return names, out


def inclusion_dependencies(models: dict[str, DataFrame]) -> DataFrame:
    """(child_model, child_column, parent_model, parent_column, child_values, parent_values,
    parent_unique): all pairs of columns where every value of the child is one of the parent.

    ``parent_unique``: no value occurs twice there, so the child may reference it. Columns
    without a value are left out; a column is not reported as its own parent.
    """
    spark = next(iter(models.values())).sparkSession
    names, cells = _cells(models)
    schema = ("child_model string, child_column string, parent_model string, parent_column string, child_values bigint, "
              "parent_values bigint, parent_unique boolean")
    if cells is None:
        return spark.createDataFrame([], schema)
    path = scratch_path(spark, "column-values")
    cells.write.parquet(path)
    cells, words = spark.read.parquet(path), range(-(-len(names) // WORD))
    bit = lambda w: F.when(F.floor(F.col("c") / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("c") % WORD)).otherwise(F.lit(0).cast("bigint"))
    masks = [f"w{w}" for w in words]
    sets = (cells.groupBy("class", "value").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
            .select(*masks).distinct())
    holds = lambda i: F.call_function("getbit", F.col(f"w{i // WORD}"), F.lit(i % WORD)) == 1
    number = spark.createDataFrame([(i, m, c) for i, (m, c) in enumerate(names)], "i int, model string, column string")
    members = F.filter(F.array(*[F.when(holds(i), F.lit(i)) for i in range(len(names))]), lambda x: x.isNotNull())
    common = sets.select(F.explode(members).alias("c"), *masks).groupBy("c").agg(*[F.bit_and(w).alias(w) for w in masks])
    pairs = common.select("c", F.explode(members).alias("p")).filter("c <> p")
    stats = cells.groupBy("c").agg(F.count(F.lit(1)).alias("values"), (F.max("n") == 1).alias("unique"))
    side = lambda s: number.join(stats, number.i == stats.c).select(
        F.col("i").alias(s[0]), F.col("model").alias(f"{s}_model"), F.col("column").alias(f"{s}_column"),
        F.col("values").alias(f"{s}_values"), F.col("unique").alias(f"{s}_unique"))
    return pairs.join(side("child"), "c").join(side("parent"), "p").select(*[x.split()[0] for x in schema.split(", ")])


def references(models: dict[str, DataFrame]) -> DataFrame:
    """Relationship rules (model, column, test, args) that the data supports: every dependency on a
    unique column of another table, or of the same table under another name."""
    d = inclusion_dependencies(models).filter("parent_unique")
    q = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")
    args = F.concat(F.lit('{"field": '), q("parent_column"), F.lit(', "to": '), q("parent_model"), F.lit("}"))
    return d.select(F.col("child_model").alias("model"), F.col("child_column").alias("column"), F.lit("relationships").alias("test"), args.alias("args"))


def composite_keys(model: str, df: DataFrame, columns: list[str] | None = None, most: int = 3) -> DataFrame:
    """(model, columns, size): minimal sets of at most ``most`` columns of which no two rows share all values.

    Only rows with a value in all columns of a set count; an empty table, or a set without such a
    row, gives no key. ``columns``: in declared order, comma-joined names as a JSON list.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = [c for c in (columns or df.columns) if kind_of(types[c]) in CLASS]
    text = {c: _value(F.col(f"`{c}`"), types[c]) for c in columns}
    keys: list[tuple[int, ...]] = []
    for size in range(1, most + 1):
        tried = [s for s in itertools.combinations(range(len(columns)), size) if not any(set(k) <= set(s) for k in keys)]
        if not tried:
            break
        whole = {s: _all_set([columns[j] for j in s]) for s in tried}
        hashed = {s: _hash(*[text[columns[j]] for j in s]) for s in tried}
        value = {s: F.to_json(F.array(*[text[columns[j]] for j in s])) for s in tried}
        part = _most(df, {s: F.when(whole[s] & (F.pmod(hashed[s], F.lit(SLICES)) == 0), value[s]) for s in tried})
        tried = [s for s in tried if s not in part or part[s].n == 1]
        by_hash = _most(df, {s: F.when(whole[s], hashed[s]) for s in tried})
        again = {s: r.v for s, r in by_hash.items() if r.n > 1}
        met = _most(df, {s: F.when(whole[s] & (hashed[s] == F.lit(h)), value[s]) for s, h in again.items()})
        by_value = _most(df, {s: F.when(whole[s], value[s]) for s in again if met[s].n == 1})
        keys += [s for s in tried if s in by_hash and (by_value.get(s) or met.get(s) or by_hash[s]).n == 1]
    rows = [(model, json.dumps([columns[j] for j in k]), len(k)) for k in sorted(keys)]
    return spark.createDataFrame(rows, "model string, columns string, size int")


def _most(df: DataFrame, cells: dict[tuple[int, ...], Column]) -> dict[tuple[int, ...], Row]:
    """Of every set of ``cells`` with a value that is not NULL: how often (n) its most frequent value v occurs."""
    if not cells:
        return {}
    sets = list(cells)
    cell = [F.struct(F.lit(i).alias("s"), cells[s].alias("v")) for i, s in enumerate(sets)]
    counted = (df.select(F.explode(F.array(*cell)).alias("x")).select("x.*").filter("v IS NOT NULL")
               .groupBy("s", "v").agg(F.count(F.lit(1)).alias("n")).groupBy("s").agg(F.max(F.struct("n", "v")).alias("m")))
    return {sets[r.s]: r.m for r in counted.collect()}          # a row per set


def _hash(*values: Column) -> Column:
    return F.xxhash64(*values)


def _all_set(columns: list[str]):
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"`{c}`").isNotNull()
    return out
