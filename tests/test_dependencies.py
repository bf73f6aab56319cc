"""Inclusion dependencies and composite keys against plain loops."""

import itertools
import json

from pyspark.sql import functions as F

from matchlake.operators import dependencies as D
from matchlake.operators import quality


def frames(spark):
    orders = spark.createDataFrame([(i, f"c{i % 4}", float(i % 3), None) for i in range(20)], "id bigint, customer string, weight double, empty string")
    lines = spark.createDataFrame([(i % 20, i % 3, f"c{i % 2}", i % 3) for i in range(60)] + [(None, 9, None, None)],
                                  "whose int, no int, name string, w smallint")
    other = spark.createDataFrame([("c0", 0.0), ("c1", 1.0), ("c2", 2.5), ("c3", 19.0)], "client string, x decimal(5,2)".replace("decimal(5,2)", "double"))
    return {"orders": orders, "lines": lines, "other": other}


def brute(models):
    values, unique = {}, {}
    for m, df in models.items():
        for f in df.schema.fields:
            got = [r[0] for r in df.select(f.name).collect() if r[0] is not None]
            if got:
                kind = "text" if isinstance(got[0], str) else "number"
                values[(m, f.name)] = {(kind, v) for v in got}
                unique[(m, f.name)] = len(set(got)) == len(got)
    return {(*a, *b, len(values[a]), len(values[b]), unique[b]) for a, b in itertools.permutations(values, 2) if values[a] <= values[b]}


def test_inclusion_dependencies_equal_a_plain_loop(spark, monkeypatch):
    models = frames(spark)
    want = brute(models)
    assert ("lines", "whose", "orders", "id", 20, 20, True) in want and ("orders", "customer", "other", "client", 4, 4, True) in want
    for word in (62, 3):                     # one word of bits, several
        monkeypatch.setattr(D, "WORD", word)
        assert {tuple(r) for r in D.inclusion_dependencies(models).collect()} == want


def test_references_are_rules_that_hold(spark):
    models = frames(spark)
    rules = [quality.Rule.make(r.model, r.column, r.test, **json.loads(r.args)) for r in D.references(models).collect()]
    assert {(r.model, r.column, r.arg("to"), r.arg("field")) for r in rules} >= {("lines", "whose", "orders", "id"), ("lines", "name", "other", "client")}
    assert all(r.args_json == x.args for r, x in zip(rules, D.references(models).collect(), strict=False) if r.args_json)
    assert all(x.status == "pass" for x in quality.evaluate(spark, rules, models).collect())


def test_composite_keys(spark):
    lines = spark.createDataFrame([(i // 3, i % 3, i % 2, f"t{i}" if i else None, 1) for i in range(12)], "o int, n int, p int, t string, one int")
    rows = [r.asDict() for r in lines.collect()]
    want = set()
    for size in (1, 2, 3):
        for s in itertools.combinations(lines.columns, size):
            seen = [tuple(r[c] for c in s) for r in rows if all(r[c] is not None for c in s)]
            if len(set(seen)) == len(seen) and not any(set(json.loads(k)) <= set(s) for k in want):
                want.add(json.dumps(list(s)))
    assert {r.columns for r in D.composite_keys("lines", lines).collect()} == want and json.dumps(["o", "n"]) in want
    assert D.composite_keys("lines", lines.limit(0)).count() == 0


def test_composite_keys_whatever_the_hashes(spark, monkeypatch):
    lines = spark.createDataFrame([(i // 3, i % 3, i % 2, f"t{i}" if i else None, None) for i in range(12)] + [(None, 1, 0, "t1", None)],
                                  "o int, n int, p int, t string, never int")
    want = {json.dumps(s) for s in (["o", "n"], ["o", "t"], ["p", "t"])}
    real = D._hash
    # as they are, all in the slice, none in the slice and all alike
    for fake in (real, lambda *v: F.lit(0).cast("bigint"), lambda *v: F.lit(1).cast("bigint"), lambda *v: F.pmod(real(*v), F.lit(3)) + 1):
        monkeypatch.setattr(D, "_hash", fake)
        assert {r.columns for r in D.composite_keys("lines", lines).collect()} == want


def test_composite_keys_shuffle_hashes_not_values(spark, monkeypatch):
    lines = spark.createDataFrame([(i // 3, i % 3) for i in range(300)], "o int, n int")
    whole, real = [], D._most
    monkeypatch.setattr(D, "_most", lambda df, cells: whole.append([df.select(c).schema[0].dataType.simpleString() for c in cells.values()]) or real(df, cells))
    assert [r.columns for r in D.composite_keys("lines", lines).collect()] == [json.dumps(["o", "n"])]
    assert whole[1] == ["bigint", "bigint"] and ["bigint"] in whole
