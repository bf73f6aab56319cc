import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.functions.exprs import first_path, iso_date, ratio, to_timestamp_ntz, tolerant_equal
from matchlake.operators.quality import Rule, describe, validate
from matchlake.sources.files import json_reports, write_report


def test_validate_rules(spark):
    m = {"t": spark.createDataFrame([(1, "a")], "id int, s string"), "p": spark.createDataFrame([(1,)], "k int")}
    rules = [Rule.make("t", "id", "not_null"), Rule.make("t", "zz", "unique"), Rule.make("x", "id", "unique"),
             Rule.make("t", "s", "accepted_values"), Rule.make("t", "id", "relationships", to="p", field="k"),
             Rule.make("t", "id", "relationships", to="p", field="nope"), Rule.make("t", "id", "frobnicate")]
    v = [(r.valid, r.reason) for r in validate(spark, rules, m).orderBy("rule_id").collect()]
    assert [x[0] for x in v] == [True, False, False, False, True, False, False]
    assert v[1][1] == "unknown column t.zz" and v[6][1] == "unknown test frobnicate"


def test_describe(spark):
    cols, sample = describe(spark.range(10).withColumn("s", F.lit("x")), "t")
    assert [(r.column, r.type) for r in cols.collect()] == [("id", "bigint"), ("s", "string")]
    assert sample.count() == 3


def test_expressions(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}, "c": 2}', "2024-01-02", 1.0, 1.0005, 3, 0),
                                ('{"c": 5}', "bad", None, None, 1, 4)],
                               "js string, d string, x double, y double, n int, m int")
    r = df.select(first_path(F.col("js"), ["$.a.b", "$.c"]).alias("v"), iso_date(F.col("d")).alias("d"),
                  tolerant_equal(F.col("x"), F.col("y"), 0.0011).alias("eq"),
                  ratio(F.col("m"), F.col("n")).alias("r")).collect()
    assert [(x.v, x.d, x.eq, x.r) for x in r] == [("1", "2024-01-02", True, 0.0), ("5", None, True, 4.0)]
    z = spark.createDataFrame([(1, 0)], "a int, b int").select(ratio(F.col("a"), F.col("b")).alias("r")).first()
    assert z.r is None
    import datetime as dt
    ts = spark.createDataFrame([(dt.date(2024, 1, 2),)], "d date").select(to_timestamp_ntz(F.col("d")).alias("t"))
    assert ts.schema["t"].dataType.simpleString() == "timestamp_ntz" and ts.first().t == dt.datetime(2024, 1, 2)


def test_json_reports_skip_corrupt_and_missing(spark, tmp_path):
    p = tmp_path / "rep"
    p.mkdir()
    (p / "a.json").write_text(json.dumps({"stage_name": "build", "duration_seconds": 2.04}) + "\n{broken\n")
    schema = T.StructType([T.StructField("stage_name", T.StringType()), T.StructField("duration_seconds", T.DoubleType())])
    rows = json_reports(spark, str(p), schema).collect()
    assert [(r.stage_name, r.duration_seconds) for r in rows] == [("build", 2.04)]
    assert json_reports(spark, str(tmp_path / "missing"), schema).count() == 0


def test_write_reports(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    write_report(df, str(tmp_path / "csv"), "csv")
    write_report(df, str(tmp_path / "js"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().k == "a"
    assert spark.read.json(str(tmp_path / "js")).first().v == 1


def test_model_persistence(spark, tmp_path):
    from matchlake.operators import ml
    rows = [(float(i % 3), float(i % 2), float(i % 5), float(i % 4), ["HOME_WIN", "AWAY_WIN", "DRAW"][i % 3])
            for i in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in ml.FEATURES) + ", match_result string")
    model, _ = ml.train_evaluate(df, num_trees=5)
    ml.save(model, str(tmp_path / "m"))
    again = ml.load(str(tmp_path / "m"))
    a = ml.class_probabilities(model, df.drop("match_result")).select("p_home_win").collect()
    b = ml.class_probabilities(again, df.drop("match_result")).select("p_home_win").collect()
    assert a == b


def test_only_a_local_master_may_do_without_a_shared_folder():
    import pytest

    from matchlake import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(Session())
