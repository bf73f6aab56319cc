from matchlake.operators.quality import Rule, evaluate


def _res(spark, rules, models):
    return {(r.model, r.column, r.test): (r.status, r.failures, r.failing_rows)
            for r in evaluate(spark, rules, models).collect()}


def test_four_rule_kinds(spark):
    child = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (2, None, 11), (None, "zz", 12), (3, "zz", None),
                                   (4, "yy", 99)], "id int, s string, p int")
    parent = spark.createDataFrame([(10,), (11,), (12,), (None,)], "k int")
    rules = [Rule.make("c", "id", "not_null"), Rule.make("c", "id", "unique"), Rule.make("c", "s", "unique"),
             Rule.make("c", "s", "accepted_values", values=["a", "b"]),
             Rule.make("c", "p", "relationships", to="par", field="k"),
             Rule.make("c", "nope", "not_null"), Rule.make("missing", "x", "unique")]
    r = _res(spark, rules, {"c": child, "par": parent})
    assert r[("c", "id", "not_null")] == ("fail", 1, 1)
    assert r[("c", "id", "unique")] == ("fail", 1, 2)        # one duplicated key (2), two rows
    assert r[("c", "s", "unique")] == ("fail", 1, 2)         # zz twice; NULL ignored
    assert r[("c", "s", "accepted_values")] == ("fail", 2, 3)  # distinct bad values zz, yy; 3 rows
    assert r[("c", "p", "relationships")] == ("fail", 1, 1)  # 99 has no parent; NULL child ignored
    assert r[("c", "nope", "not_null")][0] == "error"
    assert r[("missing", "x", "unique")] == ("error", None, None)


def test_accepted_values_null_not_counted(spark):
    # one NULL and one bad status -> 1 failure (the NULL is for not_null)
    df = spark.createDataFrame([("Match Finished",), (None,), ("BROKEN_STATUS",)], "match_status string")
    r = _res(spark, [Rule.make("f", "match_status", "accepted_values", values=["Match Finished"])], {"f": df})
    assert r[("f", "match_status", "accepted_values")] == ("fail", 1, 1)


def test_pass_and_empty(spark):
    df = spark.createDataFrame([], "id int")
    r = _res(spark, [Rule.make("t", "id", "unique"), Rule.make("t", "id", "not_null")], {"t": df})
    assert r[("t", "id", "unique")] == ("pass", 0, 0)
    assert r[("t", "id", "not_null")] == ("pass", 0, 0)


def test_rule_names_and_keys():
    r = Rule.make("fct_matches", "match_status", "accepted_values", values=["Match Finished", "In Progress"])
    assert r.name == "accepted_values_fct_matches_match_status__Match_Finished__In_Progress"
    rel = Rule.make("fct_matches", "home_team_id", "relationships", to="dim_teams", field="team_id")
    assert rel.name == "relationships_fct_matches_home_team_id__team_id__ref_dim_teams_"
    assert Rule.make("m", "c", "unique").key == "m|c|unique|{}"


def test_suite_flattening_both_argument_spellings():
    from matchlake.plans.suites import flatten_tree, suite_rules
    assert len(suite_rules("manual_only")) == 4
    assert len(suite_rules("manual_expanded")) == 29
    assert len(suite_rules("manual_plus_llm")) == 16
    a = flatten_tree({"m": {"c": [{"accepted_values": {"values": ["x"]}}]}})
    b = flatten_tree({"m": {"c": [{"accepted_values": {"arguments": {"values": ["x"]}}}]}})
    assert a == b
    assert flatten_tree({"m": {"c": [{"relationships": {"arguments": {"to": "ref('p')", "field": "k"}}}]}})[0].arg("to") == "p"
    assert flatten_tree({"m": "bad", "n": {"c": [{"a": 1, "b": 2}, "not_null"]}}) == [flatten_tree({"n": {"c": ["not_null"]}})[0]]


def test_bad_arguments_mark_their_rule_and_the_rest_runs(spark):
    from matchlake.operators.quality import Rule, evaluate
    child = spark.createDataFrame([(3000000000, "abc", 1), (1, "1", 2), (2, None, 3)], "big bigint, txt string, n int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    rules = [Rule.make("c", "big", "relationships", to="p", field="id"), Rule.make("c", "txt", "relationships", to="p", field="id"),
             Rule.make("c", "n", "accepted_values", values=["a", "b"]), Rule.make("c", "n", "accepted_values"),
             Rule.make("c", "n", "accepted_values", values=["1", 2]), Rule.make("c", "n", "unique")]
    got = {r.rule_id: (r.status, r.failures) for r in evaluate(spark, rules, {"c": child, "p": parent}).collect()}
    assert got == {0: ("fail", 1), 1: ("fail", 1), 2: ("error", None), 3: ("error", None), 4: ("fail", 1), 5: ("pass", 0)}


def test_every_unique_column_is_found(spark):
    from pyspark.sql import functions as F

    from matchlake.operators.suggest import suggest
    df = spark.range(20_000).select(*[(F.col("id") * (i + 3) + i).alias(f"c{i}") for i in range(200)])
    assert sum(r.test == "unique" for r in suggest({"t": df})) == 200


def test_relationships_compare_numbers_exactly(spark):
    from matchlake.operators.quality import Rule, evaluate
    parent = spark.sql("SELECT CAST(x AS DECIMAL(38,18)) d, CAST(x AS DOUBLE) f, CAST(x AS BIGINT) i FROM VALUES "
                       "(1.0), (0.1), (9007199254740992), (100000000000000000000), (-2.5) t(x) WHERE x < 1e18").unionByName(
        spark.sql("SELECT CAST(NULL AS DECIMAL(38,18)) d, 1e20D f, CAST(NULL AS BIGINT) i"))
    child = spark.sql("SELECT CAST(d AS DECIMAL(38,18)) dec, CAST(i AS BIGINT) int, CAST(f AS DOUBLE) dbl, s FROM VALUES "
                      "(1.000000000004, 9007199254740993, 0.1D, '1.000000000004'), (1, 9007199254740992, 1e20D, '01.0'), "
                      "(0.1, 1, 0.30000000000000004D, ' 9007199254740993 '), (-2.5, NULL, -2.5D, '-2.50'), (NULL, 0, 1e-25D, 'x'), "
                      "(0.3, 2, NULL, '1e0'), (-0.0, 1, 1.0D, '+1') t(d, i, f, s)")
    rules = [Rule.make("c", c, "relationships", to="p", field=f) for c in ("dec", "int", "dbl", "s") for f in ("d", "f", "i")]
    got = {(r.column, r.args): r.failures for r in evaluate(spark, rules, {"c": child, "p": parent}).collect()}
    want = {"dec": (3, 3, 4), "int": (3, 3, 2), "dbl": (3, 2, 5), "s": (3, 3, 4)}
    for c, (d, f, i) in want.items():
        assert [got[(c, '{"field": "%s", "to": "p"}' % x)] for x in "dfi"] == [d, f, i], (c, got)
