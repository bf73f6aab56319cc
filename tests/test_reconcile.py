from matchlake.operators import reconcile as R

COLS = ["k", "name", "x"]


def _side(spark, rows):
    df = spark.createDataFrame(rows, "k int, name string, x double")
    return R.normalise(df, COLS, ["x"])


def test_all_comparison_cases(spark):
    left = _side(spark, [(1, "a", 1.0),        # equal
                         (2, "b", 2.0),        # within tolerance
                         (3, "c", 3.0),        # outside tolerance
                         (4, "d", 4.0),        # one side NULL
                         (5, "e", 5.0),        # missing on the right
                         (7, "g", 7.0), (7, "g", 7.0),   # duplicate key, both sides
                         (None, "n", 0.0)])    # NULL key, both sides
    right = _side(spark, [(1, "a", 1.0), (2, "b", 2.001), (3, "c", 3.01), (4, None, 4.0),
                          (6, "f", 6.0),       # extra on the right
                          (7, "g", 7.0), (7, "g", 7.0), (None, "n", 0.0)])
    d = {(r.k, r.side): sorted(r.diff_columns) for r in R.diff(left, right, "k", COLS, ["x"]).collect()}
    assert d == {("3", "both"): ["x"], ("4", "both"): ["name"], ("5", "left_only"): [], ("6", "right_only"): []}
    cells = {(r.k, r.column): (r.left_value, r.right_value) for r in R.cell_diffs(left, right, "k", COLS, ["x"]).collect()}
    assert cells == {("3", "x"): ("3.0", "3.01"), ("4", "name"): ("d", None)}
    s = R.summary("t", left, right, "k", COLS, ["x"]).first()
    assert (s.left_rows, s.right_rows, s.row_diff, s.mismatched_rows, s.left_only_rows, s.right_only_rows) == \
        (8, 8, 0, 2, 1, 1)
    assert not s.checksum_match and s.status_strict == "MISMATCH" and s.status_tolerant == "MISMATCH"


def test_duplicate_rows_unbalanced(spark):
    left = _side(spark, [(7, "g", 7.0)] * 3)
    right = _side(spark, [(7, "g", 7.0)] * 2)
    d = R.diff(left, right, "k", COLS, ["x"]).collect()
    assert [(r.k, r.side) for r in d] == [("7", "left_only")]


def test_identical_tables_match_in_both_modes(spark):
    rows = [(i, f"n{i}", i / 3) for i in range(50)]
    left, right = _side(spark, rows), _side(spark, list(reversed(rows)))
    s = R.summary("t", left, right, "k", COLS, ["x"]).first()
    assert s.checksum_match and s.status_strict == "MATCH" and s.status_tolerant == "MATCH"
    o = R.overall(R.summary("t", left, right, "k", COLS, ["x"])).first()
    assert (o.compared, o.match_count, o.status) == (1, 1, "success")


def test_tolerance_only_difference_is_strict_mismatch_but_tolerant_match(spark):
    left = _side(spark, [(1, "a", 1.0)])
    right = _side(spark, [(1, "a", 1.001)])
    s = R.summary("t", left, right, "k", COLS, ["x"]).first()
    assert s.status_strict == "MISMATCH" and s.status_tolerant == "MATCH"


def test_null_profile_and_counts(spark):
    left = _side(spark, [(1, None, 1.0), (2, None, None)])
    right = _side(spark, [(1, None, 1.0)])
    n = {r.column: (r.left_nulls, r.right_nulls, r.match) for r in R.null_compare(left, right, COLS).collect()}
    assert n == {"k": (0, 0, True), "name": (2, 1, False), "x": (1, 0, False)}
    c = R.counts(left, right).first()
    assert (c.left_rows, c.right_rows, c.row_diff) == (2, 1, -1)


def test_migrated_copy_normalises_names_and_dates(spark):
    import datetime as dt

    from matchlake.plans.recon import migrated
    df = spark.createDataFrame([(1, dt.date(2024, 1, 2))], "id int, d date")
    m = migrated(df)
    assert m.columns == ["ID", "D"]
    a, b = R.normalise(df, ["id", "d"]), R.normalise(m, ["id", "d"])
    assert a.collect() == b.collect()


def test_expand_in_blocks_numbers_occurrences(spark):
    g = spark.createDataFrame([(False, "k", 10, ("b",)), (False, "k", 2, ("a",)), (False, "z", 1, ("a",))],
                              "_kn boolean, _kv string, _n long, _row struct<x:string>")
    out = sorted((r._kv, r._row.x, r._occ) for r in R._expand(g, ["x"], block=3).collect())
    assert out == [("k", "a", 1), ("k", "a", 2)] + [("k", "b", i) for i in range(3, 13)] + [("z", "a", 1)]


def _both(spark, schema, left, right, numeric=()):
    cols = [f.split()[0] for f in schema.split(", ")]
    a, b = (R.normalise(spark.createDataFrame(x, schema), cols, list(numeric)) for x in (left, right))
    return a, b, cols


def test_null_in_a_tolerance_column(spark):
    a, b, cols = _both(spark, "k int, x double", [(1, None), (2, None), (3, 1.0)], [(1, None), (2, 5.0), (3, None)], ["x"])
    assert {r.k: r.diff_columns for r in R.diff(a, b, "k", cols, ["x"]).collect()} == {"2": ["x"], "3": ["x"]}
    assert {(r.k, r.left_value, r.right_value) for r in R.cell_diffs(a, b, "k", cols, ["x"]).collect()} == {
        ("2", None, "5.0"), ("3", "1.0", None)}


def test_texts_that_look_alike_differ(spark):
    for x, y in ((("a|b", "c"), ("a", "b|c")), (("\\N", "c"), (None, "c")), (('a","b', "c"), ("a", 'b","c')), (("", "c"), (None, "c"))):
        a, b, cols = _both(spark, "k int, p string, q string", [(1, *x)], [(1, *y)])
        s = R.summary("t", a, b, "k", cols).first()
        assert not s.checksum_match and s.status_strict == "MISMATCH" and s.status_tolerant == "MISMATCH"


def test_nothing_is_cut_or_rounded(spark):
    import datetime as dt
    from decimal import Decimal
    t = dt.datetime(2024, 1, 1, 0, 0, 0)
    cases = [("timestamp", t, t.replace(microsecond=900_000)), ("double", 1.0, 1.00003), ("double", 1e15, 1e15 + 1),
             ("decimal(38,20)", Decimal("1.00000000000000000001"), Decimal("1.00000000000000000002"))]
    for kind, x, y in cases:
        cols = ["k", "v"]
        a, b = (R.normalise(spark.createDataFrame([(1, v)], f"k int, v {kind}"), cols) for v in (x, y))
        assert R.summary("t", a, b, "k", cols).first().status_strict == "MISMATCH"
        assert R.summary("t", a, a, "k", cols).first().status_strict == "MATCH"
    a, b, cols = _both(spark, "k int, x double", [(1, float("nan")), (2, 0.0), (3, 1e300)], [(1, float("nan")), (2, -0.0), (3, 1e300)], ["x"])
    assert R.summary("t", a, b, "k", cols, ["x"]).first().status_strict == "MATCH"


def test_nested_values_and_json_text(spark):
    left = spark.sql("""SELECT 1 k, named_struct('b', 1, 'a', CAST(NULL AS INT)) s, array(1, 2) l, '{"x": 1, "a": [1,2]}' j, '[no json' t""")
    right = spark.sql("""SELECT 1 K, named_struct('a', CAST(NULL AS INT), 'b', 1) S, array(1, 2) L, '{"a":[1, 2],"x":1}' J, '[no json' T""")
    cols = ["k", "s", "l", "j", "t"]
    a, b = R.normalise(left, cols), R.normalise(right, cols)
    assert R.summary("t", a, b, "k", cols).first().status_strict == "MATCH"
    assert a.first().t == "[no json"


def test_hot_key_left_overs_are_numbered_once(spark):
    n = 3000
    a, b, cols = _both(spark, "k int, name string", [(None, f"l{i}") for i in range(n)], [(None, f"r{i}") for i in range(n - 5)])
    p = R.paired(a, b, "k", cols)
    rows = p.select("occ", "side").collect()
    assert sorted(r.occ for r in rows) == list(range(1, n + 1))
    assert sum(r.side == "left_only" for r in rows) == 5 and sum(r.side == "both" for r in rows) == n - 5


def test_nested_values_and_long_numbers_lose_nothing(spark):
    def side(ts, dec, js, d, big, raw):
        df = spark.sql(f"SELECT 1 k, named_struct('t', TIMESTAMP_NTZ '{ts}', 'n', CAST({dec} AS DECIMAL(38,20)), 'a', array(map('x', DATE '2024-01-02')), "
                       f"'s', 'q\"]', 'e', CAST(NULL AS INT)) v, '{js}' j, CAST({d} AS DECIMAL(38,18)) x, {big} y, X'{raw}' b")
        return R.normalise(df, ["k", "v", "j", "x", "y", "b"], ["x", "y"])
    base = ("2024-01-01 00:00:00.000001", "0.12345678901234567890", '{"a": 1.5, "b": [1, 2]}', "1.000000000000000001", "9007199254740993L", "FF00")
    same = ("2024-01-01 00:00:00.000001", "0.12345678901234567890", '{"b":[1,2],"a":1.5}', "1.000000000000000001", "9007199254740993L", "FF00")
    cols = ["k", "v", "j", "x", "y", "b"]
    s = R.summary("t", side(*base), side(*same), "k", cols, ["x", "y"]).first()
    assert s.status_strict == "MATCH" and s.checksum_match
    long = "1." + "1" * 50
    changes = [(0, "2024-01-01 00:00:00.000002", False), (1, "0.12345678901234567891", False), (2, '{"a": 1.6, "b": [1, 2]}', False),
               (3, "1.000000000000000002", True), (4, "9007199254740992L", True), (5, "FF01", False)]     # x and y have a tolerance
    for at, value, close in changes:
        other = [*base[:at], value, *base[at + 1:]]
        s = R.summary("t", side(*base), side(*other), "k", cols, ["x", "y"]).first()
        lc, rc = (R.checksum(side(*x), cols).first().checksum for x in (base, other))
        assert s.status_strict == "MISMATCH" and not s.checksum_match and lc != rc, at
        assert s.status_tolerant == ("MATCH" if close else "MISMATCH")
    for a, b in ((f'{{"n": {long}1}}', f'{{"n": {long}2}}'), ('{"n": 1.00000000000000000001e0}', '{"n": 1e0}')):
        l, r = ([*base[:2], x, *base[3:]] for x in (a, b))
        assert R.summary("t", side(*l), side(*r), "k", cols, ["x", "y"]).first().status_tolerant == "MISMATCH"


def test_a_struct_equals_its_json_text(spark):
    df = spark.sql("SELECT 1 k, named_struct('b', 1, 'a', array('x', NULL), 'c', 1.50D) v")
    text = spark.sql("""SELECT 1 k, '{"a": ["x", null], "b": 1, "c": 1.5}' v""")
    l, r = R.normalise(df, ["k", "v"]), R.normalise(text, ["k", "v"])
    assert l.first().v == r.first().v


def test_left_overs_are_numbered_alike_by_window_and_by_ranges(spark):
    left = _side(spark, [(i % 3, f"n{i}", float(i)) for i in range(60)] + [(1, "x", 0.0)] * 5)
    right = _side(spark, [(i % 3, f"n{i}", i + 1.0) for i in range(50)])
    both = [sorted(map(str, R.paired(left, right, "k", COLS, ["x"], key_rows=n).collect())) for n in (1, 1000)]
    assert both[0] == both[1] and len(both[0]) == 65


def test_no_residue_ends_the_diff(spark):
    rows = [(1, "a", 1.0), (None, "b", 2.0)]
    left, right = _side(spark, rows), _side(spark, rows)
    assert R.diff(left, right, "k", COLS, ["x"]).count() == 0 and R.cell_diffs(left, right, "k", COLS, ["x"]).columns == \
        ["k", "occ", "column", "left_value", "right_value"]
