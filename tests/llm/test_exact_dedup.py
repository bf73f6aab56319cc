"""Exact dedup against a brute-force grouping."""

import hashlib
from collections import defaultdict

from matchlake.llm.common import AZ
from matchlake.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id bigint, text string, KEPT string, lang string"


def brute(rows, largest):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(AZ)].append(i)
    out = []
    for norm, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if largest else min)(known) if known else None
        for i in ids:
            out.append((i, best, len(ids), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    r = [(i, f"Text {i % 7} É{'x' * (i % 3)}", "clash", None) for i in range(40)]
    r += [(100 + i, "HOT Text É " + "body " * 50, None, "en") for i in range(200)]
    r += [(400 + i, "hot tEXT É " + "body " * 50, None, "en") for i in range(100)]
    r += [(500 + i, "hot text é " + "body " * 50, None, "en") for i in range(60)]  # É and é differ
    r += [(None, "x", None, None), (None, "X", None, None), (1, None, None, None), (2, "", None, None),
          (900, "same", None, None), (900, "same", None, None), (901, "Ω" * 30000, None, None), (902, "Ω" * 30000, None, None)]
    return r


def test_equals_brute_force(spark):
    data = rows()
    for keep in ("smallest", "largest"):
        got = exact_dedup(spark.createDataFrame(data, SCHEMA).repartition(6), keep=keep)
        assert got.columns == ["doc_id", "text", "lang", "keep_id", "group_size", "kept", "text_sha256"]
        res = got.collect()
        assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in res], key=str) == brute(data, keep == "largest")
        kept = defaultdict(list)
        for r in res:
            if r.kept:
                kept[r.text_sha256].append(r)
        assert set(kept) == {r.text_sha256 for r in res}
        assert all(len(v) == 1 and v[0].doc_id == v[0].keep_id for v in kept.values())


def test_empty(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_python_and_one_text_shuffle(spark):
    plan = exact_dedup(spark.createDataFrame(rows(), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "rangepartitioning" in plan
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange rangepartitioning") == 1 and "Exchange hashpartitioning" not in physical
