"""Merkle manifest against a plain tree."""

import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from matchlake.llm.merkle import fold, manifest, op11_merkle, proof_digest

SCHEMA = "doc_id bigint, source string, lang string, n_chars int, text string, Root string"
LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))


def plain_tree(leaves, fanout):
    """(root, [(siblings left, right) per level] per leaf)"""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for p, i in zip(proofs, at, strict=True):
            first = i - i % fanout
            p.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + fanout])))
        nodes = [h("".join(nodes[i:i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], proofs


def brute(rows, fanout):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(((r[0] is not None, r[0]), leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort()
        trees[g] = plain_tree([x for _, x in groups[g]], fanout)
    root, tops = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops, strict=True):
        for ((_, i), x), p in zip(groups[g], trees[g][1], strict=True):
            out.append((i, g, x, trees[g][0], root, [tuple(s) for s in p + top]))
    return sorted(out, key=str)


def rows():
    r = [(i * 3 % 101, f"s{i % 3}", "en", i, f"Text {i} É", None) for i in range(101)]
    r += [(1000 + i, None, None, None, None, "clash") for i in range(9)]
    r += [(2000, "s", "de", 1, "", "x"), (None, "s", "de", 1, "a", "x"), (None, None, "de", 1, "b", "x")]
    r += [(7, "same", "fr", 1, "same", None)] * 20          # repeated rows
    r += [(8, "s", "fr", k, "tie", None) for k in range(5)]  # equal identifiers
    r += [(5, "s", "sl", 1, "Ω" * 200_000, None), (6, "s", "Zz", 1, ":-1:", None), (6, "s", "", 1, "-", None)]
    return r


def test_equals_plain_tree_for_many_blocks_and_rounds(spark):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    for fanout, levels in ((8, 4), (3, 1), (2, 2)):
        made = manifest(df, leaf_cols=LEAF, carry={"probe": F.upper("text"), "ROOT": F.col("text")}, fanout=fanout, levels=levels)
        assert made.columns == ["doc_id", "lang", "position", "leaf", "subroot", "root", "proof", "probe"]
        res = made.withColumn("folded", fold(F.col("leaf"), F.col("proof"))).withColumn("digest", proof_digest(F.col("proof"))).collect()
        got = sorted([(x.doc_id, x.lang, x.leaf, x.subroot, x.root, [tuple(s) for s in x.proof]) for x in res], key=str)
        assert got == brute(data, fanout)
        assert all(x.folded == x.root for x in res)
        assert all(x.digest == h("".join(s.left + s.right for s in x.proof)) for x in res)
        assert sorted(x.position for x in res if x.lang == "en") == list(range(101))


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    made = manifest(df, leaf_cols=LEAF, fanout=2, levels=2)
    assert made.filter(fold(F.sha2(F.col("leaf"), 256), F.col("proof")) == F.col("root")).isEmpty()


def test_empty_and_single(spark):
    assert manifest(spark.createDataFrame([], SCHEMA), leaf_cols=LEAF).count() == 0
    one = manifest(spark.createDataFrame(rows()[:1], SCHEMA), leaf_cols=LEAF).collect()
    assert one[0].leaf == one[0].subroot == one[0].root and one[0].proof == []


def test_no_python_and_no_leaf_group_in_one_task(spark):
    plan = manifest(spark.createDataFrame(rows(), SCHEMA), leaf_cols=LEAF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "Window" not in plan


def test_query_verifies_all_but_tampered_documents(spark):
    import zlib
    res = op11_merkle(spark, "/root/testdata/sf0.001").collect()
    assert len(res) == 200 and len({x.root for x in res}) == 1
    assert all(x.verified for x in res if zlib.crc32(str(x.doc_id).encode()) % 3)
    assert not all(x.verified for x in res)
