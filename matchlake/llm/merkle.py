"""Merkle manifest of a dataset by butterfly exchange (DataFrame functions only).

Leaves are ordered within their group and cut into aligned blocks of ``fanout ** levels``
leaves; one row holds a block and hashes its own subtree. Then blocks exchange roots as in a
butterfly: in round r the ``fanout`` neighbouring spans of ``fanout ** r`` blocks form a
group, and blocks of the same offset in their spans swap the spans' roots. Every block hashes
the common ancestor itself (redundantly: all blocks of a group get the same digest) and
notes the others' roots as its siblings of that level. After the last round each block knows
the root and its whole upper proof, so nothing is passed down again; the leaves' own siblings
are read off the block's subtree.

A round is one shuffle of a row per block, its groups have at most ``fanout`` members. The last
span of a group may be short; its blocks then also answer for the offsets it lacks. The
groups' roots go through the same exchange once more and give the dataset's root.

No group of leaves meets in one task: positions come from sampled ranges of (group,
identifier), written once, and a block has a fixed number of leaves whatever the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import az_lower, documents, identifier, keep_columns, staged

RESULT = ["position", "leaf", "subroot", "root", "proof"]
PROOF = "array<struct<left:string,right:string>>"


def digest(parts: Column) -> Column:
    return F.sha2(parts.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values: ``-`` for NULL, else UTF-8 byte count, ``:``, value as text."""
    def one(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return digest(F.concat(*[one(c) for c in values]))


def fold(leaf: Column, proof: Column) -> Column:
    """Root that follows from ``leaf`` and its siblings."""
    return F.aggregate(proof, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def _positions(leaves: DataFrame, name: str) -> DataFrame:
    """``leaves`` (g, id, leaf, ...) with ``at``, the place within ``g``, and ``n``, its leaves."""
    salt = leaves.withColumn("_salt", F.monotonically_increasing_id())   # equal leaves may fill several ranges
    cut = salt.repartitionByRange("g", "id", "leaf", "_salt").sortWithinPartitions("g", "id", "leaf").drop("_salt")
    # in sorted order within a range: (range << 33) + row
    rows = staged(cut.withColumn("m", F.monotonically_increasing_id())
                  .withColumn("range", F.shiftright("m", 33)).withColumn("m", F.col("m") % (1 << 33)), name)
    per = rows.groupBy("range", "g").agg(F.count(F.lit(1)).alias("k"), F.min("m").alias("lo"))
    order = Window.partitionBy("g").orderBy("range")
    place = per.select("range", "g", "lo", F.sum("k").over(Window.partitionBy("g")).alias("n"),
                       (F.sum("k").over(order) - F.col("k")).alias("before"))
    return (rows.join(place, ["range", "g"]).withColumn("at", F.col("before") + F.col("m") - F.col("lo"))
            .drop("range", "m", "lo", "before"))


def _next_level(nodes: Column, fanout: int) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * fanout + 1, F.lit(fanout)), "")))


def _siblings(nodes: Column, i: Column, fanout: int) -> Column:
    first = i - i % fanout
    left = F.slice(nodes, (first + 1).cast("int"), (i - first).cast("int"))
    right = F.slice(nodes, (i + 2).cast("int"), (first + fanout - 1 - i).cast("int"))
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def _butterfly(blocks: DataFrame, fanout: int, most: int) -> DataFrame:
    """(g, b, nb, node) of every block -> (g, b, node, up): the group's root and the siblings on the way."""
    state = blocks.withColumn("up", F.array().cast(PROOF))
    span = 1
    while span < most:
        live, whole = F.col("nb") > span, F.lit(span).cast("long")
        group = F.floor(F.col("b") / span)
        over, offset = F.floor(group / fanout), F.col("b") % span
        size = F.least(whole, F.col("nb") - group * span)
        widest = F.least(whole, F.col("nb") - over * fanout * span)    # of the spans that swap here
        sent = state.select(
            "g", "b", "nb", F.struct((group % fanout).alias("digit"), "node").alias("said"), "up", offset.alias("offset"),
            F.when(live, over).otherwise(F.col("b")).alias("over"),
            F.explode(F.when(live, F.sequence(offset, widest - 1, size)).otherwise(F.array(offset))).alias("to"))
        met = sent.groupBy("g", "over", "to").agg(
            F.first("nb").alias("nb"), F.sort_array(F.collect_list("said")).alias("said"),
            F.collect_list(F.when(F.col("offset") == F.col("to"), F.struct("b", "said", "up"))).alias("own"))
        nodes = lambda keep: F.array_join(F.transform(F.filter("said", keep), lambda m: m["node"]), "")
        joined = met.select("g", "nb", F.explode("own").alias("own"), "said",
                            F.when(live, digest(nodes(lambda m: F.lit(True)))).alias("root"))
        digit = F.col("own.said.digit")
        level = F.struct(nodes(lambda m: m["digit"] < digit).alias("left"), nodes(lambda m: m["digit"] > digit).alias("right"))
        state = joined.select("g", "own.b", "nb", F.coalesce("root", "own.said.node").alias("node"),
                              F.when(live, F.concat("own.up", F.array(level))).otherwise(F.col("own.up")).cast(PROOF).alias("up"))
        span *= fanout
    return state.drop("nb")


def _blocks(leaves: DataFrame, fanout: int, levels: int, name: str) -> DataFrame:
    """Aligned blocks of ``leaves`` (g, id, leaf, with): their rows and the nodes ``n1``.. of their subtrees."""
    size = fanout ** levels
    rows = _positions(leaves, f"{name}-leaves").withColumn("b", F.floor(F.col("at") / size))
    block = rows.groupBy("g", "b", "n").agg(F.sort_array(F.collect_list(F.struct("at", "id", "leaf", "with"))).alias("rows"))
    block = block.withColumn("n0", F.transform("rows", lambda r: r["leaf"]))
    for k in range(levels):
        below = F.col(f"n{k}")
        block = block.withColumn(f"n{k + 1}", F.when(F.col("n") > fanout ** k, _next_level(below, fanout)).otherwise(below))
    return staged(block.drop("n0").withColumn("nb", F.ceil(F.col("n") / size)), f"{name}-blocks")


def _exchanged(block: DataFrame, fanout: int, levels: int) -> DataFrame:
    most = block.agg(F.max("nb")).first()[0] or 0
    return _butterfly(block.select("g", "b", "nb", F.element_at(f"n{levels}", 1).alias("node")), fanout, most)


def _leaves(block: DataFrame, up: DataFrame, fanout: int, levels: int) -> DataFrame:
    """A row per leaf (r, columns of ``up`` but its siblings, proof): its own siblings, then those of its block."""
    whole = block.join(up, ["g", "b"]).withColumn("n0", F.transform("rows", lambda r: r["leaf"]))

    def proof(r):
        i = r["at"] % fanout ** levels
        own = [F.when(F.col("n") > fanout ** k, _siblings(F.col(f"n{k}"), F.floor(i / fanout ** k), fanout)) for k in range(levels)]
        return F.concat(F.filter(F.array(*own), lambda s: s.isNotNull()), F.col("up")).cast(PROOF)
    each = F.transform("rows", lambda r: F.struct(r.alias("r"), proof(r).alias("proof")))
    return whole.select(*[c for c in up.columns if c != "up"], F.explode(each).alias("x")).select("*", "x.r", "x.proof").drop("x")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", leaf_cols: Sequence[str] | None = None,
             carry: dict[str, Column] | None = None, fanout: int = 8, levels: int = 4) -> DataFrame:
    """One row per row of ``docs``: identifier, group, ``position``, ``leaf``, ``subroot``, ``root``, ``proof``, ``carry``.

    A leaf is the digest of ``leaf_cols`` (default: all columns); ``subroot`` is the root of the
    row's group, ``root`` that of all subroots in the groups' bytewise order, NULL first. ``proof``:
    per level up to the root the siblings left and right of the node, so ``fold(leaf, proof)`` is
    the root. ``carry``: further (orderable) columns to compute per row and hand on.

    NULLs are values of their own in a leaf; NULL identifiers come first; rows with equal
    identifiers follow in the order of their digests, repeated rows are leaves each; an empty
    table gives an empty result. A text of any length is hashed where it is read. Columns of
    ``docs`` not asked for are ignored; carried ones named like a result column give way.
    """
    carry = carry or {}
    kept = [c for c in carry if c.lower() not in {*RESULT, id_col.lower(), group_col.lower()}]
    group = F.col(identifier(group_col)).cast("string")
    leaves = docs.select(F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("g"), F.col(identifier(id_col)).alias("id"),
                         leaf_digest([F.col(identifier(c)) for c in (leaf_cols or docs.columns)]).alias("leaf"),
                         F.struct(F.lit(0).alias("_"), *[carry[c].alias(c) for c in kept]).alias("with"))
    block = _blocks(leaves, fanout, levels, "merkle")
    up = staged(_exchanged(block, fanout, levels), "merkle-up")
    # the groups' roots as leaves of one more tree
    tops = _blocks(up.filter("b = 0").select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("node").alias("leaf"),
                                             F.struct(F.lit(0).alias("_")).alias("with")), fanout, levels, "merkle-top")
    top = staged(_leaves(tops, _exchanged(tops, fanout, levels), fanout, levels)
                 .select(F.col("r.id").alias("g"), F.col("node").alias("root"), F.col("proof").alias("rest")), "merkle-root")
    known = up.join(top, "g").select("g", "b", F.col("node").alias("subroot"), "root", F.concat("up", "rest").cast(PROOF).alias("up"))
    back = F.when(F.col("g") != "0", F.substring("g", 2, 1 << 30))
    return _leaves(block, known, fanout, levels).select(
        F.col("r.id").alias(id_col), back.alias(group_col), F.col("r.at").alias("position"), F.col("r.leaf").alias("leaf"),
        "subroot", "root", "proof", *[F.col(f"r.with.{identifier(c)}").alias(c) for c in kept])


LEAF = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Manifest of ``documents``, and the root that every third document (by CRC-32) gives with its text lower-cased."""
    docs = documents(spark, sf_dir).select(*LEAF)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    probe = leaf_digest([F.when(tampered, az_lower(F.col(c))).otherwise(F.col(c)) if c == "text" else F.col(c) for c in LEAF])
    made = manifest(docs, leaf_cols=LEAF, carry={"probe": probe})
    return (made.withColumn("folded_root", fold(F.col("probe"), F.col("proof")))
            .select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root",
                    (F.col("folded_root") == F.col("root")).alias("verified")))


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(
        f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in [*LEAF[:-1], text]) + ")"


def _sql_tree(name: str, leaves: str) -> str:
    """Levels of the trees over ``leaves`` (g, u, i, h, n), and each leaf's siblings per level."""
    return f"""
{name}(g, lvl, i, h, n) AS (
  SELECT g, 0, i, h, n FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM {name} WHERE n > 1 GROUP BY g, lvl, i // 8, n),
{name}_at AS (SELECT g, u, UNNEST(range(12)) AS lvl, i FROM {leaves}),
{name}_sib AS (
  SELECT a.u, a.lvl, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < a.i // CAST(8 ** a.lvl AS BIGINT)), '') AS l,
         coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > a.i // CAST(8 ** a.lvl AS BIGINT)), '') AS r
  FROM {name}_at a JOIN {name} t ON t.g = a.g AND t.lvl = a.lvl AND t.n > 1 AND t.i // 8 = a.i // CAST(8 ** (a.lvl + 1) AS BIGINT)
  GROUP BY ALL)"""


# CRC-32 of the decimal doc_id, bit by bit
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, {_sql_leaf('text')} AS leaf,
             {_sql_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS low FROM documents),
leaves AS (SELECT *, leaf AS h, row_number() OVER (ORDER BY g, doc_id NULLS FIRST, leaf) AS u,
                  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
{_sql_tree('tree', 'leaves')},
groups AS (SELECT '' AS g, g AS u, row_number() OVER (ORDER BY g) - 1 AS i, h, count(*) OVER () AS n FROM tree WHERE n = 1),
{_sql_tree('top', 'groups')},
sib AS (SELECT u, lvl, l, r FROM tree_sib UNION ALL
        SELECT v.u, 100 + s.lvl, s.l, s.r FROM top_sib s JOIN leaves v ON v.g = s.u),
step AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY lvl) AS k, l, r FROM sib),
proofs AS (SELECT u, max(k) AS k, sha256(string_agg(l || r, '' ORDER BY k)) AS p FROM step GROUP BY u),
kept AS (SELECT v.*, CASE WHEN crc32_mod3 = 0 THEN low ELSE leaf END AS probe FROM (SELECT *, {CRC32} % 3 AS crc32_mod3 FROM leaves) v),
folded(u, k, h) AS (SELECT u, 0, probe FROM kept UNION ALL
                    SELECT f.u, f.k + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN step s ON s.u = f.u AND s.k = f.k + 1)
SELECT doc_id, leaf, g.h AS subroot, t.h AS root, coalesce(p.p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM kept v JOIN groups g ON g.u = v.g JOIN (SELECT h FROM top WHERE n = 1) t ON true LEFT JOIN proofs p ON p.u = v.u
JOIN folded f ON f.u = v.u AND f.k = coalesce(p.k, 0)
"""
