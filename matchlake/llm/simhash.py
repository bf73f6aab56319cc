"""SimHash near-duplicates by the generalised pigeonhole principle.

1. Fingerprints: 64 majority bits over the XXH64 hashes of word shingles (numpy over ragged
   byte arrays in Arrow tasks, no shuffle).
2. Distinct fingerprints only (map-side combined), so exact copies cost nothing further.
3. Correlated bits are grouped (64 x 64 co-occurrence counts over all fingerprints) into
   eight groups, joined into partitions of one of four layouts. For thresholds ``T_i`` with
   ``sum(T_i + 1) = max_bits + 1`` two fingerprints within ``max_bits`` agree in some
   partition i up to ``T_i`` bits. Every fingerprint gets its own, unequal thresholds by
   dynamic programming on its estimated candidate counts (from the groups' value
   histograms over all fingerprints); the layout with the least estimated cost is taken.
4. Probe and verify: an equi-join on (partition, value) with the bit distance in its
   condition. Values that many fingerprints share are compared in blocks of bounded size,
   each block pair returning only a spanning forest of its links, so a dense group never
   becomes all its pairs; nothing is capped.
5. Components by alternating large and small stars, a written table per round.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AZ_BYTES, addressed, documents, identifier, keep_columns, pieces, small, staged, texts

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161,
                                             9650029242287828579, 2870177450012600261))   # Fixed values: XXH64 primes
RESULT = ["fingerprint", "component_id", "kept"]
LAYOUTS = ((1,) * 8, (2, 2, 2, 2), (3, 3, 2), (4, 4))   # groups of 8 bits in each partition
HOT = 128          # fingerprints sharing a value from which it is compared in blocks
BLOCK = 2048       # fingerprints in a block
PROBE_COST = 4.0   # cost of one probed value against one verified candidate
BYTE_DISTANCE = np.array([[bin(a ^ b).count("1") for b in range(256)] for a in range(256)], np.uint8)   # bit distances of bytes


def _rot(x, r):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def every_word(raw: bytes) -> np.ndarray:
    """Little-endian 64-bit word at every byte offset of ``raw`` (zeros follow its end)."""
    n = len(raw)
    padded = raw + b"\0" * (16 + -n % 8)
    out = np.empty(n + 8 + -n % 8, np.uint64)
    for k in range(8):
        part = np.frombuffer(padded[k:k + len(out)], "<u8")
        out[k::8] = part
    return out


def xxh64(words: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many byte slices at once; ``words`` is ``every_word`` of the buffer."""
    out = np.empty(len(start), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(start), 32768):
            out[i:i + 32768] = _xxh64(words, start[i:i + 32768], length[i:i + 32768], np.uint64(seed))
    return out


def _xxh64(words, start, length, seed):
    acc = np.full(len(start), seed + P5, np.uint64)
    off, rest = start.copy(), length.copy()
    i = np.flatnonzero(rest >= 32)
    if len(i):
        v = [np.full(len(i), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        live = np.arange(len(i))
        while len(live):
            at = off[i[live]]
            for k in range(4):
                v[k][live] = _round(v[k][live], words[at + 8 * k])
            off[i[live]] += 32
            rest[i[live]] -= 32
            live = live[rest[i[live]] >= 32]
        a = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            a = (a ^ _round(np.uint64(0), x)) * P1 + P4
        acc[i] = a
    acc += length.astype(np.uint64)
    for _ in range(3):
        i = np.flatnonzero(rest >= 8)
        if not len(i):
            break
        acc[i] = _rot(acc[i] ^ _round(np.uint64(0), words[off[i]]), 27) * P1 + P4
        off[i] += 8
        rest[i] -= 8
    i = np.flatnonzero(rest >= 4)
    acc[i] = _rot(acc[i] ^ ((words[off[i]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    off[i] += 4
    rest[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(rest > 0)
        acc[i] = _rot(acc[i] ^ ((words[off[i]] & np.uint64(0xFF)) * P5), 11) * P1
        off[i] += 1
        rest[i] -= 1
    acc ^= acc >> np.uint64(33)
    acc *= P2
    acc ^= acc >> np.uint64(29)
    acc *= P3
    return acc ^ (acc >> np.uint64(32))


def fingerprints(batch: list[str], shingle: int, seed: int = 42) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, words between ASCII white space, shingles of
    ``shingle`` words joined by a space, repeats included (fewer words: all of them)."""
    out = np.zeros(len(batch), np.uint64)
    split = [t.encode().translate(AZ_BYTES).split() for t in batch]
    full = [i for i, w in enumerate(split) if w]
    if not full:
        return out
    raw = b"\n".join([b" ".join(split[i]) for i in full])
    n = np.array([len(split[i]) for i in full], np.int64)
    byte = np.frombuffer(raw, np.uint8)
    gap = np.flatnonzero((byte == 32) | (byte == 10))
    begin, end = np.concatenate([[0], gap + 1]), np.concatenate([gap, [len(raw)]])
    many = np.maximum(n - shingle + 1, 1)
    doc = np.repeat(np.arange(len(full)), many)
    first = np.repeat(np.cumsum(n) - n, many) + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    last = first + np.repeat(np.minimum(n, shingle), many) - 1
    h = xxh64(every_word(raw), begin[first], end[last] - begin[first], seed)
    ones = np.empty((len(full), 64), np.int64)
    value_bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
    octets = h.view(np.uint8).reshape(-1, 8)
    for k in range(8):
        hist = np.bincount(doc * 256 + octets[:, k], minlength=256 * len(full)).reshape(-1, 256)
        ones[:, 8 * k:8 * k + 8] = np.rint(hist.astype(np.float64) @ value_bits).astype(np.int64)
    out[full] = np.packbits(2 * ones > many[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class Plan:
    """Bit groups, their value histograms and the per-fingerprint threshold allocation."""

    def __init__(self, order: list[int], max_bits: int):
        self.order, self.max_bits, self.near, self.layout = np.array(order), max_bits, None, LAYOUTS[1]

    def groups(self, fp: np.ndarray) -> np.ndarray:
        """(n, 8) group values."""
        return np.packbits(_bits(fp)[:, self.order], axis=1, bitorder="little")

    def learn(self, hist: np.ndarray, total: int) -> None:
        """``hist``: (8, 256) value counts; near[g, v, e]: share of all fingerprints at distance e from v."""
        same = np.stack([BYTE_DISTANCE == e for e in range(9)], 2).astype(np.float64)      # (256, 256, 9)
        self.total = total
        self.near = np.einsum("gu,uve->gve", hist / max(total, 1), same)

    def costs(self, values: np.ndarray, layout) -> np.ndarray:
        """Estimated cost of partition i with u = T_i + 1 in 0..max_bits + 1: (parts, u, n)."""
        top, out, g = self.max_bits, [], 0
        for size in layout:
            dist = np.zeros((len(values), top + 1))
            dist[:, 0] = 1.0
            for k in range(g, g + size):
                near = self.near[k][values[:, k]][:, :top + 1]
                if near.shape[1] < top + 1:
                    near = np.pad(near, ((0, 0), (0, top + 1 - near.shape[1])))
                dist = np.stack([sum(dist[:, a] * near[:, e - a] for a in range(e + 1)) for e in range(top + 1)], 1)
            found = np.cumsum(dist, 1) * self.total
            probes = np.cumsum([_choose(8 * size, e) for e in range(top + 1)])
            out.append(np.concatenate([np.zeros((1, len(values))), (found + PROBE_COST * probes).T]))
            g += size
        return np.stack(out)

    def allocate(self, values: np.ndarray, layout) -> tuple[np.ndarray, np.ndarray]:
        """Thresholds plus one, (n, parts), that sum to ``max_bits + 1`` at the least cost; the costs."""
        cost, need = self.costs(values, layout), self.max_bits + 1
        best = np.full((need + 1, len(values)), np.inf)
        best[0] = 0.0
        picks = []
        for part in cost:
            nxt = np.full_like(best, np.inf)
            pick = np.zeros(best.shape, np.int64)
            for b in range(need + 1):
                for u in range(b + 1):
                    c = best[b - u] + part[u]
                    less = c < nxt[b]
                    nxt[b][less] = c[less]
                    pick[b][less] = u
            picks.append(pick)
            best = nxt
        at, out, rows = np.full(len(values), need), [], np.arange(len(values))
        for pick in reversed(picks):
            u = pick[at, rows]
            out.append(u)
            at = at - u
        return np.stack(out[::-1], 1), best[need]

    def keys(self, values: np.ndarray):
        """Index keys per partition: partition number above the partition's value."""
        g = 0
        for i, size in enumerate(self.layout):
            v = np.zeros(len(values), np.int64)
            for k in range(size):
                v |= values[:, g + k].astype(np.int64) << (8 * k)
            yield i, size, (np.int64(i) << 32) | v
            g += size


def _choose(n: int, k: int) -> int:
    from math import comb
    return comb(n, k)


def masks(width: int, most: int) -> np.ndarray:
    """All masks of at most ``most`` of ``width`` bits."""
    return np.array([sum(1 << b for b in c) for e in range(most + 1) for c in combinations(range(width), e)], np.int64)


def _fp_batches(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        for i in range(0, b.num_rows, 8192):
            fp = b.column("fp").slice(i, 8192).to_numpy()
            if len(fp):
                yield fp.view(np.uint64)


def _plan(fps: DataFrame, max_bits: int) -> Plan:
    def together(batches):
        total = np.zeros((64, 64))
        for fp in _fp_batches(batches):
            x = _bits(fp).astype(np.float64)
            total += x.T @ x
        i, j = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j, pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["k", "n"])

    both = np.zeros(4096)
    for r in fps.mapInArrow(together, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():   # 4096 rows
        both[r.k] = r.n
    both, total = both.reshape(64, 64), fps.count()
    share = np.diag(both) / max(total, 1)
    cov = both / max(total, 1) - np.outer(share, share)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0.0)
    # a group grows from the strongest tie among free bits; the next group starts from its strongest tie to the last
    order, free = [], set(range(64))
    while free:
        left = sorted(free)
        seed = int(left[np.argmax(tie[np.ix_(left, left)].max(1))]) if not order else max(left, key=lambda b: (tie[b, order[-8:]].sum(), -b))
        group = [seed]
        free.discard(seed)
        while len(group) < 8:
            b = max(sorted(free), key=lambda b: (tie[b, group].sum(), -b))
            group.append(b)
            free.discard(b)
        order += group
    plan = Plan(order, max_bits)

    def values(batches):
        hist = np.zeros((8, 256), np.int64)
        for fp in _fp_batches(batches):
            v = plan.groups(fp)
            for g in range(8):
                hist[g] += np.bincount(v[:, g], minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2048, dtype=np.int32)), pa.array(hist.ravel())], names=["k", "n"])

    hist = np.zeros(2048)
    for r in fps.mapInArrow(values, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():     # 2048 rows
        hist[r.k] = r.n
    plan.learn(hist.reshape(8, 256), total)

    def price(batches):
        cost = np.zeros(len(LAYOUTS))
        for fp in _fp_batches(batches):
            v = plan.groups(fp)
            cost += [plan.allocate(v, layout)[1].sum() for layout in LAYOUTS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(LAYOUTS), dtype=np.int32)), pa.array(cost)], names=["k", "c"])

    priced = {r.k: r.c for r in fps.mapInArrow(price, "k int, c double").groupBy("k").agg(F.sum("c").alias("c")).collect()}
    plan.layout = LAYOUTS[min(priced, key=lambda k: (priced[k], k))] if priced else LAYOUTS[1]
    return plan


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(a, b), a > b: links among distinct fingerprints whose components are those of all
    pairs within ``max_bits`` bits (inside hot values a spanning forest per block pair)."""
    plan = _plan(fps, max_bits)

    def index(batches):
        for fp in _fp_batches(batches):
            for _, _, key in plan.keys(plan.groups(fp)):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp.view(np.int64))], names=["key", "x"])

    def probe(batches):
        table = {}
        for fp in _fp_batches(batches):
            v = plan.groups(fp)
            units, _ = plan.allocate(v, plan.layout)
            for i, size, key in plan.keys(v):
                for u in np.unique(units[:, i]).tolist():
                    if not u:
                        continue
                    if (size, u) not in table:
                        table[size, u] = masks(8 * size, u - 1)
                    m, rows = table[size, u], np.flatnonzero(units[:, i] == u)
                    step = max(1, 200_000 // len(m))
                    for s in range(0, len(rows), step):
                        r = rows[s:s + step]
                        yield pa.RecordBatch.from_arrays([pa.array((key[r][:, None] ^ m).ravel()),
                                                          pa.array(np.repeat(fp.view(np.int64)[r], len(m)))], names=["key", "q"])

    indexed = fps.mapInArrow(index, "key bigint, x bigint")
    probes = fps.mapInArrow(probe, "key bigint, q bigint")
    hot = staged(indexed.groupBy("key").agg(F.count("x").alias("n")).filter(F.col("n") > HOT), "simhash-hot")
    close = (F.bit_count(F.col("x").bitwiseXOR(F.col("q"))) <= max_bits) & (F.col("x") > F.col("q"))
    if hot.isEmpty():
        return indexed.join(probes, (indexed.key == probes.key) & close).select(F.col("x").alias("a"), F.col("q").alias("b"))
    cold_index = indexed.join(hot, "key", "left_anti")
    cold = cold_index.join(probes, (cold_index.key == probes.key) & close).select(F.col("x").alias("a"), F.col("q").alias("b"))

    # hot values: every (index block, probe block) pair is one bounded task
    asked = staged(probes.join(hot, "key").select("key", "q", "n"), "simhash-asked")
    sizes = asked.groupBy("key").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("m"))
    grid = sizes.select("key", F.ceil(F.col("n") / BLOCK).alias("nb"), F.ceil(F.col("m") / BLOCK).alias("mb"))
    lanes = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    home = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")              # noqa: E731
    left = (indexed.join(grid, "key").select("key", F.col("x").alias("fp"), home("x", "nb").alias("i"), lanes("mb").alias("j"), F.lit(True).alias("side")))
    right = (asked.select("key", "q").join(grid, "key")
             .select("key", F.col("q").alias("fp"), lanes("nb").alias("i"), home("q", "mb").alias("j"), F.lit(False).alias("side")))

    def compare(table: pa.Table) -> pa.Table:
        fp, side = table.column("fp").to_numpy(), table.column("side").to_numpy(zero_copy_only=False)
        a, b = forest(fp[side].view(np.uint64), fp[~side].view(np.uint64), max_bits)
        return pa.table([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    dense = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint")
    return cold.unionByName(dense)


def forest(x: np.ndarray, q: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two sets: breadth first over what is unvisited,
    so a dense set costs about one comparison per member."""
    node, where = np.unique(np.concatenate([x, q]), return_inverse=True)
    inx = np.zeros(len(node), bool)
    inx[where[:len(x)]] = True
    inq = np.zeros(len(node), bool)
    inq[where[len(x):]] = True
    free, a, b = np.ones(len(node), bool), [], []
    for root in range(len(node)):
        if not free[root]:
            continue
        free[root] = False
        todo = [root]
        while todo:
            u = todo.pop()
            rest = np.flatnonzero(free & ((inq if inx[u] else False) | (inx if inq[u] else False)))
            new = rest[np.bitwise_count(node[rest] ^ node[u]) <= max_bits]
            free[new] = False
            todo += new.tolist()
            a.append(np.full(len(new), node[u]))
            b.append(node[new])
    join = lambda v: np.concatenate([np.zeros(0, np.uint64), *v]).view(np.int64)
    return join(a), join(b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of the component; nodes without a link are
    absent. Alternating large and small stars: a round is two aggregations and two joins,
    and ends in a written table; the edges never grow beyond nodes plus edges."""
    edges = staged(edges.filter(F.col("a") != F.col("b")).distinct(), "simhash-edges")
    last = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("b").alias("x")), F.struct(F.col("a").alias("x"))))
        edges = staged(large.join(small, "a").select(pair.alias("p"), "m").select(F.col("p.x").alias("a"), F.col("m").alias("b"))
                       .filter("a != b").distinct(), "simhash-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def near_dedup(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint`` (16 hex digits), ``component_id`` and ``kept``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest identifier reachable (NULL only where no linked row
    has one), and exactly one row of each component is ``kept``, one with that
    identifier. A text without words (NULL, empty, white space) has fingerprint zero and is
    linked like any other. Repeated rows share a component. An empty table gives an empty
    result. Input columns named like a result column give way.
    """
    carried = keep_columns(docs, RESULT)
    row = docs.select(F.struct(*[F.col(identifier(c)) for c in carried]).alias("row"), F.col(identifier(id_col)).alias("id"),
                      F.col(identifier(text_col)).alias("text"))
    schema = T.StructType([row.schema["row"], row.schema["id"], T.StructField("fp", T.LongType())])

    def mark(batches):
        for b in pieces(batches, "text", 2 << 20):
            fp = fingerprints(texts(b.column("text")), shingle)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("id"), pa.array(fp.view(np.int64))], names=schema.names)

    rows = staged(row.mapInArrow(mark, schema).withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("rid").alias("rid")))
    fps = staged(rows.groupBy("fp").agg(first.alias("best")), "simhash-fps")
    roots = components(links(fps.select("fp"), max_bits)) if not fps.isEmpty() else None
    known = fps
    if roots is not None:
        member = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        whole = member.groupBy("root").agg(F.min("best").alias("best"))
        known = member.select("fp", "root").join(whole, "root").select("fp", "best")
    return rows.join(known, "fp").select(
        *[F.col("row").getField(c).alias(c) for c in carried], F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("best.id").alias("component_id"), (F.col("rid") == F.col("best.rid")).alias("kept"))


def without_near_copies(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_dedup`` keeps. Texts are read for the fingerprints alone: only
    identifiers and addresses travel, and the rows to leave out are dropped where they are read."""
    docs, placed = addressed(docs)
    slim = placed.select(F.col(identifier(id_col)).alias("id"), F.col(identifier(text_col)).alias("fingerprint"), "_file", "_row")
    gone = staged(near_dedup(slim, shingle, max_bits, "id", "fingerprint").filter(~F.col("kept")).select("_file", "_row"), "simhash-gone")
    return placed.join(small(gone), ["_file", "_row"], "left_anti").select(*[F.col(identifier(c)) for c in docs.columns])


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: 4-word shingles, links at 4 or fewer differing bits."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    # the text is read for the fingerprint alone; only the identifier is carried
    return near_dedup(docs.select("doc_id", F.col("text").alias("fingerprint")), text_col="fingerprint").select("doc_id", "fingerprint", "component_id")
