"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of its documents' tokens. Windows of ``window`` tokens are filled
in turn; in each window every queue's deficit grows by its share of the window (its target
proportion), the queue serves the whole tokens of its deficit, and what is left of a token
carries over to the next window. When a queue runs dry the others share its part.

To run in parallel the stream of windows is cut into lanes of ``lane_windows`` windows.
The state at a lane's start has a closed form: with ``G_k(p)`` the fluid service of queue k
after p tokens, the lane's content of queue k begins at the cut ``C_k(p)`` (tokens in order
of their virtual service time) and its deficit at ``G_k(p) - C_k(p)``; so deficits carry
across lanes and partitions without a sequential pass. A lane holds ``lane_windows *
window`` tokens whatever the sources' sizes: a hot source is spread over all lanes.

Stages: tokenise once (ids staged in the shared folder), sum tokens per (queue, part), a
running total over parts gives each document its place in its queue, documents are cut at
lane borders, one shuffle by lane, round-robin inside each lane.

Only the queues' totals reach the driver; there are at most ``window`` queues (if there are
more sources, they are dealt into ``window`` queues by hash, since a window cannot hold a
token of each).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import documents, identifier, pieces, staged, texts
from .pretokens import PLAIN, Memory, cut, per_text

class WordTokenizer:
    """Ids of the public word vocabulary as the tokenizers library gives them: plain texts are cut by
    arrays and each distinct word is merged once while it is remembered; any other text goes to the
    library whole. ``dtype``: two bytes an id where the vocabulary allows it, else four."""

    def __init__(self, path: str, dtype: str | None = None):
        self.path, self._whole = path, None
        self.memory = Memory(bpe.load("words", path).encode, 8 << 20)
        self.dtype = dtype or id_code(self.whole())

    def whole(self):
        """The library's tokenizer, loaded where a text needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def encode(self, batch: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per text) with ``end`` behind each text."""
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None and unicodedata.is_normalized("NFC", t) for t in batch]
        words, per = cut([t.lower() for t, ok in zip(batch, plain, strict=True) if ok], spaces=False)
        flat, n = self.memory.ids(words)
        done = iter(np.split(flat, np.cumsum(per_text(n, per))[:-1]) if len(per) else [])
        each = [next(done) if ok else np.array(self.whole().encode(t, add_special_tokens=False).ids, np.int64)
                for t, ok in zip(batch, plain, strict=True)]
        last = np.array([end])
        ids = np.concatenate([x for one in each for x in (one, last)]) if each else np.zeros(0, np.int64)
        return ids.astype(self.dtype), np.fromiter((len(x) + 1 for x in each), np.int64, len(each))


def id_code(tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


class Mixture:
    """Fluid schedule of the queues: ``tokens`` per queue served in proportion to ``weights``."""

    def __init__(self, tokens: list[int], weights: list[float]):
        self.tokens = np.array(tokens, np.float64)
        self.weights = np.array(weights, np.float64)
        ends = self.tokens / self.weights                      # virtual time at which a queue runs dry
        self.times = np.concatenate([[0.0], np.unique(ends)])
        self.served = self._at(self.times).sum(1)
        self.total = int(sum(tokens))

    def _at(self, v):
        return np.minimum(self.tokens, np.multiply.outer(np.atleast_1d(v), self.weights))

    def fluid(self, p):
        """Service of every queue after ``p`` tokens in all: (len(p), queues)."""
        p = np.minimum(np.atleast_1d(np.asarray(p, np.float64)), self.total)
        return self._at(np.interp(p, self.served, self.times))

    def place(self, queue, at):
        """About how many tokens are served before token ``at`` of ``queue``."""
        return np.interp((np.asarray(at) + 0.5) / self.weights[queue], self.times, self.served)

    def cuts(self, p):
        """Whole tokens of every queue among the first ``p``, in order of virtual time."""
        p = np.atleast_1d(np.asarray(p, np.int64))
        v = np.interp(np.minimum(p, self.total), self.served, self.times)
        c = np.minimum(np.floor(v[:, None] * self.weights + 0.5), self.tokens).astype(np.int64)
        for row, want in zip(c, np.minimum(p, self.total), strict=True):
            miss = int(want - row.sum())
            while miss:
                step = 1 if miss > 0 else -1
                when = (row + 0.5 * step) / self.weights
                when = np.where(row < self.tokens, when, np.inf) if step > 0 else np.where(row > 0, -when, np.inf)
                row[int(np.argmin(when))] += step
                miss -= step
        return c


def _serve(mix: Mixture, lane: int, lane_windows: int, window: int, content: np.ndarray) -> np.ndarray:
    """Tokens each queue serves in each window of a lane: deficit round-robin over ``content``."""
    start = lane * lane_windows * window
    left = content.copy()
    count = -(-int(left.sum()) // window)
    fluid = mix.fluid(start + window * np.arange(count + 1))
    deficit = fluid[0] - mix.cuts([start])[0]
    served = np.zeros((count, len(left)), np.int64)
    for w in range(count):
        deficit += fluid[w + 1] - fluid[w]
        room = min(window, int(left.sum()))
        take = np.minimum(np.maximum(np.floor(deficit), 0).astype(np.int64), left)
        over = int(take.sum()) - room
        while over > 0:                                        # the smallest claims wait
            k = int(np.argmin(np.where(take > 0, deficit - take, np.inf)))
            take[k] -= 1
            over -= 1
        while over < 0:                                        # the largest claims left over go first
            claim = np.where(take < left, deficit - take, -np.inf)
            order = np.argsort(-claim, kind="stable")[:min(-over, int((take < left).sum()))]
            take[order] += 1
            over += len(order)
        deficit -= take
        left -= take
        served[w] = take
    return served


PIECE = 1 << 20      # bytes of text encoded at once


def _tokens(docs, id_col, text_col, vocabulary, end, code):
    """(part, queue, at, id, n, ids): a document's ids and its place in the queue of its part."""
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("queue", T.StringType()),
                           T.StructField("at", T.LongType()), T.StructField("id", docs.schema["id"].dataType),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, tokenizer = TaskContext.get().partitionId(), {}, WordTokenizer(vocabulary, code)
        for b in pieces(batches, "text", PIECE):
            ids, n = tokenizer.encode(texts(b.column("text")), end)
            at = []
            for q, k in zip(b.column("queue").to_pylist(), n.tolist(), strict=True):
                at.append(seen.get(q, 0))
                seen[q] = at[-1] + k
            edge = np.concatenate([[0], np.cumsum(n)]) * ids.itemsize
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(n), pa.int64()), b.column("queue"), pa.array(at, pa.int64()), b.column("id"), pa.array(n),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw)]) if edge[-1] < 1 << 31
                 else pa.array([raw[i:j] for i, j in zip(edge, edge[1:], strict=False)], pa.binary())], names=schema.names)

    return staged(docs.mapInArrow(run, schema), "pack-ids")


def pack(docs: DataFrame, vocabulary: str, weights: dict[str, float] | None = None, id_col: str = "doc_id",
         text_col: str = "text", source_col: str = "source", window: int = 2048, lane_windows: int = 256,
         end: int = 1) -> DataFrame:
    """Sequences: (sequence_id, input_ids, n_tokens, padded, pieces).

    ``input_ids``: little-endian unsigned 32-bit ids; ``pieces``: array of (doc_id, start,
    length, offset, doc_tokens), gapless from offset 0; ``padded``: ``window``, or
    ``n_tokens`` where that is a power of two. ``weights``: target proportion per source
    (positive, else it raises; sources not named get the mean of the named weights); None: each source's share of
    all tokens. Every id lies in exactly one piece, only the last sequence can be short.

    A NULL text is empty (its document is the end id alone), a NULL source is the queue
    ''. Repeated rows are packed each on its own, NULL identifiers are carried. An empty table gives
    no sequences. Other columns are not read.
    """
    if weights and not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("target proportions must be positive numbers")
    from tokenizers import Tokenizer
    spark, code = docs.sparkSession, id_code(Tokenizer.from_file(vocabulary))
    width = np.dtype(code).itemsize
    source = F.coalesce(F.col(identifier(source_col)).cast("string"), F.lit(""))
    many = docs.select(source.alias("s")).distinct().limit(window + 1).count() > window
    named = weights or {}
    queue = source
    if many:
        queue = F.when(source.isin(list(named)), source) if named else F.when(F.lit(False), source)
        queue = F.coalesce(queue, F.concat(F.lit("hash "), F.pmod(F.xxhash64(source), F.lit(window)).cast("string")))
    rows = _tokens(docs.select(F.col(identifier(id_col)).alias("id"), F.col(identifier(text_col)).alias("text"),
                               queue.alias("queue")), "id", "text", vocabulary, end, code)
    sums = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written, so that the join below knows its size: a row per (queue, part), held in each task while
    # it is small, else joined by (queue, part)
    first = staged(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-first")
    totals = sorted((r.queue, r.n) for r in first.groupBy("queue").agg(F.sum("n").alias("n")).collect())
    names = [q for q, _ in totals]
    number = {q: k for k, q in enumerate(names)}
    # weights are taken as proportions; a queue without one gets their mean, as if it were an average source
    mean = sum(named.values()) / len(named) if named else 0.0
    mix = Mixture([n for _, n in totals], [float(named.get(q, mean)) if named else float(n) for q, n in totals]) if totals else None
    lane_size = window * lane_windows
    id_type = rows.schema["id"].dataType

    deal_schema = T.StructType([T.StructField("lane", T.LongType()), T.StructField("queue", T.IntegerType()),
                                T.StructField("place", T.LongType()), T.StructField("id", id_type),
                                T.StructField("start", T.LongType()), T.StructField("doc_tokens", T.LongType()),
                                T.StructField("ids", T.BinaryType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut each document's ids at the borders of lanes."""
        for b in batches:
            if not b.num_rows:
                continue
            queue = np.array([number[q] for q in b.column("queue").to_pylist()], np.int64)
            start = b.column("start").to_numpy()
            n = b.column("n").to_numpy()
            out = {name: [] for name in ("row", "lane", "place", "from")}
            for k in np.unique(queue).tolist():
                mine = np.flatnonzero(queue == k)
                s, e = start[mine], start[mine] + n[mine]
                lo = max(0, int(mix.place(k, s.min()) // lane_size) - 2)
                hi = int(mix.place(k, e.max()) // lane_size) + 3
                border = np.concatenate([mix.cuts(np.arange(i, min(i + 512, hi + 1)) * lane_size)[:, k]
                                         for i in range(lo, hi + 1, 512)])
                border = np.maximum.accumulate(border)
                a = np.searchsorted(border, s, side="right") - 1
                z = np.searchsorted(border, e - 1, side="right") - 1
                times = z - a + 1
                row = np.repeat(np.arange(len(mine)), times)
                lane = np.repeat(a, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                begin = np.maximum(s[row], border[lane])
                full = begin < np.minimum(e[row], np.append(border, 1 << 62)[lane + 1])
                out["row"].append(mine[row[full]])
                out["lane"].append(lane[full] + lo)
                out["place"].append(begin[full])
                out["from"].append(begin[full] - s[row[full]])
            row, lane, place, at = (np.concatenate(out[x]) for x in ("row", "lane", "place", "from"))
            order = np.lexsort((at, row))
            row, lane, place, at = row[order], lane[order], place[order], at[order]
            to = np.where(np.append(row[1:] == row[:-1], False), np.append(at[1:], 0), n[row])
            ids = b.column("ids").to_pylist()
            cut = [ids[r][width * i:width * j] for r, i, j in zip(row.tolist(), at.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(lane), pa.array(queue[row].astype(np.int32)), pa.array(place), b.column("id").take(pa.array(row)),
                 pa.array(at), pa.array(n[row]), pa.array(cut, pa.binary())], names=deal_schema.names)

    piece = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()),
                          T.StructField("length", T.LongType()), T.StructField("offset", T.LongType()),
                          T.StructField("doc_tokens", T.LongType())])
    out_schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("input_ids", T.BinaryType()),
                               T.StructField("n_tokens", T.LongType()), T.StructField("padded", T.LongType()),
                               T.StructField("pieces", T.ArrayType(piece))])
    if mix is None:
        return spark.createDataFrame([], out_schema)

    def fill(table: pa.Table) -> pa.Table:
        """One lane: round-robin over its queues, window by window."""
        table = table.combine_chunks().sort_by([("queue", "ascending"), ("place", "ascending")])
        lane = table.column("lane")[0].as_py()
        queue = table.column("queue").to_numpy()
        ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), code)
        n = np.array([len(x) // width for x in table.column("ids").to_pylist()], np.int64)
        content = np.bincount(queue, weights=n, minlength=len(names)).astype(np.int64)
        served = _serve(mix, lane, lane_windows, window, content)
        # runs: (window, queue) stretches of the lane's ids, which are ordered by queue
        base = np.concatenate([[0], np.cumsum(content)[:-1]])
        w, k = np.nonzero(served)
        size = served[w, k]
        begin = (base[k] + (np.cumsum(served, 0) - served)[w, k])
        ends = np.cumsum(n)
        a = np.searchsorted(ends, begin, side="right")
        z = np.searchsorted(ends, begin + size - 1, side="right")
        times = z - a + 1
        run = np.repeat(np.arange(len(w)), times)
        doc = np.repeat(a, times) + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)
        lo = np.maximum(begin[run], (ends - n)[doc])
        hi = np.minimum(begin[run] + size[run], ends[doc])
        length = hi - lo
        total = np.bincount(w[run], weights=length, minlength=len(served)).astype(np.int64)
        offset = np.cumsum(length) - length - np.repeat(np.cumsum(total) - total, np.bincount(w[run], minlength=len(served)))
        first = table.column("start").to_numpy()
        stream = ids[np.repeat(lo - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))].astype("<u4")
        cut = np.concatenate([[0], np.cumsum(total)]).tolist()
        rows = pa.StructArray.from_arrays(
            [table.column("id").combine_chunks().take(pa.array(doc)), pa.array(first[doc] + lo - (ends - n)[doc]),
             pa.array(length), pa.array(offset), pa.array(table.column("doc_tokens").to_numpy()[doc])], names=piece.names)
        many = np.concatenate([[0], np.cumsum(np.bincount(w[run], minlength=len(served)))])
        padded = np.where(total & (total - 1) == 0, total, window)
        return pa.table([pa.array(lane * lane_windows + np.arange(len(served))),
                         pa.array([stream[i:j].tobytes() for i, j in zip(cut, cut[1:], strict=False)], pa.binary()),
                         pa.array(total), pa.array(padded), pa.ListArray.from_arrays(pa.array(many, pa.int32()), rows)],
                        names=out_schema.names)

    placed = rows.join(first.drop("n"), ["queue", "part"]).withColumn("start", F.col("before") + F.col("at")).drop("before", "at", "part")
    return placed.mapInArrow(deal, deal_schema).groupBy("lane").applyInArrow(fill, out_schema)


def packed_pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    p = sequences.select("sequence_id", "input_ids", F.explode("pieces").alias("p"))
    ids = F.substring(F.col("input_ids"), (F.col("p.offset") * 4 + 1).cast("int"), (F.col("p.length") * 4).cast("int"))
    return p.select("p.doc_id", "p.start", "p.length", F.crc32(ids).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens, sources mixed by their share of all tokens."""
    import public_tokenizers
    return packed_pieces(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))
