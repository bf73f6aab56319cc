"""Byte-level BPE over a global shuffle of distinct words.

encode: every text is cut into pre-tokens; the positions of a block of documents (about
5 MB of text) refer to the block's list of distinct words. Positions and lists are written
once. Only the lists are dealt out by word hash, so all blocks' copies of a word meet in one
task, which merges each distinct word once; the ids return to their block by a second
shuffle, where the positions reassemble the documents. A word that stands in every text
travels once per block, never once per occurrence, so frequent words make no hot partition;
words of one hash share a task, never a group in memory.

decode: ids are joined with the token-byte table (one row per token of the vocabulary, the
fixed bound that lets every task hold it): a gather by id on flat arrays.

Both sides of the last join must see the same blocks. The cut texts are therefore written
first, whatever the input is and whichever executors are lost; a caller whose input is a plain
scan of files, which gives the same rows in the same partitions every time, may have it cut
twice instead (``again``) and saves that table; lists that differ then raise.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import documents, identifier, keep_columns, pieces, shuffle_partitions, staged, texts
from .pretokens import PLAIN, Memory, cut

BLOCK = 5 << 20      # bytes of text in a block
MEMORY = 16 << 20    # bytes of distinct words and ids that an encoding task remembers before it starts afresh
CHUNK = 1 << 18      # ids gathered at once


def splitter(pattern: str) -> Callable[[list[str]], tuple[pa.Array, list[np.ndarray]]]:
    """texts -> (their pre-tokens by ``pattern``, places of each text's pre-tokens among them)."""
    import public_tokenizers
    import regex
    full, known = regex.compile(pattern), pattern == public_tokenizers.PATTERN

    def split(batch: list[str]):
        plain = [known and PLAIN.fullmatch(t) is not None for t in batch]
        words, per = cut([t for t, ok in zip(batch, plain, strict=True) if ok], spaces=True)
        other = [full.findall(t) for t, ok in zip(batch, plain, strict=True) if not ok]
        if other:
            words = pa.concat_arrays([words, pa.array([w for x in other for w in x], pa.string())])
        size = [iter(per.tolist()), iter(map(len, other))]
        at, places = [0, int(per.sum())], []
        for ok in plain:
            k = 0 if ok else 1
            n = next(size[k])
            places.append(np.arange(at[k], at[k] + n))
            at[k] += n
        return words, places
    return split


def _flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, byte lengths) of Arrow strings."""
    edge = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4) if len(words) else np.zeros(1, np.int32)
    data = words.buffers()[2] if len(words) else None
    return (np.frombuffer(data, np.uint8)[edge[0]:edge[-1]] if data is not None and edge[-1] > edge[0] else np.zeros(0, np.uint8),
            np.diff(edge).astype(np.int64))


def _hashes(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of every word (none is empty)."""
    if not len(size):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(len(raw)) - np.repeat(begin, size)
        h = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * power[place & 1023], begin) + size.astype(np.uint64)
        h ^= h >> np.uint64(32)
        return h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)


def _gather(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class TokenTable:
    """Rows of bytes by id; ``joined`` yields the bytes of ids in order, a stretch at a time."""

    def __init__(self, rows: list[bytes]):
        self.flat, self.size = np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, len(rows))
        self.begin = np.cumsum(self.size) - self.size

    def joined(self, ids: np.ndarray) -> Iterator[bytes]:
        for i in range(0, len(ids), CHUNK):
            x = ids[i:i + CHUNK]
            yield _gather(self.flat, self.begin[x], self.size[x]).tobytes()


@functools.lru_cache(maxsize=2)
def token_table(ranks: str) -> TokenTable:
    return TokenTable(bpe.load("bytes", ranks).tokens)


@functools.lru_cache(maxsize=2)
def decimals(count: int) -> TokenTable:
    """Each id in decimal, a space behind it."""
    return TokenTable([b"%d " % i for i in range(count)])


def _press(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed byte by byte: first all low bytes, last all high ones."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T), 3)


def _unpress(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text",
           then: tuple[T.StructType, Callable[[list[np.ndarray]], list[pa.Array]]] | None = None, again: bool = False) -> DataFrame:
    """``docs`` (without the text) with ``ids``: little-endian unsigned 32-bit token ids.

    NULL and empty texts have no ids; rows are independent (repeated rows, NULL
    identifiers); an empty table gives an empty result; columns named ``ids`` give way.
    ``then``: columns to return in place of ``ids``, with a function that makes them from the
    ids of a block's documents in the task that reassembles them. ``again``: ``docs`` is a plain
    scan of files and is cut once for the lists and once for the positions.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    made = then[0] if then else T.StructType([T.StructField("ids", T.BinaryType())])
    carried = [c for c in keep_columns(docs, made.names) if c != text_col]
    row = docs.select(F.struct(*[F.col(identifier(c)) for c in carried], F.lit(0).alias("_")).alias("row"),
                      F.col(identifier(text_col)).alias("text"))
    row_type = row.schema["row"].dataType
    cut_type = T.StructType([T.StructField("block", T.LongType()), T.StructField("home", T.IntegerType()),     # a list: block, home, sizes, words
                             T.StructField("sizes", T.BinaryType()), T.StructField("words", T.BinaryType()),
                             T.StructField("row", row_type), T.StructField("number", T.IntegerType()),         # a text: block, row, number; the first
                             T.StructField("per", T.BinaryType()), T.StructField("at", T.BinaryType()),        # has the block's pre-tokens per text,
                             T.StructField("homes", T.BinaryType())])                                          # their places, the words' homes

    def blocks(batches: Iterator[pa.RecordBatch], keep: tuple[bool, bool] = (True, True)) -> Iterator[pa.RecordBatch]:
        """Lists and texts of every block, or one of the two."""
        split, part = splitter(pattern), TaskContext.get().partitionId()
        for k, b in enumerate(pieces(batches, "text", BLOCK)):
            words, places = split(texts(b.column("text")))
            coded = words.dictionary_encode()
            index = coded.indices.to_numpy(zero_copy_only=False)
            often = np.argsort(-np.bincount(index, minlength=len(coded.dictionary)), kind="stable")   # frequent words get low numbers
            number = np.empty(len(often), np.int64)
            number[often] = np.arange(len(often))
            raw, size = _flat(coded.dictionary.take(pa.array(often)))
            code = _hashes(raw, size)
            home = (code % np.uint64(parts)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            begin = np.cumsum(size) - size
            edge = np.searchsorted(home[order], np.arange(parts + 1))
            lists = [(h, _press(np.append(size[o], int(code[o].sum()) & 0xFFFFFFFF)), zstandard.compress(_gather(raw, begin[o], size[o]).tobytes(), 3))
                     for h, (i, j) in enumerate(zip(edge.tolist(), edge[1:].tolist(), strict=False)) if j > i and keep[0] for o in [order[i:j]]]
            if not keep[1]:
                b, places = b.slice(0, 0), []
            n, m, block = len(places), len(lists), (part << 24) + k
            at = number[index[np.concatenate(places)]] if n and len(index) else np.zeros(0, np.int64)
            # the words' homes, and two words of a check sum over the list
            homes = np.append(home, [int(code.sum()) & 0xFFFFFFFF, len(code)])
            first = lambda x: pa.array(([None] * m + [x] + [None] * n)[:m + n], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([block] * (m + n), pa.int64()), pa.array([x[0] for x in lists] + [None] * n, pa.int32()),
                 pa.array([x[1] for x in lists] + [None] * n, pa.binary()), pa.array([x[2] for x in lists] + [None] * n, pa.binary()),
                 pa.concat_arrays([pa.nulls(m, b.column("row").type), b.column("row")]),
                 pa.array([None] * m + list(range(n)), pa.int32()), first(_press(np.fromiter(map(len, places), np.int64, n))),
                 first(_press(at)), first(_press(homes))], names=cut_type.names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Merge each distinct word of this task's hash range once."""
        memory = Memory(bpe.load("bytes", ranks).encode, MEMORY)
        for b in pieces(batches, "words", 1 << 19):
            size = [_unpress(x) for x in b.column("sizes").to_pylist()]
            check, size = [int(x[-1]) for x in size], [x[:-1] for x in size]
            raw = b"".join(map(zstandard.decompress, b.column("words").to_pylist()))
            edge = np.concatenate([[0], np.cumsum(np.concatenate(size), dtype=np.int64)])
            words = pa.StringArray.from_buffers(len(edge) - 1, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(raw))
            flat, n = memory.ids(words)
            word, end = np.cumsum([0, *map(len, size)]).tolist(), np.concatenate([[0], np.cumsum(n)])
            done = [(_press(np.append(n[i:j], c)), _press(flat[end[i]:end[j]])) for i, j, c in zip(word, word[1:], check, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("block"), b.column("home"), pa.array([x[0] for x in done], pa.binary()),
                                              pa.array([x[1] for x in done], pa.binary())], names=["block", "home", "sizes", "ids"])

    if again:
        lists = row.mapInArrow(lambda x: blocks(x, (True, False)), cut_type)
        table = row.mapInArrow(lambda x: blocks(x, (False, True)), cut_type)
    else:
        table = staged(row.mapInArrow(blocks, cut_type), "bpe-blocks")
        lists, table = table.filter("home IS NOT NULL"), table.filter("home IS NULL")
    out = T.StructType([T.StructField("row", table.schema["row"].dataType), *made.fields])

    def reassemble(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks().sort_by("number"), right.combine_chunks().sort_by("home")
        per, at, home = (_unpress(left.column(c)[0].as_py()) for c in ("per", "at", "homes"))
        lists = [_unpress(x) for x in right.column("sizes").to_pylist()]
        join = lambda v: np.concatenate([np.zeros(0, "<u4"), *v])
        size, flat = join([x[:-1] for x in lists]).astype(np.int64), join([_unpress(x) for x in right.column("ids").to_pylist()])
        check, home = home[-2:].tolist(), home[:-2]
        if check != [sum(int(x[-1]) for x in lists) & 0xFFFFFFFF, len(size)]:
            raise RuntimeError("the input rows changed between two passes; do not ask for them to be cut twice")
        where = np.empty(len(home), np.int64)              # list number -> place among the returned words
        where[np.argsort(home, kind="stable")] = np.arange(len(home))
        begin, size = (np.cumsum(size) - size)[where], size[where]
        edge = np.concatenate([[0], np.cumsum(per, dtype=np.int64)]).tolist()
        ids = [_gather(flat, begin[x], size[x]) for x in (at[i:j] for i, j in zip(edge, edge[1:], strict=False))]
        arrays = then[1](ids) if then else [pa.array([x.tobytes() for x in ids], pa.binary())]
        return pa.table([left.column("row"), *arrays], names=out.names)

    merged = (lists.select("block", "home", "sizes", "words").repartition(parts, "home")
              .mapInArrow(merge, "block bigint, home int, sizes binary, ids binary"))
    placed = table.select("block", "row", "number", "per", "at", "homes")
    back = placed.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(reassemble, out)
    return back.select(*[F.col("row").getField(c).alias(c) for c in carried], *made.names)


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``bytes``: its ids joined with the token-byte table.

    NULL ids stay NULL; an id outside the vocabulary raises; columns named ``bytes`` give way.
    """
    carried = keep_columns(encoded, ["bytes"])
    schema = T.StructType([encoded.schema[c] for c in carried] + [T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(ranks)
        for b in pieces(batches, ids_col):
            out = [None if x is None else b"".join(table.joined(np.frombuffer(x, "<u4"))) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return encoded.select(*[F.col(identifier(c)) for c in carried]).mapInArrow(run, schema)


DIGESTS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                        T.StructField("decoded_sha256", T.StringType())])


def digests(ids: list[np.ndarray], ranks: str) -> list[pa.Array]:
    """Number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes."""
    table = token_table(ranks)
    decimal = decimals(len(table.size))

    def sha(pieces_of, cut_last):
        h, held = hashlib.sha256(), b""
        for x in pieces_of:
            h.update(held)
            held = x
        h.update(held[:-1] if cut_last else held)
        return h.hexdigest()
    return [pa.array([len(x) for x in ids], pa.int64()), pa.array([sha(decimal.joined(x), True) for x in ids], pa.string()),
            pa.array([sha(table.joined(x), False) for x in ids], pa.string())]


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents`` by the public 50k ranks."""
    import public_tokenizers
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", "text")
    made = encode(docs, ranks, public_tokenizers.PATTERN, then=(DIGESTS, lambda ids: digests(ids, ranks)), again=True)
    return made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
