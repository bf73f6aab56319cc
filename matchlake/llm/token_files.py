"""Token ids in binary files, compressed by an adaptive context-mixing range coder.

A block of ids is coded by itself: its model starts empty and its checksums are its own.
Before each id the model gives three predictions from what the block has shown so far:
order 2 (the id that last followed the previous two), order 1 (the id that last followed the
previous one) and order 0 (counts of all ids, refreshed at growing steps, on top of one for
every id of the vocabulary). Orders 2 and 1 carry a confidence; for each pair of confidences
adaptive weights mix the three into one distribution, in which the range coder (64-bit
low and range, carries, 32-bit words) codes the id.

All blocks of a batch advance in step, one id of each at a time, as numpy arrays ("lanes"),
in encoding and decoding alike, so both see the same model.

Files: Spark's text writer puts one frame per record, separated by a mark that frames
never contain (a frame's body is masked by a 32-bit nonce; among the first as many nonces
as it has positions one is free of the mark). So files are committed like any other table, can be on any
store Spark writes to, and are split at marks when read. A frame holds whole documents:
header (part, place, counts), identifiers and lengths, block index with checksums, words.

Documents ascend by identifier over the files; ranges are cut by (identifier, text hash,
row), so neither a hot identifier nor a hot source fills one range.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe
from .common import documents, identifier, pieces, shuffle_partitions, texts
from .pretokens import PLAIN, Memory, cut, per_text

BLOCK = 2048                  # ids in a block
LANES = 4096                  # blocks coded in step, those of several frames
FRAME = 1024                  # blocks in a frame of more than one document
AT_ONCE = 1 << 16             # ids whose tables are built together, so that they stay in the cache
SHIFT = 8                     # of the multiples before which begins are counted
STEP = 32                     # what one occurrence adds to an id's order-0 count of 1
BITS = 12                     # of a context's slot
MARK = "\n--end of token frame--\n"
MAGIC = b"TKF1"
HEAD = struct.Struct("<4sIIIQQIIII")   # magic, nonce, part, frame, ids before, ids, documents, blocks, bytes of the document table, crc of the body
INDEX = np.dtype([("ids", "<u4"), ("words", "<u4"), ("crc_ids", "<u4"), ("crc_words", "<u4")])
U32, ONE = np.uint64(32), np.uint64(1)
FLOOR = np.uint64(1 << 32)

K1, K2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
# change of a context's confidence (0-7) after a hit, after a miss; after a miss at 0 or 1 the id is replaced
CHANGE = np.array([1] * 7 + [0] + [(c >> 1) - c for c in range(8)], np.int32)
CHANGE_TWO = np.repeat(CHANGE << 3, 8)


class Model:
    """Predictions of orders 0 to 2 for ``lanes`` blocks of ids below ``symbols``.

    Ids are held as (id + 1) << 6, the lowest six bits are for confidences: order 1 uses the lower
    three, order 2 the upper three. Choices between lanes are made by masks (-1: yes, 0: no).
    """

    def __init__(self, lanes: int, symbols: int):
        if symbols + STEP * BLOCK >= 1 << 20:
            raise ValueError("the vocabulary is too large for the coder's precision")
        self.base, self.keys = np.arange(lanes, dtype=np.int64) << BITS, np.arange(lanes, dtype=np.int64) << 7
        self.one, self.two = (np.zeros(lanes << BITS, np.int32) for _ in range(2))     # successor, confidence
        start = np.array([(65536 * c) // (c + 2) for c in range(8)], np.uint32)
        by = np.arange(128)
        # of 65536, below 65506: upper half the chance that order 2 is right, lower half that order 1 is, if order 2 is not
        self.p = np.tile(start[by >> 3 & 7] << np.uint32(16) | np.where(by >= 64, 0, start[by & 7]).astype(np.uint32), lanes)
        first = np.full(lanes, symbols, np.uint32)
        self.g = first * K2
        self._slots(first)

    def _slots(self, x):
        h, m = x * K1, len(x)
        two, shift = h + self.g[:m], np.uint32(32 - BITS)
        self.i1, self.i2 = self.base[:m] + (h >> shift), self.base[:m] + (two >> shift)
        self.g = x * K2

    def predict(self, m: int):
        """For the first ``m`` lanes: weights of orders 2 and 1 of 4096."""
        if m < len(self.i1):
            self.i1, self.i2 = self.i1[:m], self.i2[:m]
        self.e1, self.e2 = e1, e2 = self.one.take(self.i1), self.two.take(self.i2)
        same = ((e1 ^ e2) - 64 >> 31) & 64
        self.k = self.keys[:m] + ((e1 + e2 & 63) + same)
        q = self.p.take(self.k)
        self.q2, self.q1 = (q >> np.uint32(16)).view(np.int32), (q & np.uint32(0xFFFF)).view(np.int32)
        w2 = np.minimum(np.maximum(self.q2 >> 4, 1), 4093)
        w1 = 1 + ((4094 - w2) * (self.q1 >> 4) >> 12)
        return w2, w1

    def hits(self, x):
        """Masks: order 2 is right about ``x`` (held as above), order 1 is (both may be)."""
        self.z2, self.z1 = self.e2 ^ x, self.e1 ^ x
        self.n2, self.n1 = self.z2 - 64 >> 31, self.z1 - 64 >> 31
        return self.n2, self.n1

    def update(self, x):
        j = np.minimum(self.z1, self.z1 & 7 | 8)                        # confidence, 8 more after a miss
        new, keep = self.e1 + CHANGE.take(j), ((j | 1) ^ 9) - 1 >> 31
        self.one[self.i1] = new ^ ((new ^ (x | 1)) & keep)
        j = np.minimum(self.z2, self.z2 & 56 | 64)
        new, keep = self.e2 + CHANGE_TWO.take(j), ((j | 8) ^ 72) - 1 >> 31
        self.two[self.i2] = new ^ ((new ^ (x | 8)) & keep)
        q2 = self.q2 + ((self.n2 & 65536) - self.q2 >> 5)
        q1 = self.q1 + (((self.n1 & 65536) - self.q1 >> 5) & ~self.n2)
        self.p[self.k] = (q2 << 16 | q1).view(np.uint32)
        self._slots((x >> 6).view(np.uint32) - np.uint32(1))


def _epochs(longest: int) -> list[int]:
    """Steps at which the order-0 counts are refreshed."""
    out, t = [0], 32
    while t < longest:
        out.append(t)
        t += max(32, t // 4)
    return out


class Counts:
    """Order-0 counts of the ids each lane has shown by some step."""

    def __init__(self, seen: np.ndarray, symbols: int):
        self.lanes, self.t = seen.shape
        self.symbols, self.total = symbols, symbols + STEP * self.t
        self.ids, self.low = seen.astype(np.int32), None
        self.ids.sort(axis=1)

    def share(self, lane, x):
        """(low, frequency) of ids ``x``."""
        wide = np.int64(self.total + 1)
        row = np.arange(self.lanes, dtype=np.int64)[:, None] * wide
        below, upto = (np.searchsorted((self.ids + row).ravel(), x + lane * wide, side) for side in ("left", "right"))
        return x + STEP * (below - lane * self.t), 1 + STEP * (upto - below)

    def _table(self):
        """Where the shares of the ids seen begin, and how many begin before each multiple of 2 ** shift.

        They are more than STEP apart, so few begin between two multiples. In ``low`` a lane has
        a begin below all, its ids in order, as many beyond all as a search may look past the end."""
        lanes, t = self.ids.shape
        self.shift = max(SHIFT, (self.total >> 11).bit_length())
        self.ahead, self.row = 1 << self.shift - 5, (self.total >> self.shift) + 1
        self.before, low, place, held = np.empty(lanes * self.row, np.int32), [], [], 0
        rows = max(8, AT_ONCE // t)
        for i in range(0, lanes, rows):
            ids = self.ids[i:i + rows]
            n, lane = len(ids), np.arange(len(ids), dtype=np.int64)
            new = np.ones((n, t), bool)
            np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
            run = np.flatnonzero(new)
            size = np.diff(run, append=n * t)
            own = np.repeat(lane, np.count_nonzero(new, axis=1))
            first = run - own * t                        # occurrences of smaller ids
            begin = ids.ravel().take(run) + STEP * first
            at = np.arange(1, len(run) + 1) + own * (1 + self.ahead)
            low.append(np.full(len(run) + n * (1 + self.ahead), np.iinfo(np.int32).max, np.int32))
            place.append(np.zeros(len(low[-1]), np.int32))
            low[-1][at], place[-1][at] = begin, first << 12 | size
            count = np.bincount((begin >> self.shift) + own * self.row, minlength=n * self.row)
            sums = (np.cumsum(count) - count).reshape(n, self.row) + (held + lane * (1 + self.ahead))[:, None]
            low[-1][sums[:, 0] - held] = -1 << 30
            self.before[i * self.row:(i + n) * self.row] = sums.ravel()
            held += len(low[-1])
        self.low, self.place = np.concatenate(low), np.concatenate(place)

    def find(self, lane, v):
        """(id, low, frequency) of the share that holds ``v``."""
        if not self.t:
            return v, v, np.ones(len(v), np.int64)
        if self.low is None:
            self._table()
        v = v.astype(np.int32)
        at = self.before.take(lane * self.row + (v >> self.shift)).astype(np.int64)
        step = self.ahead
        while step:                                      # the last that begins at or before v, in all lanes at once
            at += (self.low.take(at + step) <= v) * np.int64(step)
            step >>= 1
        over, place = v - self.low.take(at), self.place.take(at)
        extra = (place & 4095) * STEP
        inside = over - extra - 1 >> 31                  # mask: v is in that share; else it is the share of an id not seen
        low = v - (over & inside)
        return low - (place >> 12) * STEP - (extra & ~inside), low, 1 + (extra & inside)


def _shares(ids: np.ndarray, epochs: list[int]) -> np.ndarray:
    """Of each id (a row a step, a column a lane) the occurrences before its epoch of smaller ids and
    of the same id, as one number: the first times 4096 plus the second.

    ``ids``: a row a lane. Each row is sorted once, then an id's occurrences are a run in order of step;
    running counts of what each epoch has seen, 12 bits an epoch and five in a number, answer for all epochs."""
    lanes, longest = ids.shape
    out = np.empty((longest, lanes), np.int32)
    bits = max(1, (longest - 1).bit_length())
    epoch = np.searchsorted(epochs, np.arange(longest), side="right") - 1
    words = (len(epochs) + 4) // 5
    adds = np.zeros((words, longest), np.int64)                # by step
    for k, t in enumerate(epochs):
        adds[k // 5, :t] += 1 << 12 * (k % 5)
    word, shift = epoch // 5, 12 * (epoch % 5)
    rows = max(8, AT_ONCE // longest)
    for i in range(0, lanes, rows):
        key = ids[i:i + rows].astype(np.int64 if bits > 11 else np.int32) << bits | np.arange(longest, dtype=np.int32)
        key.sort(axis=1)
        n, step = len(key), (key & (1 << bits) - 1).astype(np.int64)
        new = np.ones((n, longest), bool)
        np.greater(key[:, 1:] ^ key[:, :-1], (1 << bits) - 1, out=new[:, 1:])
        run = np.flatnonzero(new)
        seen = np.empty((words, n, longest + 1), np.int64)
        seen[:, :, 0] = 0
        for k in range(words):
            np.cumsum(adds[k].take(step), axis=1, out=seen[k, :, 1:])
        seen = seen.ravel()
        here = np.arange(n, dtype=np.int64)[:, None] * (longest + 1) + np.arange(longest)
        begin = np.repeat(here.ravel()[run], np.diff(run, append=n * longest)).reshape(n, longest)
        which, by = word.take(step) * (n * (longest + 1)), shift.take(step)
        below = seen.take(which + begin) >> by & 4095
        upto = seen.take(which + here) >> by & 4095
        part = np.empty(longest * n, np.int32)
        part[step * n + np.arange(n)[:, None]] = below << 12 | upto - below
        out[:, i:i + n] = part.reshape(longest, n)
    return out


def _lanes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(-lengths, kind="stable")
    return order, lengths[order]


def encode_blocks(blocks: list[np.ndarray], symbols: int) -> list[bytes]:
    """Words of each block of ids (all below ``symbols``, none empty)."""
    if len(blocks) > LANES:
        return [w for i in range(0, len(blocks), LANES) for w in encode_blocks(blocks[i:i + LANES], symbols)]
    lanes = len(blocks)
    order, length = _lanes(np.array([len(b) for b in blocks], np.int64))
    longest = int(length[0])
    ids = np.zeros((lanes, longest), np.int32)
    for k, b in enumerate(order.tolist()):
        ids[k, :length[k]] = blocks[b]
    model, low, wide = Model(lanes, symbols), np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
    out, pos = np.zeros((lanes, longest + 4), np.uint64), np.zeros(lanes, np.int64)
    active = np.searchsorted(-length, -np.arange(longest), side="left")        # lanes longer than t
    epochs = _epochs(longest)
    flat_out, row = out.ravel(), np.arange(lanes, dtype=np.int64) * out.shape[1]
    share, by_step = _shares(ids, epochs), np.ascontiguousarray(ids.T)
    del ids
    for begin, end in zip(epochs, [*epochs[1:], longest], strict=True):
        total = np.uint64(symbols + STEP * begin)
        for t in range(begin, end):
            m = int(active[t])
            x = by_step[t, :m] + 1 << 6
            if m < len(low):
                low_done, wide_done = low[m:], wide[m:]
                _flush(flat_out, row, pos, low_done, wide_done, m)
                low, wide = low[:m], wide[:m]
            w2, w1 = model.predict(m)
            n2, n1 = model.hits(x)
            r, n0 = wide >> np.uint64(12), ~(n2 | n1)
            # share of the mix: order 2, then order 1, then order 0 with the rest
            both = w2 + w1
            f = w2 & n2 | w1 & n1 & ~n2 | (4096 - both) & n0
            add = r * (w2 & ~(n2 | n0) | both & n0).astype(np.uint64)
            wide = r * f.astype(np.uint64)
            miss = np.flatnonzero(n0)
            if len(miss):
                r0, count = wide.take(miss) // total, share[t].take(miss)
                add[miss] += r0 * (by_step[t].take(miss) + STEP * (count >> 12)).astype(np.uint64)
                wide[miss] = r0 * (1 + STEP * (count & 4095)).astype(np.uint64)
            new = low + add
            carry = np.flatnonzero(new < low)
            if len(carry):
                flat_out[row[carry] + pos[carry] - 1] += ONE
            low = new
            small = np.flatnonzero(wide < FLOOR)
            if len(small):
                at, value = pos.take(small), low.take(small)
                flat_out[row.take(small) + at] = value >> U32
                pos[small] = at + 1
                low[small] = value << U32
                wide[small] = wide.take(small) << U32
            model.update(x)
    del model, share, by_step
    _flush(flat_out, row, pos, low, wide, 0)
    out = out[:, :int(pos.max())]
    over = out >> U32
    while over.any():                                           # carries run to the left
        out &= np.uint64(0xFFFFFFFF)
        out[:, :-1] += over[:, 1:]
        over = out >> U32
    words = out.astype("<u4")
    done = [b""] * lanes
    for k, b in enumerate(order.tolist()):
        done[b] = words[k, :pos[k]].tobytes()
    return done


def _flush(flat_out, row, pos, low, wide, first):
    """End the lanes from ``first`` on: one word that lies inside their last interval."""
    lane = first + np.arange(len(low))
    value = low + np.uint64(0xFFFFFFFF)
    carry = lane[value < low]
    flat_out[row[carry] + pos[carry] - 1] += ONE
    flat_out[row[lane] + pos[lane]] = value >> U32
    pos[lane] += 1


def decode_blocks(words: list[np.ndarray], lengths: list[int], symbols: int) -> list[np.ndarray]:
    """Ids of each block from its words and number of ids."""
    if len(words) > LANES:
        return [x for i in range(0, len(words), LANES) for x in decode_blocks(words[i:i + LANES], lengths[i:i + LANES], symbols)]
    lanes = len(words)
    order, length = _lanes(np.array(lengths, np.int64))
    longest, wide_most = int(length[0]), max(map(len, words)) + 3
    data = np.zeros((lanes, wide_most), np.uint64)
    for k, b in enumerate(order.tolist()):
        data[k, :len(words[b])] = words[b]
    flat, at = data.ravel(), np.arange(lanes, dtype=np.int64) * wide_most + 2
    code, wide = (data[:, 0] << U32) | data[:, 1], np.full(lanes, (1 << 64) - 1, np.uint64)
    ids, model = np.zeros((lanes, longest), np.int32), Model(lanes, symbols)
    by_step = np.zeros((longest, lanes), np.int32)              # held as in the model
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    epochs = _epochs(longest)
    for begin, end in zip(epochs, [*epochs[1:], longest], strict=True):
        counts = Counts(ids[:int(active[begin]), :begin], symbols)
        total = np.uint64(counts.total)
        for t in range(begin, end):
            m = int(active[t])
            if m < len(code):
                code, wide, at = code[:m], wide[:m], at[:m]
            w2, w1 = model.predict(m)
            r = wide >> np.uint64(12)
            both = w2 + w1
            hit2, known = code < r * w2.astype(np.uint64), code < r * both.astype(np.uint64)
            n2, n0 = -hit2.astype(np.int32), known.astype(np.int32) - 1
            n1 = ~(n2 | n0)
            x = (model.e2 & n2 | model.e1 & n1) & -64
            wide = r * (w2 & n2 | w1 & n1 | (4096 - both) & n0).astype(np.uint64)
            code = code - r * (w2 & n1 | both & n0).astype(np.uint64)
            miss = np.flatnonzero(n0)
            if len(miss):
                r0, c = wide.take(miss) // total, code.take(miss)
                v = np.minimum(c // r0, total - ONE).astype(np.int64)
                found, low, f = counts.find(miss, v)
                x[miss] = found + 1 << 6
                code[miss] = c - r0 * low.astype(np.uint64)
                wide[miss] = r0 * f.astype(np.uint64)
            small = np.flatnonzero(wide < FLOOR)
            if len(small):
                place = at.take(small)
                code[small] = (code.take(small) << U32) | flat.take(place, mode="clip")
                wide[small] = wide.take(small) << U32
                at[small] = place + 1
            by_step[t, :m] = x
            model.hits(x)
            model.update(x)
        ids[:, begin:end] = (by_step[begin:end] >> 6).T - 1
    out: list = [None] * lanes
    for k, b in enumerate(order.tolist()):
        out[b] = ids[k, :length[k]].astype("<u4")
    return out


def _crc(x) -> int:
    return zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes())


def make_frame(part: int, number: int, before: int, doc_ids: list, lengths: np.ndarray, ids: np.ndarray, symbols: int) -> bytes:
    """One frame of whole documents: their identifiers, lengths and coded ids."""
    return next(make_frames(part, [(number, before, doc_ids, lengths, ids)], symbols))


def make_frames(part: int, frames: list[tuple], symbols: int) -> Iterator[bytes]:
    """Frames, each (number, ids before, identifiers, lengths, ids); the blocks of all advance in step."""
    cut = [[ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK)] for *_, ids in frames]
    blocks_of_all = [b for blocks in cut for b in blocks]
    coded = iter(encode_blocks(blocks_of_all, symbols) if blocks_of_all else [])
    for (number, before, doc_ids, lengths, ids), blocks in zip(frames, cut, strict=True):
        yield _frame(part, number, before, doc_ids, lengths, len(ids), blocks, [next(coded) for _ in blocks])


def _frame(part, number, before, doc_ids, lengths, n_ids, blocks, words) -> bytes:
    index = np.array([(len(b), len(w) // 4, _crc(b), zlib.crc32(w)) for b, w in zip(blocks, words, strict=True)], INDEX)
    table = zlib.compress(np.array([i is None for i in doc_ids], np.uint8).tobytes()
                          + np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes() + lengths.astype("<i8").tobytes(), 6)
    body = table + index.tobytes() + b"".join(words)
    body += b"\0" * (-len(body) % 4)
    crc, mark, plain, nonce = zlib.crc32(body), MARK.encode(), np.frombuffer(body, "<u4"), 0
    while True:
        head = HEAD.pack(MAGIC, nonce, part, number, before, n_ids, len(doc_ids), len(blocks), len(table), crc)
        frame = head + (plain ^ np.uint32(nonce)).tobytes()
        if (frame + mark).find(mark) == len(frame):
            return frame
        nonce += 1


class Frame:
    """A frame as read; raises where a checksum does not hold."""

    def __init__(self, raw: bytes):
        (magic, nonce, self.part, self.number, self.before, self.n_ids, n_docs, n_blocks, n_table, crc) = HEAD.unpack_from(raw)
        body = (np.frombuffer(raw, "<u4", offset=HEAD.size) ^ np.uint32(nonce)).tobytes()
        if magic != MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged token frame")
        table = zlib.decompress(body[:n_table])
        null, value = np.frombuffer(table, np.uint8, n_docs), np.frombuffer(table, "<i8", n_docs, n_docs)
        self.ids, self.lengths = pa.array(value, mask=null == 1), np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
        self.index = np.frombuffer(body, INDEX, n_blocks, n_table)
        words = np.frombuffer(body, "<u4", int(self.index["words"].sum(dtype=np.int64)), n_table + n_blocks * INDEX.itemsize)
        self.words = np.split(words, np.cumsum(self.index["words"], dtype=np.int64)[:-1]) if n_blocks else []
        if any(_crc(w) != c for w, c in zip(self.words, self.index["crc_words"].tolist(), strict=True)):
            raise ValueError("damaged block of token ids")


def part_and_ids(head: bytes) -> tuple[int, int]:
    """A frame's part and number of ids, from its header alone."""
    fields = HEAD.unpack(head)
    return fields[2], fields[5]


def decode_frames(frames: list[Frame], symbols: int) -> list[np.ndarray]:
    """Ids of each frame; its blocks and those of the other frames advance in step."""
    words = [w for f in frames for w in f.words]
    lengths = [n for f in frames for n in f.index["ids"].tolist()]
    done, out = iter(decode_blocks(words, lengths, symbols) if words else []), []
    for f in frames:
        blocks = [next(done) for _ in f.words]
        if any(_crc(b) != c for b, c in zip(blocks, f.index["crc_ids"].tolist(), strict=True)):
            raise ValueError("block of token ids does not decode to what was written")
        out.append(np.concatenate(blocks) if blocks else np.zeros(0, "<u4"))
    return out


class ByteTokenizer:
    """Ids of the public byte-level vocabulary as the tokenizers library gives them; plain
    texts are cut by arrays and each distinct word is merged once while it is remembered."""

    def __init__(self, path: str, ranks: str):
        self.path, self._whole = path, None
        self.memory = Memory(bpe.load("bytes", ranks).encode_array, 24 << 20, arrow=True)

    def whole(self):
        """The library's tokenizer, loaded where a text needs it."""
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    def encode(self, batch: list[str]) -> list[np.ndarray]:
        plain = ["<|" not in t and PLAIN.fullmatch(t) is not None for t in batch]
        words, per = cut([t for t, ok in zip(batch, plain, strict=True) if ok], spaces=True)
        flat, n = self.memory.ids(words)
        done = iter(np.split(flat, np.cumsum(per_text(n, per))[:-1]) if len(per) else [])
        return [next(done) if ok else np.array(self.whole().encode(t, add_special_tokens=False).ids, np.int32)
                for t, ok in zip(batch, plain, strict=True)]


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str, ranks: str) -> ByteTokenizer:
    """One for all tasks of a Python process: words met in one task are known in the next."""
    return ByteTokenizer(path, ranks)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, ranks: str, id_col: str = "doc_id", text_col: str = "text",
                 end: int = 2, partitions: int | None = None) -> None:
    """Write every text's ids, then ``end``, as token files under ``path``.

    ``vocabulary``: a byte-level file of the tokenizers library, ``ranks``: the same vocabulary as ranks.
    Documents ascend by identifier (integers; NULL first), equal ones by a hash of the text; a NULL text is empty
    (its document is ``end`` alone), repeated rows are written each, an empty table gives files without
    frames. A long text gets a frame of its own, whatever its length. Other columns are not read.
    """
    from tokenizers import Tokenizer
    parts = partitions or shuffle_partitions(docs.sparkSession)
    symbols = max(Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True), end + 1)
    rows = docs.select(F.col(identifier(id_col)).cast("long").alias("id"), F.coalesce(F.col(identifier(text_col)), F.lit("")).alias("text"))
    rows = rows.withColumn("salt", F.monotonically_increasing_id())          # equal rows may fill several ranges
    ordered = rows.repartitionByRange(parts, "id", F.xxhash64("text"), "salt").sortWithinPartitions("id", F.xxhash64("text"), "text").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokenizer, last = TaskContext.get().partitionId(), _tokenizer(vocabulary, ranks), np.array([end], np.int32)
        number = before = held = blocks = 0
        doc_ids, parts_of, waiting = [], [], []

        def close():
            nonlocal number, before, held, blocks, doc_ids, parts_of
            ids = np.concatenate([x for pair in parts_of for x in pair])
            waiting.append((number, before, doc_ids, np.array([len(a) + len(b) for a, b in parts_of], np.int64), ids))
            blocks += -(-len(ids) // BLOCK)
            number, before, held, doc_ids, parts_of = number + 1, before + len(ids), 0, [], []

        def coded():
            nonlocal blocks
            for made in make_frames(part, waiting, symbols):
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["frame"])
            blocks = 0
            waiting.clear()

        for b in pieces(batches, "text", 4 << 20):
            for i, ids in zip(b.column("id").to_pylist(), tokenizer.encode(texts(b.column("text"))), strict=True):
                if held and held + len(ids) + 1 > FRAME * BLOCK:
                    close()
                    if blocks + FRAME > LANES:
                        yield from coded()
                doc_ids.append(i)
                parts_of.append((ids, last))
                held += len(ids) + 1
        if held:
            close()
        yield from coded()

    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", MARK).text(path)


def read_tokens(spark: SparkSession, path: str, symbols: int) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from token files: ``start`` counts the ids of all documents
    before, ``ids`` are little-endian unsigned 32-bit. Raises on a damaged frame or block."""
    raw = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary").alias("frame"))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [part_and_ids(x) for x in b.column("head").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64())], names=["part", "n"])

    sums = raw.select(F.substring("frame", 1, HEAD.size).alias("head")).mapInArrow(heads, "part bigint, n bigint")
    first, before = {}, 0
    for r in sorted(sums.groupBy("part").agg(F.sum("n").alias("n")).collect()):      # a row per file written
        first[r.part], before = before, before + r.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents_of(frames):
            for f, ids in zip(frames, decode_frames(frames, symbols), strict=True):
                n = f.lengths
                begin = np.cumsum(n) - n
                ends = pa.py_buffer(np.append(begin, len(ids)).astype(np.int32) * 4) if len(ids) < 1 << 28 else None
                data = (pa.Array.from_buffers(pa.binary(), len(n), [None, ends, pa.py_buffer(ids.tobytes())]) if ends is not None
                        else pa.array([ids[i:i + k].tobytes() for i, k in zip(begin, n, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays([f.ids, pa.array(first[f.part] + f.before + begin), pa.array(n), data],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
        frames, lanes = [], 0
        for b in batches:
            for x in b.column("frame"):
                f = Frame(x.as_py())
                if frames and lanes + len(f.words) > LANES:
                    yield from documents_of(frames)
                    frames, lanes = [], 0
                frames.append(f)
                lanes += len(f.words)
        if frames:
            yield from documents_of(frames)

    return raw.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    """Write the ids of every whole text of ``documents`` as token files and read them back."""
    import public_tokenizers
    from tokenizers import Tokenizer
    vocabulary, path = public_tokenizers.path("byte_bpe_50k.json"), scratch_path(spark, "token-files")
    write_tokens(documents(spark, sf_dir), path, vocabulary, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    back = read_tokens(spark, path, Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
