"""Byte-pair merges on ragged numpy arrays, shared by the tokenizer operators.

A vocabulary becomes a table (left symbol, right symbol) -> (rank, merged symbol). Many
sequences are held in one flat array; in every round each sequence applies its
lowest-rank pair, all of them at once, until no sequence has a pair of the table.

Nothing is trained here: tables come from the public vocabulary files.
"""

from __future__ import annotations

import base64
import functools
import heapq
import json

import numpy as np

NONE = np.int64(1 << 40)
LONG = 4000          # symbols; longer sequences are merged one by one with a heap (same result)
BATCH = 16_384       # words merged at once: bounds the arrays of a round
SHORT = 16           # symbols; shorter sequences of bytes are merged in columns of a matrix
NO_PAIR = np.int32((1 << 31) - 1)
LOWEST, HIGHEST = np.zeros(1 << SHORT, np.int8), np.zeros(1 << SHORT, np.int8)     # set bit of a number
for _b in range(SHORT):
    HIGHEST[1 << _b:2 << _b] = _b
    LOWEST[1 << _b::2 << _b] = _b


class MergeTable:
    """Open-addressing hash table from symbol pairs to (rank, merged symbol)."""

    def __init__(self, left, right, rank, merged, symbols: int):
        left, right = np.asarray(left, np.int64), np.asarray(right, np.int64)
        self.symbols = symbols
        keys = left * symbols + right
        self.bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NONE, np.int64)
        self.merged = np.zeros(size, np.int64)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.keys[slot[todo]] == -1
            now = todo[free]
            first = now[np.unique(slot[now], return_index=True)[1]]   # one key per slot and round
            at = slot[first]
            self.keys[at], self.rank[at], self.merged[at] = keys[first], np.asarray(rank)[first], np.asarray(merged)[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = np.where(self.keys[slot[todo]] != -1, (slot[todo] + 1) & (size - 1), slot[todo])

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left, right):
        """Table slots of the pairs, -1 where the table has none."""
        keys = left.astype(np.int64) * self.symbols + right
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, slot, -1)
        rest = np.flatnonzero((found != keys) & (found != -1))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[rest]]
            hit = found == keys[rest]
            out[rest[hit]] = slot[rest[hit]]
            rest = rest[~hit & (found != -1)]
        return out

    def ranks(self, left, right):
        s = self.look(left, right)
        return np.where(s >= 0, self.rank[s], NONE)


def merge(table: MergeTable, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every sequence to its end: (flat symbols, lengths) in the order given."""
    lengths = np.asarray(lengths, np.int64)
    long = np.flatnonzero(lengths > LONG)
    if len(long):
        starts = np.concatenate([[0], np.cumsum(lengths)])
        done = {int(i): merge_long(table, flat[starts[i]:starts[i + 1]]) for i in long}
        short = lengths.copy()
        short[long] = 0
        keep = np.repeat(short > 0, lengths)
        f, n = merge(table, flat[keep], short)
        ends = np.concatenate([[0], np.cumsum(n)])
        parts = [done[i] if i in done else f[ends[i]:ends[i + 1]] for i in range(len(n))]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
    count = len(lengths)
    seq = np.repeat(np.arange(count), lengths)
    sym = np.asarray(flat, np.int64).copy()
    rank = np.full(len(sym), NONE, np.int64)          # of the pair that begins here
    if len(sym) > 1:
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = table.ranks(sym[inner], sym[inner + 1])
    out_sym, out_seq = [], []
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        low = np.minimum.reduceat(rank, first)
        size = np.diff(np.append(first, len(sym)))
        open_ = low < NONE
        if not open_.all():                            # finished sequences leave
            mask = np.repeat(open_, size)
            out_sym.append(sym[~mask])
            out_seq.append(seq[~mask])
            sym, seq, rank = sym[mask], seq[mask], rank[mask]
            low, size = low[open_], size[open_]
            if not len(sym):
                break
        at = np.flatnonzero(rank == np.repeat(low, size))
        # leftmost first: of overlapping equal pairs (a a a) every other one
        touch = np.concatenate([[False], (np.diff(at) == 1) & (seq[at[1:]] == seq[at[:-1]])])
        if touch.any():
            run = np.flatnonzero(~touch)
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            at = at[place % 2 == 0]
        sole = np.concatenate([[True], seq[at[1:]] != seq[at[:-1]]])
        slot = table.look(sym[at], sym[at + 1])
        old = None if sole.all() else (sym, seq, rank, at, slot)
        sym, seq, rank, fresh = _apply(table, sym, seq, rank, at, slot)
        if old is not None:
            # a new pair below the rank just applied: those sequences apply one pair at a time
            bad = fresh[rank[fresh] < table.rank[old[4]][np.searchsorted(old[1][old[3]], seq[fresh])]]
            if len(bad):
                sym0, seq0, rank0, at0, slot0 = old
                one = sole | ~np.isin(seq0[at0], seq[bad])
                sym, seq, rank, _ = _apply(table, sym0, seq0, rank0, at0[one], slot0[one])
    if not out_sym:
        return np.zeros(0, np.int64), np.zeros(count, np.int64)
    s, q = np.concatenate(out_sym), np.concatenate(out_seq)
    order = np.argsort(q, kind="stable")
    return s[order], np.bincount(q, minlength=count).astype(np.int64)


def _apply(table, sym, seq, rank, at, slot):
    """Apply the pairs at ``at``; also the new positions whose pair rank was looked up."""
    sym, rank = sym.copy(), rank.copy()
    sym[at] = table.merged[slot]
    keep = np.ones(len(sym), bool)
    keep[at + 1] = False
    new = np.cumsum(keep) - 1
    sym, seq, rank = sym[keep], seq[keep], rank[keep]
    here = new[at]
    near = np.zeros(len(sym), bool)
    near[here] = near[np.maximum(here - 1, 0)] = True
    fresh = np.flatnonzero(near)
    nxt = np.minimum(fresh + 1, len(sym) - 1)
    inner = (nxt > fresh) & (seq[nxt] == seq[fresh])
    rank[fresh] = NONE
    rank[fresh[inner]] = table.ranks(sym[fresh[inner]], sym[nxt[inner]])
    return sym, seq, rank, fresh


def merge_long(table: MergeTable, seq: np.ndarray) -> np.ndarray:
    """One long sequence with a heap of (rank, position) and neighbour links."""
    sym = np.asarray(seq, np.int64).tolist()
    n = len(sym)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    s = table.look(np.asarray(seq[:-1]), np.asarray(seq[1:]))
    heap = [(int(table.rank[k]), int(i), sym[i], sym[i + 1], int(table.merged[k])) for i, k in enumerate(s) if k >= 0]
    heapq.heapify(heap)
    memo: dict = {}

    def offer(i):
        j = right[i]
        if j < 0:
            return
        pair = (sym[i], sym[j])
        if pair not in memo:
            k = int(table.look(np.array([pair[0]]), np.array([pair[1]]))[0])
            memo[pair] = (int(table.rank[k]), int(table.merged[k])) if k >= 0 else None
        if memo[pair]:
            heapq.heappush(heap, (memo[pair][0], i, *pair, memo[pair][1]))

    while heap:
        _, i, a, b, m = heapq.heappop(heap)
        j = right[i]
        if sym[i] != a or j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = m, -1
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return np.array([x for x in sym if x >= 0], np.int64)


class ShortMerges:
    """Merges of short sequences of bytes: a column a sequence, one pair of each merged in every round.

    For vocabularies in which a pair's rank is the symbol it becomes. A row of ``pair`` holds the rank of
    the pair that begins in that place, with the place, so that a minimum finds the leftmost lowest."""

    def __init__(self, table: MergeTable, start: np.ndarray):
        self.table, self.start = table, start.astype(np.int32)
        self.first = self._ranks(np.repeat(start, 256), np.tile(start, 256))     # of two bytes

    def _ranks(self, left, right):
        return np.minimum(self.table.ranks(left, right), NO_PAIR >> 4).astype(np.int32)

    def merge(self, raw: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat symbols, symbols per sequence) of the sequences of ``raw`` at ``begin``, none empty or over SHORT."""
        wide, count = int(lengths.max()), len(lengths)
        place, column = np.arange(wide, dtype=np.int32)[:, None], np.arange(count)
        byte = raw.take(np.minimum(begin + place, len(raw) - 1))
        sym = self.start.take(byte)
        pair = np.full((wide, count), NO_PAIR, np.int32)
        rank = self.first.take((byte[:-1].astype(np.int64) << 8) + byte[1:])
        known = (place[1:] < lengths) & (rank < NO_PAIR >> 4)
        np.copyto(pair[:-1], rank << 4 | place[:-1], where=known)
        alive = (1 << lengths) - 1
        done, done_alive, live = np.empty((count, wide), np.int32), np.empty(count, np.int64), column
        while count:
            low = pair.min(axis=0)
            going = low < NO_PAIR
            if not going.all():
                stop, go = np.flatnonzero(~going), np.flatnonzero(going)
                done[live[stop]], done_alive[live[stop]] = sym[:, stop].T, alive[stop]
                sym, pair = sym.take(go, axis=1), pair.take(go, axis=1)
                alive, live, low = alive[go], live[go], low[go]
                count, column = len(go), column[:len(go)]
                if not count:
                    break
            at, new = (low & 15).astype(np.int64), low >> 4
            bit = np.int64(1) << at
            above = alive & -(bit << 1)
            gone = LOWEST.take(above)                                      # the pair's right symbol
            above &= above - 1
            below, alive = alive & bit - 1, alive ^ (np.int64(1) << gone)
            flat_sym, flat_pair, here = sym.ravel(), pair.ravel(), at * count + column
            flat_sym[here] = new
            flat_pair[here] = flat_pair[gone * np.int64(count) + column] = NO_PAIR
            right, left = np.flatnonzero(above), np.flatnonzero(below)
            before = HIGHEST.take(below[left]).astype(np.int64)
            there = before * count + left
            after = flat_sym.take(LOWEST.take(above[right]) * np.int64(count) + right)
            rank = self._ranks(np.concatenate([new[right], flat_sym.take(there)]), np.concatenate([after, new[left]]))
            value = np.where(rank < NO_PAIR >> 4, rank << 4 | np.concatenate([at[right], before]).astype(np.int32), NO_PAIR)
            flat_pair[here[right]], flat_pair[there] = value[:len(right)], value[len(right):]
        chosen = (done_alive[:, None] >> np.arange(wide) & 1).astype(bool)
        return done[chosen], np.count_nonzero(chosen, axis=1)


def _batched(encode, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [encode(words[i:i + BATCH]) for i in range(0, len(words), BATCH)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([p[0].astype(np.int32) for p in parts]), np.concatenate([p[1] for p in parts])


def _splits(tokens: dict, rank_of) -> tuple[list, list, list, list]:
    """All ways to make a token of two symbols that are themselves known."""
    left, right, rank, merged = [], [], [], []
    for t, i in tokens.items():
        for k in range(1, len(t)):
            a, b = tokens.get(t[:k]), tokens.get(t[k:])
            if a is not None and b is not None:
                left.append(a)
                right.append(b)
                rank.append(rank_of(i))
                merged.append(i)
    return left, right, rank, merged


class ByteRanks:
    """Byte-level vocabulary from a rank file; symbols are token ids."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.tokens[i] = t
        self.start = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.table = MergeTable(*_splits(ranks, lambda i: i), symbols=len(self.tokens))
        self.short = ShortMerges(self.table, self.start) if len(self.tokens) < NO_PAIR >> 4 else None

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _batched(self._encode, words)

    def encode_array(self, words) -> tuple[np.ndarray, np.ndarray]:
        """The same of an Arrow string array without nulls, from its bytes."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        byte = np.frombuffer(data or b"", np.uint8)
        done = [self._bytes(byte[o[0]:o[-1]], np.diff(o)) for o in (offsets[i:i + BATCH + 1] for i in range(0, len(words), BATCH))]
        return np.concatenate([d[0] for d in done]).astype(np.int32), np.concatenate([d[1] for d in done])

    def _encode(self, words):
        raw = [w.encode() for w in words]
        return self._bytes(np.frombuffer(b"".join(raw), np.uint8), np.fromiter(map(len, raw), np.int64, len(raw)))

    def _bytes(self, byte, n):
        if self.short is None:
            return merge(self.table, self.start[byte], n)
        begin, size = np.cumsum(n) - n, np.zeros(len(n), np.int64)
        kinds = [np.flatnonzero((n > a) & (n <= b)) for a, b in ((0, SHORT // 2), (SHORT // 2, SHORT))]
        done = [(k, *self.short.merge(byte, begin[k], n[k])) for k in kinds if len(k)]
        long = np.flatnonzero(n > SHORT)
        if len(long):
            done.append((long, *merge(self.table, self.start[byte[np.repeat(n > SHORT, n)]], n[long])))
        for k, _, m in done:
            size[k] = m
        out, first = np.empty(int(size.sum()), np.int64), np.cumsum(size) - size
        for k, sym, m in done:
            out[np.repeat(first[k] - (np.cumsum(m) - m), m) + np.arange(len(sym))] = sym
        return out, size


class WordMerges:
    """Vocabulary with a word-end mark and an ordered merge list; symbols are token ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.mark = model["vocab"], model["end_of_word_suffix"]
        left, right, rank, merged = [], [], [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left.append(vocab[a])
            right.append(vocab[b])
            rank.append(r)
            merged.append(vocab[a + b])
        self.table = MergeTable(left, right, rank, merged, symbols=max(vocab.values()) + 1)
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + self.mark] for c in chars], np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return _batched(self._encode, words)

    def _encode(self, words):
        raw = [w.encode() for w in words]
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        byte = np.frombuffer(b"".join(raw), np.uint8)
        flat = self.inner[byte]
        ends = np.cumsum(n) - 1
        # the mark belongs to the last character of the byte-to-character form: its last byte
        flat[ends] = self.last[byte[ends]]
        return merge(self.table, flat, n)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Pieces:
    """Piece vocabulary with byte fallback; symbols are piece numbers, then single characters
    of pieces that are none themselves, then ``unknown + bytes`` for other characters."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        usual = [i for i in range(sp.get_piece_size())
                 if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        known = {sp.id_to_piece(i): i for i in usual}
        self.pieces = sp.get_piece_size()
        extra = sorted({c for p in known for c in p} - set(known))
        self.unknown = self.pieces + len(extra)
        self.cost = np.ones(self.unknown + 5, np.int64)     # tokens that a surviving symbol stands for
        for k, c in enumerate(extra):
            self.cost[self.pieces + k] = len(c.encode())
        self.cost[self.unknown:] = np.arange(5)
        order = sorted(usual, key=lambda i: (-sp.get_score(i), i))
        ranks = {i: r for r, i in enumerate(order)}
        left, right, rank, merged = _splits({**known, **{c: self.pieces + k for k, c in enumerate(extra)}},
                                            lambda i: ranks.get(i, -1))
        good = [i for i, m in enumerate(merged) if m < self.pieces]
        pick = lambda x: [x[i] for i in good]
        self.table = MergeTable(pick(left), pick(right), pick(rank), pick(merged), symbols=self.unknown + 5)
        self.by_char = np.full(0x110000, -1, np.int32)
        for p, i in known.items():
            if len(p) == 1:
                self.by_char[ord(p)] = i
        for k, c in enumerate(extra):
            self.by_char[ord(c)] = self.pieces + k

    def counts(self, words: list[str]) -> np.ndarray:
        """Tokens of each word: the merged symbols, unknown characters by their bytes."""
        return np.concatenate([self._counts(words[i:i + BATCH]) for i in range(0, len(words), BATCH)] or [np.zeros(0, np.int64)])

    def _counts(self, words):
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        flat = self.by_char[code].astype(np.int64)
        strange = flat < 0
        if strange.any():
            c = code[strange]
            flat[strange] = self.unknown + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        sym, n = merge(self.table, flat, np.fromiter(map(len, words), np.int64, len(words)))
        total = np.concatenate([[0], np.cumsum(self.cost[sym])])
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]


@functools.lru_cache(maxsize=4)
def load(kind: str, path: str):
    """A vocabulary, read once per Python process."""
    return {"bytes": ByteRanks, "words": WordMerges, "pieces": Pieces}[kind](path)
