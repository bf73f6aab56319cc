"""Pre-tokens of plain text by array operations, and a memory of words already encoded.

``cut`` splits a batch of texts at once: characters get a class from a table, and word
borders follow from changes of class. It covers the characters of ``PLAIN``; callers hand
any other text to a tokenizer library. Words stay views of one buffer, so no Python object
is made per word; Arrow's dictionary encoding finds the distinct ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Characters whose class is certain: ASCII, Latin-1 letters, common punctuation.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ‐-‧€]*")
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
CLASS = np.full(0x2100, OTHER, np.uint8)
for _c in range(0x100):
    if chr(_c).isalpha() and chr(_c) not in "ªµº":
        CLASS[_c] = LETTER
CLASS[ord("0"):ord("9") + 1] = DIGIT
CLASS[[9, 10, 13, 32]] = SPACE
# The endings that the public patterns cut off after an apostrophe.
SHORT, LONG = "stmd", ("re", "ve", "ll")


def cut(texts: list[str], spaces: bool) -> tuple[pa.Array, np.ndarray]:
    """(words, words per text) of plain ``texts``.

    ``spaces``: byte-level rule (a space joins the word behind it, other white space is words
    of its own, digits run together); else white space is dropped and each digit is a word.
    """
    joined = "".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = joined.encode()
    if not joined:
        return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
    if len(raw) == len(joined):
        code, wide = np.frombuffer(raw, np.uint8), None
    else:
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint16)
        wide = np.zeros(len(code) + 1, np.int64)
        np.cumsum(1 + (code > 0x7F) + (code > 0x7FF), out=wide[1:])
    kind = CLASS[code] if wide is not None else np.frombuffer(raw.translate(CLASS[:256].tobytes()), np.uint8)
    n = len(code)
    text_start = np.zeros(n + 1, bool)
    begin = np.cumsum(size) - size
    text_start[begin] = True                       # an empty text marks its neighbour's start or the end
    text_start[n] = True
    start = text_start[:n].copy()                  # a word begins here
    start[1:] |= kind[1:] != kind[:-1]
    if not spaces:
        start |= kind == DIGIT
    mark = np.flatnonzero(code == ord("'"))
    mark = mark[start[mark]]
    if spaces:                                     # behind a space the apostrophe belongs to the word that the space begins
        space = code == 32
        before = (mark > 0) & ~text_start[mark]
        mark = mark[~(before & space[mark - 1])]
    ends = np.zeros(0, np.int64)
    if len(mark):
        at = lambda k: np.where(mark + k < n, code[np.minimum(mark + k, n - 1)], 0)
        inside = lambda k: (mark + k < n) & ~text_start[np.minimum(mark + k, n)]
        one = inside(1) & np.isin(at(1), [ord(c) for c in SHORT])
        two = np.zeros(len(mark), bool)
        for a, b in LONG:
            two |= (at(1) == ord(a)) & (at(2) == ord(b))
        two &= inside(1) & inside(2) & ~one
        hit = one | two
        ends = (mark + 2 + two)[hit]
        start[mark[hit] + 1] = False
        ends = ends[(ends < n)]
        start[ends] = True
    if spaces:
        # the last white space before a word: a space joins it, any other stands alone
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~text_start[1:n])
        start[last] = True
        start[last[space[last]] + 1] = False
        first = np.flatnonzero(start)
    else:
        first = np.flatnonzero(start)
    stop = np.append(first[1:], n)
    if not spaces:
        keep = kind[first] != SPACE
        first, stop = first[keep], stop[keep]
    per = np.diff(np.searchsorted(first, np.append(begin, n)))
    if not spaces:                                 # words are not adjacent: drop the bytes between them
        solid = kind != SPACE
        if wide is None:
            raw = code[solid].tobytes()
            length = stop - first
        else:
            raw = np.frombuffer(raw, np.uint8)[np.repeat(solid, np.diff(wide))].tobytes()
            length = wide[stop] - wide[first]
        offsets = np.concatenate([[0], np.cumsum(length)])
    else:
        offsets = np.append(first, n) if wide is None else wide[np.append(first, n)]
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(raw))
    return words, per


class Memory:
    """Ids of words met before, as Arrow strings and one flat array; bounded by bytes.

    ``encode``: distinct words (list of text; ``arrow``: an Arrow array) -> (flat ids, ids per word).
    """

    def __init__(self, encode, limit: int = 6 << 20, arrow: bool = False):
        self.encode, self.limit, self.arrow = encode, limit, arrow
        self._clear()

    def _clear(self):
        self.words, self.flat, self.size, self.held = pa.array([], pa.string()), np.zeros(0, np.int32), np.zeros(0, np.int64), 0

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per word) of ``words``, repeats included."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        coded = words.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.words)
        new = np.flatnonzero(place.is_null().to_numpy(zero_copy_only=False))
        place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
        flat, size = self.flat, self.size
        if len(new):
            fresh = distinct.take(pa.array(new))
            more, count = self.encode(fresh if self.arrow else fresh.to_pylist())
            place[new] = len(size) + np.arange(len(new))
            flat = np.concatenate([flat, more.astype(np.int32)])
            size = np.concatenate([size, count])
            self.held += fresh.nbytes + 4 * len(more) + 8 * len(count)
            if self.held <= self.limit:
                self.words, self.flat, self.size = pa.concat_arrays([self.words, fresh]), flat, size
            else:
                self._clear()
        at = place.take(index)
        n = size.take(at)
        stop = np.cumsum(n)
        shift = (np.cumsum(size) - size).take(at) - (stop - n)
        return flat.take(np.repeat(shift, n) + np.arange(int(stop[-1]))), n


def per_text(n: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Ids per text from ids per word ``n`` and ``words`` per text."""
    total = np.concatenate([[0], np.cumsum(n)])
    end = np.cumsum(words)
    return total[end] - total[end - words]
