"""Array pre-tokens against the patterns, and the memory of encoded words."""

import random
import re

import numpy as np
import pyarrow as pa

from matchlake.llm.pretokens import PLAIN, Memory, cut, per_text

BYTE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+")
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def test_equal_to_the_patterns():
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcdest mreveLl'''  \n\t\r09!.-é€–À") for _ in range(rng.randrange(30))) for _ in range(5000)]
    texts += ["", "'", "''s", " 's", "\n's", "a  's", "'re've'llx", "  ", "x \n", "'l", "'r", "e", "'", "s", "ÿ" * 500]
    for spaces, pattern in ((True, BYTE), (False, WORD)):
        batch = texts if spaces else [t.lower() for t in texts]
        assert all(PLAIN.fullmatch(t) for t in batch)
        for part in (batch, batch[:1], batch[-1:], ["", ""], []):
            words, per = cut(part, spaces)
            got, at = words.to_pylist(), np.concatenate([[0], np.cumsum(per)])
            assert [got[i:j] for i, j in zip(at, at[1:], strict=False)] == [pattern.findall(t) for t in part]
            assert at[-1] == len(got)


def test_memory_encodes_each_word_once_until_it_is_full():
    asked = []

    def encode(words):
        asked.extend(words)
        return (np.concatenate([np.frombuffer(w.encode(), np.uint8) for w in words]).astype(np.int64),
                np.array([len(w.encode()) for w in words], np.int64))
    rng = random.Random(2)
    for limit in (1 << 20, 300):
        asked.clear()
        m = Memory(encode, limit)
        for _ in range(20):
            words = ["w" * rng.randrange(1, 9) + str(rng.randrange(40)) for _ in range(50)]
            flat, n = m.ids(pa.array(words))
            assert bytes(flat.astype(np.uint8)).decode() == "".join(words) and n.tolist() == [len(w) for w in words]
            assert m.held <= limit
        assert (len(asked) == len(set(asked))) == (limit > 300)
        assert m.ids(pa.array([], pa.string()))[0].size == 0
    assert per_text(np.array([1, 2, 3]), np.array([0, 2, 0, 1])).tolist() == [0, 3, 0, 3]
