"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions; at every byte position a softmax
over both hidden states labels the position. A document pools the log-probabilities of all
its positions (every word of the whole text, each weighted by its bytes).

Training is numpy back-propagation through time on a bounded, deterministic sample of
labelled rows (``train_docs`` documents per language by hash, at most ``train_words``
distinct (language, word) rows of them). Prediction is one scan and one Arrow map without a
shuffle; a task runs the network once per distinct word it meets, in length-sorted batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, identifier, keep_columns, pieces, texts

WORD = re.compile(r"[^\W\d_]+")
LETTERS = r"\p{L}+"
WINDOW = 24         # bytes of a word read at once; longer words are cut into such stretches
MEMO = 200_000      # distinct words remembered by a task before it starts afresh
EDGE = 256          # input symbol before and after a word
NONE = "und"
RESULT = ["lang_pred", "score"]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def layout(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of words (each at most WINDOW long) between edges: (count, longest + 2) and lengths with edges."""
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    x = np.full((len(raw), int(n.max()) + 2), EDGE, np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    row = np.repeat(np.arange(len(raw)), n)
    x[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n) + 1] = flat
    return x, n + 2


def stretches(word: str) -> list[bytes]:
    b = word.encode("utf-8", "surrogatepass")
    return [b[i:i + WINDOW] for i in range(0, len(b), WINDOW)]


class BiGRU:
    """Two gated recurrent layers (forward and backward) and a softmax at every position."""

    def __init__(self, langs: list[str], hidden: int = 16, seed: int = 7):
        self.langs, self.hidden = langs, hidden
        rnd = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rnd.normal(0, 0.3, (EDGE + 1, 3 * hidden)).astype(np.float32)    # byte -> update, reset, candidate
            self.p[f"h{d}"] = rnd.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
        self.p["out"] = rnd.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.p["bias"] = np.zeros(len(langs), np.float32)

    def _run(self, x, mask, d, keep=None):
        """Hidden states of one direction, (time, rows, hidden); ``keep`` collects what learning needs."""
        H, wx, wh = self.hidden, self.p[f"x{d}"], self.p[f"h{d}"]
        steps = range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1)
        h = np.zeros((len(x), H), wx.dtype)
        out = np.empty((x.shape[1], len(x), H), wx.dtype)
        for t in steps:
            a, m = wx[x[:, t]], mask[:, t, None]
            g = _sigmoid(a[:, :2 * H] + h @ wh[:, :2 * H])
            z, r = g[:, :H], g[:, H:]
            c = np.tanh(a[:, 2 * H:] + (r * h) @ wh[:, 2 * H:])
            new = np.where(m, h + z * (c - h), h)
            if keep is not None:
                keep[t] = (h, z, r, c, m)
            out[t] = h = new
        return out

    def _logits(self, hf, hb):
        return hf @ self.p["out"][:self.hidden] + hb @ self.p["out"][self.hidden:] + self.p["bias"]

    def log_probs(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Per stretch: log-probabilities summed over its byte positions, and their number."""
        total = np.zeros((len(raw), len(self.langs)))
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        order = np.argsort(n, kind="stable")
        for i in range(0, len(raw), 4096):
            rows = order[i:i + 4096]
            x, size = layout([raw[k] for k in rows])
            mask = np.arange(x.shape[1]) < size[:, None]
            o = self._logits(self._run(x, mask, "f"), self._run(x, mask, "b"))
            o -= o.max(2, keepdims=True)
            o -= np.log(np.exp(o).sum(2, keepdims=True))
            inner = (np.arange(x.shape[1]) > 0) & (np.arange(x.shape[1]) < size[:, None] - 1)
            total[rows] = (o * inner.T[:, :, None]).sum(0)
        return total, n

    def gradients(self, raw, label, weight):
        """Mean cross-entropy over positions and its gradients, by back-propagation through time."""
        H = self.hidden
        x, size = layout(raw)
        mask = np.arange(x.shape[1]) < size[:, None]
        seen = {"f": {}, "b": {}}
        h = {d: self._run(x, mask, d, seen[d]) for d in "fb"}
        o = self._logits(h["f"], h["b"])
        o -= o.max(2, keepdims=True)
        p = np.exp(o)
        p /= p.sum(2, keepdims=True)
        inner = ((np.arange(x.shape[1]) > 0) & (np.arange(x.shape[1]) < size[:, None] - 1)).T
        w = (inner * weight).astype(self.p["out"].dtype)
        w /= max(w.sum(), 1e-6)
        loss = -(w * np.log(np.take_along_axis(p, np.broadcast_to(label, inner.shape)[:, :, None], 2)[:, :, 0] + 1e-12)).sum()
        d_o = p * w[:, :, None]
        d_o[:, np.arange(len(x)), label] -= w
        both = np.concatenate([h["f"], h["b"]], 2)
        grad = {"out": np.einsum("tnh,tnl->hl", both, d_o, optimize=True), "bias": d_o.sum((0, 1))}
        d_h = d_o @ self.p["out"].T
        for k, d in enumerate("fb"):
            wh = self.p[f"h{d}"]
            gx, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(wh)
            back = np.zeros((len(x), H), wh.dtype)
            steps = range(x.shape[1] - 1, -1, -1) if d == "f" else range(x.shape[1])
            for t in steps:
                old, z, r, c, m = seen[d][t]
                dh = d_h[t][:, k * H:(k + 1) * H] + back
                dn = np.where(m, dh, 0)
                dc = dn * z * (1 - c * c)
                dz = dn * (c - old) * z * (1 - z)
                drh = dc @ wh[:, 2 * H:].T
                dr = drh * old * r * (1 - r)
                da = np.concatenate([dz, dr, dc], 1)
                np.add.at(gx, x[:, t], da)
                gh[:, :2 * H] += old.T @ da[:, :2 * H]
                gh[:, 2 * H:] += (r * old).T @ dc
                back = np.where(m, dn * (1 - z) + drh * r, dh) + da[:, :2 * H] @ wh[:, :2 * H].T
            grad[f"x{d}"], grad[f"h{d}"] = gx, gh
        return loss, grad

    def fit(self, words: list[str], label: np.ndarray, weight: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01,
            updates: int = 300) -> BiGRU:
        """Adam over shuffled batches of words (all stretches of a long one); few words
        are gone through more often, until there were ``updates`` batches."""
        cut = [stretches(w) for w in words]
        raw, times = [s for c in cut for s in c], np.fromiter(map(len, cut), np.int64, len(cut))
        label, weight = np.repeat(label, times), np.repeat(weight, times)
        rnd = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        epochs = max(epochs, -(-updates // -(-len(raw) // batch)))
        step, total = 0, epochs * -(-len(raw) // batch)
        for _ in range(epochs):
            order = rnd.permutation(len(raw))
            for i in range(0, len(raw), batch):
                rows = order[i:i + batch]
                _, grad = self.gradients([raw[j] for j in rows], label[rows], weight[rows])
                step += 1
                lr = rate * (1 - 0.9 * step / total)
                for k, g in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = 400,
          train_words: int = 20_000, max_langs: int = 1000, hidden: int = 16) -> BiGRU | None:
    """A network learned from rows with text and language; None where there is none.

    Bound: about ``train_docs`` documents of each of the ``max_langs`` most frequent
    languages, chosen by the hash of the identifier, and of their distinct words the most
    frequent, ties by hash: ``train_words`` divided by the number of languages for each (at least
    20), so that no language is crowded out. Every language weighs the same.
    """
    rows = labelled.select(F.col(identifier(id_col)).alias("id"), F.col(identifier(text_col)).alias("t"),
                           F.col(identifier(lang_col)).cast("string").alias("l")).filter("t IS NOT NULL AND l IS NOT NULL")
    known = rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "l").limit(max_langs)
    lot = F.pmod(F.xxhash64(F.col("id"), F.lit(5)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # at most max_langs rows: broadcast, so that no language's documents are gathered in one task
    chosen = rows.join(F.broadcast(known), "l").filter(lot * F.col("n") < train_docs)
    words = (chosen.select("l", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(LETTERS), F.lit(0))).alias("w"))
             .groupBy("l", "w").agg(F.count(F.lit(1)).alias("n")))
    share = max(20, train_words // max(1, known.count()))
    # a window by language: its words are those of about train_docs documents
    first = Window.partitionBy("l").orderBy(F.col("n").desc(), F.xxhash64("w", "l"), "w")
    sample = (words.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= share)
              .select("l", "w", "n").orderBy(F.col("n").desc(), F.xxhash64("w", "l"), "w", "l").collect())
    if not sample:
        return None
    langs = sorted({r.l for r in sample})
    label = np.array([langs.index(r.l) for r in sample], np.int64)
    weight = np.sqrt(np.array([r.n for r in sample], np.float64))
    weight /= np.bincount(label, weights=weight)[label]
    weight *= len(sample) / weight.sum()
    return BiGRU(langs, hidden).fit([r.w for r in sample], label, weight)


def identify(docs: DataFrame, model: BiGRU | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` (a learned value, or ``und`` for a NULL text or one without
    a letter, or without a model) and ``score``: its pooled probability, 0 for ``und``.

    Whole texts, every row on its own (repeated rows, NULL identifiers); an empty table
    gives an empty result; input columns named like a result column give way.
    """
    carried = keep_columns(docs, RESULT)
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        table, size = np.zeros((0, len(model.langs) if model else 0)), np.zeros(0, np.int64)
        for b in pieces(batches, text_col):
            batch = texts(b.column(text_col))
            split = [words_of(t) if any(map(str.isalpha, t)) else [] for t in batch] if model else [[] for _ in batch]
            new = list(set().union(*split).difference(memo))
            if new:
                cut = [stretches(w) for w in new]
                lp, n = model.log_probs([s for c in cut for s in c])
                first = np.cumsum([0, *map(len, cut)])[:-1]
                memo.update(zip(new, range(len(table), len(table) + len(new)), strict=True))
                table = np.concatenate([table, np.add.reduceat(lp, first, 0)])
                size = np.concatenate([size, np.add.reduceat(n, first)])
            pred, score = [], []
            for words in split:
                if not words:
                    pred.append(NONE)
                    score.append(0.0)
                    continue
                rows = np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
                mean = table[rows].sum(0) / size[rows].sum()
                p = np.exp(mean - mean.max())
                k = int(np.argmax(p))
                pred.append(model.langs[k])
                score.append(float(p[k] / p.sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=schema.names)
            if len(memo) > MEMO:
                memo.clear()
                table, size = table[:0], size[:0]

    return docs.select(*[F.col(identifier(c)) for c in carried]).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the fold that is never learned from (and for NULL identifiers)."""
    return F.coalesce(F.crc32(F.col(identifier(id_col)).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Language of every whole text of ``documents``, learned from two of three folds."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = train(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
