"""Token counts by rank-synchronous array merging.

Each task cuts its texts into pre-tokens (stretches between spaces: no piece of the
vocabulary joins a character to a following space mark), merges the pre-tokens it has not
met yet as ragged numpy arrays - every sequence applies its lowest-rank pair in the same
round (see ``bpe.merge``) - and adds up the surviving symbols. No shuffle: the plan is one
scan and one Arrow map. Memory is bounded by the 4 MB text pieces and the memo's bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import documents, identifier, keep_columns, pieces, texts

MARK = "▁"        # stands for a space inside pieces
RUNS = re.compile(" +[^ ]*")
MEMO = 200_000         # pre-tokens remembered by a task before it starts afresh
RESULT = ["n_bytes", "n_tokens", "over_limit"]


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens whose counts add up to the text's, each without its first space mark.

    The library puts a mark before the text and one for every space; a pre-token is a run
    of marks and what follows it. A text that holds the mark itself stays in one piece.
    """
    if not text:
        return []
    if MARK in text:
        return [text]
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in RUNS.findall(" " + text)]


def count_texts(vocab: bpe.Pieces, batch: list[str], memo: dict[str, int]) -> list[int]:
    split = [pre_tokens(t) for t in batch]
    new = list(set().union(*split).difference(memo))
    if new:
        counts = vocab.counts([MARK + w.replace(" ", MARK) for w in new])
        memo.update(zip(new, counts.tolist(), strict=True))
    out = [sum(map(memo.__getitem__, words)) for words in split]
    if len(memo) > MEMO:
        memo.clear()
    return out


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``).

    Counts equal the sentencepiece library's for the model at ``vocabulary``, without
    added tokens. NULL and empty texts have 0 of both; rows are independent, so repeated
    rows, NULL identifiers and an empty table need no care. Input columns named like a
    result column give way. Texts of any length are counted whole.
    """
    carried = keep_columns(docs, RESULT)
    schema = T.StructType([docs.schema[c] for c in carried] + [
        T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, memo = bpe.load("pieces", vocabulary), {}
        for b in pieces(batches, text_col):
            column = b.column(text_col)
            n = np.array(count_texts(vocab, texts(column), memo), np.int64)
            size = pc.fill_null(pc.binary_length(column), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, size, pa.array(n), pa.array(n > limit)],
                                             names=[*b.schema.names, *RESULT])

    return docs.select(*[F.col(identifier(c)) for c in carried]).mapInArrow(count, schema)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of ``documents`` under the public 32k piece model."""
    import public_tokenizers
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", *RESULT)
