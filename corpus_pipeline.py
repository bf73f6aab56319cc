"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, PII, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``; all but the last return the columns of
``documents``. Each stage works on whatever its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.llm.common import documents, staged
from matchlake.llm.exact_dedup import exact_dedup
from matchlake.llm.langid import NONE, held_out, identify, train
from matchlake.llm.packing import pack, packed_pieces
from matchlake.llm.pii import sanitise
from matchlake.llm.simhash import without_near_copies
from matchlake.session import drop_scratch, scratch_tables

_MADE: list[str] = []


def _stage(fn):
    """``fn`` as a stage: its result is written before the next stage begins, so the next one
    first removes the scratch tables that this one made."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop_scratch(_MADE)
        before = set(scratch_tables())
        out = fn(spark, docs, sf_dir)
        _MADE[:] = [path for path in scratch_tables() if path not in before]
        return out
    return run


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing label is filled in. Rejected are texts without a
    letter (``und``); a short text of uncertain language is clean and stays."""
    model = train(docs.filter(~held_out()))
    lang = F.coalesce(F.col("lang"), F.col("lang_pred")) if model else F.col("lang")
    told = identify(docs, model).filter(F.col("lang_pred") != NONE) if model else \
        docs.filter(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    return told.withColumn("lang", lang).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs, keep="largest").filter("kept").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group within 4 of 64 bits stays (4-word shingles)."""
    return without_near_copies(docs, shingle=4, max_bits=4)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked and disclosive words generalised or removed."""
    clean = sanitise(docs).withColumn("text", F.col("sanitised"))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences of 2048 tokens."""
    return packed_pieces(pack(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("language_id", _stage(known_language)),
    ("exact_dedup", _stage(drop_exact_copies)),
    ("simhash", _stage(drop_near_copies)),
    ("pii", _stage(without_personal_data)),
    ("packing", _stage(packed)),
]

# Recurrent networks, fingerprints and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each staged in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
