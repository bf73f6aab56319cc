"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from .byte_bpe import op4_byte_bpe
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .hamming_topk import OP2_SQL, op2_hamming_topk
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .langid import op10_language_id
from .license_scan import op8_license_scan
from .lm_score import op6_lm_score
from .merkle import OP11_SQL, op11_merkle
from .packing import op1_packing
from .pii import op3_pii
from .simhash import op5_simhash
from .token_counts import op9_token_counts
from .token_files import op13_token_files

QUERIES = {
    "op1_packing": op1_packing,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_pii": op3_pii,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_lm_score": op6_lm_score,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_merkle": op11_merkle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_token_files": op13_token_files,
}

# Where SQL can express the operator; the others are tested against brute force in tests/llm.
ORACLE = {
    "op2_hamming_topk": OP2_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_merkle": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
