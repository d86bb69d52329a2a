"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .bpe_codec import op10_byte_bpe
from .embedding_dedup import OP7_SQL, op7_embedding_dedup
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .language_id import op4_language_id
from .pii import op8_pii
from .quality_model import op9_quality_classifier
from .quality_rules import OP2_SQL, op2_quality_rules
from .simhash_dedup import op3_simhash_dedup
from .source_mixing import OP1_SQL, op1_source_mixing
from .spelling_variants import op12_spelling_variants
from .substring_dedup import OP13_SQL, op13_substring_dedup
from .suffix_dedup import op6_suffix_dedup
from .token_counts import op5_token_counts

QUERIES = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_pii": op8_pii,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_substring_dedup": op13_substring_dedup,
}
ORACLE_SQL = {
    "op1_source_mixing": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op7_embedding_dedup": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op13_substring_dedup": OP13_SQL,
}
