"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quarry.llm.branch_bound import OP8_SQL, op8_exact_top_k
from quarry.llm.class_lm import op6_class_ngram_scoring
from quarry.llm.packing import op3_length_bucket_packing
from quarry.llm.piece_bpe import op9_sentencepiece
from quarry.llm.preferences import OP10_SQL, op10_preference_pairs
from quarry.llm.quality import op2_quality_divergence
from quarry.llm.simhash import op5_simhash_near_dedup
from quarry.llm.substring_dedup import op4_substring_dedup
from quarry.llm.suffix_array import op1_suffix_array_dedup
from quarry.llm.url_rules import OP7_SQL, op7_url_redirect_rules

QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup,
        op2_quality_divergence,
        op3_length_bucket_packing,
        op4_substring_dedup,
        op5_simhash_near_dedup,
        op6_class_ngram_scoring,
        op7_url_redirect_rules,
        op8_exact_top_k,
        op9_sentencepiece,
        op10_preference_pairs,
    )
}
ORACLES = {"op7_url_redirect_rules": OP7_SQL, "op8_exact_top_k": OP8_SQL, "op10_preference_pairs": OP10_SQL}
