"""The subpackage's queries, and DuckDB SQL for those that SQL can express."""

from . import grace_dedup, language_id, line_dedup, pii, quality, topk_search, toxicity
from .packing import op1_best_fit_packing
from .sentencepiece_codec import op2_sentencepiece
from .simhash import op4_simhash

QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_simhash": op4_simhash,
    "op5_exact_top_k": topk_search.op5_exact_top_k,
    "op6_language_id": language_id.op6_language_id,
    "op7_quality_cotraining": quality.op7_quality_cotraining,
    "op8_exact_dedup": grace_dedup.op8_exact_dedup,
    "op9_pii_pseudonyms": pii.op9_pii_pseudonyms,
    "op10_line_dedup": line_dedup.op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op5_exact_top_k": topk_search.ORACLE,
    "op8_exact_dedup": grace_dedup.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
