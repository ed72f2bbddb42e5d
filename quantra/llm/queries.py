"""The numbered queries and their SQL, as the repository's entry module adds them."""

from __future__ import annotations

from quantra.llm.cascade import OP9_SQL, op9_url_filter
from quantra.llm.dac import op5_token_output
from quantra.llm.gridcells import OP13_SQL, op13_vector_codes
from quantra.llm.mixing import op8_mixing
from quantra.llm.negatives import OP12_SQL, op12_hard_negatives
from quantra.llm.posindex import op7_decontamination
from quantra.llm.quality import op11_quality_rules
from quantra.llm.simhash import op3_simhash_near_dedup
from quantra.llm.substring import op4_substring_dedup
from quantra.llm.suffix import op6_suffix_dedup
from quantra.llm.surrogates import op2_pii_surrogates
from quantra.llm.toxicity import op10_toxicity
from quantra.llm.vafile import OP1_SQL, op1_vector_top_k

QUERIES = {
    "op1_vector_top_k": op1_vector_top_k,
    "op2_pii_surrogates": op2_pii_surrogates,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_output": op5_token_output,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_mixing": op8_mixing,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_quality_rules": op11_quality_rules,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {"op1_vector_top_k": OP1_SQL, "op9_url_filter": OP9_SQL, "op12_hard_negatives": OP12_SQL, "op13_vector_codes": OP13_SQL}
