"""The queries of this subpackage and the SQL that some of them are held against."""

from __future__ import annotations

from . import boilerplate, filter_audit, mixing, near_vectors, recipes, vector_codes, warc
from .boilerplate import op3_site_lines
from .fertility import op6_tokeniser_fertility
from .filter_audit import op12_relational_replay
from .lm_score import op2_ppm
from .mixing import op5_temperature
from .near_vectors import op10_product_quantisation
from .packing import op9_best_two_fit
from .recipes import op11_chunk_recipes
from .shingle_join import op8_lsh_forest
from .token_counts import op7_heap_bpe
from .toxicity import op1_noisy_or
from .vector_codes import op13_exponion
from .warc import op4_boundary_chain

QUERIES = {
    "op1_noisy_or": op1_noisy_or,
    "op2_ppm": op2_ppm,
    "op3_site_lines": op3_site_lines,
    "op4_boundary_chain": op4_boundary_chain,
    "op5_temperature": op5_temperature,
    "op6_tokeniser_fertility": op6_tokeniser_fertility,
    "op7_heap_bpe": op7_heap_bpe,
    "op8_lsh_forest": op8_lsh_forest,
    "op9_best_two_fit": op9_best_two_fit,
    "op10_product_quantisation": op10_product_quantisation,
    "op11_chunk_recipes": op11_chunk_recipes,
    "op12_relational_replay": op12_relational_replay,
    "op13_exponion": op13_exponion,
}

ORACLE_SQL = {
    "op3_site_lines": boilerplate.ORACLE_SQL,
    "op4_boundary_chain": warc.ORACLE_SQL,
    "op5_temperature": mixing.ORACLE_SQL,
    "op10_product_quantisation": near_vectors.ORACLE_SQL,
    "op11_chunk_recipes": recipes.ORACLE_SQL,
    "op12_relational_replay": filter_audit.ORACLE_SQL,
    "op13_exponion": vector_codes.ORACLE_SQL,
}
