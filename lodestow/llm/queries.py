"""The queries of the numbered operators and, where SQL can state them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sql
from .op1_decontamination import op1_greedy_string_tiling
from .op10_html import op10_min_cut_extraction
from .op11_audit import op11_permutation_trie_audit
from .op12_codes import op12_hamerly_codes
from .op13_neighbours import op13_cross_polytope_search
from .op2_pii import op2_information_sanitisation
from .op3_fingerprint import op3_imatch_fingerprints
from .op4_quality import op4_importance_resampling
from .op5_sharding import op5_histogram_sort_sharding
from .op6_jaccard import op6_ngram_jaccard_join
from .op7_line_dedup import op7_line_set_similarity
from .op8_lm import op8_backoff_automaton
from .op9_mixing import op9_sainte_lague_mixing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_greedy_string_tiling,
        op2_information_sanitisation,
        op3_imatch_fingerprints,
        op4_importance_resampling,
        op5_histogram_sort_sharding,
        op6_ngram_jaccard_join,
        op7_line_set_similarity,
        op8_backoff_automaton,
        op9_sainte_lague_mixing,
        op10_min_cut_extraction,
        op11_permutation_trie_audit,
        op12_hamerly_codes,
        op13_cross_polytope_search,
    )
}

SQL: dict[str, str] = {"op2_information_sanitisation": sql.OP2, "op6_ngram_jaccard_join": sql.OP6, "op11_permutation_trie_audit": sql.OP11, "op12_hamerly_codes": sql.OP12}
