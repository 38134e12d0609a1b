"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from tessera.llm.decontaminate import op3_spaced_seed_overlaps
from tessera.llm.htmltext import op7_min_cut_html
from tessera.llm.kneserney import op9_kneser_ney
from tessera.llm.langid import op8_ppm_language
from tessera.llm.linededup import ORACLE as OP2_SQL
from tessera.llm.linededup import op2_line_dedup
from tessera.llm.ngramjoin import op5_ngram_jaccard_join
from tessera.llm.packing import op10_best_fit_packing
from tessera.llm.pieces import op11_distinct_chunk_pieces
from tessera.llm.quality import ORACLE as OP1_SQL
from tessera.llm.quality import op1_mcd_outliers
from tessera.llm.sharding import op4_hypergeometric_sharding
from tessera.llm.spelling import op12_spelling_variants
from tessera.llm.toxicity import op6_toxic_segments

QUERIES = {
    "op1_mcd_outliers": op1_mcd_outliers,
    "op2_line_dedup": op2_line_dedup,
    "op3_spaced_seed_overlaps": op3_spaced_seed_overlaps,
    "op4_hypergeometric_sharding": op4_hypergeometric_sharding,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_toxic_segments": op6_toxic_segments,
    "op7_min_cut_html": op7_min_cut_html,
    "op8_ppm_language": op8_ppm_language,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_distinct_chunk_pieces": op11_distinct_chunk_pieces,
    "op12_spelling_variants": op12_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {"op1_mcd_outliers": OP1_SQL, "op2_line_dedup": OP2_SQL}
