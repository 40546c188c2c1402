"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from lodestone.llm.bpe import op12_byte_bpe
from lodestone.llm.centroids import OP11_SQL, op11_centroid_clusters
from lodestone.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from lodestone.llm.fingerprints import op9_fingerprints
from lodestone.llm.html_text import op4_html_text
from lodestone.llm.importance import OP13_SQL, op13_importance_resampling
from lodestone.llm.language_id import op2_language_id
from lodestone.llm.mixing import OP10_SQL, op10_mix_sources
from lodestone.llm.near_dedup import OP1_SQL, op1_near_dedup
from lodestone.llm.packing import op7_pack_sequences
from lodestone.llm.personal_data import op8_personal_data
from lodestone.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from lodestone.llm.token_counts import op3_token_counts

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_language_id, op3_token_counts, op4_html_text, op5_substring_dedup, op6_exact_dedup, op7_pack_sequences, op8_personal_data, op9_fingerprints, op10_mix_sources, op11_centroid_clusters, op12_byte_bpe, op13_importance_resampling)}
ORACLE_SQL = {"op1_near_dedup": OP1_SQL, "op5_substring_dedup": OP5_SQL, "op6_exact_dedup": OP6_SQL, "op10_mix_sources": OP10_SQL, "op11_centroid_clusters": OP11_SQL, "op13_importance_resampling": OP13_SQL}
