"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .byte_bpe import op13_byte_bpe
from .decontamination import OP4_SQL, op4_decontamination
from .fingerprints import op8_fingerprints
from .language_id import op10_language_id
from .lexical_search import OP11_SQL, op11_lexical_search
from .license_scan import op9_license_scan
from .near_dedup import op5_near_dedup
from .sentencepiece_codec import op1_sentencepiece
from .sharding import op7_sharding
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .suffix_tree_lm import op2_suffix_tree_lm
from .token_counts import op6_token_counts
from .vector_codes import OP12_SQL, op12_vector_codes

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_suffix_tree_lm, op3_substring_dedup, op4_decontamination, op5_near_dedup, op6_token_counts, op7_sharding, op8_fingerprints, op9_license_scan, op10_language_id, op11_lexical_search, op12_vector_codes, op13_byte_bpe)}
SQL: dict[str, str] = {"op3_substring_dedup": OP3_SQL, "op4_decontamination": OP4_SQL, "op11_lexical_search": OP11_SQL, "op12_vector_codes": OP12_SQL}
