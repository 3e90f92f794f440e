"""The queries of this package and their SQL."""

from __future__ import annotations

from .balltree import OP2_SQL, op2_top_k
from .counts import op7_token_counts
from .huffman import op3_token_file
from .langid import op10_language_id
from .lines import op8_line_dedup
from .minhash import OP4_SQL, op4_near_dedup
from .mixing import op5_mixing
from .packing import op9_packing
from .quality import op6_quality
from .substrings import OP1_SQL, op1_substring_dedup


def queries() -> dict:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_top_k": op2_top_k, "op3_token_file": op3_token_file, "op4_near_dedup": op4_near_dedup, "op5_mixing": op5_mixing, "op6_quality": op6_quality, "op7_token_counts": op7_token_counts, "op8_line_dedup": op8_line_dedup, "op9_packing": op9_packing, "op10_language_id": op10_language_id}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op2_top_k": OP2_SQL, "op4_near_dedup": OP4_SQL}
