"""The queries of this subpackage, and the SQL of those that SQL can express."""

from .bpe import op10_bpe
from .near_dup import OP5_SQL, op5_near_dup
from .packing import op7_pack
from .quality_rules import OP9_SQL, op9_quality_rules
from .secret_scan import op3_secret_scan
from .site_quality import op2_site_quality
from .substring_dedup import op1_substring_dedup
from .topk import OP4_SQL, op4_top_k
from .toxicity import op8_toxicity
from .url_filter import op6_url_filter

QUERIES = {
    "op2_site_quality": op2_site_quality,
    "op4_top_k": op4_top_k,
    "op1_substring_dedup": op1_substring_dedup,
    "op5_near_dup": op5_near_dup,
    "op7_pack": op7_pack,
    "op10_bpe": op10_bpe,
    "op3_secret_scan": op3_secret_scan,
    "op6_url_filter": op6_url_filter,
    "op8_toxicity": op8_toxicity,
    "op9_quality_rules": op9_quality_rules,
}

ORACLE_SQL = {
    "op4_top_k": OP4_SQL,
    "op5_near_dup": OP5_SQL,
    "op9_quality_rules": OP9_SQL,
}
