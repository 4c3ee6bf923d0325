"""The queries of this subpackage, and their SQL where there is one."""

from __future__ import annotations

from .bpe import op5_byte_bpe
from .jaccard import op8_jaccard_join
from .language import op2_language_id
from .language_model import op4_lm_score
from .licenses import ORACLE as LICENSE_SQL
from .licenses import op3_license_scan
from .mixing import ORACLE as MIXING_SQL
from .mixing import op1_source_mix
from .secrets import op6_secret_scan
from .telephony import op9_telephony
from .topk import ORACLE as TOPK_SQL
from .topk import op7_exact_topk
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_source_mix, op2_language_id, op3_license_scan, op4_lm_score, op5_byte_bpe, op6_secret_scan, op7_exact_topk, op8_jaccard_join, op9_telephony, op10_toxicity)
}
ORACLES = {"op1_source_mix": MIXING_SQL, "op3_license_scan": LICENSE_SQL, "op7_exact_topk": TOPK_SQL}
