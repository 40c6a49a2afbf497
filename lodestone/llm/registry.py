"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .alignment import op11_alignment
from .bpe import op10_bpe
from .co_bucket import op12_co_bucket
from .common import tidied
from .decontaminate import OP13_SQL, op13_decontamination
from .embed_dedup import op4_embedding_dedup
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .license_scan import op2_license
from .line_dedup import OP8_SQL, op8_line_dedup
from .packing import op3_packing
from .pii import op1_pii
from .quality import op6_quality
from .simhash import op7_simhash
from .suffix_dedup import op9_suffix_dedup

_ALL = {
    "op1_pii": op1_pii,
    "op2_license": op2_license,
    "op3_packing": op3_packing,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_bpe": op10_bpe,
    "op11_alignment": op11_alignment,
    "op12_co_bucket": op12_co_bucket,
    "op13_decontamination": op13_decontamination,
}
QUERIES = {name: tidied(query) for name, query in _ALL.items()}
ORACLE_SQL = {"op5_exact_dedup": OP5_SQL, "op8_line_dedup": OP8_SQL, "op13_decontamination": OP13_SQL}
