"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .decontaminate import op8_decontamination
from .jaccard_join import op7_ngram_jaccard_join
from .language_id import op2_language_id
from .license_scan import op5_license_scan
from .line_dedup import OP1_SQL, op1_line_dedup
from .mixing import op9_mixing
from .mpeg import op6_media_columns
from .sharding import op3_sharding
from .toxicity import op10_toxicity
from .warc import OP4_SQL, op4_warc

QUERIES = (op1_line_dedup, op2_language_id, op3_sharding, op4_warc, op5_license_scan, op6_media_columns, op7_ngram_jaccard_join, op8_decontamination, op9_mixing, op10_toxicity)


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict:
    return {"op1_line_dedup": OP1_SQL, "op4_warc": OP4_SQL}
