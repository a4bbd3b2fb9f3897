"""The ten operators' queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from .exact_dedup import OP6_SQL, op6_exact_dedup
from .html_text import op8_html_text
from .line_dedup import OP9_SQL, op9_line_dedup
from .near_dedup import op10_near_dedup
from .quality_rules import OP4_SQL, op4_quality_rules
from .packing import op3_pack
from .token_files import op2_token_files
from .toxicity import op1_toxicity
from .warc import op5_warc
from .word_bpe import op7_word_bpe

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_files": op2_token_files,
    "op3_pack": op3_pack,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_word_bpe": op7_word_bpe,
    "op8_html_text": op8_html_text,
    "op9_line_dedup": op9_line_dedup,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op4_quality_rules": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
}
