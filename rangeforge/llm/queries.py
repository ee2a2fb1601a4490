"""Queries and SQL of the training-data operators, one opN_ query an operator."""

from __future__ import annotations

from .byte_bpe import op3_byte_bpe
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .fill_middle import OP11_SQL, op11_fill_middle
from .language_id import op10_language_id
from .ngram_join import op12_ngram_join
from .packing import op2_packing
from .quality_rank import op9_quality_rank
from .quality_rules import OP6_SQL, op6_quality_rules
from .repeats import OP4_SQL, op4_repeats
from .secret_scan import op8_secret_scan
from .simhash import op5_simhash
from .url_rules import OP1_SQL, op1_url_rules

QUERIES = {
    "op1_url_rules": op1_url_rules,
    "op2_packing": op2_packing,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_repeats": op4_repeats,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality_rank": op9_quality_rank,
    "op10_language_id": op10_language_id,
    "op11_fill_middle": op11_fill_middle,
    "op12_ngram_join": op12_ngram_join,
}

ORACLE_SQL = {
    "op1_url_rules": OP1_SQL,
    "op4_repeats": OP4_SQL,
    "op6_quality_rules": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op11_fill_middle": OP11_SQL,
}
