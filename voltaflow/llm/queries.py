"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .bpe import op1_query
from .chat import OP9_SQL, op9_query
from .html_extract import op10_query
from .merkle import OP12_SQL, op12_query
from .near_dedup import op11_query
from .ngram_join import OP6_SQL, op6_query
from .packing import op5_query
from .quality import OP8_SQL, op8_query
from .secrets import op4_query
from .simhash import op7_query
from .spelling import OP13_SQL, op13_query
from .substring_dedup import OP2_SQL, op2_query
from .unigram import op3_query

QUERIES = {
    "op1_bpe_round_trip": op1_query,
    "op2_substring_dedup": op2_query,
    "op3_token_counts": op3_query,
    "op4_secret_scan": op4_query,
    "op5_packing": op5_query,
    "op6_ngram_join": op6_query,
    "op7_fingerprints": op7_query,
    "op8_quality_rules": op8_query,
    "op9_chat_format": op9_query,
    "op10_html_text": op10_query,
    "op11_near_dedup": op11_query,
    "op12_merkle_manifest": op12_query,
    "op13_spelling_variants": op13_query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_ngram_join": OP6_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
