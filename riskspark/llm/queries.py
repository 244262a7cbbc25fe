"""The registered text queries and their SQL twins."""

from __future__ import annotations

from riskspark.llm import chat, negatives, repair
from riskspark.llm.bpe import op6_bpe_encode
from riskspark.llm.kneser import op2_kneser_ney
from riskspark.llm.ngram_join import op8_ngram_jaccard
from riskspark.llm.pii import op7_pii
from riskspark.llm.resample import op5_importance_resampling
from riskspark.llm.substrings import op1_substring_dedup
from riskspark.llm.suffix_dedup import op9_suffix_dedup
from riskspark.llm.tiling import op4_decontaminate
from riskspark.llm.urls import op10_url_filter
from riskspark.llm.winnow import op3_winnow

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_winnow": op3_winnow,
    "op4_decontaminate": op4_decontaminate,
    "op5_importance_resampling": op5_importance_resampling,
    "op6_bpe_encode": op6_bpe_encode,
    "op7_pii": op7_pii,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_chat_windows": chat.op12_chat_windows,
    "op13_repair": repair.op13_repair,
}
ORACLE: dict[str, str] = {
    "op11_hard_negatives": negatives.ORACLE_SQL,
    "op12_chat_windows": chat.ORACLE_SQL,
    "op13_repair": repair.ORACLE_SQL,
}
