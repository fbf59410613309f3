"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from quarry.llm.chat_format import OP4_SQL, op4_chat_format
from quarry.llm.decontaminate import op6_decontamination
from quarry.llm.html_extract import op9_html_extract
from quarry.llm.importance import OP11_SQL, op11_importance
from quarry.llm.lexical_search import OP12_SQL, op12_lexical_search
from quarry.llm.mixing import OP7_SQL, op7_mixing
from quarry.llm.ngram_join import op8_ngram_jaccard
from quarry.llm.substring_dedup import op1_substring_dedup
from quarry.llm.token_counts import op3_token_counts
from quarry.llm.token_output import op13_token_output
from quarry.llm.topk_search import OP10_SQL, op10_topk_search
from quarry.llm.toxicity import op5_toxicity
from quarry.llm.url_filter import op2_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_url_filter": op2_url_filter,
    "op3_token_counts": op3_token_counts,
    "op4_chat_format": op4_chat_format,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_mixing": op7_mixing,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_html_extract": op9_html_extract,
    "op10_topk_search": op10_topk_search,
    "op11_importance": op11_importance,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_output": op13_token_output,
}
ORACLES: dict[str, str] = {
    "op4_chat_format": OP4_SQL,
    "op7_mixing": OP7_SQL,
    "op10_topk_search": OP10_SQL,
    "op11_importance": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
