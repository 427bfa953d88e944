"""The llm queries and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bytes_dedup, decontaminate, language, mixing, pages, secrets, simhash, tokens, words_dedup

QUERIES = {
    "op1_language": language.op1_language,
    "op2_simhash": simhash.op2_simhash,
    "op3_suffix_array": bytes_dedup.op3_suffix_array,
    "op4_substring": words_dedup.op4_substring,
    "op5_mixing": mixing.op5_mixing,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_tokens": tokens.op7_tokens,
    "op8_neighbours": ann.op8_neighbours,
    "op9_secrets": secrets.op9_secrets,
    "op10_html": pages.op10_html,
    "pipeline": corpus_pipeline.run,
}
SQL = {"op5_mixing": mixing.SQL.format(docs="documents"), "op9_secrets": secrets.oracle(secrets.forest_of())}
