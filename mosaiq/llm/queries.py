"""The queries of this subpackage, by name, and their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from mosaiq.llm import decontaminate, exact_dedup, language, merkle, mixing, ngram_join, phrases, secrets, substring_dedup, topk, toxicity, url_filter, warc

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_warc": warc.op6_warc,
    "op7_language_id": language.op7_language_id,
    "op8_mixing": mixing.op8_mixing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_secret_scan": secrets.op10_secret_scan,
    "op11_topk": topk.op11_topk,
    "op12_merkle": merkle.op12_merkle,
    "op13_phrases": phrases.op13_phrases,
}
ORACLES = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_ngram_join": ngram_join.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op6_warc": warc.OP6_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op11_topk": topk.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_phrases": phrases.OP13_SQL,
}
