"""Queries of the training-data operators and their DuckDB counterparts."""

from __future__ import annotations

from signalrank.llm import decontaminate, exact_dedup, fill_middle, hard_negatives, hidden_markov, html_text, language_id, near_dedup, packing, pieces, quality, toxicity, url_filter


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_language_id": language_id.op2_language_id,
        "op3_near_dedup": near_dedup.op3_near_dedup,
        "op4_html_text": html_text.op4_html_text,
        "op5_hidden_markov": hidden_markov.op5_hidden_markov,
        "op6_packing": packing.op6_packing,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_quality": quality.op8_quality,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_sentencepiece": pieces.op12_sentencepiece,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql():
    return {"op7_url_filter": url_filter.SQL, "op9_decontaminate": decontaminate.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_hard_negatives": hard_negatives.SQL, "op13_fill_middle": fill_middle.SQL}
