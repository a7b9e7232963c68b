"""Corpus queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from citewell.llm import exact_dedup, html_text, language_id, lexical_search, merkle, ngram_join, packing, ppm, quality_model, quality_rules, sentence_pieces, suffix_dedup, warc


def queries() -> dict:
    return {
        "op1_ppm": ppm.op1_ppm,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_warc": warc.op4_warc,
        "op5_html_extraction": html_text.op5_html_extraction,
        "op6_language_id": language_id.op6_language_id,
        "op7_sentence_pieces": sentence_pieces.op7_sentence_pieces,
        "op8_ngram_jaccard": ngram_join.op8_ngram_jaccard,
        "op9_quality_classifier": quality_model.op9_quality_classifier,
        "op10_packing": packing.op10_packing,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_suffix_array_dedup": suffix_dedup.op12_suffix_array_dedup,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.OP2_SQL, "op3_exact_dedup": exact_dedup.OP3_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op13_lexical_search": lexical_search.OP13_SQL}
