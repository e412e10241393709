"""The queries of this subpackage, one for each operator, with SQL where SQL can express them."""

from __future__ import annotations

from pairloom.llm import sql
from pairloom.llm.bpe import op2_bpe_round_trip
from pairloom.llm.covertree import op3_cover_tree_pairs
from pairloom.llm.decontam import op9_decontaminate
from pairloom.llm.htmlextract import op1_html_text
from pairloom.llm.licenses import op6_license_scan
from pairloom.llm.quality import op4_quality_classifier
from pairloom.llm.sharding import op10_hilbert_shards
from pairloom.llm.simhash import op8_covering_simhash
from pairloom.llm.substrings import op7_suffix_tree_dedup
from pairloom.llm.tokenfiles import op5_token_files


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_html_text": op1_html_text,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_cover_tree_pairs": op3_cover_tree_pairs,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_token_files": op5_token_files,
        "op6_license_scan": op6_license_scan,
        "op7_suffix_tree_dedup": op7_suffix_tree_dedup,
        "op8_covering_simhash": op8_covering_simhash,
        "op9_decontaminate": op9_decontaminate,
        "op10_hilbert_shards": op10_hilbert_shards,
    }


def oracle_sql() -> dict:
    return {"op3_cover_tree_pairs": sql.OP3, "op7_suffix_tree_dedup": sql.OP7, "op9_decontaminate": sql.OP9}
