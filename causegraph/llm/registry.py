"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from causegraph.llm import alignment, bpe, embeddings, jaccard, langid, lines, packing, pieces, quality, sharding, spelling, toxicity, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_bpe": bpe.op4_bpe,
        "op5_rendezvous_sharding": sharding.op5_rendezvous_sharding,
        "op6_revisits": warc.op6_revisits,
        "op7_jaccard_join": jaccard.op7_jaccard_join,
        "op8_language_id": langid.op8_language_id,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_sentencepiece": pieces.op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.ORACLE, "op3_quality_rules": quality.ORACLE, "op6_revisits": warc.ORACLE, "op10_embedding_near_dedup": embeddings.ORACLE, "op12_spelling_variants": spelling.ORACLE}
