"""The queries opN_<name> and pipeline, and SQL for those that SQL expresses."""

import corpus_pipeline
from tessera.llm import cosine, exact, html, langid, lm, minhash, packing, pieces, substrings, urls

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_embedding_near_dedup": cosine.op2_embedding_near_dedup,
    "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
    "op4_substring_dedup": substrings.op4_substring_dedup,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_url_filter": urls.op7_url_filter,
    "op8_language_id": langid.op8_language_id,
    "op9_lm_scoring": lm.op9_lm_scoring,
    "op10_html_extraction": html.op10_html_extraction,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_embedding_near_dedup": cosine.OP2_SQL,
    "op3_minhash_near_dedup": minhash.OP3_SQL,
    "op4_substring_dedup": substrings.OP4_SQL,
    "op5_exact_dedup": exact.OP5_SQL,
    "op7_url_filter": urls.OP7_SQL,
}
