"""The registered queries of this folder and their SQL."""

import corpus_pipeline

from . import fingerprint, langid, lm_score, main_text, mixing, packing, pii, prefix_trie, runs, simhash, suffix_dedup, topk, url_filter

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_mixing": mixing.op2_mixing,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_topk": topk.op4_topk,
    "op5_packing": packing.op5_packing,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_language": langid.op7_language,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_pii": pii.op10_pii,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_main_text": main_text.op12_main_text,
    "op13_runs": runs.op13_runs,
}
ORACLES = {"op1_lm_score": lm_score.ORACLE, "op2_mixing": mixing.ORACLE, "op4_topk": topk.ORACLE, "op6_url_filter": url_filter.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE}
