"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, html, langid, linededup, lm, mixing, neardup, ngram_join, search, sharding, toxicity, trie, whitening

QUERIES = {
    "op1_source_mixing": mixing.op1,
    "op2_toxicity": toxicity.op2,
    "op3_sharding": sharding.op3,
    "op4_topk_search": search.op4,
    "op5_ngram_join": ngram_join.op5,
    "op6_language_id": langid.op6,
    "op7_lm_scoring": lm.op7,
    "op8_html_extraction": html.op8,
    "op9_embedding_neardup": neardup.op9,
    "op10_bpe": bpe.op10,
    "op11_prefix_trie": trie.op11,
    "op12_line_dedup": linededup.op12,
    "op13_embedding_whitening": whitening.op13,
}
ORACLE_SQL = {
    "op1_source_mixing": mixing.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op4_topk_search": search.ORACLE,
    "op5_ngram_join": ngram_join.ORACLE,
    "op9_embedding_neardup": neardup.ORACLE,
    "op11_prefix_trie": trie.ORACLE,
    "op12_line_dedup": linededup.ORACLE,
}
