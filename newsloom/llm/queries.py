"""The registered queries of this subpackage and the SQL of those SQL can express."""

from __future__ import annotations

from newsloom.llm import (
    conversation_repair, conversation_trie, exact_dedup, html_extract, langid, line_dedup, mixing, packing, secret_scan, simhash,
    toxicity, url_filter, vafile,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_vafile_topk": vafile.op7_vafile_topk,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_language_id": langid.op9_language_id,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_html_extraction": html_extract.op11_html_extraction,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL.strip(),
    "op5_line_dedup": line_dedup.OP5_SQL.strip(),
    "op7_vafile_topk": vafile.OP7_SQL.strip(),
    "op13_conversation_trie": conversation_trie.OP13_SQL.strip(),
}
