"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from veritab.llm.bpe import op10_bpe_segment_tree
from veritab.llm.chat_format import OP4_SQL, op4_event_sourced_chat
from veritab.llm.collocations import OP13_SQL, op13_positional_lists
from veritab.llm.conversation_repair import op11_repair_automata
from veritab.llm.fingerprints import op1_lcp_fingerprints
from veritab.llm.html_extraction import op2_host_suffix_array
from veritab.llm.language_id import op8_language_id
from veritab.llm.packing import op3_packing
from veritab.llm.quality_classifier import op5_quality_classifier
from veritab.llm.quality_rules import op9_repetition_rules
from veritab.llm.sentence_pieces import op12_piece_chunks
from veritab.llm.simhash_dedup import op7_simhash_pivots
from veritab.llm.url_filter import op6_url_ngrams

QUERIES = {
    f.__name__: f
    for f in (op1_lcp_fingerprints, op2_host_suffix_array, op3_packing, op4_event_sourced_chat, op5_quality_classifier, op6_url_ngrams, op7_simhash_pivots, op8_language_id, op9_repetition_rules, op10_bpe_segment_tree, op11_repair_automata, op12_piece_chunks, op13_positional_lists)
}
ORACLE = {"op4_event_sourced_chat": OP4_SQL, "op13_positional_lists": OP13_SQL}
