"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from tessera.llm.bpe import op10_transducer_bpe
from tessera.llm.decontamination import op9_simhash_windows
from tessera.llm.exact_dedup import OP6_SQL, op6_digest_index
from tessera.llm.filter_audit import OP12_SQL, op12_mask_histogram
from tessera.llm.lexical_search import OP13_SQL, op13_maxscore
from tessera.llm.multi_index import op11_inverted_multi_index
from tessera.llm.ngram_join import op3_size_aware_join
from tessera.llm.quality import op1_importance_resampling
from tessera.llm.secrets import op2_randomness_battery
from tessera.llm.sharding import op8_virtual_slots
from tessera.llm.token_binary import op7_vbyte_ids
from tessera.llm.token_cache import op4_digest_cache
from tessera.llm.warc import op5_content_addressed

QUERIES = {
    f.__name__: f
    for f in (
        op1_importance_resampling,
        op2_randomness_battery,
        op3_size_aware_join,
        op4_digest_cache,
        op5_content_addressed,
        op6_digest_index,
        op7_vbyte_ids,
        op8_virtual_slots,
        op9_simhash_windows,
        op10_transducer_bpe,
        op11_inverted_multi_index,
        op12_mask_histogram,
        op13_maxscore,
    )
}
SQL = {"op6_digest_index": OP6_SQL, "op12_mask_histogram": OP12_SQL, "op13_maxscore": OP13_SQL}
