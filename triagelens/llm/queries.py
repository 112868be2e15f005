"""Registered queries of this subpackage and their check SQL."""

from __future__ import annotations

from triagelens.llm.debruijn import op5_debruijn_spans
from triagelens.llm.decontaminate import op9_qgram_leaks
from triagelens.llm.langid import op7_language_codes
from triagelens.llm.lookup import op4_lookup_placement
from triagelens.llm.minhash import op13_tensored_minhash
from triagelens.llm.negatives import OP11_SQL, op11_anchor_tree_negatives
from triagelens.llm.packing import op3_harmonic_packing
from triagelens.llm.repair import op1_repair_shards
from triagelens.llm.runs import op12_descending_lcp_runs
from triagelens.llm.simhash import op8_simhash_components
from triagelens.llm.suffixes import op10_radix_suffixes
from triagelens.llm.warc import op6_warc_dictionary
from triagelens.llm.weighted import op2_weighted_sampling

QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_shards, op2_weighted_sampling, op3_harmonic_packing, op4_lookup_placement, op5_debruijn_spans,
        op6_warc_dictionary, op7_language_codes, op8_simhash_components, op9_qgram_leaks, op10_radix_suffixes, op11_anchor_tree_negatives,
        op12_descending_lcp_runs, op13_tensored_minhash,
    )
}
ORACLES: dict[str, str] = {"op11_anchor_tree_negatives": OP11_SQL}
