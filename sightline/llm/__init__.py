"""Operators over text corpora, their registered queries and check SQL."""

from . import (
    bytebpe,
    cascade,
    cwsample,
    filteraudit,
    graphindex,
    langmask,
    merkle,
    packing,
    paritysketch,
    personal,
    repeats,
    urlrules,
    warcfiles,
)

_MODULES = {
    "op1_personal_data": personal,
    "op2_language": langmask,
    "op3_fingerprints": cwsample,
    "op4_ngram_jaccard": paritysketch,
    "op5_warc": warcfiles,
    "op6_quality": cascade,
    "op7_repeats": repeats,
    "op8_packing": packing,
    "op9_byte_bpe": bytebpe,
    "op10_url_rules": urlrules,
    "op11_merkle_manifest": merkle,
    "op12_filter_audit": filteraudit,
    "op13_graph_search": graphindex,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
CHECKS = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}

__all__ = ["CHECKS", "QUERIES"]
