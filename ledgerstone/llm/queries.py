"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

import importlib

#: name -> module that defines a function of that name
_WHERE = {
    "op1_vector_packing": "packing",
    "op2_pii": "pii",
    "op3_webp_columns": "media",
    "op4_simhash_bktree": "simhash",
    "op5_language_fusion": "language",
    "packed_conversations": "packing",
    "page_languages": "language",
    "op6_bpe_codec": "bpe_codec",
    "op7_html_lstm": "html_text",
    "op8_nn_descent": "ann",
    "op9_token_counts": "token_counts",
    "op10_ordinal_toxicity": "toxicity",
    "op11_vector_codes": "vector_codes",
    "op12_importance": "importance",
    "op13_minhash_join": "minhash_join",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in _WHERE.items()}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in dict.fromkeys(_WHERE.values()):
        out |= getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", {})
    return out
