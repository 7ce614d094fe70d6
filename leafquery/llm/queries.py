"""The registered queries of this subpackage, with production parameters, and the SQL that states their results."""

from __future__ import annotations

import importlib

#: Modules of this subpackage that register queries: QUERIES, and ORACLES where SQL can state the result.
MODULES = ["q_html", "q_minhash", "q_embedding", "q_sharding", "q_secrets", "q_fingerprint", "q_bitpack", "q_quality", "q_bpe", "q_packing"]

QUERIES, ORACLES = {}, {}
for _name in MODULES:
    _m = importlib.import_module(f"leafquery.llm.{_name}")
    QUERIES |= _m.QUERIES
    ORACLES |= getattr(_m, "ORACLES", {})
