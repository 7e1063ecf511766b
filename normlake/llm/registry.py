"""Queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from normlake.llm import op1_topk, op2_toxicity, op3_licenses, op4_simhash, op5_secrets, op6_pii, op7_mixing, op8_quality, op9_language, op10_decontaminate

_MODULES = (op1_topk, op2_toxicity, op3_licenses, op4_simhash, op5_secrets, op6_pii, op7_mixing, op8_quality, op9_language, op10_decontaminate)

QUERIES = {m.__name__.rpartition(".")[2]: getattr(m, m.__name__.rpartition(".")[2]) for m in _MODULES}
ORACLES = {m.__name__.rpartition(".")[2]: m.ORACLE for m in _MODULES if hasattr(m, "ORACLE")}
