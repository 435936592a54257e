"""The contract queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from parley.llm import decontaminate, dialogues, idfiles, langid, lattice, lexical, multiindex, packing, repeats, surrogates, topk, toxicity, triejoin

_MODULES = (triejoin, repeats, langid, toxicity, lattice, surrogates, decontaminate, packing, idfiles, topk, multiindex, dialogues, lexical)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
