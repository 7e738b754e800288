"""The registered queries of the library's operators, and their SQL."""

from __future__ import annotations

from . import classify, evidence, keyed, ordered, records, search, structures, textual

QUERIES: dict = {}
ORACLE: dict = {}
for _module in (textual, keyed, ordered, classify, search, evidence, records, structures):
    for _name, (_query, _sql) in _module.TABLE.items():
        QUERIES[_name] = _query
        if _sql:
            ORACLE[_name] = _sql
