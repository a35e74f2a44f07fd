"""Operators for preparing training corpora: mixing, deduplication, filters, tokens.

Nothing else in the library imports this subpackage.  ``queries()`` and
``oracle_sql()`` give its registered queries; ``__spark_entry__.py`` adds them.
"""

from __future__ import annotations


def queries() -> dict:
    from tablesmith.llm import registry
    return registry.queries()


def oracle_sql() -> dict[str, str]:
    from tablesmith.llm import registry
    return registry.oracle_sql()
