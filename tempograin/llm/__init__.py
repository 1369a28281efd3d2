"""Operators for preparing text corpora for language-model training.

Nothing outside this subpackage imports it.  ``QUERIES`` and ``SQL`` hold what
the repository's entry module registers.
"""

from tempograin.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
