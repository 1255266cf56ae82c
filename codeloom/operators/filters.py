"""The filter algebra of searches: one conjunction of include and exclude clauses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import all_of, any_of


def _many(value: object) -> list:
    return list(value) if isinstance(value, Sequence) and not isinstance(value, str) else [value]


def _has(matches: Column, values: list, category: str | None) -> Column:
    def test(m: Column) -> Column:
        hit = m["value"].isin(values)
        return hit & (m["category"] == category) if category else hit

    return F.exists(matches, test)


def build_predicate(filters: dict | None, columns: dict[str, str], dialect: str = "graph") -> Column:
    """The conjunction of all clauses in ``filters``; true without any.

    Keys: ``path_prefix``, ``language``, ``role``, ``category`` and ``exclude_`` with the
    last three. ``columns`` maps ``path``, ``language``, ``category`` and ``matches`` to column names; a
    key without a column is ignored, as are empty values. Prefixes are LIKE
    patterns with their final slash removed. An excluded value drops rows whose
    column is null, as SQL's NOT IN does. The ``hybrid`` dialect strips slashes at both ends
    of prefixes, takes a role from any category of match, and looks for categories in
    the column or in any match.
    """
    filters = {k: _many(v) for k, v in (filters or {}).items() if v}
    col = lambda k: F.col(columns[k])
    clauses: list[Column] = []
    hybrid = dialect == "hybrid"
    if "path_prefix" in filters and "path" in columns:
        clauses.append(any_of([col("path").like((p.strip("/") if hybrid else p.rstrip("/")) + "%") for p in filters["path_prefix"]]))
    if "language" in filters and "language" in columns:
        clauses.append(col("language").isin(filters["language"]))
    if "exclude_language" in filters and "language" in columns:
        clauses.append(~col("language").isin(filters["exclude_language"]))
    if "matches" in columns:
        role = None if hybrid else "role"
        if "role" in filters:
            clauses.append(_has(col("matches"), filters["role"], role))
        if "exclude_role" in filters:
            clauses.append(~_has(col("matches"), filters["exclude_role"], role))
    if "category" in columns:
        own = lambda v: col("category").isin(v) | F.exists(col("matches"), lambda m: m["category"].isin(v)) if hybrid else col("category").isin(v)
        if "category" in filters:
            clauses.append(own(filters["category"]))
        if "exclude_category" in filters:
            clauses.append(~own(filters["exclude_category"]))
    return all_of(clauses) if clauses else F.lit(True)
