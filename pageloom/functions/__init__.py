"""Expressions as Spark SQL text.

Every function takes SQL fragments (a column name, a literal, another expression) and returns one, for
``selectExpr`` and ``F.expr``. All of it stays inside the JVM, and a whole expression reaches the planner in
one call, however deep it is.
"""

from __future__ import annotations

from collections.abc import Iterable


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pattern(regex: str) -> str:
    """A regular expression literal, taken as written; quotes go in as hex escapes."""
    return "r'" + regex.replace("'", r"\x27") + "'"


def one_of(column: str, values: Iterable[str]) -> str:
    return f"{column} in ({', '.join(text(v) for v in values)})"


def text_array(values: Iterable[str]) -> str:
    return f"cast(array({', '.join(text(v) for v in values)}) as array<string>)"


def let(value: str, name: str, body: str) -> str:
    """Evaluate ``value`` once and use it under ``name`` several times in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"
