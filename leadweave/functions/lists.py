"""Small array helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from leadweave import fixed

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a bound variable."""
    return F.transform(F.array(value), lambda bound: body(bound)).getItem(0)


def let_sql(value: Col, body: str) -> Column:
    """Like :func:`let` with the body as SQL text ``x -> ...``; long bodies are built in one call that way."""
    return F.call_function("transform", F.array(col(value)), _parsed(body, id(SparkContext._gateway))).getItem(0)


@lru_cache(maxsize=64)
def _parsed(body: str, gateway: int) -> Column:
    """SQL text as a column, parsed once in a driver: some bodies hold long tables."""
    return F.expr(body)


def sql_text(value: str) -> str:
    """SQL string literal of any text."""
    plain = lambda c: c.isascii() and c.isprintable() and c not in "'\\"
    return "'" + "".join(c if plain(c) else (f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}") for c in value) + "'"


def empty_list() -> Column:
    return F.array().cast("array<string>")


def literals(values) -> Column:
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


_UNIQUE = f"""
x -> transform(array(filter(x, v -> trim(BOTH {sql_text(fixed.SPACE_CHARS)} FROM v) <> '')), vs ->
  CASE WHEN size(vs) < 2 OR size(array_distinct(transform(vs, v -> lower(v)))) = size(vs) THEN vs ELSE
    transform(
      sort_array(transform(
        transform(array(sort_array(transform(vs, (v, i) -> named_struct('k', lower(v), 'i', i, 'v', v)))),
                  s -> filter(s, (e, j) -> j = 0 OR get(s, j - 1).k <> e.k))[0],
        e -> named_struct('i', e.i, 'v', e.v))),
      e -> e.v)
  END)[0]
"""


def ordered_unique(values: Col) -> Column:
    """Unique ignoring case; the first spelling and its position win; blanks go.

    A list without repeats is found by hashing. One with repeats is sorted by (lowered value, position), so n values
    cost n log n.
    """
    return let_sql(values, _UNIQUE)
