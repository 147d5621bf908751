"""The plain text functions as SQL functions, so that SQL users need no Python worker."""

from __future__ import annotations

from pyspark.sql import SparkSession

from leadweave import fixed
from leadweave.functions.lists import sql_text
from leadweave.functions.text import EDGES, HANDLE_SHAPE, MAIL_DOMAIN


def _functions() -> dict[str, tuple[str, str]]:
    spaces = sql_text(fixed.SPACE_CHARS)
    edges, handle, domain = sql_text(EDGES), sql_text(HANDLE_SHAPE), sql_text(MAIL_DOMAIN)
    listed = {name: f"array({', '.join(map(sql_text, items))})" for name, items in (("tokens", fixed.NAME_TOKENS), ("ignored", fixed.IGNORED_WORDS))}
    token = f"get(filter({listed['tokens']}, t -> contains(n, t)), 0)"
    word = f"get(filter(split(n, '[ ._@-]+'), w -> NOT array_contains({listed['ignored']}, w) AND w RLIKE {sql_text(fixed.NAME_SUFFIX)}), 0)"
    reason = f"coalesce(concat('Slavic name token [', {token}, ']'), concat('Slavic surname suffix in [', {word}, ']'))"
    return {
        "name_reason": ("v STRING", f"get(transform(array(lower(trim(BOTH {spaces} FROM v))), n -> {reason}), 0)"),
        "trim_space": ("v STRING", f"trim(BOTH {spaces} FROM v)"),
        "clean_token": ("v STRING", f"regexp_replace(trim(BOTH {spaces} FROM v), {edges}, '')"),
        "normalize_handle": ("v STRING", f"trim(BOTH {spaces} FROM regexp_extract(trim(BOTH {spaces} FROM lower(v)), {handle}, 1))"),
        "mail_domain": ("v STRING", f"lower(regexp_extract(trim(BOTH {spaces} FROM v), {domain}, 1))"),
    }


def register(spark: SparkSession) -> list[str]:
    """Create the temporary SQL functions; returns their names."""
    for name, (params, body) in _functions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS STRING RETURN {body}")
    return list(_functions())
