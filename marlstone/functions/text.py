"""Text functions on columns; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that a query may name, in the order of alternatives.
PATH_PATTERN = r"(?:^|\s)([\w./\-@]+\.(?:ts|tsx|js|jsx|py|md|go|rs))"


def _tokens(text: Column, kept: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{kept}]+"), F.lit(0))


def embed_tokens(text: Column) -> Column:
    """Runs of a-z0-9 of 2 to 40 characters, lower-cased."""
    return F.filter(_tokens(text, "a-z0-9"), lambda t: F.length(t).between(2, 40))


def bm25_tokens(text: Column) -> Column:
    """Runs of a-z0-9_, lower-cased."""
    return _tokens(text, "a-z0-9_")


def query_hash(query: Column) -> Column:
    return F.substring(F.sha2(query, 256), 1, 16)


def mentioned_path(query: Column) -> Column:
    """The first file path that a query mentions, else null."""
    return F.nullif(F.regexp_extract(query, PATH_PATTERN, 1), F.lit(""))


def token_estimate(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def embed_text(name: Column, kind: Column, content: Column) -> Column:
    """What of a chunk is embedded."""
    return F.concat(F.coalesce(name, kind), F.lit(" "), F.substring(content, 1, 512))
