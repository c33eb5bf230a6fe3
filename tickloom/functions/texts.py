"""Keys, canonical JSON and content hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_key(name: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def canonical_json(entries: Column) -> Column:
    """A map as JSON text with its keys in order and no blanks, the same text for equal maps; null values stay."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))), {"ignoreNullFields": "false"})


def content_hash(text: Column) -> Column:
    """Bare lower-case hexadecimal SHA-256 of the text in UTF-8."""
    return F.sha2(text, 256)
