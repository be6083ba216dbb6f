"""Rules over a table's column names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_groups(columns: list[str], rules: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Columns to groups by ordered (group, pattern) rules: the first rule that fits claims a column, later ones don't see it.

    A column that no rule fits is in no group; a group without columns is left out.
    """
    groups: dict[str, list[str]] = {}
    for c in columns:
        if name := next((g for g, pattern in rules if re.search(pattern, c)), None):
            groups.setdefault(name, []).append(c)
    return groups


def reindex(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The columns of a contract in its order and types; a missing one is null, others go."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
