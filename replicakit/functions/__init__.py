"""Catalyst expressions used by the operators (no Python UDFs)."""

from replicakit.functions.text import (
    canon_side,
    canon_side_col,
    checked_table_name,
    first_token,
    is_true,
    map_namespace,
    map_namespace_col,
)

__all__ = [
    "canon_side",
    "canon_side_col",
    "checked_table_name",
    "first_token",
    "is_true",
    "map_namespace",
    "map_namespace_col",
]
