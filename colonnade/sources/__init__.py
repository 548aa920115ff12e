"""Table access."""

from colonnade.sources.tables import TABLES, read, register

__all__ = ["TABLES", "read", "register"]
