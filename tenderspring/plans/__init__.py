"""The registered queries. Importing this package registers them."""

from . import core, korean, search, workflow  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
