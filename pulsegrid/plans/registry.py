"""All registered queries and their SQL."""

from . import analytic, tabular  # noqa: F401
from .common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
