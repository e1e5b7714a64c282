"""The registered queries of the operators, and the SQL each must agree with where SQL can express it."""

from __future__ import annotations

from . import align, bpe, covertree, licenses, periods, pseudonyms, quotations, rans, repeats, setsketch, tiling, toxicity, warc  # noqa: F401
from .shared import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
